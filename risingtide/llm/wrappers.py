"""Trees of HTML elements, and their alignment into union-free regular expressions.

Trees may be of any depth and width: nothing recurses, and siblings are aligned in memory
of the order of their number times its square root, in bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import isqrt

# Longest run of siblings that is looked for as a repeated group.
PERIOD = 4
# A text that never changes counts as part of the template on a host with so many different pages.
TEMPLATE_PAGES = 8


class Node:
    """An element, a text, or a group of siblings that repeats.

    ``key`` tells elements apart. ``text`` is the hash of a text, None for a slot.
    ``repeated`` and ``optional`` are the marks of the regular expression; ``pages``
    are the digests of the different pages that have the node, TEMPLATE_PAGES at most:
    copies of a page are one, and which of more are held does not matter.
    """

    __slots__ = ("key", "children", "text", "repeated", "optional", "pages", "main", "body", "constant", "surplus", "into", "number",
                 "frames", "fixed", "unchanged", "marked")

    def __init__(self, key: str, children: list[Node] | None = None, text: int | None = None):
        self.key, self.children, self.text = key, children if children is not None else [], text
        self.repeated = self.optional = self.main = self.body = self.constant = self.surplus = False
        self.frames = self.fixed = self.unchanged = self.marked = False
        self.pages, self.into, self.number = frozenset(), None, -1

    @property
    def tag(self) -> str:
        return self.key.rstrip("+-~?")

    def walk(self) -> Iterator[Node]:
        """All nodes of the tree, each before its children, in page order."""
        waiting = [self]
        while waiting:
            node = waiting.pop()
            yield node
            waiting.extend(reversed(node.children))

    def plain(self) -> list:
        """The nodes in the order of ``walk``, each with the number of its children."""
        return [[n.key, int(n.repeated) + 2 * int(n.optional), sorted(n.pages), n.text, len(n.children)] for n in self.walk()]

    @property
    def many(self) -> bool:
        return len(self.pages) >= TEMPLATE_PAGES

    def each_page(self, pages: frozenset[int]) -> None:
        for node in self.walk():
            node.pages = pages

    def shape(self) -> str:
        return " ".join(f"{n.key}{'*' if n.repeated else ''} {len(n.children)}" for n in self.walk())

    def texts(self) -> list[Node]:
        return [n for n in self.walk() if n.key == "#text"]

    def number_texts(self) -> list[Node]:
        found = self.texts()
        for i, node in enumerate(found):
            node.number = i
        return found

    def leaf(self) -> int:
        """The number of the text that this one was merged into."""
        node = self
        while node.into is not None:
            node = node.into
        return node.number


def read(plain: list) -> Node:
    root, unfinished = None, []
    for key, marks, pages, text, n in plain:
        node = Node(key, None, text)
        node.repeated, node.optional, node.pages = bool(marks & 1), bool(marks & 2), frozenset(pages)
        if unfinished:
            parent = unfinished[-1]
            parent[0].children.append(node)
            parent[1] -= 1
            if not parent[1]:
                unfinished.pop()
        else:
            root = node
        if n:
            unfinished.append([node, n])
    return root


def merge(one: Node, other: Node) -> Node:
    """``one`` after ``other``, of the same key, was aligned with it."""
    pairs = [(one, other)]
    while pairs:
        left, right = pairs.pop()
        right.into = left
        if left.text != right.text:
            left.text = None
        left.repeated |= right.repeated
        left.optional |= right.optional
        if not left.many and left.pages != right.pages:
            left.pages = frozenset(sorted(left.pages | right.pages)[:TEMPLATE_PAGES])
        left.children = _aligned(left.children, right.children, pairs)
    return one


def _aligned(left: list[Node], right: list[Node], pairs: list[tuple[Node, Node]]) -> list[Node]:
    """One sequence that both match: the common elements, which ``pairs`` gets to merge, the others optional."""
    if [n.key for n in left] == [n.key for n in right]:
        pairs.extend(zip(left, right))
        return left
    out, i, j = [], 0, 0
    for a, b in _common([n.key for n in left], [n.key for n in right]):
        for node in (*left[i:a], *right[j:b]):
            node.optional = True
            out.append(node)
        pairs.append((left[a], right[b]))
        out.append(left[a])
        i, j = a + 1, b + 1
    for node in (*left[i:], *right[j:]):
        node.optional = True
        out.append(node)
    return out


def _common(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of places; equal ends are taken first."""
    first = 0
    while first < min(len(left), len(right)) and left[first] == right[first]:
        first += 1
    last = 0
    while last < min(len(left), len(right)) - first and left[-1 - last] == right[-1 - last]:
        last += 1
    a, b = left[first: len(left) - last], right[first: len(right) - last]
    found, i, j = [(k, k) for k in range(first)], 0, 0
    rows = _Suffixes(a, b)
    length = rows.length(0, 0) if a and b else 0
    while length:
        if a[i] == b[j]:
            found.append((first + i, first + j))
            i, j, length = i + 1, j + 1, length - 1
        elif rows.length(i + 1, j) == length:
            i += 1
        else:
            j += 1
    return found + [(len(left) - last + k, len(right) - last + k) for k in range(last)]


class _Suffixes:
    """Lengths of the longest common subsequences of all ends of two sequences.

    A row of the table is one number, a bit for each place of ``b``, counted from its end:
    zero where the length grows. Every so many rows one is held; the others are worked out
    again from it, a block at a time.
    """

    def __init__(self, a: list[str], b: list[str]):
        self.back, self.width, self.places = a[::-1], len(b), {}
        for k, key in enumerate(reversed(b)):
            self.places[key] = self.places.get(key, 0) | 1 << k
        self.full = (1 << len(b)) - 1
        self.step = isqrt(len(a)) + 1
        self.held = [self.full]
        for first in range(0, len(a), self.step):
            *_, row = self._rows(first)
            self.held.append(row)
        self.block, self.rows = -1, []

    def _rows(self, first: int) -> Iterator[int]:
        return accumulate(self.back[first: first + self.step], self._next, initial=self.held[first // self.step])

    def _next(self, row: int, key: str) -> int:
        grown = row & self.places.get(key, 0)
        return (row + grown | row - grown) & self.full

    def length(self, i: int, j: int) -> int:
        """That of ``a`` from ``i`` on and ``b`` from ``j`` on."""
        block, place = divmod(len(self.back) - i, self.step)
        if block != self.block:
            self.block, self.rows = block, list(self._rows(block * self.step)) if block * self.step < len(self.back) else [self.held[block]]
        rest = self.width - j
        return rest - (self.rows[place] & (1 << rest) - 1).bit_count()


def skeleton(root: Node) -> Node:
    """The tree with repeated siblings as one; texts next to each other count as such."""
    for node in reversed(list(root.walk())):
        kids, period = node.children, 1
        while 2 * period <= len(kids) and period <= PERIOD:
            kids, changed = _folded(kids, period)
            period = 1 if changed and period > 1 else period + 1
        node.children = kids
    return root


def _folded(kids: list[Node], period: int) -> tuple[list[Node], bool]:
    """Neighbouring runs of ``period`` siblings with the same keys made one repeated run."""
    if len(kids) < 2 * period:
        return kids, False
    out, i, changed, keys = [], 0, False, [n.key for n in kids]
    while i < len(kids):
        run, j = kids[i: i + period], i + period
        while len(run) == period and keys[j: j + period] == keys[i: i + period]:
            for a, b in zip(run, kids[j: j + period]):
                merge(a, b)
                a.repeated = True
            j, changed = j + period, True
        if j > i + period:
            out.extend(run)
            i = j
        else:
            out.append(kids[i])
            i += 1
    return out, changed


def align(wrapper: Node, page: Node, leaves: list[Node], has_article: bool) -> list[bool | int]:
    """For each of the page's texts whether it is main text, or the hash of the template text that it must differ from.

    The page's own elements decide, so a text is kept or left out whatever sibling of
    its element the wrapper's slot was merged from. The wrapper only adds which texts
    are the template's.
    """
    flags: list[bool | int] = [n.main if has_article else n.body for n in leaves]

    waiting = [(wrapper, page)]
    while waiting:
        outer, inner = waiting.pop()
        for a, b in _common([n.key for n in outer.children], [n.key for n in inner.children]):
            slot, own = outer.children[a], inner.children[b]
            if own.key != "#text":
                waiting.append((slot, own))
            elif flags[own.number]:
                if slot.surplus and slot.text is None:
                    flags[own.number] = False
                elif slot.surplus or slot.constant and not has_article:
                    flags[own.number] = slot.text
    return flags
