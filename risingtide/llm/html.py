"""Main text of web pages by wrappers inferred per host.

A page is a stream of tags and texts. Within a page, runs of siblings with the same
structure become one repeated group. Streams of the same host are aligned one after the
other: equal elements are merged, texts that differ become slots, and what only one side
has becomes an optional group, so a wrapper is a regular expression without unions.
Every task aligns the pages it reads into one wrapper per host; these are then aligned
with each other in groups of FANIN, in rounds, so no task sees all pages of a host.

A wrapper says which of its slots belong to the main text: those inside the article (or
the whole body on pages without one), outside of menus, headers, footers, sidebars,
notices, adverts, forms and comments. Outside of an article, a text that is the same on
all of many pages belongs to the template. Pages with the same texts count as one there,
however many copies there are, and a page that would lose all its texts so keeps them.
Each page is aligned with the wrapper of its host, and its texts in such places are
joined in page order. A text that the alignment matches to no slot, or to that of
another sibling, is kept if its own place is one of the main text.

Null and empty pages have an empty text. Pages without a host share one wrapper. Repeated
rows and repeated or null ids keep their own row. Extra columns are ignored. An empty
table gives an empty result. Pages may be of any length, and nested to any depth.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from risingtide.llm.tables import Scratch
from risingtide.llm.wrappers import Node, align, merge, read, skeleton

# Wrappers of one host that are aligned in one go, and hosts a task holds before it passes them on.
FANIN = 64
HOSTS_HELD = 2_000
# Wrappers that may be broadcast; with more hosts pages and wrappers are joined by a shuffle.
BROADCAST_HOSTS = 5_000

# How HTML elements behave.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "mark", "q", "ruby", "rb", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr", "label",
}
SKIPPED = {
    "head", "script", "style", "noscript", "template", "svg", "canvas", "iframe", "object", "embed", "audio", "video",
    "nav", "aside", "footer", "form", "button", "select", "textarea", "input", "dialog", "menu", "noembed", "noframes",
    "title", "map",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
MAIN = {"article", "main"}
TITLED = {"h1", "h2", "h3", "h4", "h5", "h6", "section"}
# Words of class and id that mark what is not the article. Inside of an article, or as a part of
# a compound, they only count where the wrapper shows links or texts that never change.
MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "sponsor", "sponsored",
    "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "submenu", "breadcrumb", "breadcrumbs",
    "masthead", "footer", "sidebar", "aside", "rail", "related", "recommended", "recommendations", "share", "sharing",
    "social", "comment", "comments", "commentlist", "respond", "disqus", "discussion", "replies", "reply", "cookie",
    "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
    "subscription", "signup", "login", "search", "searchbox", "toolbar", "pagination", "pager", "copyright", "skip",
    "skiplink", "tagcloud", "widget", "widgets", "paywall",
}
# Those of what readers write: it differs from page to page, as the article does.
COMMENTS = {"comment", "comments", "commentlist", "respond", "disqus"}
# Words that mark the article where no element of its own does.
BODIES = {"article", "post", "entry", "story", "articlebody", "maincontent"}
# An element of the first kind ends when one of the second begins.
_CLOSED_BY = {
    "p": {"p", "div", "section", "article", "ul", "ol", "dl", "table", "h1", "h2", "h3", "h4", "h5", "h6", "header",
          "footer", "nav", "aside", "form", "blockquote", "pre", "figure", "main", "hr", "address"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option"},
}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

HOST = r"^[ \t]*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
# Possessive, so a tag is read once: by its quotes, else, where they never end, up to the next
# ``>``, else, where the page is cut off behind one of its attributes, to the end.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+(?=>)|[^>]*+(?=>)|[^<>=]++=[^<>]*+(?=\Z))(?:>|\Z)"
    r"|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_MARK = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def _kind(tag: str, attributes: str) -> str:
    """``-`` for what is not the article, ``+`` for what marks it, else nothing.

    ``~`` is for a word of MARKS that is a class or id of its own, ``?`` for one that is
    only a part: what they say depends on the texts inside, see ``main_slots``.
    """
    if tag in ("html", "body"):
        return ""
    if tag in SKIPPED:
        return "-"
    if attributes.strip():
        if _HIDDEN.search(re.sub(r"(class|id)\s*=\s*(\"[^\"]*\"|'[^']*')", "", attributes)):
            return "-"
        whole, parts = set(), set()
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values)
            if name.lower() == "role":
                if value.lower() in ROLES:
                    return "-"
                if value.lower() == "main":
                    return "+"
            elif name.lower() in ("class", "id"):
                own = {re.sub(r"[-_]", "", w).lower() for w in value.split()}
                # The id of a heading or section names what it is about.
                if name.lower() == "id" and tag in TITLED:
                    own &= COMMENTS if tag == "section" else set()
                    value = ""
                whole |= own
                parts |= {w.lower() for w in _MARK.findall(value)}
        if tag == "main" or whole & BODIES:
            return "+"
        if whole & COMMENTS:
            return "-"
        if tag not in MAIN:
            if whole & MARKS:
                return "~"
            if parts & MARKS:
                return "?"
        if parts & BODIES:
            return "+"
    return "+" if tag in MAIN else ""


def parse(page: str) -> tuple[Node, list[tuple[str, Node | None]]]:
    """The tree of a page, and its texts in order with their nodes; a None marks the edge of a block."""
    root = Node("#root")
    stack, texts, at, end = [root], [], 0, len(page)
    opened: Counter[str] = Counter()

    def close(depth: int) -> None:
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]

    while at < end:
        token = _TOKEN.match(page, at)
        if token is None:  # an unclosed tag swallows the rest
            break
        at = token.end()
        closing, tag, attributes, text = token.groups()
        if text is not None:
            if not text.isspace():
                node = Node("#text", text=hash_text(text))
                stack[-1].children.append(node)
                texts.append((text, node))
            else:
                texts.append((" ", None))
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            texts.append((" ", None))
        if closing:
            if opened[tag] > 0:
                close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag))
            continue
        for open_ in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):
            if tag in _CLOSED_BY[open_] and opened[open_] > 0:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == open_:
                        close(depth)
                        break
                    if stack[depth].tag in _SCOPE.get(open_, ("body", "article", "section", "div", "td", "table")):
                        break
        node = Node(tag + _kind(tag, attributes or ""))
        stack[-1].children.append(node)
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}[\s>]", re.I).search(page, at)
            at = found.start() if found else end
        if tag not in VOID and not (attributes or "").endswith("/"):
            stack.append(node)
            opened[node.tag] += 1
    return root, texts


def hash_text(text: str) -> int:
    import zlib

    return zlib.crc32(" ".join(text.split()).encode("utf-8", "replace"))


def digest_of(texts: list[tuple[str, Node | None]]) -> int:
    """A hash of all texts of a parsed page, in order."""
    import hashlib

    said = ",".join(str(n.text) for _, n in texts if n is not None)
    return int.from_bytes(hashlib.blake2b(said.encode(), digest_size=7).digest(), "big")


def host_of(url: str | None) -> str:
    found = re.match(HOST, url or "", re.ASCII)
    return found[1].lower() if found else ""


def _not_article(node: Node) -> bool:
    return node.key[-1] in "-~" or node.tag == "header"


def _judge(tree: Node) -> None:
    """What the nodes hold, from the leaves up.

    ``frames``: an article of its own element inside, so a mark on it is the page's frame.
    ``unchanged``: all texts are links or never change; ``fixed``: over many different pages.
    ``marked``: a mark of the article inside, but for those in parts to leave out.
    """
    for node in reversed(list(tree.walk())):
        if node.key == "#text":
            node.unchanged = node.text is not None and not node.repeated
            node.fixed = node.unchanged and node.many
            continue
        link = node.tag == "a"
        node.unchanged = link or all(c.unchanged for c in node.children)
        node.fixed = link or all(c.fixed for c in node.children)
        node.frames = any(c.frames or c.tag in MAIN and c.key.endswith("+") for c in node.children)
        node.marked = any(
            c.marked or c.key.endswith("+") for c in node.children
            if c.frames or not (c.key[-1] in "-~" or c.key.endswith("?") and c.fixed)
        )


def main_slots(tree: Node, page: bool = False) -> None:
    """Mark the texts of a wrapper, or those of a page by its own elements alone.

    ``main`` are those of the article, ``body`` what a page without one keeps, but for
    the ``constant`` ones, which are the template's. ``surplus`` are the links and
    constant texts of a part with a mark that is no proof: one inside of an article, or a
    part of a compound. All texts of such a part must be of that kind.
    """

    _judge(tree)
    waiting = [(tree, True, False, False, False)]
    while waiting:
        node, in_body, in_article, surplus, in_link = waiting.pop()
        for child in node.children:
            link = in_link or child.tag == "a"
            if child.key == "#text":
                child.main, child.body, child.surplus = in_article, in_body, surplus
                child.constant = child.text is not None and not child.repeated and child.many
                if surplus and link:
                    child.text = None
            elif _not_article(child) and not (in_article and (child.tag == "header" or child.key.endswith("~"))):
                if child.tag not in SKIPPED and not in_article and child.frames:
                    waiting.append((child, False, in_article, surplus, link))
            else:
                doubted = not page and child.key[-1] in "~?" and not child.frames
                still = in_link or (child.fixed if child.key.endswith("?") else child.unchanged)
                waiting.append((child, in_body, in_article or child.key.endswith("+"), surplus or doubted and still, link))


def _pages_of(batches: Iterator[pa.RecordBatch], html_at: int, url_at: int):
    for batch in batches:
        for i, (url, page) in enumerate(zip(batch.column(url_at).to_pylist(), batch.column(html_at).to_pylist())):
            yield batch, i, host_of(url), page or ""


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url, html) to one wrapper per host and task."""
    held: dict[str, Node] = {}

    def passed() -> pa.RecordBatch:
        rows = [(h, json.dumps(w.plain())) for h, w in sorted(held.items())]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["host", "wrapper"])

    for _, _, host, page in _pages_of(batches, 1, 0):
        tree, texts = parse(page)
        digest = digest_of(texts)
        tree = skeleton(tree)
        tree.each_page(frozenset([digest]))
        held[host] = merge(held[host], tree) if host in held else tree
        if len(held) > HOSTS_HELD:
            yield passed()
    yield passed()


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    """The wrappers of one group of one host, aligned one after the other."""
    merged = None
    for said in sorted(group["wrapper"]):
        tree = read(json.loads(said))
        merged = tree if merged is None else merge(merged, tree)
    return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(merged.plain())]})


def infer_wrappers(pages: DataFrame, scratch: Scratch, fanin: int = FANIN) -> DataFrame:
    """``host`` and its ``wrapper`` as JSON: one row per host. ``pages`` has ``url`` and ``html``."""
    found = scratch.keep(pages.select("url", "html").mapInArrow(_induce, "host string, wrapper string"), "wrappers")
    while True:
        sizes = scratch.keep(found.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "sizes")
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return found
        salt = F.pmod(F.xxhash64("wrapper", F.lit(most)), F.ceil(F.col("n") / fanin))
        found = scratch.keep(
            found.join(sizes, "host").withColumn("salt", salt).groupBy("host", "salt")
            .applyInPandas(_joined, "host string, wrapper string"), "wrappers"
        )


def _kept(texts: list[tuple[str, Node | None]], flags: list[bool | int]) -> str:
    """The texts that the flags keep: a number is the hash of a template's text, left out where others remain."""

    def joined(keeps) -> str:
        return " ".join(entities.unescape("".join(
            t if n is None or keeps(t, flags[n.leaf()]) else " " for t, n in texts)).split())

    own = joined(lambda text, flag: flag if isinstance(flag, bool) else hash_text(text) != flag)
    return own or joined(lambda _, flag: flag is not False)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, wrapper) to (page_id, url, text)."""
    wrappers: dict[str, Node] = {}
    flags: dict[tuple[str, str], list[bool | int]] = {}
    for batch in batches:
        out = []
        for url, page, said in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            host = host_of(url)
            if host not in wrappers or len(wrappers) > HOSTS_HELD:
                wrappers.clear(), flags.clear()
                wrappers[host] = read(json.loads(said)) if said else Node("#root")
                main_slots(wrappers[host])
            root, texts = parse(page or "")
            shape = skeleton(root)
            leaves = shape.number_texts()
            key = (host, shape.shape())
            if key not in flags:
                if len(flags) > 10 * HOSTS_HELD:
                    flags.clear()
                main_slots(shape, page=True)
                flags[key] = align(wrappers[host], shape, leaves, shape.marked)
            out.append(_kept(texts, flags[key]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars``: one row per row of ``pages``."""
    scratch = Scratch(pages.sparkSession, "html")
    pages = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    wrappers = infer_wrappers(pages, scratch)
    few = wrappers.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    host = F.lower(F.regexp_extract("url", HOST, 1))
    with_wrapper = pages.withColumn("host", F.coalesce(host, F.lit(""))).join(
        F.broadcast(wrappers) if few else wrappers, "host", "left").select("page_id", "url", "html", "wrapper")
    texts = scratch.keep(with_wrapper.mapInArrow(_extract, "page_id long, url string, text string"), "texts")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
