import hashlib
import random

import pytest

from risingtide.llm.html import infer_wrappers, main_texts, parse
from risingtide.llm.tables import Scratch
from risingtide.llm.wrappers import _common, read
from risingtide.llm.warc import LoserTree, archived, capture_index, parse_records, read_archives, url_key, write_archives

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><nav><ul>{menu}</ul></nav>
<div class="page with-sidebar"><main><article class="post"><header><h1>Head {i}</h1></header>
<p>One   {i} <b>bo</b>ld&nbsp;&amp; x<br>y</p>{more}<ul><li>a{i}<li>b</ul><div class="ad-slot">Buy</div>
<form><input value=1><label>Name</label></form><table><tr><td>1<td>2{i}</table></article>
<section id="comments"><article class="comment"><p>reader {i}</p></article></section></main><aside>side</aside></div>
<footer>foot</footer><script>if(a<b){{x="</p>"}}</script></body></html>"""


def page(i):
    more = "".join(f"<h2>Sub {k}</h2><p>more {i} {k}</p>" for k in range(i % 3))
    menu = "".join(f"<li><a href='/{k}'>m{k}</a></li>" for k in range(i % 4 + 1))
    return PAGE.format(i=i, more=more, menu=menu)


def text_of(i):
    more = "".join(f"Sub {k} more {i} {k} " for k in range(i % 3))
    return f"Head {i} One {i} bold & x y {more}a{i} b 1 2{i}"


ODD = [None, "", "plain text only", "<div>no article <span>sp</span>an</div><nav>x</nav>", "<p>a<p>b<!-- c --><p>d < e",
       "<article>un<closed", "<article></article>", "<p>x</p>" * 3000]
ODD_TEXTS = ["", "", "plain text only", "no article span", "a b d < e", "un<closed", "", " ".join(["x"] * 3000)]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"https://a.example/{i}", page(i), "x", 1) for i in range(30)]
    rows += [(100 + i, "https://b.example/odd" if i % 2 else None, h, "x", 1) for i, h in enumerate(ODD)]
    rows += [(None, "http://[bad", page(3), None, None), rows[2], rows[2]]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper int").repartition(4).cache()


def test_main_texts(pages):
    found = main_texts(pages).collect()
    expected = {i: text_of(i) for i in range(30)} | {100 + i: t for i, t in enumerate(ODD_TEXTS)} | {None: text_of(3)}
    assert len(found) == 41
    for r in found:
        assert r["text"] == expected[r["page_id"]], r["page_id"]
        assert r["n_chars"] == len(r["text"])


def texts_of(spark, pages, columns="page_id long, url string, html string"):
    rows = [(i, f"https://c.example/{i}", h) for i, h in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in main_texts(spark.createDataFrame(rows, columns).coalesce(1)).collect()}


def test_texts_matched_to_another_sibling_are_kept(spark):
    inner = ["<h2>a</h2><p>b</p>", "<p>c <em>d</em> e</p>", "<p>f</p><h2>g</h2><p>h</p>"]
    expected = {0: "a b", 1: "c d e", 2: "f g h"}
    for tag in ("article", "div"):
        assert texts_of(spark, [f"<body><nav>n</nav><{tag}>{x}</{tag}></body>" for x in inner]) == expected


def test_copies_are_no_template(spark):
    one = "<body><h1>Head</h1><div><p>alone</p></div><ul><li>x</ul></body>"
    assert set(texts_of(spark, [one] * 3000).values()) == {"Head alone x"}
    # A structure that only the copies have, on a host with other pages; a line of all pages is template.
    other = "<body><h1>Head {i}</h1><p>text {i}</p><p>line <b>{i}</b></p><div>Made by us</div></body>"
    copy = "<body><h1>Head</h1><table><tr><td>cell</table><div>Made by us</div></body>"
    pages = [other.format(i=i) for i in range(12)] + [copy] * 40
    expected = [f"Head {i} text {i} line {i}" for i in range(12)] + ["Head cell"] * 40
    assert texts_of(spark, pages) == dict(enumerate(expected))
    # Pages of nothing but template texts keep them.
    bare = [f"<body><div>Made by us</div>{'<!-- -->' * i}<i>{'' if i else 'x'}</i></body>" for i in range(3)]
    assert texts_of(spark, [*pages[:12], *bare])[13] == "Made by us"


def test_marks_never_empty_an_article(spark):
    heads = ['article class="post has-sidebar"', 'article class="entry comments-open"', 'main class="search"', 'div class="post related"',
             'div class="page has-sidebar"']
    for head in heads:
        tag = head.split()[0]
        page = (f'<body><{head}><h2 id="related-work">Work</h2><p>p {{i}}</p><section id="discussion">said {{i}}</section>'
                f'<div class="search-results">found {{i}}</div><p class="notice">note {{i}}</p></{tag}></body>')
        expected = {i: f"Work p {i} said {i} found {i} note {i}" for i in range(3)}
        if "page" in head:  # no article here, where a class of its own is proof
            expected = {i: f"Work p {i} said {i} found {i}" for i in range(3)}
        assert texts_of(spark, [page.format(i=i) for i in range(3)]) == expected, head


def test_marks_with_support_are_left_out(spark):
    page = ('<body><article><p>p {i}</p><div class="related"><h3>More</h3><a href=1>one {i}</a></div>'
            '<div class="site-notice">All rights</div><div class="comments">reader {i}</div></article></body>')
    assert texts_of(spark, [page.format(i=i) for i in range(10)]) == {i: f"p {i}" for i in range(10)}


def test_wrappers_are_merged_in_rounds(pages, spark):
    scratch = Scratch(spark, "test")
    once = {r["host"]: r["wrapper"] for r in infer_wrappers(pages, scratch).collect()}
    more = {r["host"]: r["wrapper"] for r in infer_wrappers(pages.repartition(16), scratch, fanin=2).collect()}
    assert set(once) == set(more) and {"a.example", "b.example", ""} <= set(once)


def test_pages_of_nothing(pages):
    assert main_texts(pages.limit(0)).collect() == [] and archived(pages.limit(0)).collect() == []


def test_archives_round_trip(pages, spark):
    scratch = Scratch(spark, "test")
    rows = pages.collect()
    first = {}
    for r in rows:
        data = (r["html"] or "").encode()
        if len(data) >= 100 and r["page_id"] is not None:
            first[data] = min(first.get(data, r["page_id"]), r["page_id"])
    expected = []
    for r in rows:
        data = (r["html"] or "").encode()
        to = first.get(data) if len(data) >= 100 else None
        to = None if to == r["page_id"] else to
        expected.append((str(r["page_id"]), len(data), hashlib.sha256(data).hexdigest(), "revisit" if to is not None else "response", to))
    found = [(str(r["page_id"]), *r[1:]) for r in archived(pages).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    # Records lie where the index says.
    path = scratch.path("archives")
    write_archives(pages, path, scratch)
    captures = read_archives(spark, path, scratch)
    some = captures.where("page_id = 5").first()
    with open(some["run"].removeprefix("file:"), "rb") as file:
        data = file.read()[some["offset"]: some["offset"] + some["length"]]
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n") and page(5).encode() in data
    assert next(parse_records("x", data))[0] == 5
    # Parts of the index follow each other in order.
    index = capture_index(captures, scratch, range_rows=7)
    keys = [tuple(x or "" for x in r) for r in index.selectExpr("url_key", "captured", "input_file_name()").collect()]
    by_file = {}
    for key in keys:
        by_file.setdefault(key[2], []).append(key[:2])
    assert all(k == sorted(k) for k in by_file.values())
    spans = sorted((k[0], k[-1]) for k in by_file.values())
    assert len(spans) > 2 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_payloads_may_hold_record_ends(spark):
    odd = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 5
    rows = [(1, "http://x.example/\r\nX: y", odd), (2, "http://x.example/", odd), (3, "", "é" * 60)]
    found = archived(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found] == [
        ("response", None, len(odd)), ("revisit", 1, len(odd)), ("response", None, 120)]


def test_url_keys(spark):
    urls = ["https://User@Www.Example.com:80/A?b=1", "//x.y/z", "", None, "no host"]
    found = spark.createDataFrame([(u,) for u in urls], "url string").select(url_key("url")).collect()
    assert [r[0] for r in found] == ["com,example,www)/a?b=1", "y,x)/z", "", "", "no host)"]


def test_loser_tree():
    rng = random.Random(6)
    for k in range(0, 12):
        runs = [sorted(rng.randrange(30) for _ in range(rng.randrange(0, 9))) for _ in range(k)]
        assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_cut_off_tags_take_no_time(spark):
    starts = ['<a href="x">link</a> kept words here ' + tail for tail in (
        "<img " + " ".join(f'a{i}="v{i}"' for i in range(200)), "<img " + 'alt="" ' * 400, "<p " + '"' * 401, "<p class='" + "x " * 9000)]
    found = texts_of(spark, ["<html><body><article><p>First part.</p><p>" + s for s in starts])
    assert all("First part. link kept words here" in t and "alt" not in t and "v7" not in t for t in found.values())


def test_quotes_that_never_end_cost_their_tag_only(spark):
    html = '<html><body><article><p title="never ended>One.</p><p>Two words.</p></article></body></html>'
    assert "Two words." in texts_of(spark, [html])[0]


def test_large_and_negative_ids(spark):
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", "x" * 200) for i in (10**13, -5, 2**62, 0)], "page_id long, url string, html string")
    assert {r["page_id"]: r["refers_to"] for r in archived(pages).collect()} == {-5: None, 0: -5, 10**13: -5, 2**62: -5}


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 100_000 + "inmost text" + "</div>" * 50_000 + " after"
    wide = ["<body>" + "".join(f"<{k}{i}>{k}{i}</{k}{i}>" for i in range(20_000)) + "<p>end</p></body>" for k in ("x", "y")]
    open_ = "<p><b>" * 30_000 + "</i>" * 30_000 + "last"
    found = texts_of(spark, [deep, "<div>flat</div>", *wide, open_])
    assert found[0] == "inmost text after" and found[1] == "flat" and found[4] == "last"
    assert found[2] == " ".join(f"x{i}" for i in range(20_000)) + " end" and found[3].startswith("y0 y1 ")


def test_common_subsequences_are_longest():
    rng = random.Random(9)

    def longest(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
        return table[0][0]

    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 30))] for _ in range(2))
        pairs = _common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == longest(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_trees_are_stored_and_read():
    tree, _ = parse("<main class=x><p>one</p><p>two <b>three</b></p></main><ul><li>a<li>b</ul>")
    assert read(tree.plain()).plain() == tree.plain() and [n.key for n in tree.walk()][:3] == ["#root", "main+", "p"]
