"""Extraction: held-out pages, the blocks of odd markup."""

import html
import re
import time

import pytest

from ledgerline.llm import extract as X
from ledgerline.llm import queries as Q


@pytest.fixture(scope="module")
def model():
    return X.fit()


def test_held_out_pages(model):
    right = blocks = errors = 0
    for page, main in X.labelled_pages(150, 4242):
        found = model.blocks(page)
        y = X.labels(found, main)
        got = model.decode(found)
        blocks, errors = blocks + len(y), errors + sum(a != b for a, b in zip(got, y, strict=True))
        right += X.main_text(model, page) == "\n".join(main)
    assert right > 0.85 * 150 and errors < 0.01 * blocks


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in Q.op2_html_extraction(spark, sf).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>?", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?p>|</?h1>", inner)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("", []), ("plain", ["plain"]), ("<p>a<br>b  c</p>", ["a b c"]), ("<p>a<b>b</b>c<p>d", ["abc", "d"]), ("<script>if (a</b) '<p>x</p>'</script><p>y", ["y"]), ("<!-- <p>x --><p>y<!-- z", ["y"]), ("<p>&amp;lt; &eacute;&#233; &am", ["&lt; éé &am"]),
        ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("<p>x <b", ["x"]), ("a < b", ["a < b"]), ('<p title="a>b">x', ["x"]), ("<head><title>t</title></head>x", ["x"]), ("<STYLE>p{}</STYLE><P>x</P>", ["x"]), ("<table><tr><td>a<td>b</table>", ["a", "b"]),
        ('<a title="5" tall">x</a>y <i class=">">z', ["xy z"]), ('<p title="a>b', ["b"]), ("<p " + 'a="b" ' * 3000, []), ("<p " * 2000 + "x", []),
        ("<head><meta charset=utf-8><body><p>x</p></body>", ["x"]), ("<html><head><title>t</title><link rel=a><p>x", ["x"]), ("<head><title>t</title> \n x", ["x"]), ("<head><template><p>a</p></template><p>b", ["b"]), ("<head><title>t<body><p>x", ["t", "x"]),
        ("<p>a<svg><path><g><p>b</p>", ["a", "b"]), ("<svg><text>a</text><foreignObject><p>b</p></foreignObject></svg><p>c", ["c"]), ("<p>a<select><option>b<option>c<p>d", ["a", "d"]), ("<select><option>b</select>d", ["d"]), ("<svg><p>x<svg></svg>y", ["x", "y"]),
        ("<video src=a><p>b", ["b"]), ("<div><video src=a>no</div><p>b</video>", ["b"]), ("<noscript><p>a<p>b", ["a", "b"]), ("İ<SELECT><p>b", ["İ", "b"]), ("<ul><li><p>a<li><p>b</ul><dl><dt>c<dd>d<dt>e</dl>", ["a", "b", "c", "d", "e"]),
    ],
)
def test_blocks(page, blocks):
    assert [b[0] for b in X.leaf_blocks(page, X.Places())] == blocks


def test_end_tags_left_out(model):
    """An article is found whatever end tags are missing, and whatever hidden element is never closed."""
    prose = ["Theheer of the inan onth stre.", "Thing er onwh, reatly of ing and nd.", "Ionth eren was as it onan."]
    body = "<h1>Anwh onre</h1>" + "".join(f"<p>{x}" for x in prose)
    for before in ("<head><meta charset=utf-8>", "<html><head><title>t</title><body>", "<svg><g>", "<select><option>a", "<canvas>", "<iframe>", "<template>", "<object>", "<datalist><option>b"):
        for after in ("", "</article>", "</article></body></html>", "<footer>&copy; x"):
            assert X.main_text(model, f"{before}<nav><a href=a>b</a></nav><article>{body}{after}") == "\n".join(["Anwh onre", *prose]), (before, after)


@pytest.mark.parametrize("page", ["<div>x" * 50_000, "<div class=q{}>x", "<b>" * 50_000 + "<p>x" * 2000, "<li><p>x" * 20_000, "<svg>" * 50_000 + "x", "<select>" * 50_000, "</div>" * 50_000, "<title>" * 50_000, "<p><li>" * 30_000])
def test_time_is_linear(model, page):
    page = "".join(page.format(k) for k in range(50_000)) if "{}" in page else page
    began = time.perf_counter()
    X.main_text(model, page)
    assert time.perf_counter() - began < 2


def test_viterbi_is_exact(model):
    from itertools import product

    for page, _ in X.labelled_pages(30, 9):
        found = model.blocks(page)[:9]
        ids = model.ids(found)
        score = lambda y, ids=ids: sum(model.margin[f] for k, own in enumerate(ids) if y[k] for f in own) + sum(model.step[a, b] for a, b in zip(y[:-1], y[1:], strict=True))
        best = max(score(y) for y in product((0, 1), repeat=len(found)))
        assert abs(score(model.decode(found)) - best) < 1e-9


def test_odd_rows(spark):
    d = spark.createDataFrame([(1, None, None, "k", 1), (1, "u", "", "k", 1), (None, "u", "<p>", None, None), (2, "u", "<article><p>" + "word " * 200_000 + "</article>", "k", 1)], "page_id long, url string, html string, text string, n_chars int")
    got = X.extract(d).collect()
    assert [len(r["text"]) for r in got] == [0, 0, 0, 999_999] and [r["n_chars"] for r in got] == [0, 0, 0, 999_999]
    assert X.extract(d.limit(0)).count() == 0
