"""Main text of pages: held-out generated layouts, planted pages, the parser's hard cases."""

import numpy as np
import pytest

from inboxlake.llm import dom, html_extract, layouts

PAGE = ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<header class='site-header'><a href='/'>Site name</a></header>"
        "<nav><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li><li><a href='/c'>Three</a></li></ul></nav>"
        "<div class='cookie-banner'><p>We use cookies to make this site better for you.</p><button>Ok</button></div>"
        "<!-- ad 3 --><div class='ad'>Buy one now and get another one for free.</div>"
        "<article><h1>A  headline &amp; more</h1><p>First paragraph, with a <a href='/x'>link</a> and\n some "
        "<b>bold</b> words. It goes on for a while.<p>Second one &lt;here&gt;, never closed.<ul><li>an item of a list</li>"
        "<li>another item</li></ul><p>The last words of it.</p></article>"
        "<aside class='sidebar'><h3>More</h3><ul><li><a href='/d'>Read this</a></li></ul></aside>"
        "<section class='comments'><h2>Comments</h2><div class='comment'><p>I liked it. Thank you very much.</p></div>"
        "<div class='comment'><p>So did I, and my friends did too.</p></div></section>"
        "<form class='newsletter'><label>Mail</label><input name='m'><button>Go</button></form>"
        "<footer>&copy; example.org &middot; All rights.</footer></body></html>")
TEXT = ("A headline & more\nFirst paragraph, with a link and some bold words. It goes on for a while.\n"
        "Second one <here>, never closed.\nan item of a list\nanother item\nThe last words of it.")


@pytest.fixture(scope="module")
def trees(spark):
    return html_extract.fit(spark)


def test_held_out_layouts(trees):
    nodes = dom.Nodes([dom.parse(layouts.labelled_page(i)) for i in range(1_000_000, 1_000_300)])
    keep = html_extract.decode(nodes, trees.log_odds(nodes.features))
    runs = nodes.group == dom.TEXT_RUN
    want, got = nodes.labels[runs] > 0, keep[runs]
    assert (want & got).sum() / got.sum() > 0.95 and (want & got).sum() / want.sum() > 0.95
    parent = nodes.parent[keep]
    assert keep[parent[parent >= 0]].all()  # no node without its ancestors
    inner = np.flatnonzero(keep & ~runs)
    held = np.zeros(len(keep), bool)
    held[nodes.parent[keep & (nodes.parent >= 0)]] = True
    assert held[inner].all()  # and no element without anything below


S = "The committee met on Tuesday to discuss the new budget, which had been delayed twice. Members wanted more time."
LAYOUTS = {
    "divs": ("<div id='header'><a href='/'>My Site</a> The best site</div><div id='menu'><a href=1>Home</a><a href=2>News</a>"
             f"</div><div id='content'><h1>Delayed again</h1><p>{S}</p><p>{S}</p></div><div id='sidebar'><h3>Latest</h3><ul><li>"
             "<a href=x>One story</a></ul></div><div id='comments'><div class='comment'><p>I think this is wrong, really.</p>"
             "</div></div><div id='footer'>Copyright 2020. All rights reserved.</div>", f"Delayed again\n{S}\n{S}"),
    "no attributes": ("<div><a href='/'>My Site</a></div><div><a href=1>Home</a> <a href=2>News</a> <a href=3>About</a></div>"
                      f"<div><h1>Delayed again</h1><p>{S}</p><p>{S}</p><p>{S}</p></div>"
                      "<div><a href=4>Privacy</a> &copy; 2020</div>", f"Delayed again\n{S}\n{S}\n{S}"),
    "parts within": (f"<nav><a href=1>Home</a></nav><article><h1>T</h1><p>{S}</p><div class='newsletter'><p>Sign up for our "
                     f"newsletter and never miss a story.</p><form><input></form></div><p>{S}</p><div class='ad'><p>Cheap flights,"
                     f" book today.</p></div><p>{S}</p></article><div class='cookie-notice'>This site uses cookies.</div>",
                     f"T\n{S}\n{S}\n{S}"),
    "paragraphs alone": (f"<p>{S}</p><p>{S}</p>", f"{S}\n{S}"), "text alone": (S, S)}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts_written_by_hand(trees, layout):
    page, text = LAYOUTS[layout]
    assert html_extract.main_texts([f"<html><body>{page}</body></html>"], trees) == [text]


def test_extracts_rows(spark, trees):
    long_page = PAGE.replace("The last words of it.", "The last words of it. " * 20_000)
    long_text = TEXT.replace("The last words of it.", ("The last words of it. " * 20_000).strip())
    rows = [(1, "u1", PAGE), (1, "u1", PAGE), (2, None, None), (3, "u3", ""), (None, "u4", PAGE), (5, "u5", "  \n "),
            (6, "u6", "<" * 5000), (7, "u7", '<a title="' * 3000), (8, "u8", "<div>" * 3000 + "x" + "</div>" * 3000),
            (9, "u9", long_page), (10, "u10", "<script>never closed " * 100), (11, "u11", "&#x41; &nosuch; &amp")]
    schema = "page_id long, url string, html string, text int, n_chars string, features double"
    got = html_extract.extract(spark.createDataFrame([(*r, 1, "x", 0.0) for r in rows], schema).repartition(3), trees)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(got.collect(), key=lambda r: (r.page_id or 0, r.url or ""))
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by_url = {r.url: r.text for r in got}
    assert by_url["u1"] == by_url["u4"] == TEXT
    assert by_url["u9"] == long_text
    assert by_url[None] == by_url["u3"] == by_url["u5"] == by_url["u10"] == ""
    empty = spark.createDataFrame([], schema)
    assert html_extract.extract(empty, trees).collect() == []


def runs(page):
    return [t for t in dom.parse(page).texts if t is not None]


@pytest.mark.parametrize("page, texts", [
    ("a<br>b<p>c<p>d</p>e", ["a b", "c", "d", "e"]),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>d", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("x<script>if (a<b) '</p>'</script>y<style>p{}</style>z<!-- no --><b>!</b>", ["xyz!"]),
    ("a &lt;b&gt; &amp;amp; &copy;&nbsp;c &am", ["a <b> &amp; © c &am"]),
    ("1 < 2 and 3 > 2</p><div data-x='>'>q</div></nosuch>r", ["1 < 2 and 3 > 2", "q", "r"]),
    ("<head><title>t</title>", []), ("<head><title>t</title><body>b", ["b"]), ("</", []), ("a</p", ["a"]),
    ("<template><p>no</p></template><svg><text>no</text></svg><select><option>no</select>yes", ["yes"]),
    ("<p title='a > b'>c</p>", ["c"])])
def test_parses(page, texts):
    assert runs(page) == texts


def test_parser_is_linear():
    for piece in ("<", "<a b='", '<a ="', "<!--", "<p", "</", "&", "<b><p>"):
        page = piece * 60_000
        dom.parse(page)


def test_levels_and_labels():
    nodes = dom.Nodes([dom.parse(f"<div>x<p {dom.LABEL}=\"1\">y</p></div>"), dom.parse(""), dom.parse("z")])
    assert nodes.depth.tolist() == [0, 1, 2, 2, 3, 0, 0, 1]
    assert nodes.labels.tolist() == [1, 1, 0, 1, 1, 0, 0, 0]
    assert nodes.page.tolist() == [0] * 5 + [1] + [2] * 2
    assert nodes.features.shape == (len(dom.FEATURES), 8) and dom.Nodes([]).features.shape[1] == 0
