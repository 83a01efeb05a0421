import html as lib
import re

from tessera.llm import html
from tessera.llm.common import table
from tessera.llm.queries import op10_html_extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) x("</p>")</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=x>menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Head &amp; more</h1></header><p>One&nbsp;two<p>Three <b>bold</b>ly <a href=x>link</a>
<ul><li>i1<li>i2</ul><div class="ad">buy</div><form>name<input></form><p>a &lt;b&gt; 3 < 4</p><pre>x
 y</pre><section id="comments"><article class="comment"><p>nice</p></article></section></article>
<aside>side</aside></main><footer>f</footer></body></html>"""


def plain(page):
    """The article of a generated page, by its known shape."""
    start = page.index("<article>") + 9
    end = page.find("</article>")
    end = page.find("<footer>") if end < 0 else end
    blocks = re.split(r"</?(?:p|h1)\b[^>]*>", page[start:end].replace("<br>", " "))
    blocks = [" ".join(lib.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_table_against_known_shape(spark, small):
    pages = {r["page_id"]: r for r in table(spark, small, "pages").collect()}
    rows = op10_html_extraction(spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == plain(pages[r["page_id"]]["html"])
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_a_page_with_everything():
    assert html.main_text(PAGE) == "Head & more\nOne two\nThree boldly link\ni1\ni2\na <b> 3 < 4\nx y"


def test_without_an_article_text_surges_between_menus():
    menu = "".join(f'<div><a href="{i}">entry {i}</a></div>' for i in range(20))
    body = "".join(f"<p>{'sentence ' * 30}{i}</p>" for i in range(5))
    assert html.main_text(menu + body + menu) == "\n".join(f"{'sentence ' * 30}{i}" for i in range(5))


def test_broken_markup():
    assert html.main_text("") == ""
    assert html.main_text("plain") == "plain"
    assert html.main_text('<div class="ad">x<article>foo</article>') == "foo"
    assert html.main_text("<article><p>a<!-- b") == "a"
    assert html.main_text("<article><p>a</i></b></div> b") == "a\nb"
    assert html.main_text('<article><p title="x>y">a <b') == "a"
    assert html.main_text("<article><script>x") == ""
    assert html.main_text("<article>" + "<div>" * 5000 + "deep" + "<p>x " * 20000) != ""


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "k"), (None, "<article>a</article>", None), (2, "", "k"), (2, "", "k")]
    out = html.extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in out) == [(0, "a"), (1, ""), (2, ""), (2, "")]
    assert html.extract(spark.createDataFrame([], "html string")).count() == 0
