import time

from tessera.llm import html
from tessera.llm.common import table


def test_main_text_beside_an_article_is_kept():
    body = "".join(f"<p>{'sentence ' * 30}{i}</p>" for i in range(5))
    page = f"<nav>menu</nav><main>{body}<article><p>teaser</p></article></main><footer>f</footer>"
    want = [f"{'sentence ' * 30}{i}" for i in range(5)]
    assert html.main_text(page).split("\n") == [*want, "teaser"]
    assert html.main_text(f"<article>teaser</article><main>{body}</main><div>other</div>").split("\n") == ["teaser", *want]


LONG = "sentence " * 30


def without_windows(page):
    return "\n".join(html.weighed(html.lines_of(page))[0])


def test_windows_decide_on_pages_with_marks():
    """Lines beside the article that nothing marks go, as the windows over them stay low; a line of few letters inside stays."""
    inside = "".join(f"<p>{t}</p>" for t in ("Go.", LONG.strip(), "x", "y", "z", "w", "Ok."))
    page = f"<div>My site</div><div>Today is Monday</div><article>{inside}</article><div>All rights reserved by the owners of this very site since 1999</div><div>f1</div>"
    assert html.main_text(page).split("\n") == ["Go.", LONG.strip(), "x", "y", "z", "w", "Ok."]
    assert without_windows(page) != html.main_text(page)


def test_windows_decide_on_the_generated_pages(spark, small):
    pages = [r["html"] for r in table(spark, small, "pages").collect()]
    assert sum(without_windows(p) != html.main_text(p) for p in pages) > len(pages) // 2


def test_windows_decide_on_pages_without_marks():
    links = "".join(f"<div><a href=x>entry number {i}</a></div>" for i in range(4))
    page = f"<div>Site</div>{links}<p>{LONG}1</p><p>short</p><p>{LONG}2</p>{links}<div>(c) me</div>"
    assert html.main_text(page).split("\n") == [f"{LONG}1", "short", f"{LONG}2"]
    between = f"<p>{LONG}1</p>{links}<p>short</p>{links}<p>{LONG}2</p>"
    assert html.main_text(between).split("\n") == [f"{LONG}1", "short", f"{LONG}2"]


def test_what_is_marked_inside_the_text_makes_no_gap():
    ad = "<div class=ad>buy</div><form>name</form><nav>menu</nav>"
    assert html.main_text(f"<p>{LONG}1</p>{ad}{ad}<p>the end</p>").split("\n") == [f"{LONG}1", "the end"]


def test_marks_of_a_small_part_do_not_hide_the_text():
    body = "".join(f"<p>{LONG}{i}</p>" for i in range(5))
    want = [f"{LONG}{i}" for i in range(5)]
    assert html.main_text(f"<article>teaser</article>{body}").split("\n") == ["teaser", *want]


def test_elements_that_are_never_closed():
    assert html.main_text("<article><p>a <math><mi>x</mi><p>b").split("\n") == ["a x", "b"]
    for tag in ("object", "video", "select", "svg", "canvas"):
        assert html.main_text(f"<article><p>a</p><{tag}><p>b</p>").split("\n") == ["a", "b"]
        assert html.main_text(f"<article><p>a</p><{tag}>no</{tag}><p>b</p>").split("\n") == ["a", "b"]


def test_broken_pages_are_read_in_linear_time():
    n = 50_000
    pages = [
        "<article>" + "<span>" * n + "x" + "</section>" * n, "<i><div>" + "<span>" * n + "</i>" * n + "<p>x", "<video>" * n + "x", "<li><div>" * n + "x",
        "<p>" * n + "x" + "</a>" * n, "<ul><li>" * n + "x" + "</td>" * n, "<td><p><b>" * n + "x", "<article>" * n + "</p>" * n + "x", "<select><object>" * n + "x" + "</select>" * n,
    ]
    for page in pages:
        began = time.process_time()
        html.main_text(page)
        assert time.process_time() - began < 4, page[:40]
