"""Main text of pages with the markup of real sites."""

import pytest
from pyspark.sql import functions as F

from privtab.llm import html_text

WORDS = "words of a sentence that goes on for a while and then ends with a stop"
EVEN = [f"Paragraph {i} has {WORDS}. It has {WORDS}." for i in range(6)]


def p(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


@pytest.mark.parametrize("name", """comment-list comments-area comment-form ad-container advert-box ad-slot adsbygoogle
    cookie-notice-bar newsletter-box related-posts share-buttons nav-wrapper adContainer commentList widget_related
    site-search social-links""".split())
@pytest.mark.parametrize("place", ["inside", "after"])
def test_named_parts_go(name, place):
    part = f'<div class="x {name}"><h3>More of it</h3><p>{EVEN[5]}</p><p>One more thing to read here, it is said.</p></div>'
    body = p(*EVEN[:3]) + part * (place == "inside") + p(*EVEN[3:5])
    page = f"<html><body><article><h1>Head</h1>{body}</article>{part * (place == 'after')}</body></html>"
    assert html_text.main_text(page) == "\n".join(["Head", *EVEN[:5]])


@pytest.mark.parametrize("name", ["has-sidebar", "no-comments", "with-banner", "search-result", "entry-header", "post-header"])
def test_parts_of_the_text_stay(name):
    page = f'<body><div id=wrap><div class="{name}"><h1>Head</h1>{p(*EVEN[:1])}</div>{p(*EVEN[1:5])}</div><nav><a href=x>M</a></nav></body>'
    assert html_text.main_text(page) == "\n".join(["Head", *EVEN[:5]])


def test_comments_as_articles_go():
    comments = "".join(f'<article class="comment"><p>{t}</p></article>' for t in EVEN[3:])
    for page in (f"<article><h1>H</h1>{p(*EVEN[:3])}{comments}</article>", f"<article><h1>H</h1>{p(*EVEN[:3])}</article>{comments}"):
        assert html_text.main_text(page) == "\n".join(["H", *EVEN[:3]])


def test_article_by_the_content_it_holds():
    teaser = "A teaser " + "that goes on and on " * 60
    page = (f"<main><article>{p(*EVEN[:5])}</article><section><h2>More</h2><article><p>{teaser}</p></article></section></main>")
    long = html_text.main_text(page.replace(teaser, teaser[:300]))
    assert long == "\n".join(EVEN[:5])
    one = "One long line " * 40
    page = f"<main><article>{p(*EVEN)}</article><section><h2>More</h2><article><p>{one}</p></article></section></main>"
    assert html_text.main_text(page) == "\n".join(EVEN)


def test_prose_outside_of_articles():
    page = f"<main><h1>H</h1>{p(*EVEN)}<article><h2>See also</h2><p>A short note on it.</p></article></main>"
    assert html_text.main_text(page).startswith("\n".join(["H", *EVEN]))


@pytest.mark.parametrize("times", [1, 4, 12])
def test_one_long_line_is_not_the_only_content(times):
    last = EVEN[5] * times
    page = f"<body><div>{p(*EVEN[:3])}</div><div>{p(*EVEN[3:5], last)}</div><div><a href=x>a</a> <a href=y>b</a></div></body>"
    assert html_text.main_text(page).split("\n")[:6] == [*EVEN[:5], last]


def test_awkward_pages_and_clashing_columns(spark):
    rows = [(1, "u", f"<article>{p(*EVEN)}</article>"), (1, "u", f"<article>{p(*EVEN)}</article>"), (None, None, None), (3, "", ""),
            (4, "v", "<article><p>" + "long &amp; text <b>of</b> it " * 200_000 + "</p></article>"), (5, "w", "<" * 50), (6, "x", "\x00<p>a\x00b")]
    named = spark.createDataFrame([(*r, "mine", 7, "c") for r in rows],
                                  "page_id long, url string, html string, text string, n_chars int, carry string")
    got = html_text.extract_pages(named, carry=("url", "text", "n_chars")).orderBy(F.col("page_id")).collect()
    assert [r.page_id for r in got] == [None, 1, 1, 3, 4, 5, 6]
    assert got[0].text == got[3].text == "" and got[1].text == got[2].text == "\n".join(EVEN)
    assert got[4].text == ("long & text of it " * 200_000).strip() and got[4].n_chars == len(got[4].text)
    assert all(r.carry.text == "mine" and r.carry.n_chars == 7 for r in got)
