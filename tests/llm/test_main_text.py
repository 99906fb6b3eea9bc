"""Main text of pages: the article of every given page, odd markup, missing values, linear time."""

import html
import re
import time

import numpy as np
from pyspark.sql import functions as F

from scoreframe.llm import main_text
from scoreframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
LONG = "This paragraph has a good many words, so that it is a real one of an article's text."


def test_every_page_gives_its_article(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = QUERIES["op11_html_extraction"](spark, FOLDER).collect()
    assert len(got) == len(pages)
    for row in got:
        article = re.search(r"<article>(.*?)</article>", pages[row.page_id].html, re.DOTALL).group(1)
        blocks = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", article))
        assert row.text == " ".join(" ".join(html.unescape(x) for x in blocks).split())
        assert row.n_chars == len(row.text) and row.url == pages[row.page_id].url


def test_a_page_without_an_article_element():
    page = f"""<html><body class="has-sidebar"><header><h1>Site</h1></header>
      <div class="cookie-notice">We use cookies, and here is a long text that says so with many words.</div>
      <nav>Home News</nav><div id="main"><h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG} &amp; &lt;b&gt;</p>
      <ul><li><a href=x>one link</a><li><a href=y>another link</a></ul><p>foo<b>bar</b>\n {LONG}</p></div>
      <div id="comments"><p>{LONG}</p></div><aside>{LONG}</aside><form>{LONG}</form><footer>{LONG}</footer>"""
    assert main_text.main_text(page) == f"Title {LONG} Short. {LONG} & <b> foobar {LONG}"


def test_elements_that_are_never_text_and_those_around_articles():
    cases = {
        f"<form><article><p>{LONG}</p></article></form>": LONG,
        f"<nav>menu<main><p>{LONG}</p></main>": LONG,
        f"<aside><article><p>{LONG}</p></article></aside>": "",
        f"<article><header><h1>Head</h1></header><p>{LONG}</p><div class=comments><article>{LONG}</article></div></article>": f"Head {LONG}",
        f"<article><p>{LONG}<script>var t='</p>'</script> end<style>p</style></p></article>": f"{LONG} end",
        f"<main><p hidden>{LONG}</p><p style='display: none'>no</p><div role=alert>no</div><p>{LONG}</p></main>": LONG,
        "<article><h1>A b.</h1><p><b>A b.<br></article><footer>A longer line of text than the article has</footer>": "A b. A b.",
        "<p>x<span class=ad>buy</span>y<wbr>z": "xyz",
    }
    for page, text in cases.items():
        assert main_text.main_text(page) == text, page


def test_broken_markup_is_read_on_and_in_linear_time():
    cases = {
        "": "", "plain  text": "plain text", "<p>a<!-- b <p>c": "a b c", "<!-->x<!--->y": "xy", "<![foo[ z ]]>a": "a",
        "<!doctype html><p>q": "q", "x<a href='": "x", "<p>a<a href=\"x>b</p>c": "ab c", "a < b & c > d &nbsp; &#xD800;": "a < b & c > d �",
        "</p>a</div></nav>b": "a b", "<script>never ends <p>a": "", "<ul><li>one<li>two": "one two",
    }
    for page, text in cases.items():
        assert main_text.main_text(page) == text, page
    begin = time.perf_counter()
    for piece in ("<div>", "<a ", '<a x="', "</a ", "</", "<?a ", "<!", "<![ ", "<!-- a <p>", "&#", "<li>", "<nav><article>", "</article>"):
        main_text.main_text(piece * 100_000)
    assert len(main_text.main_text("<p>" + "word " * 1_000_000)) == 4_999_999
    assert time.perf_counter() - begin < 60


def test_smoothing_and_threshold_as_by_hand():
    ratios = np.array([1.0, 5.0, 2.0])
    weight = lambda d: np.exp(-d * d / 2)
    want = [sum(weight(i - j) * r for j, r in enumerate(ratios)) / sum(weight(i - j) for j in range(3)) for i in range(3)]
    assert np.allclose(main_text.smoothed(ratios), want)
    rng = np.random.default_rng(3)
    for _ in range(50):
        x = np.sort(rng.random(rng.integers(2, 12)) * 9)
        cut = main_text.threshold(x)
        if x[-1] - x[0] < main_text.SAME:
            assert cut == -np.inf
            continue
        inside = [x[:i].var() * i + x[i:].var() * (len(x) - i) for i in range(1, len(x))]
        assert cut == x[1 + int(np.argmin(inside))]


def test_missing_values_repeats_and_other_columns(spark):
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>a", "t"), (2, "u", "", "t"), (3, "v", "<p>" + "long " * 200_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0), r.url, r.n_chars) for r in main_text.extracted(pages).collect() if r.url)
    assert got == [(1, "u", 0), (1, "u", 0), (2, "u", 0), (3, "v", 999_999)]
    out = main_text.extracted(pages.where(F.lit(False)))
    assert out.count() == 0 and out.columns == ["page_id", "url", "text", "n_chars"]
