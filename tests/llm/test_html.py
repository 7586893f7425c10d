"""Main text of pages: blocks, what is left out, odd markup."""

import pytest

from ratewright.llm.html_text import _stretches, extracted, main_text

LONG = "A sentence of some length that stands for the text of an article. " * 3

CASES = {
    "": "",
    "plain text only": "plain text only",
    "<p>a</p><p>b</p>": "a b",
    "<article><h1>Title</h1><p>One&nbsp;two\n three</p><p>x<b>y</b>z</p></article>": "Title One two three xyz",
    "<nav><ul><li><a href=/>Home</a></ul></nav><article><p>Text</p></article><footer>&copy; me": "Text",
    "<article><p>one<div class='ad'>buy</div><p>two</p><aside>no</aside><form>no</form></article>": "one two",
    "<div class=ad>never closed<article><p>real</p></article>": "real",
    "<article><p>a &lt;b&gt; &amp; c &#233; &#x41; &am</p></article>": "a <b> & c é A &am",
    "<article><p>body</p><section id=comments><article class=comment><p>a reader</p></article></section></article>": "body",
    "<main><h1>T</h1><p>text</p></main><div>other</div>": "T text",
    "<article><script>if (a < b) { x('</p>') }</script><style>p{}</style><p>kept</p><!-- <p>no</p> --></article>": "kept",
    "<article><p>cut off in the mid": "cut off in the mid",
    "<article><p>cut in a tag<a href='x": "cut in a tag",
    "<div class='page-with-sidebar'><article>ok</article><div class='sidebar'>no</div></div>": "ok",
    "<div role=navigation>no</div><p hidden>no</p><p style='display: none'>no</p><article>yes</article>": "yes",
    f"<div class=cookie-notice>We use cookies</div><div><h1>Head</h1><p>{LONG}</p><p>Short.</p></div><div class=sidebar>{LONG}</div>": f"Head {LONG.strip()} Short.",
    f"<ul><li><a href=1>one link here</a><li><a href=2>two links here</a></ul><p>{LONG}</p>": LONG.strip(),
}


@pytest.mark.parametrize("page", CASES)
def test_main_text(page):
    assert main_text(page) == CASES[page]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article>{LONG}</article><article>Short one.</article>", f"{LONG.strip()} Short one."),
        (f"<main><header><h1>Title</h1></header><p>Lead.</p><nav>no</nav><article>{LONG}</article></main><p>no</p>", f"Title Lead. {LONG.strip()}"),
        (f"<p>{LONG * 5}</p>" + "<p>Yes.</p>" * 6 + f"<p>{LONG}</p>", f"{(LONG * 5).strip()} {'Yes. ' * 6}{LONG.strip()}"),
        (f"<p>{LONG}</p><p>See <a href=1>a long link in the text</a></p><p>{LONG}</p>", f"{LONG.strip()} See a long link in the text {LONG.strip()}"),
    ],
)
def test_nothing_but_what_is_marked_is_left_out(page, text):
    assert main_text(page) == text


def test_surge_and_dive():
    # Windows of three lines: they exceed the bar from line 2 on and no longer from line 5 on.
    assert _stretches([0, 0, 0, 0, 100, 5, 0, 0, 0, 0], 80) == [(2, 7)]
    assert _stretches([], 0) == [] and _stretches([0, 0], 0) == []
    assert _stretches([50, 0, 0, 0, 0, 50], 0) == [(0, 3), (3, 6)]


def test_rows_without_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>x</p>"), (4, "w", "<p>y</p>"), (4, "w", "<p>y</p>"), (5, "z", "<article>" + "<p>word</p>" * 20000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = sorted((tuple(r) for r in extracted(df).collect()), key=str)
    long = " ".join(["word"] * 20000)
    want = [(1, "u", "", 0), (2, None, "", 0), (None, "v", "x", 1), (4, "w", "y", 1), (4, "w", "y", 1), (5, "z", long, len(long))]
    assert got == sorted(want, key=str)
    assert extracted(df.limit(0)).collect() == []
