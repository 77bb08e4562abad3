"""Main text of small pages."""

import random
import re
from collections import Counter

import pytest

from siftframe.llm import extract as extraction
from siftframe.llm.extract import extract, main_text

PAGES = [
    ("", ""),
    ("no markup at all", "no markup at all"),
    ("<p>a</p>", "a"),
    ("<html><head><title>T</title><style>p{}</style><script>var x='</p>';</script></head><body></body></html>", ""),
    ("<nav><a href=/>Home</a></nav><article><h1>Head &amp; tail</h1><p>One\n  two</p><p>&lt;three&gt;</p></article><footer>&copy; x</footer>", "Head & tail\nOne two\n<three>"),
    ("<article><p>One</p><div class='ad'>Buy</div><p>Two</p><aside>More</aside><form>Name<input name=a></form><p>Three</p></article>", "One\nTwo\nThree"),
    ("<article><p><b>Open<br><p>Next</p></article><footer>end", "Open\nNext"),
    ("<article><p>Text</p></article><div id=comments><p>A reader says something long enough to be a surge of its own, says the reader.</p></div>", "Text"),
    ("<div class='cookie-notice'>We use cookies</div><p>Body text.</p><div class=\"sidebar left\">x</div>", "Body text."),
    ("<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><p>Just text</p>", "Just text"),
    ("<p>x</p><!-- <p>hidden</p> --><p>y</p>", "x\ny"),
    ("<a title='a > b'>link</a> text", "link text"),
    ("<article><p>a <a href='/x?id=header'>b</a> c</p></article>", "a b c"),
    ("<main><p>1</p></main><p>outside of the marked part, however long this line of text may be here</p>", "1"),
    ("<div class=ad>never closed <article><p>kept</p></article>", "kept"),
    ("&nbsp;&#65;&#x42;&eacute; &bogus; 1 < 2", "ABé &bogus; 1 < 2"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_page(page, text):
    assert main_text(page) == text


def test_short_stretch_far_from_the_main_one_is_left_out():
    long = "<p>" + "A sentence of the main text. " * 8 + "</p>"
    page = f"<div>{long}{long}</div><div class=widget>w</div><div>tiny</div>"
    assert main_text(page) == "\n".join(["A sentence of the main text. " * 7 + "A sentence of the main text."] * 2)


LONG = "A sentence of the main text. " * 7 + "A sentence of the main text."


def test_surges_choose_the_text_where_a_page_marks_an_article():
    assert LONG in main_text(f"<body><article class=card>Teaser</article><div><p>{LONG}</p><p>{LONG}</p></div></body>").split("\n")
    assert main_text(f"<article><p>One</p></article><nav>{LONG}</nav><div><p>{LONG}</p><p>tail</p></div>") == f"One\n{LONG}\ntail"
    assert main_text("<article><p>One</p></article><div>short line outside</div>") == "One"


def test_table_with_nulls_repeats_and_clashes(spark):
    rows = [(1, "u", "<p>x</p>", "t"), (1, "u", "<p>x</p>", "t"), (None, None, None, None), (2, "v", "<p>" + "y " * 200_000 + "</p>", "t")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "html", "text", "_text"]
    assert sorted((r["page_id"] or 0, len(r["_text"])) for r in got.collect()) == [(0, 0), (1, 1), (1, 1), (2, 399_999)]
    assert extract(spark.createDataFrame([], "html string")).collect() == []


@pytest.mark.parametrize("name", ["no-sidebar", "has-comments", "social-post", "legal-news", "layout no-sidebar"])
def test_classes_that_only_hold_a_known_word(name):
    assert main_text(f"<article class='{name}'><p>Kept</p></article>") == "Kept"
    assert main_text(f"<div id='{name}'><p>Kept</p></div>") == "Kept"


@pytest.mark.parametrize("name", ["comments", "comment-list", "ad_slot-2", "site-header", "x sidebar", "cookie-notice", "related-posts"])
def test_whole_known_classes(name):
    assert main_text(f"<article><p>{LONG}</p><div class='{name}'>gone</div></article>") == LONG
    # not for an element with most of the text, unless the article is elsewhere
    assert main_text(f"<nav>{LONG * 3}</nav><div class='{name}'><h1>T</h1><p>{LONG}</p></div><p>x</p>").startswith(f"T\n{LONG}")
    assert main_text(f"<article><p>Text</p></article><div class='{name}'>{LONG}</div>") == "Text"


def test_link_lists_and_short_blocks_of_the_article():
    sources = "<ul><li><a href=1>Source one</a></li><li><a href=2>Source two</a></li></ul>"
    assert main_text(f"{sources}<article><p>Text</p>{sources}</article>{sources}") == "Text\nSource one\nSource two"
    advert = "<div class=ad>Buy</div>"
    assert main_text(f"<div><p>{LONG}</p>{advert}<p>The end.</p></div><div>other</div>") == f"{LONG}\nThe end."
    assert main_text(f"<div>{LONG}</div>{advert}<div>Short.</div>{advert}<div>{LONG}</div>{advert}<div>tiny</div>") == f"{LONG}\nShort.\n{LONG}"


def test_embedded_elements_without_content():
    assert main_text("<article><p>One</p><svg class=i/><p>Two</p></article>") == "One\nTwo"
    for name in ("iframe", "object", "math", "svg"):
        assert main_text(f"<article><p>One</p><{name} x=1><p>Two</p></article>") == "One\nTwo"
        assert main_text(f"<article><p>One</p><{name} x=1>gone</{name}><p>Two</p></article>") == "One\nTwo"
    assert main_text("<svg>" * 20_000 + "<p>text</p>") == "text"


def test_comments_longer_than_the_article():
    comments = f"<div class=comment-list><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>"
    assert main_text(f"<div><p>{LONG}</p><p>End.</p></div>{comments}") == f"{LONG}\nEnd."
    assert main_text(f"<div><p>{LONG}</p></div><div id=google_ads_1>{LONG} {LONG}</div>") == LONG


def test_surges_choose_the_text_on_pages_without_marks(spark):
    """Articles, menus, adverts and footers as plain <div>: the text is still nearly that of the marked pages."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    both = found = wanted = removed = 0
    for page in pages:
        bare = re.sub(r"<(/?)(?:article|header|footer|nav|aside|main)\b[^>]*>", r"<\1div>", page)
        bare = re.sub(r"\s(?:class|id)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", bare)
        want, got = Counter(main_text(page).split()), main_text(bare)
        every = "\n".join(t for t, n, _, _ in extraction.lines(bare) if n)
        removed += got != every
        got = Counter(got.split())
        both, found, wanted = both + (want & got).total(), found + got.total(), wanted + want.total()
    assert both >= 0.99 * found and both >= 0.99 * wanted
    assert removed > 0.9 * len(pages)  # by surges and dives alone


def test_window_sums_and_stretches_by_plain_loops():
    rng = random.Random(4)
    for _ in range(400):
        window = rng.randrange(1, 5)
        counts = [rng.choice((0, 0, 0, 5, 80)) for _ in range(rng.randrange(15))]
        sums = [sum(counts[j] for j in range(len(counts)) if k <= j < k + window) for k in range(1 - window, len(counts))]
        assert extraction.window_sums(counts, window) == sums
        found = extraction.stretches(counts, window)
        # runs of counted lines that fewer than ``window`` empty ones part
        runs, last = [], None
        for j in (j for j, n in enumerate(counts) if n):
            if last is None or j - last > window:
                runs.append([])
            runs[-1].append(j)
            last = j
        assert [[j for j in covered if counts[j]] for _, covered in found] == runs
        assert [peak for peak, _ in found] == [max(sum(counts[k : k + window]) for k in range(run[0], run[-1] + 1)) for run in runs]
