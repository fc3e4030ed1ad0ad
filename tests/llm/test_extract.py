"""Main text against a plain cut of the test pages, and against written pages."""

import html
import re

import pytest

from millrace.llm import extract as X
from millrace.llm.queries import QUERIES
from tests.conftest import SF


def plain(page):
    """The test pages keep their text in one article of headings and paragraphs."""
    found = re.search(r"<article>(.*?)(</article>|<footer>|$)", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", found[1]) if found else []
    texts = (html.unescape(re.sub(r"<[^>]*>", " ", p)) for p in parts)
    return "\n".join(t for t in (" ".join(t.split()) for t in texts) if t)


def test_query_equals_the_plain_cut(spark):
    got = {r.page_id: r for r in QUERIES["op3_html_extraction"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        row = got[page.page_id]
        assert (row.text, row.url) == (plain(page.html), page.url)
        assert row.n_chars == len(row.text)


LONG = "This is a sentence of the story, and it goes on for a while. " * 4
SHORT = "So it ended."

PAGES = {
    # No article element: ratios decide.
    f"<body><div class=top><a href=/>Home</a> <a href=/x>News</a></div><div id=c><h2>A title</h2>"
    f"<p>{LONG}</p><p>{SHORT}</p></div><ul><li><a href=1>one two</a><li><a href=2>three</a></ul>"
    f"<div class=bottom>Contact</div></body>": f"A title\n{LONG.strip()}\n{SHORT}",
    # Lists, quotes and tables of an article stay; what is marked goes.
    f"<article><header><h1>T &amp; t</h1><span>by us</span></header><p>{LONG}<ul><li>One<li>Two</ul>"
    f"<blockquote>Q&#233;</blockquote><table><tr><td>a<td>b</table><aside>side</aside>"
    f"<div class='share-buttons'>Tell all</div></article>": f"T & t\n{LONG.strip()}\nOne\nTwo\nQé\na\nb",
    f"<nav>menu. of, words. that, look. like, text.</nav><main><p>{SHORT}</main><section id=comments>"
    f"<p>{LONG}</section><form><p>{LONG}</form><div role=alert>{LONG}</div>": SHORT,
    f"<p hidden>{LONG}</p><p style='display: none'>{LONG}</p><div class=cookieNotice>{LONG}</div>"
    f"<p>{SHORT}</p>": SHORT,
    "plain text,\n not\ta  page &lt;ok&gt; &am &amp": "plain text, not a page <ok> &am &",
    f"<p>One<br>two &nbsp;three<b> bold</b>er<p>{SHORT}<script>var a='<p>x</p>'</script>":
        f"One two three bolder\n{SHORT}",
    f"<article><p>{SHORT}</p><p>cut of": f"{SHORT}\ncut of",
    "<nav><a href=1>only</a></nav>": "",
    "<!-- <p>none</p> --><style>p{}</style><title>t</title>": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert X.main_text(page) == PAGES[page]


WRAPPERS = [
    "<article class='post comments-open'>{}</article>",
    "<div class='content-sidebar-wrap'><main>{}</main><div class=sidebar>Side.</div></div>",
    "<div class='has-sidebar'><main class='site'>{}</main></div>",
    "<div id=page class='header-fixed'><article>{}</article></div>",
    "<div class='social-science post'>{}</div>",
    "<div class='story-notice-of-change'>{}</div>",
    "<div class='has-widget-area'><div class=inner>{}</div></div><ul><li><a href=1>x</a></ul>",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_a_word_in_a_name_loses_no_article(wrapper):
    story = f"<h1>A title</h1><p>{LONG}</p><div class=ad>Buy now, buy more.</div><p>{SHORT}</p>"
    want = f"A title\n{LONG.strip()}\n{SHORT}"
    assert X.main_text(f"<body>{wrapper.format(story)}</body>") == want
    # What readers wrote isn't the article, though each comment be one, and longer.
    readers = f"<section class='comments'><article><p>{LONG * 3}</p></article></section>"
    if "<main" in wrapper or "<article" in wrapper:
        assert X.main_text(f"<body>{wrapper.format(story)}{readers}</body>") == want


def test_names_still_count_where_nothing_speaks_against_them():
    page = f"<div class='reader-comments'><p>{LONG}</div><div class=story><p>{SHORT}</div>"
    assert X.main_text(page) == SHORT
    page = f"<article><div class='related-posts'><p>{LONG}</div><p>{SHORT}</article>"
    assert X.main_text(page) == SHORT


def test_deep_pages_take_memory_in_proportion():
    import tracemalloc

    page = "".join(f"<div>text {i}" for i in range(20_000))
    tracemalloc.start()
    blocks, _ = X.blocks_of(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(blocks) == 20_000
    assert peak < 100 << 20


def test_ratios_decide_without_an_article():
    """A plain computation of the same ratios over pages of unmarked blocks."""
    import random

    rng = random.Random(7)
    for _ in range(60):
        groups = []
        for g in range(rng.randrange(1, 6)):
            words = lambda n: " ".join(rng.choice(["a", "bc", "def.", "gh,"]) for _ in range(n))
            groups.append([(f"g{g}", tag, words(rng.randrange(1, 40)), rng.random() < 0.3)
                           for tag in rng.choices(["p", "li", "h2"], k=rng.randrange(1, 6))])
        page = "".join(
            f"<div class={g[0][0]}>" + "".join(
                f"<{t}>" + (f"<a href=x>{x}</a>" if link else x) + f"</{t}>" for _, t, x, link in g
            ) + "</div>" for g in groups
        )
        flat = [row for g in groups for row in g]

        def ratio(rows):
            chars = sum(len(x) for _, _, x, _ in rows)
            marks = sum(x.count(".") + x.count(",") for _, _, x, _ in rows)
            links = sum(len(x) for _, _, x, link in rows if link)
            import math

            free = 1 - links / chars
            return chars / len(rows) * (1 + math.log1p(marks / len(rows))) * free * free

        fused = {}
        for c, t in {(c, t) for c, t, _, _ in flat}:
            own = [r for r in flat if r[:2] == (c, t)]
            fused[c, t] = (ratio(own) + ratio([r for r in flat if r[0] == c])) / 2
        best = {c: max(v for (k, _), v in fused.items() if k == c) for c, _ in fused}
        value = {(c, t): best[c] if t == "h2" else v for (c, t), v in fused.items()}
        mean = sum(value[c, t] * len(x) for c, t, x, _ in flat) / sum(len(x) for _, _, x, _ in flat)
        want = [x for c, t, x, _ in flat if value[c, t] > 0 and value[c, t] >= 0.25 * mean - 1e-9]
        assert X.main_text(page) == "\n".join(want)


def test_ratios():
    assert X._ratio(0, 0, 0, 0) == 0
    assert X._ratio(100, 1, 0, 100) == 0
    assert X._ratio(100, 1, 4, 0) > X._ratio(100, 1, 0, 0) > X._ratio(100, 2, 0, 0)


def test_edge_rows(spark):
    many = f"<p>{SHORT}</p>" * 20_000
    rows = [(1, "u", f"<p>{SHORT}", "x"), (1, "u", f"<p>{SHORT}", "x"), (None, None, None, None),
            (2, "v", "", "y"), (3, "w", many, "z"), (4, "w", "<div>" * 3000 + SHORT, "z"),
            (5, "w", "<" * 2000 + "</p></b></zz>" + "&#xD800;&#0;&bogus;", "z")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = X.with_main_text(frame).collect()
    by_id = {r.page_id: r.text for r in got}
    assert sorted((r.page_id for r in got), key=repr) == [1, 1, 2, 3, 4, 5, None]
    assert by_id[1] == by_id[4] == SHORT and by_id[2] == by_id[None] == ""
    assert by_id[3] == "\n".join([SHORT] * 20_000)
    assert X.with_main_text(frame.limit(0)).collect() == []
