"""HTML extraction: text that must stay, hostile pages in time, and the cut against brute force."""

import random
import time

import pytest

from tessera.llm import html


@pytest.fixture(scope="module")
def w():
    return html.train()


def test_nothing_of_the_article_is_lost(w):
    page = (
        '<body><nav><a href="/">Home</a></nav><article><h1>T &amp; u</h1><p>Let <math><mi>x</mi></math> be 3,\n\n and <noscript>so on</noscript>.</p>'
        '<p class="note-story comment-policy">Really, a paragraph of the article.</p><header><h2>Part two</h2></header><p>First  one.<p>Second one.'
        '<div class="ad">Buy it.</div><p title="x>y">Third one.</article><form><button>Go</button></form><footer>&copy; x</footer>'
    )
    assert html.main_text(page, w) == "T & u\nLet x be 3, and so on.\nReally, a paragraph of the article.\nPart two\nFirst one.\nSecond one.\nThird one."
    assert html.main_text("", w) == "" == html.main_text("<script>x</script><!-- y", w) == html.main_text("<title>x", w)


def test_blocks_of_held_out_pages(w):
    x, y = html.generated(60, 9)
    assert ((x @ w > 0) == y).mean() > 0.94
    silent = x.copy()
    silent[:, 3:5] = 0  # without any names
    assert ((silent @ w > 0) == y).mean() > 0.88


@pytest.mark.parametrize(
    "page",
    ["<p>aa, bb cc dd ee ff.</p><li><a>x</a></li>" * 16_000, "<a '" * 250_000, '<a ="' * 200_000, "<" * 10**6, "<div>" * 100_000 + "x" + "</span>" * 50_000, "<b>" * 100_000 + "<h1>x</h1>" * 30_000]
    + ["<!--" * 200_000, "<p><table>" * 60_000 + "x", "<title>" * 100_000, "<p>x" * 200_000, "<!" * 400_000, "<a b='" * 150_000 + ">", "&amp" * 250_000, "word " * 200_000],
)
def test_a_megabyte_of_anything_takes_seconds(w, page):
    began = time.time()
    html.main_text(page, w)
    assert time.time() - began < 15


def test_minimum_cut_by_brute_force():
    r = random.Random(4)
    for _ in range(150):
        n = r.randint(1, 8)
        s, t = [r.randint(0, 9) for _ in range(n)], [r.randint(0, 9) for _ in range(n)]
        e = [(i, j, r.randint(0, 5)) for i in range(n) for j in range(i) if r.random() < 0.5]
        cost = lambda m: sum(b if k else a for a, b, k in zip(s, t, m)) + sum(c for i, j, c in e if m[i] != m[j])
        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(html.minimum_cut(s, t, e)) == best


def test_labels_of_a_page_by_brute_force(w):
    found = html.blocks("<nav><a>x</a></nav><p>One two three, four.</p><div class=ad>ad ad</div><p>Five six seven, eight.</p><footer>c</footer>")
    assert [b.text for b in found] == ["x", "One two three, four.", "ad ad", "Five six seven, eight.", "c"]
    assert [b.far for b in found] == [1, 2, 2, 2, 2] and found[1].home == found[3].home == 0


def test_tables_with_nulls_repeats_and_clashing_names(spark, w):
    rows = [(1, "u", "<article><p>A b.</p></article>", "t"), (1, "u", "<article><p>A b.</p></article>", "t"), (2, None, None, "t"), (None, "v", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extracted(df, w)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(map(str, got.collect())) == sorted(["Row(page_id=1, url='u', text='A b.')"] * 2 + ["Row(page_id=2, url=None, text='')", "Row(page_id=None, url='v', text='')"])
    assert html.extracted(df.limit(0), w).count() == 0
