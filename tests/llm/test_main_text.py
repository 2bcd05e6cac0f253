import itertools
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera.llm import main_text, queries


def cost(label, odds, edges):
    return sum(abs(o) for x, o in zip(label, odds, strict=True) if x != (o > 0)) + sum(w for (i, j), w in edges.items() if label[i] != label[j])


@pytest.mark.parametrize("seed", range(60))
def test_cut_is_of_least_cost(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 10)
    odds = [rng.uniform(-2, 2) for _ in range(n)]
    edges = {(i, j): rng.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
    got = main_text.minimum_cut(odds, edges)
    least = min(cost(x, odds, edges) for x in itertools.product([False, True], repeat=n))
    assert cost(got, odds, edges) == pytest.approx(least)


def test_long_chain_is_quick():
    rng = random.Random(1)
    odds = [rng.uniform(-1, 1) for _ in range(4000)]
    assert len(main_text.minimum_cut(odds, {(i, i + 1): 1.5 for i in range(3999)})) == 4000


BODY = ["A long paragraph of the article, with enough words to be read as prose; it goes on.", "Another paragraph &amp; more\n  prose, with <b>bold</b>ness<br>and a break."]
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy things, now, at a good price.</div><div id="cookie-notice"><p>We use cookies, dear reader.</p></div>
<article><h1>The title</h1><p>{BODY[0]}<p>{BODY[1]}</p><form><p>Your name</p><input></form>
<div class="comments"><p>A reader wrote a long comment here, with many words in it.</p></div></article>
<aside>See also this text.</aside><div class=sidebar><p>Side text here.</p></div><footer>&copy; site</footer></body></html>"""
WANT = "The title\n\n" + BODY[0] + "\n\nAnother paragraph & more prose, with boldness and a break."


def test_main_text_of_a_marked_up_page():
    assert main_text.main_text(PAGE, main_text.DEFAULT_WEIGHTS) == WANT


@pytest.mark.parametrize(
    "opening",
    ['<div class="content with-sidebar"><article>', '<div id="page" class="no-sidebar"><article>', '<div class="sidebar"><article class="post">', "<form id=f><main>", '<div class="post-wrap has-header">', '<div class="promo">'],
)
def test_layout_wrappers_keep_the_article(opening):
    """Names around an article, around most of a page, or that only tell of a layout, don't remove it; headlines in article headers stay."""
    prose = [f"Paragraph {i} is a sentence of some length, and it ends here. Then comes another one, as prose has it." for i in range(4)]
    head = '<div class="article-header"><h1>A headline of some words</h1></div>'
    close = "".join(f"</{t}>" for t in reversed([x.split()[0] for x in opening.strip("<").replace(">", "").split("<")]))
    page = f'<body><nav><a href="/">Home</a></nav>{opening}{head}' + "".join(f"<p>{p}</p>" for p in prose) + f'<div class="comments"><p>{prose[0]} My view.</p><p>{prose[1]} Mine too.</p></div>{close}<footer>(c) site</footer></body>'
    got = main_text.main_text(page, main_text.DEFAULT_WEIGHTS)
    assert got == "\n\n".join(["A headline of some words", *prose])


def test_names():
    named = lambda x: main_text._named(f'class="{x}"')
    assert named("content-with-sidebar") == named("article") == (False, True)
    assert named("article-comments") == named("sidebar-content") == named("site-header") == (True, False)
    assert named("entry-header") == (False, True) and named("no-header") == (False, False)


def test_capitals_are_counted_over_the_whole_block():
    column = main_text.FEATURES.index("capitals")
    low, high = (main_text.features(main_text.blocks_of(f"<p>{'word ' * 100}{x * 100}</p>"))[0, column] for x in ("word ", "Word "))
    assert (low, high) == (0.0, 0.5)


def _stripped(page):
    """A page without class names and with plain elements for those that show a part."""
    return re.sub(r"<(/?)(?:article|nav|footer|header|aside|main)>", r"<\1div>", re.sub(r' class="[^"]*"', "", page))


def test_cut_beats_thresholding_on_held_out_pages_without_mark_up():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    learning, held = pages[:100], pages[100:]
    rows = [(r, b.marked > 0) for p in learning for bs in [main_text.blocks_of(p)] for r, b in zip(main_text.features(bs), bs, strict=True) if b.marked]
    weights = main_text.train(np.array([r for r, _ in rows]), np.array([float(y) for _, y in rows]))
    cut = single = changed = 0
    for page in held:
        want = [b.text for b in main_text.blocks_of(re.search("(?s)<article>.*</article>", page)[0])]
        blocks = main_text.blocks_of(_stripped(page))
        odds = main_text.odds_of(blocks, weights)
        keep = main_text.minimum_cut(odds, main_text.edges_of(blocks))
        cut += [b.text for b, k in zip(blocks, keep, strict=True) if k] == want
        single += [b.text for b, o in zip(blocks, odds, strict=True) if o > 0] == want
        changed += sum(k != (o > 0) for k, o in zip(keep, odds, strict=True))
    assert cut >= 0.98 * len(held) and cut > single + 0.1 * len(held) and changed


@pytest.mark.parametrize(("evidence", "least_mended", "most_wrong"), [(0.0, 60, 1), (0.1, 20, 0), (1.0, 0, 0)])
def test_cut_mends_what_thresholding_gets_wrong_on_marked_up_pages(evidence, least_mended, most_wrong):
    """Pages as they are: with a share of the mark-up's evidence, the cut against the sign of the same odds, block by block."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    every = [main_text.blocks_of(p) for p in pages]
    rows = [(r, b.marked > 0) for bs in every for r, b in zip(main_text.features(bs), bs, strict=True) if b.marked]
    weights = main_text.train(np.array([r for r, _ in rows]), np.array([float(y) for _, y in rows]))
    wrong = mended = 0
    for page, blocks in zip(pages, every, strict=True):
        article = [b.text for b in main_text.blocks_of(re.search("(?s)<article>.*</article>", page)[0])]
        texts = [b.text for b in blocks]
        begin = next(i for i in range(len(texts)) if texts[i : i + len(article)] == article)
        odds = [o - (1 - evidence) * b.hint for o, b in zip(main_text.odds_of(blocks, weights), blocks, strict=True)]
        for i, (kept, o) in enumerate(zip(main_text.minimum_cut(odds, main_text.edges_of(blocks)), odds, strict=True)):
            right = begin <= i < begin + len(article)
            wrong += kept != right
            mended += kept == right != (o > 0)
    assert wrong <= most_wrong and mended >= least_mended


def test_query_on_whole_pages_against_the_article_element(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in queries.op10_main_text(spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        want = "\n\n".join(b.text for b in main_text.blocks_of(re.search("(?s)<article>.*</article>", p.html)[0]))
        assert (got[p.page_id].text, got[p.page_id].n_chars) == (want, len(want))


def test_without_mark_up():
    prose = [f"Paragraph {i} is a sentence of some length, and it ends here. Then comes another one, as prose has it." for i in range(4)]
    links = "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(6))
    page = f"<body><ul>{links}</ul><div>" + "".join(f"<p>{p}</p>" for p in prose) + f"</div><ul>{links}</ul></body>"
    assert main_text.main_text(page, main_text.DEFAULT_WEIGHTS) == "\n\n".join(prose)


@pytest.mark.parametrize("page", ["", "<", "plain", "<p", "<p>x</div></p></p>", "<script>", "<a href='>'>x</a>", "<!-- never ends", "&#0;&bogus;", "<p>" * 3000 + "x", "<p>" + "x" * 399 + " y"])
def test_broken_pages(page):
    assert isinstance(main_text.main_text(page, main_text.DEFAULT_WEIGHTS), str)


def test_query(spark, tmp_path):
    rows = [(i, f"u{i}", PAGE) for i in range(20)] + [(100, None, None), (101, "u", ""), (None, "u", PAGE), (102, "u", "<article>" + "<p>long words here.</p>" * 5000 + "</article>"), (3, "u3", PAGE)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.op10_main_text(spark, str(tmp_path)).collect()
    got = {r.page_id: r for r in found}
    assert len(found) == len(rows) == len(got) + 1  # a repeated row stays twice
    assert got[3].text == got[None].text == WANT and got[3].n_chars == len(WANT)
    assert (got[100].text, got[100].n_chars, got[101].text) == ("", 0, "")
    assert got[102].text == "\n\n".join(["long words here."] * 5000)


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, html string, text string")
    assert np.array_equal(main_text.fit(empty), main_text.DEFAULT_WEIGHTS)
    assert main_text.extract(empty, main_text.DEFAULT_WEIGHTS).count() == 0
