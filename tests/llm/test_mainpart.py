"""Main text of pages: the parser on odd markup, the chain against all labellings, accuracy on pages not trained on."""

import itertools
import math
import random

import numpy as np
import pytest

from areaweave.llm import layouts, mainpart


@pytest.fixture(scope="module")
def model():
    return mainpart.fit(layouts.labelled_pages(layouts.FILLER))


def texts(page):
    return [b.text for b in mainpart.blocks(page)[0]]


def test_blocks_of_odd_markup():
    page = "<!DOCTYPE html><title>A &amp; B</title><script>var t='</p><p>no</p>';</script><STYLE>p{}</STYLE><p>one<br>two <b>bold<p>three&nbsp;&#x41;&ampx &am;<!-- no <p>no</p> --><div title='a>b'>four</div>five<li>six<li>seven<table><tr><td>8<td>9</table>"
    assert texts(page) == ["one two bold", "three A&x &am;", "four", "five", "six", "seven", "8", "9"]
    assert mainpart.blocks(page)[1] == "A & B"
    assert texts(None) == texts("") == texts("<p> \n </p>") == []
    assert texts("a < b & c") == ["a < b & c"] and texts("x<!-- open") == ["x"] and texts("x<p unclosed") == ["x"] and texts("x<!-->y") == ["xy"]
    assert texts("<p>a<script>never closed <p>b") == ["a"] and texts("</div></p>x</b>y") == ["xy"]
    assert texts('<p class="a" hidden>h</p><P>t') == ["h", "t"] and "(hidden)" in mainpart.blocks("<p hidden>h")[0][0].names


def test_long_and_deep_pages_are_read_whole(model):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert texts(deep) == ["x"]
    long = "<article><h1>T</h1><p>" + "word " * 400_000 + "</p><p>The end of it.</p></article>"
    got = mainpart.main_text(long, model)
    assert got.endswith("The end of it.") and len(got) > 1_999_000


def toy(rng, n):
    page = [mainpart.Block(f"w{rng.randint(0, 5)} " * rng.randint(1, 9), 0, ("div",), frozenset(), frozenset(), rng.randint(0, 1), rng.choice("01")) for _ in range(n)]
    for b in page:
        b.text = b.text.strip()
    return page


def test_viterbi_against_all_labellings():
    rng = random.Random(4)
    for n in range(1, 8):
        page = toy(rng, n)
        feats = mainpart.features(page, "")
        chain = mainpart.Chain({x: rng.uniform(-2, 2) for f in feats for x in f}, np.array([[[rng.uniform(-2, 2) for _ in "01"] for _ in "01"] for _ in "01"]))
        score = chain.scores(feats)
        def worth(y):
            return sum(s for s, v in zip(score, y) if v) + sum(chain.steps[int(page[k].parent == page[k - 1].parent)][y[k - 1]][y[k]] for k in range(1, n))
        best = max(itertools.product((0, 1), repeat=n), key=worth)
        assert math.isclose(worth(best), worth(tuple(map(int, chain.decode(page, "")))))


def test_training_raises_the_likelihood_by_all_labellings():
    """The conditional likelihood, summed over all labellings by hand, rises with the rounds of training."""
    pages = [p for p in layouts.labelled_pages(layouts.FILLER, 120) if len(mainpart.blocks(p)[0]) <= 11]
    assert len(pages) > 10

    def likelihood(chain):
        total = 0.0
        for p in pages:
            page, title = mainpart.blocks(p)
            score = chain.scores(mainpart.features(page, title))
            def worth(y):
                return sum(s for s, v in zip(score, y) if v) + sum(chain.steps[int(page[k].parent == page[k - 1].parent)][y[k - 1]][y[k]] for k in range(1, len(y)))
            gold = tuple(int(b.label == "1") for b in page)
            total += worth(gold) - math.log(sum(math.exp(worth(y)) for y in itertools.product((0, 1), repeat=len(page))))
        return total

    steps = [likelihood(mainpart.fit(pages, rounds=r, decay=0.0)) for r in (0, 5, 20, 80)]
    assert steps == sorted(steps) and steps[-1] > steps[0] / 10


def test_held_out_layouts(model):
    right = total = 0
    for p in layouts.labelled_pages(layouts.FILLER, 200, seed=77):
        page, title = mainpart.blocks(p)
        got = model.decode(page, title)
        right += sum(g == (b.label == "1") for g, b in zip(got, page))
        total += len(page)
    assert right / total > 0.98


def test_a_page_with_all_the_parts(model):
    page = """<html><head><title>The long road home - Site</title></head><body><div class="cookie-consent"><p>We use cookies, as all do.</p><button>Accept</button></div>
    <header class="site-header"><a href="/">Site</a><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav></header>
    <div class="layout"><article class="post"><h1>The long road home</h1><p>It was late, and the road &mdash; as ever &mdash; was long.</p><div class="ad">Buy shoes now!</div><p>Yes.</p>
    <ul><li>one thing, said aloud</li><li>another thing</li></ul><p>She  walked\n on.</p></article><aside class="sidebar"><h3>Most read</h3><ul><li><a href="/x">Ten shoes</a></li></ul></aside></div>
    <section class="comments"><h3>2 comments</h3><div class="comment"><p>I liked this story very much, thank you.</p></div></section>
    <form class="newsletter"><label>Your e-mail</label><input></form><footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""
    want = ["The long road home", "It was late, and the road — as ever — was long.", "Yes.", "one thing, said aloud", "another thing", "She walked on."]
    assert mainpart.main_text(page, model) == "\n\n".join(want)


def test_tables_nulls_and_clashing_columns(spark, model):
    rows = [(1, "<nav>Menu</nav><article><p>Text, long enough to be one.</p></article>", "old", 1), (1, "<nav>Menu</nav><article><p>Text, long enough to be one.</p></article>", "old", 2), (None, None, None, None), (3, "", "x", 4)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, __html int")
    got = mainpart.extract(pages.drop("__html"), model)
    assert got.columns == ["page_id", "text"]
    assert sorted(map(str, ((r["page_id"], r["text"]) for r in got.collect()))) == sorted(map(str, [(1, "Text, long enough to be one.")] * 2 + [(None, ""), (3, "")]))
    assert mainpart.extract(pages, model, keep=["page_id", "__html"]).count() == 4
    assert mainpart.extract(pages.limit(0), model, keep=["page_id"]).count() == 0
    assert layouts.words_of(pages.where("page_id = 1"))[:2] == ["Menu", "Text,"] and layouts.words_of(pages.limit(0)) == []


def test_without_labelled_pages_nothing_is_main():
    assert mainpart.main_text("<p>x</p>", mainpart.fit([])) == ""
