import itertools
import time

import numpy as np
import pytest

from dropletry.llm import blocks, extraction, op10_extraction


def test_held_out_labelled_pages():
    field = extraction.trained()
    right = total = 0
    for page, labels in extraction.labelled(range(9000, 9150)):
        got = field.labels(page)
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.985


def test_blocks():
    page = "<p>a &amp; b<br>c<p>d <b>e</b>\n f<script>var x='</p>'</script><ul><li>g<li>h</ul><div style='display:none'>no</div><!-- no -->t&am"
    assert [b.text for b in blocks.blocks(page)] == ["a & b c", "d e f", "g", "h", "t&am"]
    assert blocks.blocks(None) == blocks.blocks("") == [] and blocks.blocks("<<<>>>")[0].text == "<<<>>>"


def test_only_what_is_hidden_is_hidden():
    def texts(page):
        return [b.text for b in blocks.blocks(page)]

    for attribute in ('href="/hidden-gems"', 'alt="a hidden door"', 'aria-hidden="false"', 'class="overflow-hidden"', "data-hidden", 'title="style=display:none"', 'style="--display:none"', "style='display:none;display:block'"):
        assert texts(f"<p>a <a {attribute}>b</a> c") == ["a b c"], attribute
    for attribute in ("hidden", "class=x hidden", "HIDDEN=''", 'id="a"hidden', "style='color:red; display: none'", "style=display:none"):
        assert texts(f"<p>a <a {attribute}>b</a> c") == ["a c"], attribute
    assert texts("<html><head><title>t</title><meta charset=x><style>s</style><body><p>a") == ["a"]
    assert texts("<head><link rel=x><div>a</div><p>b") == ["a", "b"] and texts("<head><title>t</title>a<p>b") == ["a", "b"]
    assert texts("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.") == ["So x=2 holds."]
    assert texts("<ul><li hidden>a<li>b</ul><p hidden>c<p>d<p>e<template><p>f</template>g") == ["b", "d", "eg"]
    field, whole = extraction.trained(), "<p>First text of it, a long one.<p>Second text of it, long too."
    plain = extraction.main_text(f"<html><body><article><h1>Head line</h1>{whole}</article></body>", field)
    assert extraction.main_text(f"<html><head><title>t</title><body><div class=overflow-hidden><article><h1>Head line</h1>{whole}</article></div></body>", field) == plain != ""


def test_labels_and_posteriors_against_all_labellings():
    rng = np.random.default_rng(0)
    page = [blocks.Block(f"text {k}", "p", frozenset(), frozenset(), 0) for k in range(6)]
    for _ in range(20):
        scores, change = rng.normal(0, 2, 6), rng.normal(0, 2, (2, 2))
        total = {y: scores @ y + sum(change[a, b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=6)}
        field = extraction.Field({}, change)
        object.__setattr__(field, "scores", lambda _, s=scores: s.tolist())
        assert total[tuple(field.labels(page))] == pytest.approx(max(total.values()))
        z = sum(np.exp(v) for v in total.values())
        p, pairs = extraction._posteriors(scores, change)
        assert p == pytest.approx([sum(np.exp(v) for y, v in total.items() if y[k]) / z for k in range(6)])
        assert pairs == pytest.approx(np.array([[sum(np.exp(v) * sum(c == (a, b) for c in zip(y, y[1:])) for y, v in total.items()) / z for b in (0, 1)] for a in (0, 1)]))


def test_references_are_decoded_run_by_run():
    assert [b.text for b in blocks.blocks("<p>&am<b>p;</b>x &l<i>t;</i> &amp;lt; &#65;")] == ["&amp;x &lt; &lt; A"]


@pytest.mark.parametrize("part", ["<a ", "<b>", "<div>", '<a b="x" ', '<a b=">" ', "<p><b></i>", "<blockquote><li>x", "<x{}>", "<div class=c{}>x", "<a b='", "</div>", "<!", "&amp"])
def test_broken_pages_take_time_in_proportion(part):
    page = "".join(part.format(k) for k in range(1_000_000 // len(part)))
    began = time.process_time()
    blocks.blocks(page, frozenset())
    assert time.process_time() - began < 25  # a square would take hours


def test_article_among_boilerplate():
    page = "<html><body><nav><a href=x>Home</a></nav><div class=ad>Buy it now.</div><article><h1>Head line</h1><p>First text of it.<p>Second &lt;text&gt;.</article><div id=comments><p>I liked it.</p></div><form><p>Sign in here</p></form><footer>&copy; someone</footer>"
    assert extraction.main_text(page, extraction.trained()) == "Head line\n\nFirst text of it.\n\nSecond <text>."


def test_edges(spark):
    rows = [(1, None, "old"), (2, "", "old"), (3, "<article><p>Some words of a text that is long enough to be one, and more.</p></article>", "old"), (3, "<article><p>Some words of a text that is long enough to be one, and more.</p></article>", "old"), (4, "<article>" + "<p>word text here.</p>" * 20000, "old")]
    got = sorted(map(tuple, extraction.extract(spark.createDataFrame(rows, "page_id long, html string, text string")).select("page_id", "text", "n_chars").collect()))
    assert got[:4] == [(1, "", 0), (2, "", 0), (3, "Some words of a text that is long enough to be one, and more.", 61), (3, "Some words of a text that is long enough to be one, and more.", 61)] and got[4][2] == 20000 * 17 - 2
    assert extraction.extract(spark.createDataFrame(rows, "page_id long, html string, text string").limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = op10_extraction.query(spark, folder).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert len(rows) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in rows)
    for r in rows:
        inside = [b.text for b in blocks.blocks(pages[r["page_id"]]) if "article" in b.path]
        assert r["text"] == "\n\n".join(inside)
