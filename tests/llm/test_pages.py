import math
import re
import time
import zlib

import numpy as np
import pytest

from strandgraph.llm import block_labeller, train_blocks
from strandgraph.llm.html_blocks import blocks

from .conftest import prose

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-banner">We use cookies <button>OK</button></div>
<article><h1>The   title &amp; more</h1><p><b>One two three four five six seven eight nine ten, eleven and twelve.<br><p>%s</p>
<div class="ad"><p>Buy now</p></div><p>Last paragraph with&nbsp;some words in it, and a few more of them.</article>
<section class="comments"><h2>Comments</h2><div class="comment"><p>%s</p></div></section><aside class="sidebar"><a href="/x">Related</a></aside>
<form><label>Email</label><input name="e"></form><footer>&copy; site &middot; all rights</footer></body></html>"""


def test_blocks():
    page = blocks("<div class='a b'>x <b>y</b>\n z<p>one<p>two<br>three</p>tail</div><!-- <p>no</p> --><script>if (a < b) {}</script>&lt;end&gt;")
    assert [b.text for b in page] == ["x y z", "one", "two three", "tail", "<end>"]
    assert page[0].path == ["div", "class=a", "class=b"] and page[1].path[-1] == "p" and page[4].path == []
    assert blocks("") == [] and blocks("<p><div><span></p></x><!--") == []
    assert [b.text for b in blocks("a < b and c > d <i>e</i>")] == ["a < b and c > d e"]
    assert [b.text for b in blocks("<head><title>t</title><meta x><p>one <math><mi>x</mi></math> two<object>o</object>")] == ["one x two", "o"]
    assert [b.text for b in blocks("<p>don't <a title=don't>x</a> y's</p>1 < 2 <i class=")] == ["don't x y's", "1 < 2"]
    assert [b.text for b in blocks("<p title='a>b'>x<p title='open>y")] == ["x", "y"]


@pytest.mark.parametrize("page", ["<a " * 300000, "<div>" * 50000, "<div><b>x" * 20000, "<b>" * 50000 + "</i>" * 50000, "<i><div>" + "<b>" * 50000 + "</i>" * 50000, '<a x="' * 100000 + "y>", "<script>" * 100000, "<" * 300000, "<!" * 100000])
def test_hostile_pages_take_time_in_proportion(page):
    began = time.perf_counter()
    blocks(page)
    assert time.perf_counter() - began < 2


def test_page():
    main = prose(1, 60)
    page = blocks(PAGE % (main, prose(2, 30)))
    keep = block_labeller.label([page], block_labeller.load())[0]
    text = "\n".join(b.text for b, k in zip(page, keep) if k)
    assert text == f"The title & more\nOne two three four five six seven eight nine ten, eleven and twelve.\n{main}\nLast paragraph with some words in it, and a few more of them."


def slow_scores(page, w):
    """The labeller once more, block by block and number by number, without numpy's matrices."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    mean = lambda rows: [sum(r[k] for r in rows) / len(rows) for k in range(16)]
    x = []
    for k, b in enumerate(page):
        path = [w["path"][zlib.crc32(p.encode()) % 1024] for p in b.path] or [w["path"][0]]
        words = [w["word"][zlib.crc32(v.encode()) % 2048] for v in re.findall(r"\w+", b.text.lower())] or [w["word"][0]]
        n, spaces = len(b.text), b.text.count(" ") + 1
        x.append(mean(path) + mean(words) + [math.log(1 + n) / 8, math.log(1 + spaces) / 6, b.linked / n, k / len(page), 1 / (1 + k), 1 / (len(page) - k), sum(c in ".,;:!?" for c in b.text) / spaces, math.log(1 + len(b.path)) / 3])
    def states(rows, into, onto, bias):
        h, c, out = [0.0] * 16, [0.0] * 16, []
        for row in rows:
            a = [bias[j] + sum(v * into[i][j] for i, v in enumerate(row)) + sum(v * onto[i][j] for i, v in enumerate(h)) for j in range(64)]
            c = [sig(a[16 + j]) * c[j] + sig(a[j]) * math.tanh(a[48 + j]) for j in range(16)]
            h = [sig(a[32 + j]) * math.tanh(c[j]) for j in range(16)]
            out.append(h)
        return out
    forth, back = states(x, w["wf"], w["uf"], w["bf"]), states(x[::-1], w["wb"], w["ub"], w["bb"])[::-1]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    return [sig(dot(f, w["of"]) + dot(b, w["ob"]) + dot(r, w["oi"]) + w["o"]) for f, b, r in zip(forth, back, x)]


def test_scores_equal_those_of_a_plain_labeller():
    w = block_labeller.load()
    pages = [blocks(PAGE % (prose(k, 5 + 40 * k), prose(9, 30))) for k in range(4)] + [blocks("x"), blocks("<div>" * 40 + "y<p>z")]
    for page, own in zip(pages, block_labeller.scores([block_labeller.inputs(p, w) for p in pages], w)):
        assert own == pytest.approx(slow_scores(page, {k: v.tolist() for k, v in w.items()}), abs=1e-9)


def test_long_pages_are_read_whole(monkeypatch):
    w, texts = block_labeller.load(), [prose(k, 12) + "." for k in range(3000)]
    page = blocks("<html><body><nav><a href='/'>Home</a></nav><article><h1>Title of it</h1>" + "".join(f"<p>{t}</p>" for t in texts) + "</article><footer>&copy; me</footer></body></html>")
    keep = block_labeller.label([page], w)[0]
    assert [b.text for b, k in zip(page, keep) if k] == ["Title of it", *texts]
    monkeypatch.setattr(block_labeller, "STEPS", 7)
    monkeypatch.setattr(block_labeller, "WORDS_HELD", 5)
    small = page[:40]
    for b in small:
        b.element.sums = None
    own = block_labeller.scores([block_labeller.inputs(small, w)], w)[0]
    monkeypatch.undo()
    assert own == pytest.approx(block_labeller.scores([block_labeller.inputs(small, w)], w)[0], abs=1e-9)


def test_the_end_of_a_long_block_counts():
    w = block_labeller.load()
    a, b = (block_labeller.inputs(blocks(f"<p>{prose(1, 5000)} {last}</p>"), w) for last in ("one", "two"))
    assert (a[0, 16:32] != b[0, 16:32]).any()


def test_fresh_pages():
    texts = [prose(k, 400).replace(" ", ", ", 5) for k in range(60)]
    examples = train_blocks.examples(train_blocks.Composer(texts, 77), 150)
    assert train_blocks.accuracy(block_labeller.load(), examples) > 0.98


def test_gradients():
    composer = train_blocks.Composer([prose(k, 300) for k in range(10)], 1)
    batch, w = train_blocks.examples(composer, 3), train_blocks.fresh(1)
    _, g = train_blocks.step(batch, w)
    r = np.random.default_rng(2)
    for name in ("wf", "uf", "bf", "wb", "ub", "bb", "of", "ob", "oi", "o", "path", "word"):
        at = tuple(r.integers(0, n) for n in w[name].shape)
        if name in ("path", "word"):
            at = (int(batch[0][0][0][name == "word"][0]), 2)
        old, h = w[name][at], 1e-5
        losses = []
        for d in (h, -h):
            w[name] = w[name].copy()
            w[name][at] = old + d
            losses.append(train_blocks.step(batch, w)[0])
        w[name][at] = old
        assert g[name][at] == pytest.approx((losses[0] - losses[1]) / (2 * h), abs=1e-6), name


def test_operator(spark):
    long = "<html><body><article>" + "".join(f"<p>{prose(k, 30)}</p>" for k in range(1500)) + "</article></body></html>"
    rows = [(1, "u", PAGE % (prose(1, 60), "c")), (2, None, None), (3, "u", ""), (4, "u", "<html><body></body></html>"), (None, "u", long), (1, "u", PAGE % (prose(1, 60), "c")), (5, "u", "<" * 1000)]
    df = spark.createDataFrame([(*r, "?", "?") for r in rows], "page_id bigint, url string, html string, text string, the_html string")
    out = block_labeller.extract(df).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    by = {r.page_id: r for r in out}
    assert [by[k].text for k in (2, 3, 4)] == ["", "", ""]
    assert by[None].text.count("\n") == 1499
    assert block_labeller.extract(df.limit(0)).collect() == []
