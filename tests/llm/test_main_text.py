"""HTML blocks, the conditional random field, and main texts of pages whose truth is known."""

import itertools
import random
import re

import numpy as np
import pytest

from loomwork.llm import main_text as M
from loomwork.llm.html_blocks import leaf_blocks

DATA = "/root/testdata/sf0.001"


def texts(page):
    return [b.text for b in leaf_blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain &amp; text\n two", ["plain & text two"]),
        ("<p>a<p>b<b>c<br>d<p>e", ["a", "bc d", "e"]),
        ("<div>x<p>y</div>z", ["x", "y", "z"]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<p>a <a href='>'>link</a>, b</p>", ["a link, b"]),
        ('<p title="a > b">c</p>', ["c"]),
        ("<script>var a='<p>no</p>';</script><p>yes</p><style>p{}</style><!-- <p>no -->", ["yes"]),
        ("<SCRIPT>no</ScRiPt >yes", ["yes"]),
        ("<p>a<script>never closed", ["a"]),
        ("<p>a<!-- never closed", ["a"]),
        ("<p>a<div class='never closed", ["a"]),
        ("1 < 2 and 3 <4 </ 5", ["1 < 2 and 3 <4 </ 5"]),
        ("<select><option>a<option>b</select><button>c</button>d", ["d"]),
        ("<p>&nbsp;</p><p>　x  y</p>&copy;&#x41;&bogus;", ["x y", "©A&bogus;"]),
        ("</p></div>x</b>", ["x"]),
        ("<b><p>x</b>y</p>", ["xy"]),
        ("<title>t</title><textarea><p>no</textarea><noscript>no</noscript><br/>x<custom-tag>y</custom-tag>", ["xy"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_long_and_deep_pages_take_linear_time():
    assert len(leaf_blocks("<div>" * 20_000 + "x")) == 1
    assert len(leaf_blocks("<b><p>x" * 5_000)) == 5_000
    assert texts("<a " * 30_000) == []
    assert texts("<" * 100_000)[0] == "<" * 100_000
    assert len(leaf_blocks("<a 'x>" * 20_000)) <= 1


def field(seed=0):
    rng = np.random.default_rng(seed)
    return M.Model(rng.normal(size=(M.FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))


def paths(scores, m):
    for path in itertools.product(range(2), repeat=len(scores)):
        yield path, m.begins[path[0]] + sum(scores[i, y] for i, y in enumerate(path)) + sum(m.moves[a, b] for a, b in itertools.pairwise(path))


def test_likelihood_and_decoding_equal_all_paths():
    m, rng = field(), np.random.default_rng(1)
    pages = []
    for n in (1, 2, 5, 7, 5):
        sizes = rng.integers(1, 4, size=n).tolist()
        pages.append((rng.integers(0, M.FEATURES, size=sum(sizes)).tolist(), sizes, rng.integers(0, 2, size=n).tolist()))
    want = 0.0
    for ids, sizes, labels in pages:
        scores = np.array([m.weights[part].sum(axis=0) for part in np.split(np.array(ids), np.cumsum(sizes)[:-1])])
        every = dict(paths(scores, m))
        want += np.log(sum(np.exp(v) for v in every.values())) - every[tuple(labels)]
        assert tuple(M.viterbi(scores, m)) == max(every, key=every.get)
    arrays = [np.concatenate(c) for c in zip(*pages, strict=True)] + [np.array([len(p[1]) for p in pages])]
    value, gradient = M.likelihood(*arrays, m)
    assert value == pytest.approx(want)
    flat, g = M._flat(m), M._flat(gradient)
    for i in [*np.flatnonzero(g)[::3], *range(len(flat) - 6, len(flat))]:
        d = np.zeros_like(flat)
        d[i] = 1e-5
        slope = (M.likelihood(*arrays, M._model(flat + d))[0] - M.likelihood(*arrays, M._model(flat - d))[0]) / 2e-5
        assert g[i] == pytest.approx(slope, abs=1e-6)


@pytest.fixture(scope="module")
def model(spark):
    return M.fit(M.labelled_pages(spark.read.parquet(f"{DATA}/pages.parquet")))


def test_given_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in M.extract(pages, model).collect():
        article = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        assert r.text == "\n".join(texts(article)) and r.n_chars == len(r.text)


def test_held_out_layouts(spark, model):
    """Layouts of pages that were not seen: at least 97 of 100 blocks are right."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    wrong = n = 0
    for i, page in enumerate(pages):
        rng = random.Random(1000 + i)
        blocks = leaf_blocks(M.laid_out(texts(page), rng))
        scores = np.stack([model.weights[sorted(set(M._ids(b.features, {})))].sum(axis=0) for b in blocks])
        wrong += sum((b.truth or 0) != y for b, y in zip(blocks, M.viterbi(scores, model), strict=True))
        n += len(blocks)
    assert n > 3000 and wrong < 0.03 * n


def test_a_page_by_hand(spark, model):
    page = """<html><head><title>no</title></head><body><div id="top-menu"><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></div>
    <div class="cookie-notice"><p>We use cookies, as all do.</p><button>OK</button></div>
    <div class="post-content"><h1>The headline &amp; more</h1><p>First paragraph of the story, which is long enough to be one.</p>
    <div class="advert">Buy our fine goods today.</div><p>Second  paragraph,<br>with a break and a <a href=3>link</a> in it.</p></div>
    <div class="comments"><div class="comment"><b>ann</b><p>I do not agree with the second paragraph, it is wrong.</p></div></div>
    <div class="sidebar"><h3>Related</h3><ul><li><a href=4>Another story of ours</a></li></ul></div><div class="footer">&copy; 2020 The Paper</div></body></html>"""
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert M.extract(df, model).first().text == "The headline & more\nFirst paragraph of the story, which is long enough to be one.\nSecond paragraph, with a break and a link in it."


def test_edges(spark, model):
    rows = [(1, None, "a", 9), (1, None, "a", 9), (None, "", "b", 8), (3, "<p></p>", None, 7), (4, "<article><p>" + "long words, many of them. " * 40_000 + "</p></article>", "c", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")
    got = M.extract(df, model, keep=["page_id", "text"]).collect()
    assert sorted(r.n_chars for r in got)[:4] == [0] * 4 and len(got) == 5 and all(r.text is not None for r in got)
    assert max(r.n_chars for r in got) in (0, 26 * 40_000 - 1)
    assert M.extract(df.where("false"), model).isEmpty()
    nothing = M.fit(M.labelled_pages(df.where("false")))
    assert {r.n_chars for r in M.extract(df, nothing).collect()} == {0}


def test_fit_does_not_depend_on_partitions(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    a, b = (M.fit(M.labelled_pages(pages.repartition(n)), calls=4) for n in (1, 7))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.moves, b.moves)
