"""The main text of web pages: a linear-chain conditional random field over leaf blocks, trained here, decoded by Viterbi.

Labelled pages are HTML whose elements carry ``data-label`` (1: main text, 0: not). :func:`labelled_pages` makes them from a bounded
sample of pages: texts of a page are set again in layouts drawn at random (semantic tags, classes and ids of many habits, or none), with menus,
headers, sidebars, adverts, notices, forms, comments and footers around and inside the article; a page with one ``article`` or ``main`` element
is labelled by it as well. The likelihood and its gradient are added up over tasks, one job for each step of the descent.

A null or empty page, or one without text, has an empty main text. Repeated rows and ids each give a row. Whole pages are read, however
long; time is linear in them. Columns with names of added ones give way to these.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  named as pa.compute in the tasks
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.descent import minimise
from . import common
from .html_blocks import LABEL, leaf_blocks

#: Hashed features, and labels of a block.
FEATURES, LABELS = 1 << 13, 2
#: Training: sampled pages, layouts of them together, texts of a page that are used, tasks, weight of the squared weights, calls of the gradient.
SAMPLE_PAGES, LAID_OUT, TEXTS, TASKS, SQUARES, CALLS = 240, 1500, 60, 4, 0.1, 60


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # label before x label
    begins: np.ndarray  # label


def _ids(features: list[str], known: dict[str, int]) -> list[int]:
    out = []
    for f in features:
        if f not in known:
            if len(known) > 50_000:
                known.clear()
            known[f] = zlib.crc32(f.encode()) % FEATURES
        out.append(known[f])
    return out


# --- labelled pages ---

#: Words that sites use in classes and ids, by kind of region, and tags for it; "" is a plain div.
REGIONS = {
    "main": (("article", "main", "section", "", "", ""), ("article", "post", "entry", "content", "story", "main", "body", "text", "page", "blog", "news", "single")),
    "menu": (("nav", "nav", "", "ul"), ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "links", "tabs", "pagination")),
    "header": (("header", "header", ""), ("header", "masthead", "top", "brand", "logo", "banner", "site", "tagline", "hero")),
    "footer": (("footer", "footer", ""), ("footer", "copyright", "legal", "bottom", "colophon", "site", "imprint")),
    "sidebar": (("aside", "aside", "", "section"), ("sidebar", "aside", "widget", "related", "recommended", "trending", "popular", "rail", "secondary", "more", "side", "promo")),
    "notice": (("", "", "section", "dialog"), ("notice", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "message", "overlay", "banner", "warning", "paywall")),
    "advert": (("", "", "aside", "section"), ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "adsense", "promotion", "dfp")),
    "form": (("form",), ("form", "search", "login", "signup", "contact", "subscribe")),
    "comments": (("section", "", "", "aside", "ol"), ("comments", "comment", "replies", "discussion", "respond", "responses", "thread", "reader", "disqus", "feedback")),
    "share": (("", "ul"), ("share", "social", "tags", "meta", "toolbar", "buttons")),
}
ENDINGS = ("content", "wrapper", "area", "list", "box", "container", "block", "section", "inner", "item")
ODD = ("row", "col", "container", "wrapper", "grid", "css", "block", "inner", "clearfix", "wide")


def _attributes(rng: random.Random, kind: str) -> str:
    names, out = REGIONS[kind][1], []
    for key, chance in (("class", 0.8), ("id", 0.25)):
        if rng.random() < chance:
            parts = [rng.choice(names)] + ([rng.choice((*names, *ENDINGS))] if rng.random() < 0.5 else [])
            word = parts[0] + "".join(p.title() for p in parts[1:]) if rng.random() < 0.2 else rng.choice("-_").join(parts)
            out.append(f'{key}="{word}{" " + rng.choice(ODD) if rng.random() < 0.2 else ""}"')
    return " ".join(["", *out])


def _around(rng: random.Random, kind: str, inside: str, label: int | None = None) -> str:
    tag = rng.choice(REGIONS[kind][0]) or "div"
    mark = "" if label is None else f' {LABEL}="{label}"'
    role = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "main": "main"}.get(kind)
    return f"<{tag}{_attributes(rng, kind)}{mark}{f' role={role}' if role and rng.random() < 0.1 else ''}>{inside}</{tag}>"


def laid_out(texts: list[str], rng: random.Random) -> str:
    """A labelled page in a random layout; ``texts`` are plain texts that its blocks take words from."""
    words = " ".join(texts).split() or ["text"]
    cut = lambda low, high: " ".join(words[(at := rng.randrange(len(words))) : at + rng.randint(low, high)]).replace("&", "&amp;").replace("<", "&lt;")
    maybe = lambda chance, make: make() if rng.random() < chance else ""
    link = lambda low=1, high=4: f'<a href="/{rng.randrange(999)}">{cut(low, high)}</a>'
    box = lambda inside: rng.choice(("<p>{}</p>", "<div>{}</div>", "<span>{}</span>", "{}")).format(inside)
    items = lambda make, low, high: "<ul>" + "".join(f"<li>{make()}</li>" for _ in range(rng.randint(low, high))) + "</ul>" if rng.random() < 0.7 else " ".join(box(make()) for _ in range(rng.randint(low, high)))
    menu = lambda: _around(rng, "menu", items(link, 2, 9))
    advert = lambda: _around(rng, "advert", box(cut(3, 25) + maybe(0.3, link)), 0)
    notice = lambda: _around(rng, "notice", box(cut(4, 30)) + maybe(0.5, lambda: f"<button>{cut(1, 2)}</button>") + maybe(0.3, link), 0)
    form = lambda: _around(rng, "form", f"<label>{cut(1, 3)}</label><input name=q>" + maybe(0.5, lambda: box(cut(3, 15))) + f"<button>{cut(1, 2)}</button>", 0)
    header = lambda: _around(rng, "header", box(link()) + maybe(0.5, lambda: box(cut(2, 9))) + maybe(0.5, menu))
    footer = lambda: _around(rng, "footer", maybe(0.5, lambda: items(link, 2, 6)) + box(maybe(0.7, lambda: "&copy; ") + cut(2, 25)) + maybe(0.3, lambda: box(cut(3, 25))))
    side = lambda: _around(rng, "sidebar", maybe(0.6, lambda: f"<h3>{cut(1, 4)}</h3>") + rng.choice((lambda: items(lambda: link(2, 9), 2, 8), lambda: box(cut(5, 60)), lambda: items(lambda: cut(2, 20), 1, 5)))(), 0)
    comment = lambda: rng.choice(("<div{}>{}</div>", "<li{}>{}</li>", "<article{}>{}</article>")).format(_attributes(rng, "comments"), maybe(0.6, lambda: rng.choice(("<b>{}</b>", "<div>{}</div>", "<span>{}:</span> ")).format(cut(1, 2))) + box(cut(3, 60)))
    comments = lambda: _around(rng, "comments", maybe(0.7, lambda: f"<h3>{cut(1, 3)}</h3>") + "".join(comment() for _ in range(rng.randint(1, 6))) + maybe(0.3, form), 0)
    share = lambda: _around(rng, "share", items(link, 1, 4), 0)

    def piece() -> str:
        return rng.choice(
            (lambda: f"<h{(n := rng.randint(2, 4))}>{cut(1, 8)}</h{n}>", lambda: f"<ul>{''.join(f'<li>{cut(2, 30)}</li>' for _ in range(rng.randint(2, 6)))}</ul>", lambda: f"<blockquote>{box(cut(5, 50))}</blockquote>", lambda: f"<div>{cut(8, 90)}</div>",
             lambda: f"<table><tr><td>{cut(1, 6)}</td><td>{cut(1, 6)}</td></tr></table>", lambda: f"<pre>{cut(3, 30)}</pre>", lambda: f"{cut(10, 60)}<br><br>{cut(10, 60)}", lambda: f"<p>{cut(1, 4)}</p>")
        )()

    paragraph = lambda: f"<p>{maybe(0.1, lambda: '<b>')}{cut(1, rng.choice((8, 30, 150)))}{maybe(0.2, link)}{maybe(0.1, lambda: '<br>')}" + maybe(0.9, lambda: "</p>")
    body = maybe(0.85, lambda: f"<h1>{cut(2, 12)}</h1>")
    body += "".join((paragraph if rng.random() < 0.8 else piece)() for _ in range(rng.randint(1, 14)))
    for _ in range(rng.choice((0, 0, 1, 1, 2))):  # what is set between an article's paragraphs
        stop = body.find("<p>", rng.randrange(len(body)))
        body = body if stop < 0 else body[:stop] + rng.choice((advert, advert, notice, side, share, form))() + body[stop:]
    body += maybe(0.2, share) + maybe(0.15, comments) + maybe(0.1, form)
    main = _around(rng, "main", body, 1) if rng.random() < 0.93 else f'<div {LABEL}="1">{body}</div>'
    if rng.random() < 0.3:  # an article in a plain or odd box
        main = f'<div class="{rng.choice(ODD)}">{main}{maybe(0.3, comments)}</div>'
    parts = [maybe(0.2, notice), maybe(0.6, header), maybe(0.7, menu), maybe(0.4, advert), maybe(0.2, side), main, maybe(0.3, comments), maybe(0.4, side), maybe(0.2, advert), maybe(0.2, form), maybe(0.8, footer), maybe(0.2, notice)]
    if rng.random() < 0.04:
        parts = [main]
    return f'<!DOCTYPE html><html><head><title>{cut(1, 8)}</title></head><body {LABEL}="0">{"".join(parts)}</body></html>'


def labelled_pages(pages: DataFrame, html: str = "html", sample: int = SAMPLE_PAGES, layouts: int = LAID_OUT, seed: str = "main-text") -> DataFrame:
    """(html) of labelled pages from about ``sample`` pages, chosen by a hash of their content, set again in about ``layouts`` layouts; see the module."""
    pages = pages.where(F.length(f"`{html}`") > 0).select(F.col(f"`{html}`").alias("html"))
    total = pages.count()
    chosen, each = common.sample_by_hash(pages, "html", sample, seed, total), -(-layouts // max(1, min(total, sample)))

    def make():
        def run(columns: list[list]) -> Iterator[list[list]]:
            for page in columns[0]:
                blocks = leaf_blocks(page)
                if not blocks:
                    continue
                rng = random.Random(zlib.crc32(f"{seed}:{page}".encode()))
                out = []
                for holder in ("article", "main"):
                    # the page as it is: what stands in its one article or main element, but not in what is no text of it
                    if len(re.findall(rf"(?i)<{holder}\b", page)) == 1 and LABEL not in page:
                        marked = re.sub(r"(?i)<(nav|header|footer|aside|form)\b", rf'<\1 {LABEL}="0"', re.sub(rf"(?i)<{holder}\b", f'<{holder} {LABEL}="1"', page))
                        out.append(re.sub(r"(?i)<body\b", f'<body {LABEL}="0"', marked))
                        break
                texts = [b.text for b in rng.sample(blocks, min(TEXTS, len(blocks)))]
                out += [laid_out(texts, rng) for _ in range(each)]
                yield [out]

        return run

    return common.map_batches(chosen, make, [("html", "string")])


# --- training ---


def _page_arrays(page: str, known: dict[str, int]) -> tuple[list[int], list[int], list[int]] | None:
    """(feature ids of all blocks, number of each block's, labels); a block without a label counts as no main text."""
    blocks = leaf_blocks(page)
    ids = [sorted(set(_ids(b.features, known))) for b in blocks]
    return ([i for f in ids for i in f], [len(f) for f in ids], [b.truth or 0 for b in blocks]) if blocks else None


def featured(labelled: DataFrame) -> DataFrame:
    """(ids, sizes, labels) of labelled pages."""

    def make():
        known: dict[str, int] = {}

        def run(columns: list[list]) -> Iterator[list[list]]:
            found = [f for page in columns[0] if page and (f := _page_arrays(page, known))]
            yield [list(c) for c in zip(*found, strict=True)] if found else [[], [], []]

        return run

    return common.map_batches(labelled, make, [("ids", "array<int>"), ("sizes", "array<int>"), ("labels", "array<int>")])


def likelihood(ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray, lengths: np.ndarray, model: Model) -> tuple[float, Model]:
    """Minus the log-likelihood of labelled pages, and its gradient: forward and backward sums over all pages side by side.

    ``ids``: features of all blocks of all pages; ``sizes``: each block's number of features; ``lengths``: each page's blocks.
    """
    weights, moves, begins = model.weights, model.moves, model.begins
    first = np.cumsum(lengths) - lengths
    scores = np.add.reduceat(weights[ids], np.cumsum(sizes) - sizes)
    order = np.argsort(-lengths, kind="stable")
    alive = [order[: np.searchsorted(-lengths[order], -t, side="left")] for t in range(lengths.max())]  # pages with more than t blocks
    plus = lambda x, axis: (top := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis=axis))
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[first] = begins + scores[first]
    for t in range(1, len(alive)):
        at = first[alive[t]] + t
        forward[at] = plus(forward[at - 1][:, :, None] + moves[None], 1) + scores[at]
    for t in range(len(alive) - 1, 0, -1):
        at = first[alive[t]] + t
        backward[at - 1] = plus(moves[None] + (scores[at] + backward[at])[:, None, :], 2)
    total = plus(forward[first + lengths - 1], 1)
    page = np.repeat(np.arange(len(lengths)), lengths)
    chance = np.exp(forward + backward - total[page][:, None])
    later = np.setdiff1d(np.arange(len(labels)), first, assume_unique=True)
    pairs = np.exp(forward[later - 1][:, :, None] + moves[None] + (scores[later] + backward[later])[:, None, :] - total[page[later]][:, None, None]).sum(axis=0) if len(later) else np.zeros_like(moves)
    value = total.sum() - scores[np.arange(len(labels)), labels].sum() - moves[labels[later - 1], labels[later]].sum() - begins[labels[first]].sum()
    chance[np.arange(len(labels)), labels] -= 1
    by_block = np.repeat(np.arange(len(sizes)), sizes)
    by_weight = np.stack([np.bincount(ids, weights=chance[by_block, y], minlength=len(weights)) for y in range(chance.shape[1])], axis=1)
    np.subtract.at(pairs, (labels[later - 1], labels[later]), 1)
    return float(value), Model(by_weight, pairs, chance[first].sum(axis=0))


def _flat(m: Model) -> np.ndarray:
    return np.concatenate([m.weights.ravel(), m.moves.ravel(), m.begins])


def _model(x: np.ndarray) -> Model:
    at = FEATURES * LABELS
    return Model(x[:at].reshape(FEATURES, LABELS), x[at : at + LABELS * LABELS].reshape(LABELS, LABELS), x[at + LABELS * LABELS :])


def fit(labelled: DataFrame, squares: float = SQUARES, calls: int = CALLS) -> Model:
    """The field of largest penalised likelihood on labelled pages (column html), a bounded number of them.

    Pages' features are stored once. Each task adds up its pages; the driver gets one number and one gradient (16,390 numbers)
    from each of :data:`TASKS` tasks. Without any labelled page nothing is main text.
    """
    spark = labelled.sparkSession
    with common.scratch(spark):
        # dealt by content, so that tasks are the same in each run
        rows = common.stored(featured(labelled.repartition(TASKS, F.xxhash64("html")).sortWithinPartitions("html")), "featured")
        if rows.isEmpty():
            return Model(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.array([1.0, 0.0]))

        def value_and_gradient(x: np.ndarray) -> tuple[float, np.ndarray]:
            model = _model(x)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                parts = [(*(b.column(i).flatten().to_numpy() for i in range(3)), pa.compute.list_value_length(b.column(1)).to_numpy()) for b in batches if b.num_rows]
                if parts:
                    value, gradient = likelihood(*(np.concatenate(c) for c in zip(*parts, strict=True)), model)
                    yield pa.RecordBatch.from_pydict({"value": [value], "gradient": [_flat(gradient).tobytes()]})

            parts = rows.mapInArrow(run, "value double, gradient binary").collect()
            gradient = sum(np.frombuffer(p.gradient) for p in sorted(parts, key=lambda p: p.value))
            return sum(sorted(p.value for p in parts)) + squares / 2 * (x @ x), gradient + squares * x

        x, _ = minimise(value_and_gradient, np.zeros(FEATURES * LABELS + LABELS * LABELS + LABELS), most_calls=calls, tolerance=1e-4)
    return _model(x)


# --- decoding ---


def viterbi(scores: np.ndarray, model: Model) -> list[int]:
    """The likeliest labels of a page's blocks; of equal ones the smaller label."""
    best, back = model.begins + scores[0], []
    for row in scores[1:]:
        ways = best[:, None] + model.moves
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + row
    labels = [int(best.argmax())]
    for came in reversed(back):
        labels.append(int(came[labels[-1]]))
    return labels[::-1]


def extractor(model: Model) -> Callable[[], Callable[[list], list[list]]]:
    """For :func:`common.map_texts`: main text and its number of code points."""

    def make():
        known: dict[str, int] = {}

        def main(page: str | None) -> str:
            blocks = leaf_blocks(page) if page else []
            if not blocks:
                return ""
            # one by one: a page may have millions of blocks
            scores = np.stack([model.weights[sorted(set(_ids(b.features, known)))].sum(axis=0) for b in blocks])
            return "\n".join(b.text for b, y in zip(blocks, viterbi(scores, model), strict=True) if y)

        def run(pages: list) -> list[list]:
            texts = [main(p) for p in pages]
            return [texts, [len(t) for t in texts]]

        run.done = known.clear
        return run

    return make


def extract(pages: DataFrame, model: Model, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages``' columns ``keep`` (all by default) with text and n_chars of the main text."""
    return common.map_texts(pages, html, extractor(model), [("text", "string"), ("n_chars", "bigint")], keep=keep)
