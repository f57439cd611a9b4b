"""Operator 3, language identification by multilingual mixture inference.

Each language has a model of its hashed character n-grams (one to three characters, lower-cased, over word borders).
A text is taken for a mixture: expectation-maximisation estimates the share of each language in it from the n-grams'
likelihoods. The set of languages grows from the best single one while the log-likelihood gains more than a penalty for
each language added. The language with the largest share is the text's, and the share is its score.

The models are fitted on a bounded sample of labelled texts (``sample_rows`` of each language, drawn by their ids), of
``MOST_LANGUAGES`` languages at most: a table of more would not be broadcast, and is refused. Texts that are null or
have no letter are ``und`` with score 0; texts of any length are read whole; where nothing is learned, every text is
``und``. Repeated rows are predicted each, and count each where they are learned from. An empty table gives no rows. A column
that has the name of an added one gives way to it.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS, MOST_LANGUAGES = 16, 500
LETTER = regex.compile(r"\p{L}")
#: Odd multipliers of the n-gram hash.
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed n-grams of a text and their counts."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    one = c * MIX[0]
    two = one[:-1] + c[1:] * MIX[1]
    three = two[:-1] * MIX[2] + c[2:] * MIX[0]
    h = np.concatenate([one ^ (one >> 15), (two ^ (two >> 13)) * MIX[1], (three ^ (three >> 15)) * MIX[2]]) >> (32 - BITS)
    if len(h) < 1500:
        return np.unique(h, return_counts=True)
    counts = np.bincount(h, minlength=1 << BITS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def mixture(likelihood: np.ndarray, counts: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Shares of the languages (columns of ``likelihood``; a row for each n-gram) by EM, and the log-likelihood."""
    n, share = counts.sum(), np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    last = -np.inf
    for _ in range(rounds):
        of = likelihood * share
        total = of.sum(1)
        now = float(counts @ np.log(total))
        share = (counts / total) @ of / n
        if now - last < 1e-3 * max(1.0, -now * 1e-4):
            break
        last = now
    return share, now


def gain(mix: np.ndarray, other: np.ndarray, counts: np.ndarray, steps: int = 5) -> float:
    """By how much the log-likelihood grows at the best share of one more language: a concave function of the share, by Newton steps."""
    r = other / mix - 1
    slope = counts @ r
    if slope <= 0:
        return 0.0
    x, of, weighed = 0.0, r, counts * r
    for _ in range(steps):
        curve = weighed @ (of / (1 + x * r))
        x = min(max(x + slope / max(curve, 1e-12), 0.0), 0.999)
        of = r / (1 + x * r)
        slope = counts @ of
        if abs(slope) < 1e-3 * counts.sum():
            break
    return float(counts @ np.log1p(x * r))


def languages(likelihood: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Shares of all languages, 0 outside the set that the penalised likelihood selects."""
    chosen, share = [int((counts @ np.log(likelihood)).argmax())], np.ones(1)
    cost = penalty * np.log(max(counts.sum(), 2))
    while len(chosen) < likelihood.shape[1]:
        mix = likelihood[:, chosen] @ share
        grown, x = max((gain(mix, likelihood[:, x], counts), x) for x in range(likelihood.shape[1]) if x not in chosen)
        if grown <= cost:
            break
        chosen.append(x)
        share, _ = mixture(likelihood[:, chosen], counts)
    out = np.zeros(likelihood.shape[1])
    out[chosen] = share
    return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = 1500, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """The languages in order and the probability of each hashed n-gram in each, from about ``sample_rows`` texts of each."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    by_lang = {r.lang: r.n for r in rows.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(by_lang) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not by_lang:
        return [], np.zeros((1 << BITS, 0))
    wanted = F.lit(False)
    for name, n in by_lang.items():
        wanted = wanted | ((F.col("lang") == name) & common.rows_by_hash("key", 1.2 * sample_rows / n, "language"))

    def make():
        def count(columns):
            total: dict[str, np.ndarray] = {}
            for t, name in zip(*columns, strict=True):
                found, n = grams(t)
                total.setdefault(name, np.zeros(1 << BITS, np.int64))[found] += n
            for name, x in total.items():
                found = np.flatnonzero(x)
                yield [[name] * len(found), found.tolist(), x[found].tolist()]

        return count

    sample = rows.where(wanted & F.col("text").isNotNull()).select("text", "lang")
    counted = common.map_batches(sample, make, [("lang", "string"), ("gram", "int"), ("n", "long")]).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    names = sorted(by_lang)
    table = np.full((1 << BITS, len(names)), smoothing)
    found = counted.toArrow()  # no more than 2^BITS rows for each language
    np.add.at(table, (found["gram"].to_numpy(), [names.index(x) for x in found["lang"].to_pylist()]), found["n"].to_numpy())
    return names, table / table.sum(0)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: list[str] | None = None, penalty: float = 3.0) -> DataFrame:
    """``docs``' columns ``keep`` (all by default) with ``lang_pred``, its ``score`` and ``lang_shares``, the set of languages with their shares."""
    names = model[0]
    shared = docs.sparkSession.sparkContext.broadcast(model[1].astype(np.float32))

    def make():
        table = shared.value

        def predict(texts):
            out: list[list] = [[], [], []]
            for t in texts:
                if not names or t is None or not LETTER.search(t):
                    row = "und", 0.0, {}
                else:
                    found, n = grams(t)
                    shares = languages(table[found].astype(np.float64), n, penalty)
                    best = int(shares.argmax())
                    row = names[best], min(1.0, float(shares[best])), {names[i]: float(shares[i]) for i in np.flatnonzero(shares)}
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            out[2] = [list(x.items()) for x in out[2]]
            return out

        return predict

    return common.map_texts(docs, text, make, [("lang_pred", "string"), ("score", "double"), ("lang_shares", "map<string,double>")], keep=keep)
