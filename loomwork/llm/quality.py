"""Operator 1, quality rules as a short-circuit cascade.

Each rule says of a text's measures whether it rejects the text. Where they are asked for (:func:`cascade`), the base measures are computed for
every text; on a bounded sample (``sample_rows`` documents) each rule is timed after them, so that its cost is what the cascade pays for it, and its
verdicts are noted. The cascade then takes, again and again, the rule with the most rejections among the texts that are left,
per second. Over the corpus a text goes through the rules in that order up to the first that rejects it. The order decides on
time alone: a text is kept if no rule rejects it.

A null text has no words and fails the base rules. Texts of any length are measured whole; repeated rows are judged each; an
empty table gives no rows, and rules in their given order. A column that has the name of an added one gives way to it
(:func:`cascade`), or stays as it was (:func:`accepted`).
"""

from __future__ import annotations

import copy
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
LOWER, UPPER = bytes(range(97, 123)), bytes(range(65, 91))
#: Deleted to leave letters, bytes of characters outside ASCII and white space.
NO_LETTER = bytes(b for b in range(128) if not chr(b).isalpha() and b not in common.SPACES)


class Text:
    """Measures of a text, each computed when it is first asked for."""

    def __init__(self, text: str | None):
        self.chars = len(text or "")
        self.data = (text or "").encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return self.chars - len(self.data) + len(self.data.translate(None, common.SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three words that the text has twice or more."""
        n = len(self.words)
        if n < 4:
            return 0
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, n)
        pairs = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)[1]
        _, window, times = np.unique(pairs * len(number) + ids[2:], return_inverse=True, return_counts=True)
        again = times[window] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : n - 2 + shift] |= again
        return int(covered.sum())

    @cached_property
    def n_upper(self) -> int:
        return len(self.data) - len(self.data.translate(None, UPPER))

    @cached_property
    def n_lower(self) -> int:
        return len(self.data) - len(self.data.translate(None, LOWER))

    @cached_property
    def n_letter_words(self) -> int:
        """Words with an ASCII letter or a character outside ASCII."""
        return len(self.data.translate(None, NO_LETTER).split())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: The rules that every text must pass first: enough words, and no more than half of them in repeated windows.
BASE = (
    Rule("too_few_words", lambda t: t.n_words < 50),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
#: The rules of the cascade. Bounds are shares as integers, so that no rounding decides.
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("capitals", lambda t: t.n_upper > t.n_lower),
    Rule("repeated_lines", lambda t: 10 * t.n_dup_lines > 4 * len(t.lines)),
    Rule("word_length", lambda t: t.word_chars < 3 * t.n_words or t.word_chars > 12 * t.n_words),
    Rule("words_without_letters", lambda t: 5 * t.n_letter_words < 4 * t.n_words),
)


@dataclass(frozen=True)
class Estimate:
    """What a sample shows of a rule: seconds for a text, and rejected texts of all and of those that earlier rules left."""

    rule: str
    seconds: float
    rejected: float
    rejected_of_left: float


def ordered(names: list[str], seconds: list[float], verdicts: dict[int, int]) -> list[Estimate]:
    """Rules by rejections per cost. ``verdicts``: texts by the set of rules that reject them, rule i as bit i."""
    total, left, todo, out = sum(verdicts.values()), dict(verdicts), set(range(len(names))), []
    while todo:
        n = sum(left.values())
        hits = {i: sum(k for v, k in left.items() if v >> i & 1) for i in todo}
        best = min(todo, key=lambda i: (-hits[i] / max(seconds[i], 1e-9), seconds[i], i))
        out.append(Estimate(names[best], seconds[best], sum(k for v, k in verdicts.items() if v >> best & 1) / max(total, 1), hits[best] / max(n, 1)))
        left = {v: k for v, k in left.items() if not v >> best & 1}
        todo.discard(best)
    return out


def base_measures(t: Text) -> tuple:
    return t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, any(r.rejects(t) for r in BASE)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 2000, key: str = "doc_id", after_base: bool = True) -> list[Estimate]:
    """The order of the cascade with its grounds, from about ``sample_rows`` documents, read once.

    A rule's cost is the time that it takes on a text whose base measures are there already, and texts that fail the base rules
    do not come to the cascade and count for nothing; without ``after_base`` all texts do, and a rule pays for all but the text's words.
    """

    def make():
        def measure(columns):
            spent, found, n = [0] * len(rules), Counter(), 0
            for t in columns[0]:
                measured = Text(t)
                if after_base and base_measures(measured)[-1]:
                    continue
                measured.words  # noqa: B018  what nearly all rules begin with
                verdict = 0
                for i, rule in enumerate(rules):
                    own, began = copy.copy(measured), time.perf_counter_ns()
                    verdict |= bool(rule.rejects(own)) << i
                    spent[i] += time.perf_counter_ns() - began
                found[verdict] += 1
                n += 1
            yield [[n, *[0] * len(found)], [spent, *[[]] * len(found)], [None, *found], [0, *found.values()]]

        return measure

    sample = common.sample_by_hash(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "key", sample_rows, "quality").select("text")
    with common.scratch(docs.sparkSession):
        seen = common.stored(common.map_batches(sample, make, [("rows", "long"), ("spent", "array<long>"), ("verdict", "long"), ("n", "long")]), "quality-sample")
        costs = [F.sum(F.try_element_at("spent", F.lit(i + 1))).alias(f"c{i}") for i in range(len(rules))]
        whole = seen.agg(F.sum("rows").alias("rows"), *costs).first()
        verdicts = {r["verdict"]: r["n"] for r in seen.where("verdict IS NOT NULL").groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
    rows = whole["rows"] or 0
    return ordered([r.name for r in rules], [(whole[f"c{i}"] or 0) / 1e9 / max(rows, 1) for i in range(len(rules))], verdicts)


BASE_FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean")]


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, names: str = "", sample_rows: int = 2000) -> DataFrame:
    """``docs``' columns ``keep`` (all by default) with base measures, ``base_failed`` and the cascade's verdict ``kept``.

    ``names`` is put before the added columns' names, for tables that have such columns.
    """
    by_name = {r.name: r for r in rules}
    order = tuple(by_name[e.rule] for e in estimate(docs, rules, text, sample_rows, key))

    def make():
        def judge(texts):
            out: list[list] = [[] for _ in BASE_FIELDS]
            for t in map(Text, texts):
                row = base_measures(t)
                for column, value in zip(out, (*row, not row[-1] and not any(r.rejects(t) for r in order)), strict=True):
                    column.append(value)
            return out

        return judge

    return common.map_texts(docs, text, make, [(names + n, t) for n, t in BASE_FIELDS], keep=keep)


def passes(text: str | None, order: tuple[Rule, ...]) -> bool:
    """Whether no rule rejects a text; it is measured no further than the first that does."""
    t = Text(text)
    return not any(r.rejects(t) for r in order)


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id", sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs`` that neither a base rule nor another rejects, with their columns.

    Where only the verdict is asked for, base rules are rules of the cascade like the others: their costs and rejections decide on their
    place, so that few texts come to the count of repeated windows, the dearest of all.
    """
    by_name = {r.name: r for r in (*BASE, *rules)}
    order = tuple(by_name[e.rule] for e in estimate(docs, tuple(by_name.values()), text, sample_rows, key, after_base=False))

    def make():
        return lambda texts: [[passes(t, order) for t in texts]]

    kept = common.free_name("kept", *docs.columns)
    return common.map_texts(docs, text, make, [(kept, "boolean")], keep=docs.columns).where(F.col(kept)).select(*(F.col(f"`{c}`") for c in docs.columns))
