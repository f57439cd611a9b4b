"""Operator 4, token counts: a map-side lookup in two tiers.

The pieces of a sentencepiece model whose only marks of white space stand at their start never reach over the border
between a word and the spaces after it, so a text's tokens are those of its pre-tokens (spaces, then a word), one by one.
Tier one is a broadcast table of the lengths of frequent pre-tokens; it is counted on a bounded sample
(``sample_rows`` documents, ``table_size`` pre-tokens), which decides on speed alone. Tier two is a bounded cache in
each Python worker, filled by the library for whatever the table lacks. No pre-token of the corpus is shuffled.

Nulls count as empty texts (0 bytes, 0 tokens); repeated rows are counted each; texts of any length are counted whole; an empty
table gives no rows. Columns that are not named do not matter.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
PRE_TOKEN = re.compile(" +[^ ]*")
#: Entries, and characters of them, in a worker's cache before it starts anew; longer pre-tokens are not kept.
CACHE_SIZE, CACHE_CHARS, LONG = 200_000, 4_000_000, 64

_models: dict[str, object] = {}


def model(path: str):
    """The library's model, loaded once in each process; it must keep marks of white space at the start of its pieces."""
    if path not in _models:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(MARK in m.id_to_piece(i).lstrip(MARK) for i in range(m.vocab_size())) or m.encode("a", out_type=str)[0][0] != MARK:
            raise ValueError("pieces reach over white space, or the model adds none before a text: its pre-tokens are not independent")
        _models[path] = m
    return _models[path]


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space, which the library adds again."""
    if MARK in text:  # the library takes the mark and a space for the same
        text = text.replace(MARK, " ")
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return [x[1:] for x in PRE_TOKEN.findall(" " + text)]
    return text.split(" ") if text else []


class Lengths(dict):
    """Tokens by pre-token: the broadcast table, then what the library gave for others."""

    def __init__(self, table: dict[str, int], path: str):
        super().__init__(table)
        self.table, self.encode, self.held = table, model(path).encode, 0
        self.lone_space = len(self.encode("a ")) - len(self.encode("a"))

    def __missing__(self, key: str) -> int:
        n = len(self.encode(key)) if key else self.lone_space
        if len(key) <= LONG:
            if len(self) > len(self.table) + CACHE_SIZE or self.held > CACHE_CHARS:
                self.clear()
                self.update(self.table)
                self.held = 0
            self[key] = n
            self.held += len(key)
        return n

    def of(self, text: str) -> int:
        return sum(map(self.__getitem__, pre_tokens(text)))


def frequent(docs: DataFrame, text: str, path: str, sample_rows: int, table_size: int, key: str = "doc_id") -> dict[str, int]:
    """Lengths of the ``table_size`` most frequent pre-tokens of about ``sample_rows`` documents, drawn by their ids."""

    def make():
        def count(columns):
            found = Counter()
            for t in columns[0]:
                found.update(pre_tokens(t or ""))
            yield [list(found), list(found.values())]

        return count

    sample = common.sample_by_hash(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "key", sample_rows, "pre-tokens").select("text")
    counted = common.map_batches(sample, make, [("piece", "string"), ("n", "long")]).groupBy("piece").agg(F.sum("n").alias("n"))
    top = [r.piece for r in counted.where("length(piece) BETWEEN 1 AND 40 AND n > 1").orderBy(F.desc("n"), "piece").limit(table_size).collect()]
    return dict(zip(top, map(len, model(path).encode(top)), strict=True)) if top else {}


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096, sample_rows: int = 4000, table_size: int = 50_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, text, path, sample_rows, table_size, doc_id))

    def make():
        of = Lengths(shared.value, path).of  # a cache for each task: none stays in the worker

        def count(texts):
            n = [of(t) if t else 0 for t in texts]
            return [[len(t.encode()) if t else 0 for t in texts], n, [x > limit for x in n]]

        return count

    out = common.map_texts(docs, text, make, [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")], keep=[doc_id])
    return out.withColumnRenamed(doc_id, "doc_id")
