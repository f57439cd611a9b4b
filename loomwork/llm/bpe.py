"""Operator 8, BPE encoding and decoding by forced-boundary splitting.

No merge can join two bytes that stand side by side in no token of the vocabulary, so a text may be cut between them, if the
pre-tokenizer's matches stay as they are. Every text, of any length, is cut at all such places: :func:`kinds` tells letters,
numbers, other signs and white space apart, and :func:`safe` says between which of them a cut leaves the matches alone. The
fragments are encoded on their own, once while a worker's bounded cache has them, and their ids put together again. Decoding puts
the bytes of the ids' tokens together and reads them as UTF-8.

Nulls count as empty texts (no ids); repeated rows are encoded each; texts of any length are encoded whole; an empty table gives
no rows. A column that has the name of an added one gives way to it.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from functools import cache
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame

from . import common

#: A worker's cache has two generations of so many fragments, or bytes of fragments and their ids; longer fragments are not kept.
CACHE_SIZE, CACHE_BYTES, LONG = 100_000, 8_000_000, 64
#: Fragments that the library encodes at once.
AT_ONCE = 5_000
UNKNOWN, LETTER, NUMBER, OTHER, APOSTROPHE, SPACE, DOUBTFUL = range(7)
#: Code points whose kind all versions of Unicode agree on: up to Cyrillic, punctuation, Kana, CJK, Hangul and full-width forms.
STABLE = ((0, 0x500), (0x2010, 0x2028), (0x2030, 0x205F), (0x3001, 0x3040), (0x3041, 0x3097), (0x309B, 0x3100), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4), (0xFF01, 0xFF5F))
#: Unicode's white space.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Those that some libraries take for white space: no cut beside them.
PERHAPS_WHITE = (*range(0x1C, 0x20), 0x180E, 0x200B, 0xFEFF)


def safe() -> np.ndarray:
    """safe()[a, b]: a cut between characters of kinds a and b leaves the pre-tokenizer's matches as they are.

    A match never goes on from another sign into white space, so a cut before white space is safe; one after it is not, as the
    pattern looks ahead there. Between signs of two kinds every match ends, but for apostrophes: before letters they may open
    a contraction, and after other signs they belong to a run that would not open one. Inside a run of one kind, both parts
    match as runs.
    """
    out = np.zeros((7, 7), bool)
    plain = [LETTER, NUMBER, OTHER]
    out[np.ix_([UNKNOWN, *plain, APOSTROPHE], [SPACE])] = True
    out[np.ix_(plain, plain)] = True
    out[[LETTER, NUMBER], APOSTROPHE] = True
    out[APOSTROPHE, [NUMBER, OTHER]] = True
    return out


SAFE = safe()


@cache
def kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, first byte and last byte (of UTF-8) of the characters below U+10000; the last place is for all others."""
    kind, first, last = (np.zeros(0x10001, np.uint8) for _ in range(3))
    for lo, hi in STABLE:
        for i in range(lo, hi):
            category = unicodedata.category(chr(i))
            kind[i] = {"L": LETTER, "N": NUMBER}.get(category[0], UNKNOWN if category == "Cn" else OTHER)
    kind[ord("'")] = APOSTROPHE
    kind[list(WHITE)] = SPACE
    kind[list(PERHAPS_WHITE)] = DOUBTFUL
    for i in (*range(0xD800), *range(0xE000, 0x10000)):
        data = chr(i).encode()
        first[i], last[i] = data[0], data[-1]
    return kind, first, last


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, others from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary with its certain cuts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normalizer and added spaces is cut here")
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        of, self.token_bytes = byte_characters(), {}
        for token, i in spec["model"]["vocab"].items():
            self.token_bytes[i] = token.encode() if token in self.added else bytes(map(of.__getitem__, token))
        self.token_bytes |= {i: t.encode() for t, i in self.added.items()}
        #: joined[a, b]: some token has byte a before byte b; elsewhere a cut is certain.
        self.joined = np.zeros((256, 256), bool)
        added = set(self.added.values())
        for b in (np.frombuffer(t, np.uint8) for i, t in self.token_bytes.items() if i not in added):
            self.joined[b[:-1], b[1:]] = True
        kind = kinds()[0][:128]
        self.ascii_cuts = SAFE[kind[:, None], kind[None, :]] & ~self.joined[:128, :128]
        self.at_added = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")") if self.added else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cached_bytes = 0

    def fragments(self, text: str) -> list[str]:
        """``text`` (without added tokens) at all of its certain cuts."""
        kind, first, last = kinds()
        if text.isascii():
            codes = np.frombuffer(text.encode(), np.uint8)
            cuts = self.ascii_cuts[codes[:-1], codes[1:]]
        else:
            codes = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0x10000)
            of = kind[codes]
            cuts = SAFE[of[:-1], of[1:]] & ~self.joined[last[codes[:-1]], first[codes[1:]]]
        if "'" in text:  # both letters of a contraction stay together
            letter = np.flatnonzero(codes[:-2] == 39) + 1
            cuts[letter[kind[codes[letter + 1]] == LETTER]] = False
        ends = (np.flatnonzero(cuts) + 1).tolist()
        return [text[a:b] for a, b in pairwise([0, *ends, len(text)])]

    def learn(self, fragments: set[str]) -> list[str]:
        """Ids of fragments that the cache lacks; those of the long ones, which are returned, are not to be kept.

        A full cache becomes the older generation; what is asked for again moves back from there, the rest goes with it.
        """
        if len(self.cache) > CACHE_SIZE or self.cached_bytes > CACHE_BYTES:
            self.cache, self.older, self.cached_bytes = {}, self.cache, 0
        new = []
        for x in fragments:
            if x not in self.cache:
                if ids := self.older.get(x):
                    self.cache[x] = ids
                    self.cached_bytes += len(x) + len(ids)
                else:
                    new.append(x)
        for at in range(0, len(new), AT_ONCE):
            part = new[at : at + AT_ONCE]
            for x, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                i = found.ids
                self.cache[x] = ids = struct.pack(f"<{len(i)}I", *i)
                self.cached_bytes += (len(x) + len(ids)) * (len(x) <= LONG)
        return [x for x in new if len(x) > LONG]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for t in texts:
            sections = [t or ""] if not self.at_added or not t or not any(a in t for a in self.added) else self.at_added.split(t)
            split.append([(s, None) if s in self.added else (s, self.fragments(s)) for s in sections if s])
        long = self.learn({f for sections in split for _, fragments in sections for f in fragments or ()})
        get = self.cache.__getitem__
        out = [b"".join(self.added[s].to_bytes(4, "little") if fragments is None else b"".join(map(get, fragments)) for s, fragments in sections) for sections in split]
        for x in long:
            del self.cache[x]
        return out

    def forget(self) -> None:
        """Empty the caches."""
        self.cache, self.older, self.cached_bytes = {}, {}, 0

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, loaded once in each process."""
    if path not in _codecs:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, text: str = "text", column: str = "ids") -> DataFrame:
    """``docs`` with the array of token ids of ``text`` in ``column``."""

    def make():
        c = codec(path)

        def run(texts):
            return [[np.frombuffer(x, "<u4").astype(np.int32).tolist() for x in c.encode(texts)]]

        run.done = c.forget
        return run

    return common.map_texts(docs, text, make, [(column, "array<int>")])


def decode(rows: DataFrame, path: str, ids: str = "ids", column: str = "text") -> DataFrame:
    """``rows`` with the text of the array ``ids`` in ``column``; it takes the place of a column of that name (null ids: null)."""

    def make():
        c = codec(path)

        def run(columns):
            yield [*columns, [None if x is None else c.decode(np.array(x, "<u4").tobytes()) for x in columns[names.index(ids)]]]

        return run

    rows = rows.drop(column)
    names = rows.columns
    return common.map_batches(rows, make, [*((f.name, f.dataType.simpleString()) for f in rows.schema), (column, "string")])


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the text decoded from them, for each row of ``docs``."""

    def make():
        c = codec(path)

        def run(texts):
            ids = c.encode(texts)
            return [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids]]

        run.done = c.forget
        return run

    out = common.map_texts(docs, text, make, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], keep=[doc_id])
    return out.withColumnRenamed(doc_id, "doc_id")
