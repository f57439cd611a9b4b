"""Operators that look at one text at a time."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomwork.llm import bpe, common, language, licenses, quality, token_counts, toxicity

from .conftest import EDGES

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def random_texts(n, seed=1):
    parts = [*"ab 'sréà　 \n\t\r.!1漢字ll\x1c\u0085‍", "<|endoftext|>", "'re", " à ", "  ", "\n\n", "▁", "Zürich", " the"]
    rng = random.Random(seed)
    return ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(n)]


def test_token_counts_equal_the_library():
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.Lengths({}, PIECES)
    for t in [*random_texts(3000), *filter(None, EDGES)]:
        assert own.of(t) == len(sp.encode(t)), repr(t[:80])


def test_token_counts_over_edges(edge_docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = token_counts.count_tokens(edge_docs, PIECES).collect()
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in edge_docs.collect())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows)
    assert token_counts.count_tokens(empty, PIECES).count() == 0


def test_the_worker_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_SIZE", 5)
    own = token_counts.Lengths({"the": 1}, PIECES)
    assert [own.of(f"the w{i}") for i in range(50)] == [len(token_counts.model(PIECES).encode(f"the w{i}")) for i in range(50)]
    assert len(own) <= 8


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(BYTE_BPE), bpe.Codec(BYTE_BPE)
    for x in [*random_texts(4000), *filter(None, EDGES), "z" * 999 + "漢" * 500]:
        want = t.encode(x, add_special_tokens=False).ids
        got = c.encode([x])[0]
        assert np.frombuffer(got, "<u4").tolist() == want, repr(x[:80])
        assert c.decode(got) == t.decode(want, skip_special_tokens=False)


def test_cuts_are_certain_at_all_lengths():
    c = bpe.Codec(BYTE_BPE)
    own = lambda x: c.tokenizer.encode(x, add_special_tokens=False).ids
    for x in ["".join(random.Random(2).choices("abcéèßñ漢字дж", k=3000)), "it's, 'tis: don't!'s 12a'9 (x)'ll 'rex''d", "a-b_c 3.14 ß'é qz"]:
        parts = c.fragments(x)
        assert len(parts) > 5
        assert "".join(parts) == x
        assert sum(map(own, parts), []) == own(x)
        assert all(not c.joined[a.encode()[-1], b.encode()[0]] for a, b in zip(parts, parts[1:]))
    assert c.fragments("a zqx") == ["a", " z", "q", "x"]  # between two letters of a short text


def test_bpe_equals_the_library_over_many_signs():
    from tokenizers import Tokenizer

    t, c, rng = Tokenizer.from_file(BYTE_BPE), bpe.Codec(BYTE_BPE), random.Random(11)
    kinds = ["abtsremdlvqzj", "ABQZ", "0123456789²½", "''’", ".,!?-_()[]#\"", " ", " \t\n\r\x0b\x0c", "\x1c\x1f\x85\xa0 　​᠎", "éßñüðжщя", "漢字かなカナ한글", "́҇€→", "😀𝔸\U00020000", "ཀ፩ᚠࡰ"]
    for _ in range(6000):
        x = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(1, 40)))
        assert np.frombuffer(c.encode([x])[0], "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_long_fragments_are_not_kept(monkeypatch):
    c = bpe.Codec(BYTE_BPE)
    c.encode(["e" * 5000 + " the"])
    assert set(c.cache) == {" the"}
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20)
    for i in range(9):
        assert c.encode([f"w{i} word"])[0] == np.array(c.tokenizer.encode(f"w{i} word").ids, "<u4").tobytes()
    assert c.cached_bytes < 60


def test_bpe_over_edges(edge_docs, empty):
    rows = bpe.round_trip(edge_docs, BYTE_BPE).collect()
    want = sorted((r.doc_id or -1, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in edge_docs.collect())
    assert sorted((r.doc_id or -1, r.decoded_sha256) for r in rows) == want
    back = bpe.decode(bpe.encode(edge_docs, BYTE_BPE).drop("text"), BYTE_BPE)
    assert sorted((r.text or "") for r in back.collect()) == sorted((r.text or "") for r in edge_docs.collect())
    assert bpe.round_trip(empty, BYTE_BPE).count() == 0


def repeated(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})


def test_measures_equal_brute_force():
    rng = random.Random(3)
    for t in [*EDGES[:9], *EDGES[10:], *(" ".join(rng.choices("abcd", k=rng.randint(0, 40))) + "\n#$ x\n\nx\nx" for _ in range(200))]:
        m, words = quality.Text(t), re.findall(common.WORD, t or "")
        assert (m.n_words, m.word_chars, m.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert m.n_repeat_words == repeated(words)
        lines = [x for x in (t or "").split("\n") if re.search(common.WORD, x)]
        assert m.n_dup_lines == sum(x in lines[:i] for i, x in enumerate(lines))


def test_cascade_orders_by_rejections_per_cost():
    got = quality.ordered(["cheap", "strong", "same"], [1.0, 2.0, 1.0], {0b000: 50, 0b010: 40, 0b101: 10})
    assert [e.rule for e in got] == ["strong", "cheap", "same"]
    assert got[2].rejected_of_left == 0.0
    assert got[2].rejected == 0.1


def test_kept_does_not_depend_on_the_order(docs):
    one = {r.doc_id: r.kept for r in quality.cascade(docs, keep=["doc_id"]).collect()}
    two = {r.doc_id: r.kept for r in quality.cascade(docs, tuple(reversed(quality.RULES)), keep=["doc_id"]).collect()}
    assert one == two
    assert 0 < sum(one.values()) < len(one)


def test_good_documents_are_kept(docs, labels):
    judged = quality.cascade(docs, keep=["doc_id"]).join(labels, "doc_id").where("NOT base_failed")
    assert judged.where("quality = 1 AND NOT kept").count() == 0
    assert judged.where("quality = 0 AND kept").count() <= 1


def test_quality_over_edges(edge_docs, empty):
    rows = quality.cascade(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all(r.base_failed and not r.kept for r in rows if not r.text)
    assert quality.cascade(empty).count() == 0


def test_mixtures_find_both_languages():
    like = np.full((4, 3), 1e-4)
    like[0, 0] = like[1, 1] = like[2, 2] = 0.5
    share = language.languages(like, np.array([30, 70, 0, 1]), penalty=3.0)
    assert share[2] == 0
    assert share[:2] == pytest.approx([0.3, 0.7], abs=0.02)


def test_languages_on_held_out_documents(docs):
    held = common.crc_mod("doc_id", 4) == 2
    found = language.identify(docs.where(held), language.fit(docs.where(~held)), keep=["doc_id", "lang"]).collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_languages_over_edges(edge_docs, docs, empty):
    model = language.fit(docs)
    rows = language.identify(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    assert {r.lang_pred for r in rows if r.text is None or not any(ch.isalpha() for ch in r.text)} == {"und"}
    assert "und" not in {r.lang_pred for r in rows if r.text == "a"}
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.identify(edge_docs, nothing).collect()} == {"und"}


def test_toxicity_on_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    held = common.crc_mod("doc_id", 3) == 1
    model = toxicity.fit(docs.where(~held), labels.where(~held))
    rows = toxicity.score(docs.where(held), model, keep=["doc_id"]).join(labels, "doc_id").collect()
    pairs = [(a.score > b.score) + (a.score == b.score) / 2 for a in rows if a.toxic for b in rows if not b.toxic]
    assert np.mean(pairs) > 0.8
    assert sum(r.score >= 0.7 for r in rows if not r.toxic) <= 2


def test_toxicity_over_edges(edge_docs, docs, labels, empty):
    model = toxicity.fit(docs, labels.unionByName(labels.limit(3)).withColumn("toxic", F.when(F.col("doc_id") % 50 > 0, F.col("toxic"))))
    rows = toxicity.score(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    one_class = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.score < 0.01 for r in toxicity.score(edge_docs, one_class).collect()} == {True}
    assert toxicity.fit(empty, labels).score("x") <= 1
    assert toxicity.fit(docs, labels.where("false")).score("x") < 0.01


def test_language_sets_equal_exhaustive_search():
    """EM and the choice of the set, against plain Python over all subsets of four languages."""
    rng = np.random.RandomState(5)
    right = close = 0
    for trial in range(40):
        table = rng.dirichlet(np.full(60, 0.3), 4).T + 1e-4
        table /= table.sum(0)
        truth = np.zeros(4)
        chosen = rng.choice(4, rng.randint(1, 4), replace=False)
        truth[chosen] = rng.dirichlet(np.full(len(chosen), 4.0))
        counts = rng.multinomial(900, table @ truth)
        seen = counts > 0
        likelihood, counts = table[seen], counts[seen]

        def best_of(subset):
            share = [1 / len(subset)] * len(subset)
            for _ in range(300):
                total = [sum(s * row[k] for s, k in zip(share, subset)) for row in likelihood]
                share = [sum(c * s * row[k] / t for c, row, t in zip(counts, likelihood, total)) / counts.sum() for s, k in zip(share, subset)]
            return sum(c * np.log(sum(s * row[k] for s, k in zip(share, subset))) for c, row in zip(counts, likelihood)), share

        if trial < 6:  # EM itself
            subset = list(range(4))
            got, log = language.mixture(likelihood, counts, rounds=300)
            want, share = best_of(subset)
            assert log == pytest.approx(want, abs=2.0)
            assert got == pytest.approx(share, abs=0.03)
        cost = 3.0 * np.log(counts.sum())
        scores = {s: language.mixture(likelihood[:, list(s)], counts, rounds=300)[1] - cost * len(s) for n in range(1, 5) for s in itertools.combinations(range(4), n)}
        shares = language.languages(likelihood, counts, 3.0)
        mine = tuple(np.flatnonzero(shares).tolist())
        right += mine == max(scores, key=scores.get)
        close += scores[mine] >= max(scores.values()) - cost
        assert shares.sum() == pytest.approx(1)
    assert right >= 36  # growing by one language at a time is greedy
    assert close == 40


def test_language_counts_equal_brute_force(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("Abc abd", "x"), ("bad cab", "y"), ("été à", "y"), (None, "x"), ("zz", None), ("Abc abd", "x")])]
    names, table = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    want = {n: np.full(1 << language.BITS, 0.5) for n in "xy"}
    one, two, three = (int(x) for x in language.MIX)
    m = (1 << 32) - 1
    for _, t, lang in rows:
        if t is None or lang is None:
            continue
        c = [ord(x) for x in f" {t.lower()} "]
        for i in range(len(c)):
            a = c[i] * one & m
            want[lang][(a ^ a >> 15) >> 32 - language.BITS] += 1
            if i + 1 < len(c):
                b = a + (c[i + 1] * two & m) & m
                want[lang][((b ^ b >> 13) * two & m) >> 32 - language.BITS] += 1
            if i + 2 < len(c):
                d = (b * three & m) + (c[i + 2] * one & m) & m
                want[lang][((d ^ d >> 15) * three & m) >> 32 - language.BITS] += 1
    assert names == ["x", "y"]
    for k, n in enumerate(names):
        assert table[:, k] == pytest.approx(want[n] / want[n].sum())


def test_toxicity_equals_brute_force(spark):
    """Features, ratios and scores by plain Python loops; the fit by Newton steps on the same features."""
    rng = random.Random(4)
    bad, good = ["vile", "hate", "scum", "dumb"], ["tree", "lake", "bird", "moss", "fern"]
    rows = [(i, " ".join(rng.choices(good + (bad if i % 3 == 0 else []), k=rng.randint(3, 12))), int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, n_features=50)
    grams = lambda t: {t[i : i + k] for k in (4, 5) for i in range(len(t) - k + 1)}
    of = [grams(f" {t.lower()} ") for _, t, _ in rows]
    number = {}
    for g in set().union(*of):  # a text that is the gram alone has just its hash
        c = np.frombuffer(g.encode("utf-32-le"), np.uint32)
        two = c[:-1] * toxicity.MIX[0] + c[1:] * toxicity.MIX[1]
        two ^= two >> np.uint32(15)
        four = two[:-2] * toxicity.MIX[2] + two[2:] * toxicity.MIX[0]
        h = four[0] ^ four[0] >> np.uint32(15) if len(g) == 4 else (lambda f: (f ^ f >> np.uint32(13)) + toxicity.MIX[0])(four[0] * toxicity.MIX[1] + c[4] * toxicity.MIX[2])
        number[g] = int((h * toxicity.MIX[1]) >> np.uint32(32 - toxicity.BITS))
    feats = [{number[g] for g in gs} for gs in of]
    assert all(f == set(toxicity.hashed(t).tolist()) for f, (_, t, _) in zip(feats, rows))
    n = [sum(y == k for _, _, y in rows) for k in (0, 1)]
    rated = {}
    for f in set().union(*feats):
        k0, k1 = (sum(f in x for x, (_, _, y) in zip(feats, rows) if y == k) for k in (0, 1))
        if k0 + k1 >= 3:
            p, q = (k1 + 1) / (n[1] + 2), (k0 + 1) / (n[0] + 2)
            rated[f] = (abs((p - q) / np.sqrt(p * (1 - p) / n[1] + q * (1 - q) / n[0])), np.log(p / q))
    top = sorted(rated, key=lambda f: (-rated[f][0], f))[:50]
    assert set(np.flatnonzero(model.weights)) <= set(top)
    assert len(np.flatnonzero(model.weights)) >= 45
    x = np.array([[rated[f][1] * (f in fs) for f in top] for fs in feats])
    y = np.array([r[2] for r in rows])
    weight = np.where(y == 1, len(rows) / 2 / n[1], len(rows) / 2 / n[0])
    w, b = np.zeros(50), 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = np.r_[x.T @ (weight * (p - y)) / weight.sum() + 0.001 * w, (weight * (p - y)).sum() / weight.sum()]
        s = weight * p * (1 - p) / weight.sum()
        x1 = np.c_[x, np.ones(len(x))]
        step = np.linalg.solve(x1.T @ (s[:, None] * x1) + np.diag([0.001] * 50 + [1e-9]), g)
        w, b = w - step[:-1], b - step[-1]
    want = 1 / (1 + np.exp(-(x @ w + b)))
    assert [model.score(t) for _, t, _ in rows] == pytest.approx(want, abs=0.02)


def test_crc_is_of_the_id_as_text(docs):
    rows = docs.select("doc_id", common.crc_mod("doc_id", 4).alias("m")).limit(50).collect()
    assert all(r.m == zlib.crc32(str(r.doc_id).encode()) % 4 for r in rows)


def phrase_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_phrases_equal_brute_force(docs):
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)
    texts = [r.text for r in docs.collect()] + EDGES + ["cc by cc-by CC\nBY", "All rights reserved. All rights reserved", "gnu général public license", "xcc by", "under the General  Public\tLicense"]
    for t in texts:
        assert scanner.scan(t)[:5] == phrase_places(t)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("This work is licensed under the Apache License, Version 2.0 (the License)", "apache-2.0"),
        ("Licensed under the Apache License, Version 1.1.", None),
        ("Released under the MIT License.", "mit"),
        ("Released under the terms of the MIT License.", "mit"),
        ("Released under the terms of MIT License.", None),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("Licensed under a Creative Commons CC BY 4.0 International", "cc-by-4.0"),
        ("Copyright 2020 Jane Doe and others. All rights reserved.", "all-rights-reserved"),
    ],
)
def test_templates(text, label):
    got = licenses.Scanner(licenses.TEMPLATES, {}).scan(f"before it {text} after it")
    assert (got[5] or None) == label
    assert got[6] == (1.0 if label else 0.0)


def as_pattern(template):
    """A template read as a regular expression over words between single spaces."""
    out = []
    for part in re.split(r"(<<optional>>|<<end>>|<<any:\d+>>)", template):
        if part == "<<optional>>":
            out.append("(?:")
        elif part == "<<end>>":
            out.append(")?")
        elif part.startswith("<<any:"):
            out.append(r"(?:\S+ ){0,%s}" % part[6:-2])
        else:
            out += [re.escape(w) + " " for w in re.findall(r"[a-z0-9]+", part.lower())]
    return re.compile("(?<= )" + "".join(out))


def test_labels_equal_regular_expressions():
    rng, scanner = random.Random(6), licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)
    patterns = {k: as_pattern(t) for k, t in licenses.TEMPLATES.items()}
    seen = set()
    for name in [*licenses.TEMPLATES] * 25:
        parts = []
        for part in re.split(r"(<<any:\d+>>|<<optional>>|<<end>>)", licenses.TEMPLATES[name]):
            if part.startswith("<<any"):
                parts += rng.choices(["jane", "2024", "the", "é"], k=rng.randint(0, int(part[6:-2]) + (rng.random() < 0.1)))
            elif not part.startswith("<<"):
                parts += part.split() if rng.random() < 0.9 else []
        if parts and rng.random() < 0.3:
            parts[rng.randrange(len(parts))] = "other"
        text = " ".join(["before", "it", *parts, "after", "all", "rights", "reserved"][: rng.randint(len(parts), len(parts) + 6)])
        line = " " + " ".join(w.decode() for w in licenses.words_of(text)) + " "
        labels = {k.split("#")[0] for k, p in patterns.items() if p.search(line)}
        base = {x for x in phrase_places(text)[4].split(",") if x}
        assert scanner.scan(text)[5] == ",".join(sorted(labels | base)), text
        seen |= labels
    assert seen == {k.split("#")[0] for k in licenses.TEMPLATES}


def test_many_places_take_no_longer_each():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)
    began = time.monotonic()
    n = 1_000_000
    got = scanner.scan("All rights reserved. " * n)
    assert got[:4] == (3 * n, n, 0, 3 * (n - 1))
    assert scanner.scan("licensed under the Apache License Version 3 " * 100_000)[5] == ""
    assert time.monotonic() - began < 30


def test_replaceable_regions_are_bounded():
    a = licenses.compile_template("x", "start <<any:2>> middle <<optional>>maybe <<optional>>not<<end>><<end>> end")
    ok = lambda t: a.found([w.encode() for w in t.split()], f" {t} ".encode())
    assert ok("start middle end")
    assert ok("q start a b middle maybe not end q")
    assert ok("start a middle maybe end")
    assert not ok("start a b c middle end")
    assert not ok("start middle not end")
    with pytest.raises(ValueError):
        licenses.compile_template("y", "<<optional>>a<<end>>")


def test_the_full_text_of_a_license():
    text = licenses.TEXTS["mit"].replace("<<any:8>>", "THE AUTHORS OR COPYRIGHT HOLDERS").replace("<<any:12>>", "(c) 2024 Some Body")
    text = re.sub(r"<<\w+>>", "", text)
    assert "mit" in licenses.Scanner(licenses.TEMPLATES, {}).scan(text)[5].split(",")
    assert licenses.Scanner(licenses.TEMPLATES, {}).scan(text.replace("sublicense", "resell"))[5] == ""


def test_licenses_over_edges(edge_docs, empty):
    rows = licenses.scan(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all((r.n_words, r.n_base, r.first_word, r.labels, r.score) == (0, 0, None, "", 0.0) for r in rows if not r.text)
    assert licenses.scan(empty).count() == 0


@pytest.mark.parametrize("label", ["mit", "isc", "bsd-2-clause", "bsd-3-clause", "zlib", "unlicense"])
def test_a_cut_wording_is_no_license(label):
    text = re.sub(r"<<(optional|end)>>", "", licenses.TEXTS[label])
    text = re.sub(r"<<any:\d+>>", "someone", text)
    found = lambda t: licenses.Scanner(licenses.TEMPLATES, {}).scan(t)[5].split(",")
    words = text.split()
    assert label in found(text)
    assert label not in found(" ".join(words[:-3])) and label not in found(" ".join(words[: len(words) // 2]))
    assert label not in found("... by any means for a fee of ten dollars " + " ".join(words[:40]))


def test_base_rules_are_part_of_the_cascade(docs, monkeypatch):
    """Where the verdict alone is asked for, the dearest rule is the last, and a short text never comes to it."""
    rules = (*quality.BASE, *quality.RULES)
    names = [e.rule for e in quality.estimate(docs, rules, after_base=False)]
    assert sorted(names) == sorted(r.name for r in rules) and names.index("too_few_words") < names.index("repeated_words")
    order = tuple({r.name: r for r in rules}[n] for n in names)
    windows = []
    real = quality.Text.n_repeat_words.func
    monkeypatch.setattr(quality.Text, "n_repeat_words", property(lambda t: (windows.append(t.n_words), real(t))[1]))
    texts = [r.text for r in docs.collect()] + EDGES + ["word " * 49, "word " * 50]
    got = [quality.passes(t, order) for t in texts]
    assert windows and min(windows) >= 50
    assert got == [not any(r.rejects(quality.Text(t)) for r in rules) for t in texts]
    kept = sorted(r.doc_id for r in quality.accepted(docs).collect())
    assert kept == sorted(r.doc_id for r in quality.cascade(docs, keep=["doc_id"]).where("kept").collect())
