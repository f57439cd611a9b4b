"""Operators that relate documents to each other, and the pipeline."""

import base64
import gzip
import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import common, components, edit_prints, mixing, queries, simhash, toxicity, warc

from .conftest import DATA, EDGES


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- archives ---


@pytest.fixture
def pages(spark):
    rows = [(5, "http://a/x", "same"), (3, "http://a/y\r\nEvil: 1", "same"), (9, None, "same"), (7, "http://b", None), (8, "http://c", ""), (1, "http://d", "body\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3), (2, "http://é", "ünï" * 50_000), (None, "http://n", "lone"), (3, "http://a/y", "same")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("first", F.lit(1))


def archive(spark, pages, **options):
    path = common.shared_path(spark, "test-warc")
    warc.write(pages, path, **options)
    return warc.read(spark, path)


def test_archives_round_trip(spark, pages):
    found = warc.captures(archive(spark, pages)).collect()
    got = {}
    for r in found:
        page = int(m[1]) if (m := re.search(r"capture:(-?\d+):", r.record_id)) else None
        got.setdefault(page, (r.payload_bytes, r.payload_digest, r.record_type, m[1] if (m := re.search(r"capture:(-?\d+):", r.refers_to or "")) else ""))
        assert (r.n_requests, r.n_metadata) == (1, 1)
        assert r.request.block.startswith(b"GET ")
    assert len({r.record_id for r in found}) == len(found) == pages.count()
    assert {r.refers_to for r in found} - {None} <= {r.record_id for r in found if r.record_type == "response"}
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert got[3] == (4, digest("same"), "response", "")
    assert got[5] == (4, digest("same"), "revisit", "3")
    assert got[9] == (4, digest("same"), "revisit", "3")
    assert got[7] == (0, digest(""), "response", "")
    assert got[8] == (0, digest(""), "revisit", "7")
    assert got[1][0] == 3 * len("body\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n")
    assert got[2] == (len(("ünï" * 50_000).encode()), digest("ünï" * 50_000), "response", "")
    assert got[None][2] == "response"


def test_repeated_and_null_ids_do_not_cross(spark):
    """Pages with one id, or none, and unlike payloads keep their own request and metadata."""
    rows = [(1, "http://a", "A"), (1, "http://b", "B"), (None, "http://c", "C"), (None, "http://d", "D"), (1, "http://a", "A"), (2, "http://e", "A")]
    found = warc.captures(archive(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(found) == 6 and {(r.n_requests, r.n_metadata) for r in found} == {(1, 1)}
    for r in found:
        assert r.request.block.decode().split(" ")[1] == r.target_uri == r.metadata.target_uri
        assert r.request.record_id == r.record_id.replace(":response>", ":request>")
    assert sorted((r.target_uri[-1], r.record_type) for r in found) == [("a", "response"), ("a", "response"), ("b", "response"), ("c", "response"), ("d", "response"), ("e", "revisit")]


def test_small_payloads_may_be_kept_whole(spark, pages):
    kinds = {r.record_id: r.record_type for r in warc.captures(archive(spark, pages, least_bytes=5)).collect()}
    assert set(kinds.values()) == {"response"}


def test_empty_archive(spark, pages):
    assert warc.captures(archive(spark, pages.where("false"))).count() == 0


def test_other_writers_archives(spark, tmp_path):
    def record(kind, i, block, *more):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{i}>", *more, f"Content-Length: {len(block)}"]
        return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    http = "Content-Type: application/http;msgtype=response"
    data = [record("warcinfo", "w", b"x: y"), record("response", "r1", b"HTTP/1.1 200 OK\r\n\r\nhi", http, "WARC-Concurrent-To: <urn:q1>"), record("request", "q1", b"GET /"), record("metadata", "m1", b"a: b", "WARC-Concurrent-To: <urn:q1>"), record("response", "r2", b"HTTP/1.1 200 OK\r\n\r\nho", http), record("request", "q2", b"GET /2", "WARC-Concurrent-To: <urn:r2>")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    (tmp_path / "b.warc").write_bytes(record("response", "r3", b"HTTP/1.1 200 OK\r\n\r\n", http))
    rows = {r.record_id: r for r in warc.captures(warc.read(spark, str(tmp_path))).collect()}
    assert set(rows) == {"<urn:r1>", "<urn:r2>", "<urn:r3>"}
    assert rows["<urn:r1>"].request.block == b"GET /"
    assert rows["<urn:r1>"].metadata.block == b"a: b"
    assert rows["<urn:r2>"].request.record_id == "<urn:q2>"
    assert (rows["<urn:r3>"].request, rows["<urn:r3>"].n_requests, rows["<urn:r3>"].payload_bytes) == (None, 0, 0)


# --- mixing ---


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        each = {s: budget * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if each[s] >= epochs * sizes[s]}
        if not over:
            return target | each
        for s in over:
            target[s] = epochs * sizes[s]
            budget -= target[s]
        open_ -= over
    return target


def check_mix(rows, sources):
    sizes = {}
    for r in rows:
        sizes[sources[r.doc_id]] = sizes.get(sources[r.doc_id], 0) + r.size
    want = brute_targets(sizes)
    taken = {}
    for r in rows:
        s = sources[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s], abs=1e-3)
        assert 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    return {s: (taken[s], want[s]) for s in sizes}


def test_mix_meets_its_targets(docs):
    rows = mixing.mix(docs).collect()
    for got, want in check_mix(rows, {r.doc_id: r.source for r in docs.collect()}).values():
        assert got == int(want)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_mix_in_many_ranges(docs, monkeypatch):
    want = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == want


def test_mix_over_edges(edge_docs, empty):
    rows = mixing.mix(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all(r.size == r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix(empty).count() == 0
    assert mixing.mixture(empty).count() == 0


def test_the_mixture_has_the_words_taken(docs):
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = {}
    for r in mixing.mixture(docs).collect():
        assert texts[r.doc_id].startswith(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
    assert words == {i: t for i, (_, t) in taken.items() if t}


def test_repeated_rows_share_the_cut(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s")] * 10 + [(2, "a b", "t")] * 3, "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 13
    for got, want in check_mix(rows, {1: "s", 2: "t"}).values():
        assert want - 13 <= got <= want


# --- SimHash ---


def brute_fingerprint(text, width=3):
    words = re.findall(common.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    import xxhash

    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), seed=42) for i in range(max(1, len(words) - width + 1))]
    return sum((2 * sum(x >> i & 1 for x in h) > len(h)) << i for i in range(64))


def test_fingerprints_equal_brute_force(docs):
    texts = [r.text for r in docs.limit(60).collect()] + [t for t in EDGES if len(t or "") < 10_000]
    assert [simhash.fingerprint(t) & (1 << 64) - 1 for t in texts] == [brute_fingerprint(t) for t in texts]


def test_components_of_documents(spark):
    path = f"{DATA}/documents.parquet"
    rows = spark.read.parquet(path).collect()
    fp = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    want = classes([(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 2], fp)
    got = queries.op7_simhash(spark, DATA).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {i: format(x, "016x") for i, x in fp.items()}


@pytest.mark.parametrize("distance", [1, 2])
def test_links_in_large_groups(spark, distance):
    rng = random.Random(distance)
    fps = set()
    for i in range(12):
        base = rng.getrandbits(64)
        for _ in range(150 if i < 2 else 8):
            x = base
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    want = classes([(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance], fps)
    linked = {n for n, r in want.items() if n != r} | {r for n, r in want.items() if n != r}
    got = components.components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), distance)).collect()
    assert {r.node: r.root for r in got} == {n: want[n] for n in linked}


def test_chains_end_at_their_smallest_node(spark):
    chain = [(i, i + 1) for i in range(0, 199)] + [(1000, 1001), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(200), 0) | {1000: 1000, 1001: 1000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_over_edges(edge_docs, empty):
    rows = simhash.groups(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert len({r.component_id for r in rows if r.fp == 0}) == 1
    assert simhash.groups(empty).count() == 0


def edited(text, words, rng, share):
    w = text.split(" ")
    for _ in range(max(1, int(share * len(w)))):
        w[rng.randrange(len(w))] = rng.choice(words)
    return " ".join(w)


def near_classes(texts, least=0.8):
    """The class of every text, by all pairs."""
    sets = {n: simhash.shingle_set(t, 5) for n, t in texts.items() if t is not None}
    return classes([(a, b) for a, b in itertools.combinations(sets, 2) if texts[a] == texts[b] or (len(sets[a]) and simhash.similarity(sets[a], sets[b]) >= least)], texts)


def test_near_copies_equal_brute_force(spark, docs):
    rng = random.Random(7)
    base = [r.text for r in docs.collect() if 80 < len(r.text.split()) < 2000][:60]
    words = " ".join(base[:9]).split()
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, edited(t, words, rng, 0.02)) for i, t in enumerate(base)]
    rows += [(200 + i, base[0]) for i in range(20)] + [(300 + i, edited(base[1], words, rng, 0.01)) for i in range(40)] + [(400, None), (None, base[2]), (401, ""), (402, ""), (403, "a b"), (404, "A b"), (2, base[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_classes(dict(enumerate(t for _, t in rows)))
    first = {r: min((rows[n][0] for n, x in want.items() if x == r and rows[n][0] is not None), default=None) for r in want.values()}
    size = {r: sum(x == r for x in want.values()) for r in want.values()}
    got = sorted((r.doc_id or -1, r.class_id, r.class_size) for r in simhash.near_copies(df).collect())
    assert got == sorted((i or -1, first[want[n]], size[want[n]]) for n, (i, _) in enumerate(rows))
    kept = sorted(r.doc_id for r in simhash.without_copies(df).collect())
    assert kept == sorted(first.values())
    assert simhash.without_copies(df.where("false")).count() == 0
    assert simhash.near_copies(df.where("false")).count() == 0
    alone = {r.root for r in simhash.classes(df, signatures_alone=True)[1].collect()}
    assert len(alone) <= 1.1 * (len(set(want.values())))  # what signatures miss is little here


def test_groups_of_drifting_copies_lose_no_link(spark):
    """Groups far above MOST_COMPARED, with members unlike their head, next to a passage that all share."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passage, rows = " ".join(word() for _ in range(120)), []
    for g in range(3):
        line = [word() for _ in range(400)]
        for i in range(40):  # neighbours are alike, distant ones are not
            rows.append((1000 * g + i, " ".join(line[3 * i : 3 * i + 100])))
    rows += [(5000 + i, passage + " " + " ".join(word() for _ in range(18 + i % 30))) for i in range(60)]
    rng.shuffle(rows)
    want = near_classes(dict(rows))
    got = {r.doc_id: r.class_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert 3 < len(set(want.values())) < 100


def test_repeated_ids_keep_their_texts(spark):
    a, b = (" ".join(random.Random(i).choices("abcdefghijklmnop", k=60)) for i in range(2))
    rows = [(1, a, 0), (2, a, 0), (2, b, 0), (2, b, 1), (None, a, 0), (None, None, 5), (None, None, 5), (3, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id int")
    kept = simhash.without_copies(df).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(1, a), (2, b), (0, ""), (0, ""), (3, "")])
    assert df.columns == simhash.without_copies(df).columns
    only_null = spark.createDataFrame([(None, a, 0), (None, a, 0)], df.schema)
    assert simhash.without_copies(only_null).count() == 1


def test_prefixes_are_exact_in_any_order(spark):
    rng = np.random.RandomState(4)
    for _ in range(300):
        n = rng.randint(1, 60)
        x = np.unique(rng.randint(0, 1 << 62, n).astype(np.uint64))
        y = np.union1d(x[rng.rand(len(x)) > rng.rand() * 0.3], rng.randint(0, 1 << 62, rng.randint(0, 6)).astype(np.uint64))
        if not len(y) or simhash.similarity(x, y) < 0.8:
            continue
        counts = rng.randint(0, 5, 1 << simhash.BUCKET_BITS)
        large, small = sorted((x, y), key=len, reverse=True)
        probe = simhash.rarest_first(large, counts)[: len(large) - int(np.ceil(0.8 * len(large) - 1e-9)) + 1]
        index = simhash.rarest_first(small, counts)[: len(small) - int(np.ceil(1.6 / 1.8 * len(small) - 1e-9)) + 1]
        assert len(np.intersect1d(probe, index))


def test_parities_differ_no_more_than_sets(spark):
    random = np.random.RandomState(6)
    for n in (0, 5, 300, 4000):
        a, b = (np.unique(random.randint(0, 1 << 62, n).astype(np.uint64)) for _ in range(2))
        b = np.union1d(a[: n // 2], b[: n // 3])
        for x, y in ((simhash.folded(simhash.set_bits(s)) for s in (a, b)),):
            assert sum((int(i) & (1 << 64) - 1).bit_count() for i in x ^ y) <= len(np.setxor1d(a, b))
        long, short = sorted((simhash.set_bits(a), simhash.set_bits(b)), key=len, reverse=True)
        if len(long) <= 2 * len(short):
            frame = spark.createDataFrame([(long.tolist(), short.tolist())], "x array<long>, y array<long>")
            r = frame.select(simhash.differing("x", "y").alias("d"), simhash.differing("y", "x").alias("e")).first()
            want = sum((int(i) & (1 << 64) - 1).bit_count() for i in np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0) ^ short)
            assert (r.d, r.e) == (want, want)
            assert want <= len(np.setxor1d(a, b))


def test_scratch_tables_go_and_results_stay(spark, docs):
    import os

    folder = common.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with common.scratch(spark) as result:
        common.stored(docs.limit(3), "gone")
        kept = result(docs.limit(2), "kept")
    assert kept.count() == 2
    assert [x.split("-")[1] for x in set(os.listdir(folder)) - before if not x.startswith(".")] == ["kept"]
    assert common.free_name("A", "a", "_a") == "__A"


# --- edit fingerprints ---


def brute_edits(rows):
    rows = sorted(rows)
    out = {}
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1] or ""
        text = text or ""
        n = len(text) // 4
        e = text[: len(text) - n] + following[:n]
        fp, fe, fn = map(edit_prints.fingerprint, (text, e, following))
        out[doc] = (len(text), hashlib.sha256(e.encode()).hexdigest(), fp, fe, edit_prints.likeness(fp, fe), edit_prints.likeness(fp, fn))
    return out


@pytest.mark.parametrize("chars", [24_000_000, 40_000])
def test_edits_equal_brute_force(docs, chars, monkeypatch):
    monkeypatch.setattr(edit_prints, "RANGE_CHARS", chars)
    got = {r[0]: tuple(r[1:]) for r in edit_prints.with_edits(docs.repartition(3)).collect()}
    assert got == brute_edits([(r.doc_id, r.text) for r in docs.collect()])


def test_one_id_with_many_texts_is_cut(spark, monkeypatch):
    monkeypatch.setattr(edit_prints, "RANGE_CHARS", 3000)
    rng = random.Random(3)
    rows = [(rng.choice([7, 7, 7, None, 2, (1 << 60) + 1, -5]), "".join(rng.choices("abcdefg ", k=rng.randint(1, 400)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tied = {(r.doc_id, r.text): r.tie for r in df.withColumn("tie", F.xxhash64("text")).collect()}
    order = sorted(set(rows), key=lambda x: (-(1 << 63) if x[0] is None else x[0], tied[x]))
    sizes = df.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("tie"), (F.length("text") + 200).cast("long").alias("size"))
    assert len(edit_prints.bounds_of(sizes)) > 20
    want = {(i, hashlib.sha256((t[: len(t) - len(t) // 4] + order[(n + 1) % len(order)][1][: len(t) // 4]).encode()).hexdigest()) for n, (i, t) in enumerate(order)}
    got = edit_prints.with_edits(df.dropDuplicates()).collect()
    assert {(r.doc_id, r.edited_sha256) for r in got} == want
    assert len(got) == len(order)


def test_edits_over_edges(spark, edge_docs, empty):
    assert edit_prints.with_edits(edge_docs).count() == edge_docs.count()
    assert edit_prints.with_edits(empty).count() == 0
    one = edit_prints.with_edits(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert one.near_next == 1.0
    zero = edit_prints.with_edits(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert {(r.n_chars, r.near_next, r.near_edited) for r in zero} == {(0, 1.0, 1.0)}


def test_likeness_follows_edits(docs):
    rng, low, high = random.Random(5), [], []
    texts = [r.text for r in docs.collect() if len(r.text) > 1500][:25]
    for t in texts:
        fp = edit_prints.fingerprint(t)
        few, many = list(t), list(t)
        for i in rng.sample(range(len(t)), 2):
            few[i] = "#"
        for i in rng.sample(range(len(t)), len(t) // 4):
            many[i] = "#"
        high.append(edit_prints.likeness(fp, edit_prints.fingerprint("".join(few))))
        low.append(edit_prints.likeness(fp, edit_prints.fingerprint("".join(many))))
    assert np.mean(high) > 0.85
    assert np.mean(low) < 0.5
    assert np.mean([edit_prints.likeness(edit_prints.fingerprint(a), edit_prints.fingerprint(b)) for a, b in itertools.pairwise(texts)]) < 0.2


def test_walks_of_parts_go_on():
    codes = np.frombuffer("the quick brown fox".encode("utf-32-le"), np.uint32)
    whole = edit_prints.walk(codes)
    rest = edit_prints.walk(codes[7:], int(whole[6]))
    assert whole[7:].tolist() == rest.tolist()
    both = np.minimum(edit_prints.least(codes[:7], whole[:7]), edit_prints.least(codes[7:], rest, int(whole[6])))
    assert both.tolist() == edit_prints.least(codes, whole).tolist()


def test_near_prints_are_classed(spark, docs):
    base = [r.text for r in docs.collect() if len(r.text) > 2000][:20]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t[:-30] + "q" * 30) for i, t in enumerate(base)] + [(200, base[0]), (201, "")]
    prints = edit_prints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"])
    got = {r.doc_id: r.class_id for r in edit_prints.near_copies(prints).collect()}
    assert len(got) == len(rows)
    assert got[200] == got[0]
    assert sum(got[100 + i] == got[i] for i in range(20)) >= 19
    assert len({got[i] for i in range(20)}) == 20


# --- queries and pipeline ---


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline_equals_brute_force(spark, docs, labels):
    from loomwork.llm import bpe, quality

    rows = [r for r in docs.collect() if not any(x.rejects(quality.Text(r.text)) for x in (*quality.BASE, *quality.RULES))]
    kept = docs.where(F.col("doc_id").isin([r.doc_id for r in rows]))
    train = common.crc_mod("doc_id", 3) != 1
    model = toxicity.fit(kept.where(train), labels.where(train))
    rows = [r for r in rows if model.score(r.text) < 0.7]
    root = near_classes({r.doc_id: r.text for r in rows})
    rows = [r for r in rows if root[r.doc_id] == r.doc_id]
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.encode().split())
    target, want, c = brute_targets(sizes), [], bpe.Codec(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    for source, size in sizes.items():
        epochs, rest = divmod(int(target[source]), size)
        for r in sorted((r for r in rows if r.source == source), key=lambda r: hashlib.md5(f"mix{r.doc_id}".encode()).hexdigest()):
            words = re.findall(r"[\x20\x09-\x0D]*" + common.WORD, r.text)
            n = min(len(words), rest)
            rest -= n
            for text in [r.text] * epochs + [r.text if n == len(words) else "".join(words[:n])] * (n > 0):
                ids = c.encode([text])[0]
                want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(want)


def test_stages_keep_the_columns_of_documents(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(60), DATA)
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.where("false"), DATA).count() == 0, name


def test_transactions_are_assembled(spark):
    urls = {r.page_id: re.sub(r"[\x00-\x20\x7f]", "", r.url) for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url").collect()}
    rows = queries.queries()["op2_transactions"](spark, DATA).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.n_requests, r.n_metadata) == (1, 1)
        capture = re.fullmatch(rf"<urn:capture:{r.page_id}:(\d+):request>", r.request.record_id)
        assert r.metadata.record_id == f"<urn:capture:{r.page_id}:{capture[1]}:metadata>"
        assert r.request.block_bytes == len(f"GET {urls[r.page_id]} HTTP/1.1\r\n\r\n".encode())
    found = queries.op2_warc(spark, DATA).collect()
    assert {(r.n_requests, r.n_metadata) for r in found} == {(1, 1)}
    assert len(found) == len(urls)


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 300_000)
    sizes = [10] * 40 + [60_000] * 12 + [500_000, 900_000, 0]
    pages = spark.createDataFrame([(i, "http://a", chr(97 + i % 26) * n) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "a"))
    bytes_of = [sum(len(block) for _, block in warc.parsed(warc.unpacked(f.read_bytes()))) for f in (tmp_path / "a").rglob("part-*")]
    assert sorted(bytes_of)[-2:] == pytest.approx([500_000, 900_000], abs=600)
    assert all(n <= 300_000 for n in sorted(bytes_of)[:-2])
    assert warc.captures(warc.read(spark, str(tmp_path / "a"))).count() == len(sizes)


def drifted(rng, n):
    """Fingerprints of a chain, each a few digits from the one before, and of its neighbours' surroundings."""
    out = ["".join(rng.choice("0123456789abcdef") for _ in range(128))]
    while len(out) < n:
        x = list(rng.choice(out[-6:]))
        for i in rng.sample(range(128), rng.randint(10, 34)):
            x[i] = rng.choice("0123456789abcdef")
        out.append("".join(x))
    return out


def test_bands_miss_no_alike_pair(spark):
    rng = random.Random(9)
    prints = [p for _ in range(6) for p in drifted(rng, 25)]
    rng.shuffle(prints)
    rows = list(enumerate(prints)) + [(900, prints[3]), (None, prints[4]), (901, "0" * 128)]
    sampled = np.random.RandomState(11)
    at = [[int(k) for k in sampled.choice(128, edit_prints.WIDTH, replace=False)] for _ in range(edit_prints.BANDS)]
    alike = [(a, b) for a, b in itertools.combinations(range(150), 2) if edit_prints.likeness(prints[a], prints[b]) >= 0.8]
    meeting = [(a, b) for a, b in alike if any(all(prints[a][k] == prints[b][k] for k in band) for band in at)]
    want = classes(meeting, range(150))
    got = {r.doc_id: r for r in edit_prints.with_classes(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()}
    assert {i: got[i].class_id for i in range(150)} == want
    assert (got[900].class_id, got[None].class_id) == (want[3], want[4])
    assert got[901].class_id == 901
    size = {r: sum(x == r for x in want.values()) + (r == want[3]) + (r == want[4]) for r in want.values()}
    assert all(got[i].class_size == size[want[i]] for i in range(150))
    assert len(meeting) >= 0.95 * len(alike)  # recall of the bands against brute force


@pytest.mark.parametrize("least", [0.5, 0.8, 0.9])
def test_equal_digits_decide_as_likeness(spark, least):
    rng = random.Random(10)
    prints = drifted(rng, 40)
    pairs = spark.createDataFrame([(a, b) for a in prints for b in prints], "a string, b string")
    n = edit_prints.equal_digits(edit_prints.digits(F.col("a")), edit_prints.digits(F.col("b")))
    for r in pairs.withColumn("n", n).collect():
        assert r.n == sum(x == y for x, y in zip(r.a, r.b, strict=True))
        assert (r.n >= edit_prints.least_equal(least)) == (edit_prints.likeness(r.a, r.b) >= least)


def test_edit_prints_are_classed_in_the_query(spark, docs):
    rows = {r.doc_id: r for r in queries.op9_edit_prints(spark, DATA).collect()}
    assert len(rows) == docs.count()
    pairs = [(a, b) for a, b in itertools.combinations(sorted(rows), 2) if rows[a].fingerprint == rows[b].fingerprint or sum(map(str.__eq__, rows[a].fingerprint, rows[b].fingerprint)) >= edit_prints.least_equal(0.8)]
    want = classes(pairs, rows)
    assert sum(rows[a].class_id == rows[b].class_id for a, b in pairs) >= 0.95 * len(pairs)
    assert all(want[r.class_id] == want[i] for i, r in rows.items())


def test_helpers_names_do_not_clash(spark, docs, labels):
    """Tables with columns that are named as operators name their own keep them, values and all."""
    from loomwork.llm import bpe, language, quality

    names = ["text_to_map", "q_kept", "toxic_score", "mix_size", "mix_key", "mix_of", "mix_taken", "mix_copy", "mix_words", "gone_id", "gone_node", "key", "tie", "bucket", "__text", "__size", "Node", "size", "taken"]
    rows = docs.limit(80).withColumns({n: F.lit(7) for n in names})
    for out in (
        quality.accepted(rows), mixing.mixture(rows), simhash.without_copies(rows), toxicity.without_toxic(rows, toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), -1.0)),
        bpe.encode(rows, corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")), language.identify(rows, language.fit(docs)),
    ):
        assert [c for c in rows.columns if c not in out.columns] == []
        assert out.where(" OR ".join(f"`{n}` <> 7" for n in names)).count() == 0
        assert out.count() > 0
    assert {r.taken <= 2 * r.size for r in mixing.mix(rows).collect()} == {True}
    assert edit_prints.with_edits(rows).count() == 80
    assert simhash.groups(rows).count() == 80


def test_repeated_rows_and_empty_tables(spark, docs, labels):
    from loomwork.llm import language, quality, token_counts

    rows = docs.limit(40).union(docs.limit(5))
    pieces = corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model")
    model, tongues = toxicity.fit(docs, labels), language.fit(docs)
    for of in (lambda d: quality.cascade(d, keep=["doc_id"]), lambda d: token_counts.count_tokens(d, pieces), lambda d: toxicity.score(d, model, keep=["doc_id"]), lambda d: language.identify(d, tongues, keep=["doc_id"])):
        found = [tuple(map(str, r)) for r in of(rows).collect()]
        assert len(found) == 45
        assert len(set(found)) == 40  # a repeated row has the same result
        assert of(rows.where("false")).count() == 0
