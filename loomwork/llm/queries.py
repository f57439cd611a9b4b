"""The queries of this subpackage, each over the whole of its table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, common, edit_prints, language, licenses, main_text, mixing, quality, simhash, spelling, token_counts, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cascade(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op2_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested row for each capture: the response or revisit with its request and metadata records and their numbers."""
    with common.scratch(spark) as result:  # the archive itself is not kept
        path = common.shared_path(spark, "warc")
        warc.write(table(spark, sf_dir, "pages"), path)
        records = result(warc.read(spark, path, blocks=False).drop("block"), "records")
    found = warc.captures(records)
    return found.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"), "request", "metadata", "n_requests", "n_metadata")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested rows' digest: the records that assembly has found stand behind the columns of the capture itself."""
    nested = warc.page_of("request.record_id").alias("request_page"), warc.page_of("metadata.record_id").alias("metadata_page")
    return op2_transactions(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *nested, "n_requests", "n_metadata")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = common.crc_mod("doc_id", 4) == 2
    model = language.fit(docs.where(~held_out))
    found = language.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = common.crc_mod("doc_id", 3) == 1
    model = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    found = toxicity.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), width=3, distance=2)
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_edit_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_prints.with_classes(common.stored_alone(spark, lambda: edit_prints.with_edits(table(spark, sf_dir, "documents")), "edits"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = main_text.fit(main_text.labelled_pages(pages))
    return main_text.extract(pages, model, keep=["page_id", "url"])


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=40, rounds=5, size=64, seed=2)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_warc": op2_warc,
        "op2_transactions": op2_transactions,
        "op3_language": op3_language,
        "op4_token_counts": op4_token_counts,
        "op5_toxicity": op5_toxicity,
        "op6_mixing": op6_mixing,
        "op7_simhash": op7_simhash,
        "op8_bpe": op8_bpe,
        "op9_edit_prints": op9_edit_prints,
        "op10_licenses": op10_licenses,
        "op11_main_text": op11_main_text,
        "op12_clusters": op12_clusters,
        "op13_spelling": op13_spelling,
    }


OP1_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]*[A-Za-z\x{80}-\x{10FFFF}][^\x20\x09-\x0D]*')) AS letter_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower
  FROM base
), windows AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3) AS x
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) AS x WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS k) AS s GROUP BY doc_id
), measured AS (
  SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, letter_words, n_upper, n_lower
  FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR n_upper > n_lower OR 10 * n_dup_lines > 4 * n_lines
            OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 5 * letter_words < 4 * n_words) AS kept
FROM judged
"""


OP2_SQL = """
WITH p AS (SELECT row_number() OVER () AS row, page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT row, page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS h FROM p),
n AS (SELECT row, page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first_id FROM d),
digits AS (
  SELECT row, page_id, payload_bytes, first_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
           (CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1), '' ORDER BY i) AS payload_digest
  FROM n, range(32) AS r(i) GROUP BY 1, 2, 3, 4
), parts AS ( -- the records beside the capture, each naming its row
  SELECT row AS concurrent_to, page_id, kind FROM p, (VALUES ('request'), ('metadata')) AS k(kind)
), assembled AS (
  SELECT concurrent_to, min(page_id) FILTER (WHERE kind = 'request') AS request_page, min(page_id) FILTER (WHERE kind = 'metadata') AS metadata_page,
         count(*) FILTER (WHERE kind = 'request') AS n_requests, count(*) FILTER (WHERE kind = 'metadata') AS n_metadata FROM parts GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to, request_page, metadata_page, n_requests, n_metadata
FROM digits JOIN assembled ON digits.row = assembled.concurrent_to
"""
OP6_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS no FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS cap FROM by_source
), ahead AS (
  SELECT *, CAST(1.5 * sum(source_size) OVER () AS DOUBLE) AS budget,
         coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before, sum(w) OVER () AS w_all
  FROM weighed WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (SELECT *, cap * (w_all - w_before) <= (budget - cap_before) * w AS is_capped FROM ahead),
targets AS (
  SELECT source, source_size, CASE WHEN is_capped THEN CAST(cap AS DOUBLE)
         ELSE (budget - coalesce(sum(CASE WHEN is_capped THEN cap END) OVER (), 0)) * w / sum(CASE WHEN NOT is_capped THEN w END) OVER () END AS target
  FROM capped
), budgets AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // source_size END AS epochs FROM targets
), placed AS (
  SELECT sizes.doc_id, sizes.size, b.source_size, b.target, b.epochs, CAST(floor(b.target) AS BIGINT) - b.epochs * b.source_size AS rest,
         sum(sizes.size) OVER (PARTITION BY sizes.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sizes.size AS before
  FROM sizes JOIN budgets AS b ON sizes.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM placed
"""


def _clusters_sql(k: int, rounds: int, size: int, seed: int) -> str:
    """Lloyd's rounds written out one after another."""
    squares = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    nearest = f"SELECT x.row, x.vec_id, x.v, min({{'d': CAST({squares} AS BIGINT), 'c': c.c}}) AS best FROM kept AS x, centroids AS c GROUP BY 1, 2, 3"
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = {size} AND len(embedding) = {size})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM kept QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED ({nearest.replace('centroids', f'c{i}')})")
        if i < rounds:
            mean = "CAST((sum(v[d]) - ((sum(v[d]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
            parts.append(f"m{i} AS (SELECT c, list(m ORDER BY d) AS v FROM (SELECT best.c AS c, d, {mean} AS m FROM a{i}, range(1, {size + 1}) AS r(d) GROUP BY 1, 2) AS x GROUP BY 1)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON c{i}.c = m{i}.c)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, best.c AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS c ON best.c = c.c"""


OP13_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) AS x WHERE length(r) >= 6 GROUP BY 1, 2
), steps AS ( -- crc32 bit by bit: a byte comes in, then eight shifts
  SELECT doc_id, run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x), -1, -1, -1, -1, -1, -1, -1, -1]
         ELSE [192 + (unicode(x) >> 6), -1, -1, -1, -1, -1, -1, -1, -1, 128 + (unicode(x) & 63), -1, -1, -1, -1, -1, -1, -1, -1] END)) AS s FROM runs
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(s AS BIGINT[])), lambda c, b: CASE WHEN b < 0 THEN xor(c >> 1, 3988292384 * (c & 1)) ELSE xor(c, b) END)) AS h FROM steps
), words AS MATERIALIZED (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), cut AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, CAST(unnest(range(length(word))) AS INTEGER) AS i FROM words) AS x),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM cut AS a JOIN cut AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words AS a JOIN cut AS b ON a.word = b.rest UNION SELECT b.word, a.word, a.n FROM words AS a JOIN cut AS b ON a.word = b.rest
), best AS (SELECT word, count(*) AS n_near, min({'n': -n, 'w': near}) AS b FROM pairs GROUP BY 1),
forms AS MATERIALIZED (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 5 * n THEN b.w END AS form, CASE WHEN -b.n >= 5 * n THEN -b.n END AS form_n FROM words LEFT JOIN best ON words.word = best.word
), chains AS (SELECT word, word AS root FROM forms UNION SELECT chains.word, forms.form FROM chains JOIN forms ON chains.root = forms.word WHERE forms.form IS NOT NULL)
SELECT forms.word, forms.form, chains.root, forms.n, forms.n_near, forms.form_n FROM forms JOIN chains ON forms.word = chains.word JOIN forms AS last ON chains.root = last.word AND last.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": OP1_SQL, "op2_warc": OP2_SQL, "op6_mixing": OP6_SQL, "op12_clusters": _clusters_sql(40, 5, 64, 2), "op13_spelling": OP13_SQL}
