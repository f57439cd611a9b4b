"""Queries over keyed records and logs: upserts, cascades, validation, coverage, audits, registries, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import evaluation as E
from ..operators import tables as T
from .series import read


def events(spark, sf_dir):
    return read(spark, sf_dir, "events")


#: Every event is in one of the batches: some users in the old one alone, some in the new one alone, the others in both.
BATCH = "CASE WHEN user_id % 10 < 2 THEN 'old' WHEN user_id % 10 > 7 OR event_id % 2 = 1 THEN 'new' ELSE 'old' END"
#: Every event comes from one tier.
TIER = "CASE WHEN user_id % 3 = 0 AND event_id % 5 = 0 THEN 'live' WHEN user_id % 2 = 0 AND event_id % 7 = 0 THEN 'seed' ELSE 'fallback' END"


def upsert_last_wins(spark, sf_dir):
    """All events in two batches whose (user, type) overlap; in each the last event counts."""
    keep = ["user_id", "event_type", "event_id", "value"]
    e = events(spark, sf_dir).select(*keep, F.expr(BATCH).alias("batch"))
    old = T.last_wins(e.where("batch = 'old'").select(*keep), ["user_id", "event_type"], "event_id")
    new = T.last_wins(e.where("batch = 'new'").select(*keep).withColumn("value", F.when(F.col("event_id") % 4 > 0, F.col("value"))), ["user_id", "event_type"], "event_id")
    return T.upsert(old, new, ["user_id", "event_type"], keep_old_when_null=("value",)).withColumnRenamed("_change", "change")


def fallback_cascade(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", "value", F.expr(TIER).alias("tier"))
    return T.cascade([(t, e.where(F.col("tier") == t).drop("tier")) for t in ("live", "seed", "fallback")], ["user_id"])


def coverage_missing_codes(spark, sf_dir):
    """Customers that no event names, as codes that were expected."""
    expected = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"))
    return T.missing_codes(expected, events(spark, sf_dir).select(F.col("user_id").alias("code")), "code")


def coded(spark, sf_dir):
    k = F.col("p_partkey")
    code = F.when(k % 10 == 0, None).when(k % 10 == 1, "  ").when(k % 10 == 2, "9999").when(k % 10 == 3, "2799").otherwise(F.concat((10 + k % 24).cast("string"), F.lit("10")))
    return read(spark, sf_dir, "part").select(k, code.alias("code"))


def codes(spark, sf_dir):
    return read(spark, sf_dir, "nation").where("n_nationkey BETWEEN 10 AND 24").select(F.concat(F.col("n_nationkey").cast("string"), F.lit("10")).alias("code"))


def code_validation_issues(spark, sf_dir):
    return C.validate_codes(coded(spark, sf_dir), codes(spark, sf_dir), "code").where("reason IS NOT NULL")


def code_validation_summary(spark, sf_dir):
    return C.validation_summary(C.validate_codes(coded(spark, sf_dir), codes(spark, sf_dir), "code"))


CODED = """coded AS (SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN '9999' WHEN 3 THEN '2799' ELSE CAST(10 + p_partkey % 24 AS VARCHAR) || '10' END AS code FROM part),
 codes AS (SELECT CAST(n_nationkey AS VARCHAR) || '10' AS valid FROM nation WHERE n_nationkey BETWEEN 10 AND 24),
 judged AS (SELECT p_partkey, code, CASE WHEN code IS NULL OR trim(code) = '' THEN 'missing_code' WHEN valid IS NOT NULL THEN NULL WHEN regexp_matches(trim(code), '^(C|1[0-9]|2[0-9]|3[0-3])') THEN 'unknown_code' ELSE 'not_section_c' END AS reason FROM coded LEFT JOIN codes ON trim(code) = valid)"""


def listing_clean_flags_notes(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 4 > 0, F.col("l_extendedprice").cast("string")).otherwise("n/a").alias("price"), F.col("l_tax").alias("units"), F.when(F.col("l_orderkey") % 3 == 0, "seen").alias("notes"))
    return C.clean_listings(rows, ["price", "units"], method="zscore", action="null", zscore=1.5)


def latest_job_per_family(spark, sf_dir):
    jobs = events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("event_type").alias("job_name"), F.when(F.col("value") > 50, "success").otherwise("failed").alias("status"), F.col("ts").alias("created_at"))
    families = {"macro": ("view", "click"), "trade": ("purchase",), "idle": ("nothing",)}
    return T.latest_jobs(jobs, families)


def source_health(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("source", F.when(F.col("event_id") % 3 == 0, "FALLBACK").otherwise("LIVE")).withColumn("source", F.when(F.col("event_type") == "view", "FALLBACK").otherwise(F.col("source")))
    return T.source_health(rows, "event_type", "source", F.col("source").ilike("%fall%")).withColumn("sources", F.array_join("sources", ","))


def registry(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("event_type").alias("model_name"), F.col("ts").alias("trained_at"), F.when(F.col("event_id") % 120 > 0, F.round(F.col("value"), 2)).alias("mape"))


def model_registry_latest(spark, sf_dir):
    r = registry(spark, sf_dir).withColumn("is_active", F.lit(True))
    return T.register(r.where("id % 80 = 0"), r.where("id % 80 > 0")).select("id", "model_name", "mape", "is_active")


def drift_flags(spark, sf_dir):
    r = registry(spark, sf_dir).withColumn("is_active", F.lit(True))
    base = r.where("mape IS NOT NULL").groupBy("model_name").agg(F.min_by("mape", "id").alias("mape"))
    return T.drift(T.register(r.where("id % 80 = 0"), r.where("id % 80 > 0")), base)


def preferred_forecast_model(spark, sf_dir):
    r = registry(spark, sf_dir).withColumn("is_active", F.lit(True))
    return T.preferred_model(T.register(r.where("id % 80 = 0"), r.where("id % 80 > 0"))).select("id", "model_name", "mape")


def presence_audit(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 3 == 0).alias("flag"))
    u = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 10 > 0, F.col("c_name")).otherwise("").alias("url"))
    return T.audit(c, u, ["c_custkey"]).where("mismatch IS NOT NULL").select("c_custkey", "mismatch")


def keep_previous_state(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    now = o.select("o_orderkey", (F.col("o_orderkey") % 100 > 0).alias("ok"), F.col("o_orderstatus").alias("state"))
    before = o.select("o_orderkey", F.when(F.col("o_orderkey") % 200 == 0, "P").alias("state"))
    return T.keep_previous(now, before, ["o_orderkey"], "ok", ["state"])


def guesses(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    low = F.lower("text")
    return d.select("doc_id", (F.col("toxic") == 1).alias("truth"), low.contains("idiot").alias("base"), (low.contains("idiot") | low.contains("moron") | low.contains("scum") | low.contains("clown")).alias("candidate"))


def prf_confusion(spark, sf_dir):
    return guesses(spark, sf_dir).agg(*E.confusion(F.col("truth"), F.col("base")))


def ab_gate(spark, sf_dir):
    return E.gate(guesses(spark, sf_dir), "truth", "base", "candidate")


def field_accuracy_grouping_sets(spark, sf_dir):
    ls = read(spark, sf_dir, "lineitem")
    rows = ls.select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field"), F.col("l_quantity").alias("expected"), F.when(F.col("l_partkey") % 5 > 0, F.col("l_quantity") + F.when(F.col("l_partkey") % 7 == 0, 1).otherwise(0)).alias("got"))
    return E.field_accuracy(rows, "case_id", "field", "expected", "got")


QUERIES = {f.__name__: f for f in (
    upsert_last_wins, fallback_cascade, coverage_missing_codes, code_validation_issues, code_validation_summary, listing_clean_flags_notes, latest_job_per_family, source_health,
    model_registry_latest, drift_flags, preferred_forecast_model, presence_audit, keep_previous_state, prf_confusion, ab_gate, field_accuracy_grouping_sets,
)}
REG = """r AS (SELECT event_id AS id, event_type AS model_name, ts AS trained_at, CASE WHEN event_id % 120 > 0 THEN round(value, 2) END AS mape FROM events),
 a AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY trained_at DESC, id DESC) = 1 AS is_active FROM r)"""
GUESS = """g AS (SELECT d.doc_id, toxic = 1 AS truth, contains(lower(text), 'idiot') AS base, contains(lower(text), 'idiot') OR contains(lower(text), 'moron') OR contains(lower(text), 'scum') OR contains(lower(text), 'clown') AS candidate FROM documents AS d JOIN labels AS l ON d.doc_id = l.doc_id)"""


def prf_sql(guess: str, suffix: str = "") -> tuple[str, str]:
    counts = ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}{suffix}" for n, c in (("tp", f"truth AND {guess}"), ("fp", f"NOT truth AND {guess}"), ("fn", f"truth AND NOT {guess}"), ("tn", f"NOT truth AND NOT {guess}")))
    tp, fp, fn = (f"{n}{suffix}" for n in ("tp", "fp", "fn"))
    figures = f"round(coalesce({tp} / nullif({tp} + {fp}, 0), 0), 4) AS precision{suffix}, round(coalesce({tp} / nullif({tp} + {fn}, 0), 0), 4) AS recall{suffix}, round(coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0), 4) AS f1{suffix}"
    return counts, figures


SQL = {
    "upsert_last_wins": f"""WITH o AS (SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events WHERE {BATCH} = 'old' GROUP BY 1, 2),
 n AS (SELECT user_id, event_type, max(event_id) AS event_id, CASE WHEN max(event_id) % 4 > 0 THEN max_by(value, event_id) END AS value FROM events WHERE {BATCH} = 'new' GROUP BY 1, 2)
 SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.event_type, n.event_type) AS event_type, coalesce(n.event_id, o.event_id) AS event_id, coalesce(n.value, o.value) AS value,
   CASE WHEN o.user_id IS NULL THEN 'inserted' WHEN n.user_id IS NULL THEN 'kept' ELSE 'updated' END AS "change" FROM o FULL JOIN n ON o.user_id = n.user_id AND o.event_type = n.event_type""",
    "fallback_cascade": f"""WITH s AS (SELECT user_id, event_id, value, {TIER} AS source_tier FROM events), c AS (SELECT *, CASE source_tier WHEN 'live' THEN 0 WHEN 'seed' THEN 1 ELSE 2 END AS tier FROM s), b AS (SELECT *, min(tier) OVER (PARTITION BY user_id) AS best FROM c)
 SELECT user_id, event_id, value, source_tier, CASE tier WHEN 0 THEN 'ok' ELSE 'fallback' END AS status FROM b WHERE tier = best""",
    "coverage_missing_codes": "SELECT c_custkey AS code FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
    "code_validation_issues": f"WITH {CODED} SELECT * FROM judged WHERE reason IS NOT NULL",
    "code_validation_summary": f"WITH {CODED} SELECT count(*) AS checked, count(*) FILTER (WHERE reason IS NULL) AS valid, count(*) FILTER (WHERE reason = 'missing_code') AS n_missing_code, count(*) FILTER (WHERE reason = 'unknown_code') AS n_unknown_code, count(*) FILTER (WHERE reason = 'not_section_c') AS n_not_section_c FROM judged",
    "listing_clean_flags_notes": """WITH b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 4 > 0 THEN l_extendedprice END AS p, l_tax AS u, CASE WHEN l_orderkey % 3 = 0 THEN 'seen' END AS n FROM lineitem),
 s AS (SELECT avg(p) AS pm, nullif(stddev_pop(p), 0) * 1.5 AS ps, avg(u) AS um, nullif(stddev_pop(u), 0) * 1.5 AS us FROM b),
 f AS (SELECT b.*, coalesce(p < pm - ps OR p > pm + ps, false) AS po, coalesce(u < um - us OR u > um + us, false) AS uo FROM b, s)
 SELECT l_orderkey, l_linenumber, CASE WHEN NOT po THEN p END AS price, CASE WHEN NOT uo THEN u END AS units, CASE WHEN po OR uo THEN concat_ws('; ', n, CASE WHEN po THEN 'outlier:price' END, CASE WHEN uo THEN 'outlier:units' END) ELSE n END AS notes, po AS price_outlier, uo AS units_outlier FROM f""",
    "latest_job_per_family": """WITH m AS (SELECT event_id AS id, event_type AS job_name, CASE WHEN value > 50 THEN 'success' ELSE 'failed' END AS status, ts AS created_at, CASE WHEN event_type IN ('view', 'click') THEN 'macro' WHEN event_type = 'purchase' THEN 'trade' END AS family FROM events),
 l AS (SELECT * FROM m WHERE family IS NOT NULL QUALIFY row_number() OVER (PARTITION BY family ORDER BY created_at DESC, id DESC) = 1), f AS (SELECT unnest(['macro', 'trade', 'idle']) AS family)
 SELECT f.family, job_name, status, created_at, id FROM f LEFT JOIN l ON f.family = l.family""",
    "source_health": """WITH s AS (SELECT event_type, CASE WHEN event_type = 'view' OR event_id % 3 = 0 THEN 'FALLBACK' ELSE 'LIVE' END AS source FROM events), g AS (SELECT event_type, count(*) AS n_rows, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) FILTER (WHERE source ILIKE '%fall%') AS n_fallback FROM s GROUP BY 1)
 SELECT *, CASE WHEN n_rows = n_fallback THEN 'fallback' ELSE 'ok' END AS status FROM g""",
    "model_registry_latest": f"WITH {REG} SELECT id, model_name, mape, is_active FROM a",
    "drift_flags": f"""WITH {REG}, b AS (SELECT model_name, min_by(mape, id) AS baseline_mape FROM r WHERE mape IS NOT NULL GROUP BY 1), l AS (SELECT model_name, mape FROM a WHERE is_active)
 SELECT coalesce(l.model_name, b.model_name) AS model_name, l.mape, baseline_mape, round(l.mape - baseline_mape, 4) AS drift_points, abs(round(l.mape - baseline_mape, 4)) >= 5 AS drifted FROM l FULL JOIN b ON l.model_name = b.model_name""",
    "preferred_forecast_model": f"WITH {REG} SELECT id, model_name, mape FROM a WHERE is_active ORDER BY mape ASC NULLS LAST, id LIMIT 1",
    "presence_audit": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'flag_without_url' ELSE 'url_without_flag' END AS mismatch FROM customer WHERE (c_custkey % 3 = 0) <> (c_custkey % 2 = 0 AND c_custkey % 10 > 0)",
    "keep_previous_state": "SELECT o_orderkey, o_orderkey % 100 > 0 AS ok, CASE WHEN o_orderkey % 100 > 0 THEN o_orderstatus WHEN o_orderkey % 200 = 0 THEN 'P' END AS state FROM orders",
    "prf_confusion": f"WITH {GUESS}, c AS (SELECT {prf_sql('base')[0]} FROM g) SELECT *, {prf_sql('base')[1]} FROM c",
    "ab_gate": f"WITH {GUESS}, c AS (SELECT {prf_sql('base', '_base')[0]}, {prf_sql('candidate', '_candidate')[0]} FROM g), f AS (SELECT *, {prf_sql('base', '_base')[1]}, {prf_sql('candidate', '_candidate')[1]} FROM c) SELECT *, f1_candidate >= f1_base AND precision_candidate >= 0.9 AS passed FROM f",
    "field_accuracy_grouping_sets": """WITH b AS (SELECT l_orderkey AS case_id, 'f' || CAST(l_linenumber AS VARCHAR) AS field, l_quantity AS e, CASE WHEN l_partkey % 5 > 0 THEN l_quantity + CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END END AS g FROM lineitem),
 a AS (SELECT field, case_id, CAST(grouping(field, case_id) AS BIGINT) AS level, count(*) AS n, count(g) AS n_found, count(*) FILTER (WHERE e = g) AS n_correct FROM b GROUP BY GROUPING SETS ((), (field), (case_id)))
 SELECT *, round(n_found / n, 4) AS coverage, round(n_correct / n, 4) AS accuracy FROM a""",
}
