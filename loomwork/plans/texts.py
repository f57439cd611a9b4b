"""Queries over text and nested payloads: folding, labels, numbers, pages, TF-IDF, vectors, extraction, feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as X
from ..operators.resolution import resolve
from ..operators.cosine import similar_pairs, top_cosines
from ..operators.shared import result
from ..operators.vectors import nearest
from ..sources import payloads
from .series import read


def text_normalize(spark, sf_dir):
    named = F.concat(F.lit("Đồng-Nai_Sữa@"), F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", X.normalized(F.regexp_replace(named, "[^\\x00-\\x7FĐồữ]", "")).alias("normalized"))


def token_stopwords(spark, sf_dir):
    t = X.tokens(F.regexp_replace("p_name", "[^\\x00-\\x7F]", ""), ("part", "blue", "the"))
    return read(spark, sf_dir, "part").select("p_partkey", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, "").alias("compact"))


ALIASES = (("purchase", "buy"), ("pur", "other"), ("click", "touch"), ("view", "see"))


def label_alias_map(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(X.mapped(F.concat(F.lit("  Event "), F.upper("event_type")), ALIASES).alias("label")).agg(F.count("*").alias("n"))


def amounts(spark, sf_dir):
    """Order prices written in several dialects."""
    whole, cents = F.floor("o_totalprice").cast("string"), F.lpad((F.round(F.col("o_totalprice") * 100).cast("long") % 100).cast("string"), 2, "0")
    grouped = F.regexp_replace(whole, r"(\d)(?=(\d{3})+$)", "$1.")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(grouped, F.lit(","), cents)).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("("), grouped, F.lit(")"))).when(F.col("o_orderkey") % 4 == 2, F.concat(whole, F.lit("."), cents)).otherwise("n/a")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.alias("written"))


def number_dialects(spark, sf_dir):
    return amounts(spark, sf_dir).select("o_orderkey", X.number(F.col("written")).alias("value"))


def number_tokens(spark, sf_dir):
    said = F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(said).cast("long").alias("n_numbers"), F.array_join(said, ",").alias("numbers"))


def honest_numbers(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    claim = F.concat(F.lit("worth "), F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string"), F.lit(" in "), F.when(F.col("o_orderkey") % 40 == 0, F.year("o_orderdate") + 9_000_000).otherwise(F.year("o_orderdate")).cast("string"))
    return o.select("o_orderkey", X.honest(claim, F.array(F.col("o_totalprice"), F.year("o_orderdate").cast("double"))).alias("honest"))


def period_parse(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyy-MM")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).when(k == 3, F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))).otherwise("bad-period")
    return o.select("o_orderkey", X.period(text).alias("period"), X.quarter_end(F.year(d), F.quarter(d)).alias("quarter_end"))


def html_commerce_flags(spark, sf_dir):
    cart = F.when(F.col("page_id") % 5 == 0, '<a class="x" href="/gio-hang">go</a>').when(F.col("page_id") % 5 == 1, "<form method=post action='/add-to-cart'>").when(F.col("page_id") % 5 == 2, "<p>Our showroom and Cửa hàng</p>").otherwise("")
    shop, checkout = X.commerce_flags(F.concat("html", cart))
    return read(spark, sf_dir, "pages").select("page_id", shop.alias("has_ecommerce"), checkout.alias("has_checkout"))


def url_handles(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", X.host(u).alias("host"), X.last_segment(u).alias("last_segment"), X.channel(u).alias("channel"))


def block_detection(spark, sf_dir):
    marks = F.array(F.lit("track("), F.lit("captcha"), F.lit("verify you are human"))
    return read(spark, sf_dir, "pages").groupBy(F.exists(marks, lambda m: F.lower("html").contains(m)).alias("blocked")).agg(F.count("*").alias("n"))


def char_ngram_tfidf_cosine(spark, sf_dir):
    """Every part type against every market segment name, by character n-grams."""
    names = read(spark, sf_dir, "part").select(F.col("p_type").alias("name")).union(read(spark, sf_dir, "customer").select("c_mktsegment")).union(read(spark, sf_dir, "nation").select("n_name")).distinct()
    weights = X.tfidf(names, "name", X.ngrams(F.col("name")))
    return X.cosines(weights, weights.withColumnRenamed("name", "other"), ("name", "other")).where("name < other").select("name", "other", F.round("cosine", 4).alias("cosine"))


def labels_weighed(spark, sf_dir):
    """Names with their weighed n-grams: part names with types, and names of nations and market segments."""
    parts = read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("name"))
    names = parts.union(read(spark, sf_dir, "customer").select("c_mktsegment")).union(read(spark, sf_dir, "nation").select("n_name")).distinct()
    return result(X.tfidf(names, "name", X.ngrams(F.col("name"))), "weights")


def ngram_cosine_top(spark, sf_dir):
    """The three names most like each name, by pruned cosines of character n-grams."""
    weights = labels_weighed(spark, sf_dir)
    return top_cosines(weights, weights.withColumnRenamed("name", "other"), ("name", "other"), 3, but_self=True).select("name", "other", F.round("cosine", 4).alias("cosine"), "place")


def ngram_cosine_pairs(spark, sf_dir):
    """All pairs of names whose cosine is 0.8 or more."""
    weights = labels_weighed(spark, sf_dir)
    return similar_pairs(weights, weights.withColumnRenamed("name", "other"), ("name", "other"), 0.8).where("name < other").select("name", "other", F.round("cosine", 4).alias("cosine"))


def vector_cosine_topk(spark, sf_dir):
    """The five nearest vectors of each query vector (ids divisible by 20) by cosine."""
    v = read(spark, sf_dir, "embeddings")
    return nearest(v, v.where("vec_id % 20 = 0"), 5).withColumnRenamed("id", "vec_id")


def json_props_map(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    k = F.try_element_at(F.from_json("props", "map<string,bigint>"), F.lit("k"))
    return e.groupBy("event_type").agg(F.count(k).alias("n_k"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


def listing_payloads(spark, sf_dir):
    """Item lists as a marketplace sends them, parsed into listings."""
    ls = read(spark, sf_dir, "lineitem")
    item = F.struct(F.col("l_partkey").alias("itemid"), F.concat(F.lit("item "), F.col("l_partkey").cast("string")).alias("name"), F.floor(F.col("l_extendedprice") * 100_000).cast("long").alias("price"), F.col("l_quantity").cast("int").alias("historical_sold"))
    packed = ls.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("body"))
    rows = payloads.shopee_listings(packed, "l_orderkey", "body")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum(F.col("price") * F.col("units_sold_est")), 0).alias("revenue"))


def feedback_harvest(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    factor = F.when(F.col("event_type") == "click", 1000.0).when(F.col("event_type") == "view", F.when(F.col("event_id") % 30 == 0, 0.001).otherwise(1.5)).otherwise(2.0)
    edits = e.select(F.col("event_type").alias("field"), F.col("value").cast("string").alias("before"), F.when(F.col("event_id") % 70 == 0, F.col("value").cast("string")).otherwise((F.col("value") * factor).cast("string")).alias("after"))
    return X.harvest(edits)


def unit_scale_class(spark, sf_dir):
    ls = read(spark, sf_dir, "lineitem")
    r = F.element_at(F.array(*map(F.lit, (1000.0, 1050.0, 1_000_000.0, 0.001, 1e-6, 2.0))), (F.col("l_partkey") % 6 + 1).cast("int"))
    return ls.groupBy(X.scale_class(F.col("l_quantity"), F.col("l_quantity") * r).alias("scale")).agg(F.count("*").alias("n"))


def statement_extraction(spark, sf_dir):
    """Statements written from orders, read back field by field."""
    o = read(spark, sf_dir, "orders")
    p = F.floor("o_totalprice").cast("string")
    text = F.concat(F.when(F.col("o_orderkey") % 50 == 0, "Đơn vị: triệu đồng\n").otherwise(""), F.lit("Doanh thu thuần  "), p, F.lit("\nTotal assets 1.250.000\n"), F.when(F.col("o_orderkey") % 75 == 0, "Total assets 99.000\n").otherwise(""), F.lit("Number of employees 45\nVốn chủ sở hữu 7"))
    return X.extract_fields(o.select("o_orderkey", text.alias("text")), "o_orderkey", "text")


def map_field_diffs(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    before = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("note"), F.lit(""))
    after = F.create_map(F.lit("status"), F.when(F.col("o_orderkey") % 200 == 0, "X").otherwise(F.col("o_orderstatus")), F.lit("priority"), F.col("o_orderpriority"))
    return o.select("o_orderkey", F.size(X.field_diffs(before, after)).cast("long").alias("n_diffs"), F.array_join(F.transform(X.field_diffs(before, after), lambda d: d.field), ",").alias("fields"))


def fuzzy_resolve(spark, sf_dir):
    """Shop handles against firm names: the best firm of each, if sure enough."""
    n = read(spark, sf_dir, "nation")
    firms = n.select(F.col("n_nationkey").alias("company_id"), F.concat(F.lit("Cong ty co phan "), "n_name").alias("name"))
    shops = read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("shop_id"), F.concat(F.translate(F.lower("n_name"), "_ ", ""), F.lit(".official"), (F.col("s_suppkey") % 3).cast("string")).alias("shop"))
    return resolve(shops, firms, "shop_id", "shop", "company_id", "name").select("shop_id", "company_id", F.round("score", 4).alias("score"))


QUERIES = {f.__name__: f for f in (
    text_normalize, token_stopwords, label_alias_map, number_dialects, number_tokens, honest_numbers, period_parse, html_commerce_flags, url_handles, block_detection, char_ngram_tfidf_cosine, ngram_cosine_top, ngram_cosine_pairs,
    vector_cosine_topk, json_props_map, listing_payloads, feedback_harvest, unit_scale_class, statement_extraction, map_field_diffs, fuzzy_resolve,
)}
NORMAL = r"trim(regexp_replace(regexp_replace({x}, '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
WEIGHED = r"""WITH names AS (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part UNION SELECT DISTINCT c_mktsegment FROM customer UNION SELECT n_name FROM nation), w AS (SELECT name, ' ' || unnest(list_filter(string_split(""" + NORMAL.format(x="lower(name)") + r""", ' '), lambda x: x <> '')) || ' ' AS w FROM names),
 g AS (SELECT name, substr(w, CAST(i + 1 AS INTEGER), CAST(n AS INTEGER)) AS term FROM w, (SELECT unnest([3, 4, 5]) AS n) AS s, (SELECT unnest(range(0, 60)) AS i) AS r WHERE i + n <= length(w)),
 tf AS (SELECT name, term, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM names),
 x AS (SELECT name, tf.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df ON tf.term = df.term, n), u AS (SELECT name, term, x / sqrt(sum(x * x) OVER (PARTITION BY name)) AS u FROM x),
 pairs AS (SELECT a.name, b.name AS other, round(sum(a.u * b.u), 9) AS cosine FROM u AS a JOIN u AS b ON a.term = b.term AND a.name <> b.name GROUP BY 1, 2)"""
SQL = {
    "ngram_cosine_top": WEIGHED + " SELECT name, other, round(cosine, 4) AS cosine, row_number() OVER (PARTITION BY name ORDER BY cosine DESC, other) AS place FROM pairs QUALIFY place <= 3",
    "ngram_cosine_pairs": WEIGHED + " SELECT name, other, round(cosine, 4) AS cosine FROM pairs WHERE name < other AND cosine >= 0.8",
    "text_normalize": r"""WITH t AS (SELECT doc_id, translate(lower(regexp_replace('Đồng-Nai_Sữa@' || coalesce(text, ''), '[^\x00-\x7FĐồữ]', '', 'g')), 'đồữ', 'dou') AS t FROM documents) SELECT doc_id, """ + NORMAL.format(x="t") + " AS normalized FROM t",
    "token_stopwords": r"WITH t AS (SELECT p_partkey, list_filter(string_split(" + NORMAL.format(x="lower(p_name)") + r", ' '), lambda x: x NOT IN ('part', 'blue', 'the', '')) AS t FROM part) SELECT p_partkey, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, '') AS compact FROM t",
    "label_alias_map": "SELECT CASE WHEN contains(event_type, 'purchase') THEN 'buy' WHEN contains(event_type, 'pur') THEN 'other' WHEN contains(event_type, 'click') THEN 'touch' WHEN contains(event_type, 'view') THEN 'see' END AS label, count(*) AS n FROM events GROUP BY 1",
    "number_dialects": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN floor(o_totalprice) + (CAST(round(o_totalprice * 100) AS BIGINT) % 100) / 100 WHEN 1 THEN -floor(o_totalprice) WHEN 2 THEN CAST(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS DOUBLE) END AS value FROM orders",
    "number_tokens": r"SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS n_numbers, array_to_string(regexp_extract_all(text, '[0-9]+'), ',') AS numbers FROM conversations",
    "honest_numbers": "SELECT o_orderkey, o_orderkey % 40 <> 0 AS honest FROM orders",
    "period_parse": """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 5 AS k FROM orders)
 SELECT o_orderkey, CASE k WHEN 0 THEN CAST(date_trunc('year', d) AS DATE) WHEN 1 THEN CAST(date_trunc('month', d) AS DATE) WHEN 2 THEN CAST(date_trunc('month', d) AS DATE) WHEN 3 THEN CAST(date_trunc('quarter', d) AS DATE) END AS period, CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end FROM o""",
    "html_commerce_flags": r"""WITH p AS (SELECT page_id, lower(html) AS t, page_id % 5 AS k FROM pages) SELECT page_id, k IN (0, 1, 2) OR regexp_matches(t, '\b(shop|product)\b') OR contains(t, 'cửa hàng') OR contains(t, 'online store') OR contains(t, 'add to cart') AS has_ecommerce,
   k IN (0, 1) OR regexp_matches(t, '\b(cart|checkout)\b') OR contains(t, 'add to cart') OR contains(t, 'shop now') AS has_checkout FROM p""",
    "url_handles": r"""WITH u AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS b FROM pages) SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^(www|m)\.', '') AS host, string_split(b, '/')[-1] AS last_segment,
   CASE WHEN contains(lower(url), 'shopee') THEN 'shopee' WHEN contains(lower(url), 'tiktok') THEN 'tiktok' WHEN contains(lower(url), 'lazada') THEN 'lazada' ELSE 'website' END AS channel FROM u""",
    "block_detection": "SELECT contains(lower(html), 'track(') OR contains(lower(html), 'captcha') OR contains(lower(html), 'verify you are human') AS blocked, count(*) AS n FROM pages GROUP BY 1",
    "char_ngram_tfidf_cosine": r"""WITH names AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT c_mktsegment FROM customer UNION SELECT n_name FROM nation), w AS (SELECT name, ' ' || unnest(list_filter(string_split(""" + NORMAL.format(x="lower(name)") + r""", ' '), lambda x: x <> '')) || ' ' AS w FROM names),
 g AS (SELECT name, substr(w, CAST(i + 1 AS INTEGER), CAST(n AS INTEGER)) AS term FROM w, (SELECT unnest([3, 4, 5]) AS n) AS s, (SELECT unnest(range(0, 60)) AS i) AS r WHERE i + n <= length(w)),
 tf AS (SELECT name, term, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM names),
 x AS (SELECT name, tf.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df ON tf.term = df.term, n), u AS (SELECT name, term, x / sqrt(sum(x * x) OVER (PARTITION BY name)) AS u FROM x)
 SELECT a.name, b.name AS other, round(sum(a.u * b.u), 4) AS cosine FROM u AS a JOIN u AS b ON a.term = b.term AND a.name < b.name GROUP BY 1, 2""",
    "vector_cosine_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS cosine FROM v JOIN v AS q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS place FROM c) SELECT * FROM r WHERE place <= 5""",
    "json_props_map": "SELECT event_type, count(CAST(props ->> '$.k' AS BIGINT)) AS n_k, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS sum_k, max(CAST(props ->> '$.k' AS BIGINT)) AS max_k FROM events GROUP BY 1",
    "listing_payloads": "SELECT l_orderkey, count(*) AS n, round(sum(floor(l_extendedprice * 100000) / 100000 * CAST(l_quantity AS INTEGER)), 0) AS revenue FROM lineitem GROUP BY 1",
    "feedback_harvest": """WITH e AS (SELECT event_type AS field, event_id, value AS b, value * CASE event_type WHEN 'click' THEN 1000.0::DOUBLE WHEN 'view' THEN CASE WHEN event_id % 30 = 0 THEN 0.001::DOUBLE ELSE 1.5::DOUBLE END ELSE 2.0::DOUBLE END AS a FROM events WHERE event_id % 70 <> 0 AND value <> 0)
 SELECT field, count(*) AS n_edits, 'review_aliases' AS proposal, CASE WHEN field = 'click' THEN 'nghin' WHEN field = 'view' AND count(*) FILTER (WHERE event_id % 30 = 0) >= 3 THEN 'nghin_overapplied' END AS review_unit_scale FROM e GROUP BY 1 HAVING count(*) >= 3""",
    "unit_scale_class": "SELECT CASE l_partkey % 6 WHEN 0 THEN 'nghin' WHEN 1 THEN 'nghin' WHEN 2 THEN 'trieu' WHEN 3 THEN 'nghin_overapplied' WHEN 4 THEN 'trieu_overapplied' END AS scale, count(*) AS n FROM lineitem GROUP BY 1",
    "statement_extraction": """WITH o AS (SELECT o_orderkey, floor(o_totalprice) AS p, CASE WHEN o_orderkey % 50 = 0 THEN 1000000.0::DOUBLE ELSE 1.0::DOUBLE END AS s, o_orderkey % 75 = 0 AS twice FROM orders)
 SELECT o_orderkey, f.field AS field, f.v AS value, f.c AS confidence, f.w AS warning FROM (SELECT o_orderkey, unnest([
   {'field': 'operating_revenue', 'v': p * s, 'c': 0.9::DOUBLE, 'w': NULL}, {'field': 'profit_before_tax', 'v': NULL, 'c': NULL, 'w': 'missing'}, {'field': 'employees', 'v': 45.0::DOUBLE, 'c': 0.9::DOUBLE, 'w': NULL},
   {'field': 'total_assets', 'v': CASE WHEN NOT twice THEN 1250000 * s END, 'c': 0.9::DOUBLE, 'w': CASE WHEN twice THEN 'ambiguous' END}, {'field': 'total_equity', 'v': NULL, 'c': 0.7::DOUBLE, 'w': 'low_confidence'}]) AS f FROM o) AS x""",
    "map_field_diffs": "SELECT o_orderkey, CASE WHEN o_orderkey % 200 = 0 THEN 1 ELSE 0 END AS n_diffs, CASE WHEN o_orderkey % 200 = 0 THEN 'status' ELSE '' END AS fields FROM orders",
}
