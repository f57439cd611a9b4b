"""Landed payloads as typed records: SDMX in XML and JSON, PX-Web, commented CSV, statements, listings, logs, code lists.

Payload columns are parsed in place as VARIANT or by patterns, so that one scan of landed bodies gives all records; bad
parts become nulls or rows with a reason, never exceptions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text as X
from ..operators.windows import step_held

#: Series of the statistics office by SDMX indicator; of quarterly and annual ones the quarterly is preferred.
SDMX_SERIES = {"AIP_ISIC4_C_IX": "IIP_C", "NGDPVA_R_ISIC4_C_XDC": "VA_C", "NGDPVA_ISIC4_C_XDC": "VA_C_NOMINAL"}
FREQUENCIES = {"M": "monthly", "Q": "quarterly", "A": "annual"}
#: A marketplace writes prices times this; statement tables are in thousands.
PRICE_UNIT, STATEMENT_UNIT = 100_000, 1000
STATEMENT_FIELDS = ("revenue", "profit_before_tax", "net_profit", "total_assets", "total_equity", "current_assets", "current_liabilities", "operating_expenses", "cost_of_goods", "rental_cost", "remuneration", "employees", "gross_margin")
#: Folded row labels of quarterly statement tables, the first hit counts.
STATEMENT_LABELS = (
    ("doanh thu ban hang", "revenue"), ("doanh thu thuan", "revenue"), ("gia von hang ban", "cost_of_goods"), ("tong loi nhuan truoc thue", "profit_before_tax"), ("loi nhuan truoc thue", "profit_before_tax"),
    ("loi nhuan sau thue cua cong ty me", "net_profit"), ("loi nhuan sau thue", "net_profit"), ("tong tai san luu dong ngan han", "current_assets"), ("tai san ngan han", "current_assets"), ("tong tai san", "total_assets"),
    ("no ngan han", "current_liabilities"), ("von chu so huu", "total_equity"),
)


def get(v: str, path: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', '{kind}')")


def first_of(v: str, *paths: str, kind: str = "string") -> Column:
    return F.coalesce(*(get(v, p, kind) for p in paths))


def items(df: DataFrame, body: str, *paths: str) -> DataFrame:
    """``df`` with a VARIANT column ``item`` for each element of the first array that the body has."""
    return df.withColumn("__v", F.try_parse_json(body)).withColumn("item", F.explode(first_of("__v", *paths, kind="array<variant>"))).drop("__v", body)


def sdmx_xml(spark: SparkSession, path: str) -> DataFrame:
    """Observations of SDMX 2.1 StructureSpecificData files: series attributes, period, value and why one is skipped."""
    schema = "_INDICATOR STRING, _FREQ STRING, _BASE_PER STRING, _REF_AREA STRING, Obs ARRAY<STRUCT<_TIME_PERIOD STRING, _OBS_VALUE STRING>>"
    rows = spark.read.format("xml").schema(schema).option("rowTag", "Series").load(path)
    rows = rows.select(F.col("_INDICATOR").alias("indicator"), F.col("_FREQ").alias("freq"), F.col("_BASE_PER").alias("base"), F.col("_REF_AREA").alias("country"), F.explode("Obs").alias("o"))
    t, v = F.trim("o._TIME_PERIOD"), F.trim(F.coalesce(F.col("o._OBS_VALUE"), F.lit("")))
    period, value = X.period(t), X.number(v, "plain")
    reason = F.when(t.isNull() | period.isNull(), "invalid_TIME_PERIOD").when(v == "", "missing_OBS_VALUE").when(value.isNull(), "invalid_OBS_VALUE")
    unit = F.concat(F.lit("index_"), F.col("base"), F.lit("=100"))
    return rows.select("indicator", "freq", "country", period.alias("period"), value.alias("value"), unit.alias("unit"), reason.alias("skipped"))


def office_series(observations: DataFrame, series: dict[str, str] = SDMX_SERIES) -> DataFrame:
    """Good observations of the wanted series, quarterly and annual ones step-held to months, quarterly preferred."""
    code = F.element_at(F.create_map(*(F.lit(x) for kv in series.items() for x in kv)), F.col("indicator"))
    good = observations.where("skipped IS NULL").withColumn("indicator_code", code).where("indicator_code IS NOT NULL")
    rank = F.when(F.col("freq") == "M", 0).when(F.col("freq") == "Q", 1).otherwise(2)
    best = good.groupBy("indicator_code").agg(F.min(rank).alias("__best"))
    kept = good.join(F.broadcast(best), "indicator_code").where(rank == F.col("__best")).drop("__best")  # a row for each wanted series
    months = F.when(F.col("freq") == "M", 1).when(F.col("freq") == "Q", 3).otherwise(12)
    return step_held(kept, months)


def sdmx_json(df: DataFrame, key: str, body: str, country: str | None = None, activity: str | None = None) -> DataFrame:
    """Observations of SDMX-JSON 2 messages, bare or wrapped under ``sdmx``: index keys resolved against the dimensions' values."""
    parsed = F.try_parse_json(body)
    v = df.select(key, F.coalesce(F.try_variant_get(parsed, "$.sdmx", "variant"), parsed).alias("__v"))
    dims = "transform(flatten(array({})), d -> struct(try_variant_get(d, '$.id', 'string') AS id, transform(try_variant_get(d, '$.values', 'array<variant>'), x -> try_variant_get(x, '$.id', 'string')) AS ids))"
    levels = ", ".join(f"coalesce(try_variant_get(__v, '$.data.structures[0].dimensions.{level}', 'array<variant>'), array())" for level in ("dataSet", "series", "observation"))
    v = v.select(key, F.expr(dims.format(levels)).alias("__d"), F.explode(F.map_entries(get("__v", "$.data.dataSets[0].observations", "map<string,variant>"))).alias("__o"))
    v = v.withColumn("__i", F.transform(F.split("__o.key", ":"), lambda i: i.try_cast("int")))
    named = F.map_from_entries(F.zip_with("__d", "__i", lambda d, i: F.struct(F.coalesce(d.id, F.lit("?")).alias("k"), F.try_element_at(d.ids, i + 1).alias("v"))))
    v = v.where(F.size("__d") == F.size("__i")).withColumn("__m", named)
    at = lambda name: F.try_element_at("__m", F.lit(name))
    freq = F.coalesce(at("FREQ"), F.lit("M"))
    labels = F.create_map(*(F.lit(x) for kv in FREQUENCIES.items() for x in kv))
    rows = v.select(key, at("REF_AREA").alias("country"), at("ACTIVITY").alias("activity"), X.period(at("TIME_PERIOD")).alias("period"), get("__o.value", "$[0]", "double").alias("value"), F.coalesce(at("UNIT_MEASURE"), F.lit("index")).alias("unit"), F.coalesce(F.try_element_at(labels, freq), freq).alias("frequency"))
    for name, wanted in (("country", country), ("activity", activity)):
        if wanted is not None:
            rows = rows.where(F.col(name).isNull() | (F.col(name) == wanted))
    return rows.where("value IS NOT NULL AND period IS NOT NULL")


def pxweb(df: DataFrame, key: str, body: str, activity: str = "0", monthly: bool = True) -> DataFrame:
    """Values of one activity in PX-Web tables with their metadata, by year, held over its months if ``monthly``."""
    v = df.select(key, F.try_parse_json(body).alias("__v"))
    year = "element_at(filter(try_variant_get(__v, '$.meta.variables', 'array<variant>'), x -> try_variant_get(x, '$.code', 'string') = 'Year'), 1)"
    v = v.withColumn("__y", F.expr(f"try_variant_get({year}, '$.values', 'array<string>')")).withColumn("__t", F.expr(f"try_variant_get({year}, '$.valueTexts', 'array<string>')"))
    v = v.select(key, F.map_from_arrays("__y", "__t").alias("__years"), F.explode(get("__v", "$.data.data", "array<variant>")).alias("__c"))
    label = F.try_element_at("__years", get("__c", "$.key[1]"))
    y = F.regexp_extract(label, r"(20\d{2}|19\d{2})", 1).try_cast("int")
    rows = v.where(get("__c", "$.key[0]") == activity).select(key, F.make_date(y, F.lit(1), F.lit(1)).alias("period"), X.number(get("__c", "$.values[0]"), "plain").alias("value"))
    rows = rows.where("period IS NOT NULL AND value IS NOT NULL")
    return step_held(rows, 12) if monthly else rows


def commented_csv(spark: SparkSession, path: str) -> DataFrame:
    """Series rows of CSV files with a header and ``#`` comment lines; rows without period or value are dropped."""
    schema = "vsic_code STRING, indicator_code STRING, indicator_name STRING, period STRING, value STRING, unit STRING, source STRING"
    rows = spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)
    return rows.withColumns({"period": X.period(F.col("period")), "value": X.number(F.col("value"), "plain")}).where("period IS NOT NULL AND value IS NOT NULL")


def statements_json(df: DataFrame, key: str, body: str) -> DataFrame:
    """Financial statements, with their fields under ``fields`` or beside the header."""
    v = df.select(key, F.try_parse_json(body).alias("__v"))
    fields = [first_of("__v", f"$.fields.{f}", f"$.{f}", kind="double").alias(f) for f in STATEMENT_FIELDS]
    return v.select(key, F.upper(get("__v", "$.stock_code")).alias("stock_code"), F.try_to_date(get("__v", "$.period")).alias("period"), F.coalesce(get("__v", "$.report_type"), F.lit("annual")).alias("report_type"), *fields, get("__v", "$.source_url").alias("source_url"))


def statements_html(df: DataFrame, key: str, body: str) -> DataFrame:
    """Statements of pages whose cells name their field in ``data-field``."""
    cells = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<td\b[^>]*\bdata-field=[\"']([a-z_]+)[\"'][^>]*>[^<]*</td>"), F.lit(0))
    name = lambda c: F.regexp_extract(c, r"(?is)data-field=[\"']([a-z_]+)[\"']", 1)
    pairs = F.map_from_entries(F.transform(F.array_distinct(F.transform(cells, name)), lambda n: F.struct(n.alias("k"), F.element_at(F.filter(cells, lambda c: name(c) == n), 1).alias("v"))))
    rows = df.select(key, F.col(body), pairs.alias("__f"))
    value = lambda f: X.number(F.regexp_extract(F.try_element_at("__f", F.lit(f)), r">([^<]*)<", 1), "vn").alias(f)
    attribute = lambda a: F.nullif(F.regexp_extract(F.col(body), rf"(?is)\bdata-{a}=[\"']([^\"']*)[\"']", 1), F.lit(""))
    return rows.select(key, F.try_to_date(attribute("period")).alias("period"), F.coalesce(attribute("report-type"), F.lit("annual")).alias("report_type"), *map(value, STATEMENT_FIELDS))


def statement_tables(df: DataFrame, key: str, body: str) -> DataFrame:
    """Quarterly statement tables: rows by label, the latest quarter with revenue (else with any value), in full units."""
    tr = F.explode(F.regexp_extract_all(F.col(body), F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0)))
    cell = F.transform(F.regexp_extract_all("__tr", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+|&nbsp;", " ")))
    rows = df.select(key, tr.alias("__tr")).select(key, cell.alias("cells"))
    flat = rows.select(key, F.col("cells")[0].alias("label"), F.posexplode("cells").alias("i", "cell"))
    quarter = F.regexp_extract("cell", r"(?i)Qu[yý]\s*([1-4])\s*[-–]?\s*(20\d{2})", 1).try_cast("int"), F.regexp_extract("cell", r"(?i)Qu[yý]\s*([1-4])\s*[-–]?\s*(20\d{2})", 2).try_cast("int")
    heads = flat.where(quarter[0].isNotNull()).groupBy(key, "i").agg(F.max(X.quarter_end(quarter[1], quarter[0])).alias("period"))
    field = X.mapped(F.col("label"), STATEMENT_LABELS)
    values = flat.select(key, "i", field.alias("field"), X.number(F.col("cell"), "dots").alias("v")).where("i > 0 AND field IS NOT NULL AND v IS NOT NULL")
    values = values.join(heads, [key, "i"]).groupBy(key, "period", "field").agg(F.min_by(F.col("v") * STATEMENT_UNIT, "i").alias("v"))
    quarters = values.groupBy(key, "period").agg(F.max(F.col("field") == "revenue").alias("has"), F.map_from_entries(F.collect_list(F.struct("field", "v"))).alias("f"))
    best = quarters.groupBy(key).agg(F.max_by(F.struct("period", "f"), F.struct("has", "period")).alias("q"))
    fields = sorted({f for _, f in STATEMENT_LABELS})
    out = best.select(key, F.col("q.period").alias("period"), F.lit("quarterly").alias("report_type"), *(F.try_element_at("q.f", F.lit(f)).alias(f) for f in fields))
    return out.withColumn("gross_margin", F.try_divide(F.col("revenue") - F.col("cost_of_goods"), F.col("revenue")))


def revenue_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("revenue_est", F.col("price") * F.col("units_sold_est"))


def shopee_listings(df: DataFrame, key: str, body: str) -> DataFrame:
    """Listings of item documents, the items plain or wrapped; prices in small units."""
    rows = items(df.select(key, body), body, "$.items", "$.data.items")
    at = lambda kind, *names: first_of("item", *(f"$.item_basic.{n}" for n in names), *(f"$.{n}" for n in names), kind=kind)
    raw = X.number(at("string", "price", "price_min"), "plain")
    price = F.when((raw > 0) & (raw / PRICE_UNIT < 1), raw).otherwise(raw / PRICE_UNIT)
    name = F.trim(at("string", "name", "title"))
    url = F.concat(F.lit("https://shopee.vn/product/-/"), at("string", "itemid", "item_id"))
    units = at("string", "historical_sold", "sold").try_cast("double").try_cast("int")
    return revenue_of(rows.select(key, F.lit("shopee").alias("platform"), name.alias("product_name"), price.alias("price"), units.alias("units_sold_est"), at("double", "item_rating.rating_star", "item_rating").alias("rating"), url.alias("product_url")).where("product_name <> ''"))


def tiktok_listings(df: DataFrame, key: str, body: str) -> DataFrame:
    """Listings of product documents, the price plain or in a struct."""
    rows = items(df.select(key, body), body, "$.products", "$.items")
    price = X.number(first_of("item", "$.price.sale_price", "$.price.price", "$.price"), "plain")
    url = F.concat(F.lit("https://www.tiktok.com/shop/pdp/"), first_of("item", "$.product_id", "$.id"))
    units = first_of("item", "$.sold_count", "$.units_sold", "$.historical_sold").try_cast("double").try_cast("int")
    return revenue_of(rows.select(key, F.lit("tiktok").alias("platform"), F.trim(first_of("item", "$.title", "$.name", "$.product_name")).alias("product_name"), price.alias("price"), units.alias("units_sold_est"), first_of("item", "$.rating", "$.rating_star", kind="double").alias("rating"), url.alias("product_url")).where("product_name <> ''"))


def provenance(rows: DataFrame, source: str = "source") -> DataFrame:
    """``source`` as live, seed, fallback or other."""
    s = F.lower(F.trim(source))
    return rows.withColumn(source, F.when(s.isin("live", "seed", "fallback"), s).when(s.startswith("live"), "live").otherwise("other"))


def provenance_counts(rows: DataFrame, source: str = "source") -> DataFrame:
    return rows.agg(*(F.count_if(F.col(source) == s).alias(s) for s in ("live", "seed", "fallback", "other")), (F.count("*") == 0).cast("int").alias("empty"))


def jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good records of a JSON-lines log, and a one-row count of malformed lines."""
    rows = spark.read.text(path).where("trim(value) <> ''").withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("ok", F.try_parse_json("value").isNotNull())
    return rows.where("ok").select("r.*"), rows.agg(F.count_if(~F.col("ok")).alias("skipped"))


def allowed(rows: DataFrame, allow: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are on the allow-list."""
    return rows.join(allow.select(*keys).distinct(), keys, "left_semi")


def code_list(spark: SparkSession, path: str) -> DataFrame:
    """Four-digit codes of a classification's JSON mapping."""
    rows = spark.read.schema("vsic_code STRING, isic_code STRING, level INT, name_vi STRING, name_en STRING, parent_code STRING").option("multiLine", True).json(path)
    return rows.where("level = 4 AND length(vsic_code) = 4")


def usable(spark: SparkSession, path: str, column: str) -> DataFrame | None:
    """A Parquet artifact, or None if it is missing, empty or lacks the column."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    return df if column in df.columns and not df.limit(1).isEmpty() else None


def shop_allow_list(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, url, channel) of a discovery allow-list; the channel is told by the URL where it is not given."""
    rows = spark.read.schema("ticker STRING, url STRING, channel STRING").option("multiLine", True).json(path)
    return rows.where("ticker IS NOT NULL AND trim(url) <> ''").select(F.upper(F.trim("ticker")).alias("ticker"), F.trim("url").alias("url"), F.coalesce(F.lower("channel"), X.channel(F.col("url"))).alias("channel"))


def universe(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good rows of a universe file (ticker and source type known), and those that are not, with why."""
    rows = spark.read.schema("ticker STRING, name STRING, source_type STRING, status STRING").option("multiLine", True).json(path)
    reason = F.when(F.coalesce(F.trim("ticker"), F.lit("")) == "", "no_ticker").when(F.col("source_type").isNull(), "no_source_type")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def series_url(base: str, *key: str | None, start: str | None = None) -> str:
    """The address of one series in an SDMX service: its key's parts between dots (empty ones are wildcards)."""
    return f"{base.rstrip('/')}/{'.'.join(k or '' for k in key)}" + (f"?startPeriod={start}" if start else "")


def is_empty_series(status: Column, body: Column) -> Column:
    """Whether a service's answer says that a series has no data: not found, no content, or a body without observations."""
    return status.isin(204, 404) | F.coalesce(body.rlike(r"(?i)no\s*(records|results|data)\s*found"), F.lit(False)) | (F.coalesce(F.trim(body), F.lit("")) == "")


def embedded_json(html: Column, name: str | None = None) -> Column:
    """The first JSON text in a page: of a script of type ld+json, or with ``name`` what a script assigns to that name; null if it is none.

    For a body that is JSON itself, or holds some without a script, see :func:`json_within`.
    """
    pattern = rf"(?s)\b{re.escape(name)}\s*=\s*(\{{.*?\}}|\[.*?\])\s*;?\s*</script" if name else r"(?is)<script[^>]*ld\+json[^>]*>\s*(.*?)\s*</script"
    found = F.regexp_extract(html, pattern, 1)
    return F.when(F.try_parse_json(F.nullif(found, F.lit(""))).isNotNull(), found)


def json_within(text: Column) -> Column:
    """The JSON object of a body: the body itself, else what stands from its first { to its last }; null if that is none."""
    t = F.trim(text)
    start, end = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    inner = F.when((start > 0) & (end > start) & F.contains(t, F.lit("}")), F.substring(t, start, end - start + 1))

    def is_object(c: Column) -> Column:
        alone = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))  # in brackets, as a parser passes over what follows a whole value
        return F.coalesce(F.schema_of_variant(F.try_variant_get(alone, "$[0]", "variant")).startswith("OBJECT") & F.try_variant_get(alone, "$[1]", "variant").isNull(), F.lit(False))

    return F.when(is_object(t), t).when(is_object(inner), inner)
