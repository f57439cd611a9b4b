"""Queries that read landed payloads: bodies and files as services send them, written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import payloads as P
from . import firms
from .extra import _folder
from .series import MONTHLY, monthly, read


def _bodies(spark, sf_dir):
    """(series, months): the months of each series in order, as (period, value)."""
    return monthly(spark, sf_dir).groupBy("series").agg(F.array_sort(F.collect_list(F.struct("period", "value"))).alias("months"))  # some hundred months


def sdmx_json_payload(spark, sf_dir):
    month = lambda m: F.date_format(m.period, "yyyy-MM")
    values = F.to_json(F.transform("months", lambda m: F.struct(month(m).alias("id"))))
    seen = F.to_json(F.map_from_entries(F.transform("months", lambda m, i: F.struct(F.concat(F.lit("0:0:"), i.cast("string")).alias("k"), F.array(m.value).alias("v")))))
    head = '{"data": {"structures": [{"dimensions": {"dataSet": [], "series": [{"id": "REF_AREA", "values": [{"id": "VNM"}]}, {"id": "FREQ", "values": [{"id": "M"}]}], "observation": [{"id": "TIME_PERIOD", "values": '
    body = F.concat(F.lit(head), values, F.lit('}]}}], "dataSets": [{"observations": '), seen, F.lit("}]}}"))
    return P.sdmx_json(_bodies(spark, sf_dir).select("series", body.alias("body")), "series", "body", country="VNM").select("series", "country", "period", "value", "frequency")


def pxweb_payload(spark, sf_dir):
    """Yearly sums (of cents, so that halves round alike in any order of summing) in a statistics office's table, held over the months."""
    y = monthly(spark, sf_dir).groupBy("series", F.year("period").alias("y")).agg(F.round(F.sum(F.col("value").cast("decimal(20,2)")), 0).cast("long").alias("v")).groupBy("series").agg(F.array_sort(F.collect_list(F.struct("y", "v"))).alias("years"))
    number = lambda i: i.cast("string")
    codes, texts = F.to_json(F.transform("years", lambda _, i: number(i))), F.to_json(F.transform("years", lambda x: F.concat(F.lit("Year "), x.y.cast("string"))))
    cells = F.to_json(F.flatten(F.transform("years", lambda x, i: F.array(F.struct(F.array(F.lit("0"), number(i)).alias("key"), F.array(x.v.cast("string")).alias("values")), F.struct(F.array(F.lit("1"), number(i)).alias("key"), F.array(F.lit("..")).alias("values"))))))
    body = F.concat(F.lit('{"meta": {"variables": [{"code": "Industry"}, {"code": "Year", "values": '), codes, F.lit(', "valueTexts": '), texts, F.lit('}]}, "data": {"data": '), cells, F.lit("}}"))
    return P.pxweb(y.select("series", body.alias("body")), "series", "body").select("series", "period", "value")


def statements_json_payload(spark, sf_dir):
    """Statements with their fields under ``fields`` in one half of the firms and beside the header in the other."""
    r = firms.reports(spark, sf_dir)
    head = [F.concat(F.lit("s"), F.col("company_id").cast("string")).alias("stock_code"), F.col("period").cast("string").alias("period"), F.when(F.col("report_type") != "annual", F.col("report_type")).alias("report_type")]
    body = F.when(F.col("company_id") % 2 == 0, F.to_json(F.struct(*head, F.struct("revenue", "net_profit", "employees").alias("fields")))).otherwise(F.to_json(F.struct(*head, "revenue", "net_profit", "employees")))
    return P.statements_json(r.select("company_id", body.alias("body")), "company_id", "body").select("company_id", "stock_code", "period", "report_type", "revenue", "net_profit", "employees", "total_assets")


def statements_html_payload(spark, sf_dir):
    r = firms.reports(spark, sf_dir).select("company_id", "period", "report_type", F.floor("revenue").alias("revenue"), "employees")
    grouped = F.regexp_replace(F.col("revenue").cast("string"), r"(\d)(?=(\d{3})+$)", "$1.")
    body = F.concat(F.lit('<table data-period="'), F.col("period").cast("string"), F.lit('" data-report-type="'), F.col("report_type"), F.lit('"><tr><td class="v" data-field="revenue"> '), grouped, F.lit('</td><td data-field="employees">'), F.col("employees").cast("string"), F.lit('</td><td data-field="net_profit">n/a</td></tr></table>'))
    return P.statements_html(r.select("company_id", body.alias("body")), "company_id", "body").select("company_id", "period", "report_type", "revenue", "employees", "net_profit")


def statement_tables_payload(spark, sf_dir):
    """Two quarters of which only the older has revenue; values are in thousands."""
    c = F.col("s_suppkey").cast("string")
    rows = F.concat(F.lit("<tr><th>Chỉ tiêu</th><th>Quý 1-2023</th><th>Quý 2-2023</th></tr><tr><td><b>Doanh thu bán hàng</b></td><td>1."), F.lpad(c, 3, "0"), F.lit("</td><td></td></tr><tr><td>Tổng tài sản</td><td>"), c, F.lit("</td><td>7</td></tr><tr><td>Giá vốn hàng bán</td><td>500</td><td></td></tr>"))
    return P.statement_tables(read(spark, sf_dir, "supplier").select("s_suppkey", rows.alias("body")), "s_suppkey", "body").select("s_suppkey", "period", "report_type", "revenue", "total_assets", "cost_of_goods", F.round("gross_margin", 6).alias("gross_margin"))


def tiktok_payload(spark, sf_dir):
    ls = read(spark, sf_dir, "lineitem")
    price = F.when(F.col("l_linenumber") % 2 == 0, F.to_json(F.struct(F.struct(F.col("l_extendedprice").alias("sale_price")).alias("price")))).otherwise(F.to_json(F.struct(F.col("l_extendedprice").alias("price"))))
    item = F.concat(F.lit('{"id": "'), F.col("l_partkey").cast("string"), F.lit('", "title": " part '), F.col("l_partkey").cast("string"), F.lit(' ", "sold_count": '), F.col("l_quantity").cast("int").cast("string"), F.lit(", "), F.substring(price, 2, 1000))
    packed = ls.groupBy("l_orderkey").agg(F.concat(F.lit('{"products": ['), F.array_join(F.collect_list(item), ", "), F.lit("]}")).alias("body"))  # an order's lines
    rows = P.tiktok_listings(packed, "l_orderkey", "body")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("revenue_est"), 0).alias("revenue"), F.min("product_name").alias("first_name"))


def provenance_payload(spark, sf_dir):
    source = F.when(F.col("event_type") == "view", " Live:api").when(F.col("event_type") == "click", "SEED").when(F.col("event_type") == "purchase", "fallback").otherwise("file")
    return P.provenance(read(spark, sf_dir, "events").select("event_id", source.alias("source"))).groupBy("source").agg(F.count("*").alias("n"))


def sdmx_xml_files(spark, sf_dir):
    """A service's XML files, one for each series; every third month has no value."""
    obs = F.array_join(F.transform("months", lambda m: F.concat(F.lit('<Obs TIME_PERIOD="'), F.date_format(m.period, "yyyy-MM"), F.lit('" OBS_VALUE="'), F.when(F.month(m.period) % 3 > 0, m.value.cast("decimal(18,2)").cast("string")).otherwise(""), F.lit('"/>'))), "")
    text = F.concat(F.lit('<m><DataSet><Series INDICATOR="'), F.col("series"), F.lit('" FREQ="M" BASE_PER="2015" REF_AREA="VN">'), obs, F.lit("</Series></DataSet></m>"))
    folder = f"{_folder(spark)}/xml"
    _bodies(spark, sf_dir).select(text.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(folder)
    return P.sdmx_xml(spark, folder).select(F.col("indicator").alias("series"), "freq", "country", "period", "value", "unit", "skipped")


def commented_csv_files(spark, sf_dir):
    m = monthly(spark, sf_dir)
    line = F.concat_ws(",", F.lit("C"), F.regexp_replace("series", "[^A-Za-z0-9-]", "_"), F.lit("name"), F.date_format("period", "yyyy-MM"), F.when(F.month("period") > 1, F.col("value").cast("decimal(18,2)").cast("string")).otherwise("n/a"), F.lit("bn"), F.lit("live"))
    folder = f"{_folder(spark)}/csv"
    head = F.lit("# a note\nvsic_code,indicator_code,indicator_name,period,value,unit,source\n")
    packed = m.groupBy("series").agg(F.concat(head, F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("value")).repartition(5, "series")  # some hundred months
    packed.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(folder)
    return P.commented_csv(spark, folder).select("indicator_code", "period", "value", "unit", "source")


QUERIES = {f.__name__: f for f in (sdmx_json_payload, pxweb_payload, statements_json_payload, statements_html_payload, statement_tables_payload, tiktok_payload, provenance_payload, sdmx_xml_files, commented_csv_files)}
SQL = {
    "sdmx_json_payload": f"WITH {MONTHLY} SELECT series, 'VNM' AS country, period, value, 'monthly' AS frequency FROM monthly",
    "pxweb_payload": f"WITH {MONTHLY}, y AS (SELECT series, year(period) AS y, CAST(round(sum(CAST(value AS DECIMAL(20, 2))), 0) AS DOUBLE) AS value FROM monthly GROUP BY 1, 2) SELECT series, make_date(y, i, 1) AS period, value FROM y, range(1, 13) AS r(i)",
    "statements_json_payload": f"WITH {firms.REPORTS} SELECT company_id, 'S' || company_id AS stock_code, period, report_type, revenue, net_profit, CAST(employees AS DOUBLE) AS employees, CAST(NULL AS DOUBLE) AS total_assets FROM reports",
    "statements_html_payload": f"WITH {firms.REPORTS} SELECT company_id, period, report_type, floor(revenue) AS revenue, CAST(employees AS DOUBLE) AS employees, CAST(NULL AS DOUBLE) AS net_profit FROM reports",
    "statement_tables_payload": """WITH t AS (SELECT s_suppkey, CAST('1' || lpad(substr(CAST(s_suppkey AS VARCHAR), 1, 3), 3, '0') AS DOUBLE) AS r FROM supplier)
 SELECT s_suppkey, DATE '2023-03-31' AS period, 'quarterly' AS report_type, r * 1000 AS revenue, s_suppkey * 1000.0::DOUBLE AS total_assets, 500000.0::DOUBLE AS cost_of_goods, round((r - 500) / r, 6) AS gross_margin FROM t""",
    "tiktok_payload": "SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice * CAST(l_quantity AS INTEGER)), 0) AS revenue, min('part ' || l_partkey) AS first_name FROM lineitem GROUP BY 1",
    "provenance_payload": "SELECT CASE event_type WHEN 'view' THEN 'live' WHEN 'click' THEN 'seed' WHEN 'purchase' THEN 'fallback' ELSE 'other' END AS source, count(*) AS n FROM events GROUP BY 1",
    "sdmx_xml_files": f"WITH {MONTHLY} SELECT series, 'M' AS freq, 'VN' AS country, period, CASE WHEN month(period) % 3 > 0 THEN value END AS value, 'index_2015=100' AS unit, CASE WHEN month(period) % 3 = 0 THEN 'missing_OBS_VALUE' END AS skipped FROM monthly",
    "commented_csv_files": f"WITH {MONTHLY} SELECT regexp_replace(series, '[^A-Za-z0-9-]', '_', 'g') AS indicator_code, period, value, 'bn' AS unit, 'live' AS source FROM monthly WHERE month(period) > 1",
}
