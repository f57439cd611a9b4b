"""Industry heat map: value by class and firm, the best of each firm, then sums, firm counts and intensity by class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def heatmap_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("class_code"))
    firm = lines.join(parts, "l_partkey").groupBy("class_code", "l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("va")).where("va > 0")
    by_class = firm.groupBy("class_code").agg(F.round(F.sum("va"), 2).alias("total_va"), F.count("*").alias("company_count"))
    peak = F.max("total_va").over(Window.partitionBy())  # one row for each class
    return by_class.withColumn("intensity", F.round(F.col("total_va") / peak, 4)).orderBy(F.desc("total_va"), "class_code")


QUERIES = {"heatmap_intensity": heatmap_intensity}
SQL = {
    "heatmap_intensity": """
WITH firm AS (
  SELECT p_type AS class_code, l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS va
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2 HAVING sum(l_extendedprice * (1 - l_discount)) > 0
), by_class AS (SELECT class_code, round(sum(va), 2) AS total_va, count(*) AS company_count FROM firm GROUP BY 1)
SELECT *, round(total_va / max(total_va) OVER (), 4) AS intensity FROM by_class ORDER BY total_va DESC, class_code
""",
}
