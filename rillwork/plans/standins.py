"""Hydrology roles played by the given tables, with the same roles as SQL text.

Each function returns a DataFrame Spark derives from whole given tables; the
``*_SQL`` constants are common table expressions that give DuckDB the same
relation for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions import vectors as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def R(c, places: int = 6):
    """Rounded, with negative zero folded into zero."""
    return F.round(c, places) + F.lit(0.0)


# --- hydrograph: supplier = site, ship month = month, quantity = flow -----------

def hydrograph(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("site"), F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"), F.col("l_quantity").alias("v"))
    return V.month_slots(li, ["site", "year"], "month", "v")


MONTHLY_SQL = """monthly AS (
  SELECT l_suppkey AS site, CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(month(l_shipdate) AS INTEGER) AS month, sum(l_quantity) AS v
  FROM lineitem GROUP BY 1, 2, 3)"""
HYDRO_SQL = MONTHLY_SQL + """, hyd AS (
  SELECT m.* FROM monthly m SEMI JOIN
   (SELECT site, year FROM monthly GROUP BY 1, 2 HAVING count(*) = 12) c
   ON m.site = c.site AND m.year = c.year)"""
ANNUAL_SQL = HYDRO_SQL + """, annual AS (
  SELECT site, year, avg(v) AS value FROM hyd GROUP BY 1, 2)"""


def complete_hydrograph(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    return hydrograph(spark, sf_dir).where(V.is_complete(q))


def annual_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_hydrograph(spark, sf_dir).select(
        "site", "year", V.mean(F.col("q")).alias("value"))


# --- climate index: standardised yearly order figures --------------------------

def climate_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("year"), "o_totalprice",
        (F.col("o_orderstatus") == "F").cast("double").alias("done"))
    yearly = orders.groupBy("year").agg(F.avg("o_totalprice").alias("oni"),
                                        F.avg("done").alias("pdo"))
    long = yearly.unpivot("year", ["oni", "pdo"], "index", "raw")
    stats = long.groupBy("index").agg(F.avg("raw").alias("m"), F.stddev_pop("raw").alias("s"))
    return long.join(F.broadcast(stats), "index").select(
        "index", "year", F.round((F.col("raw") - F.col("m")) / F.col("s"), 6).alias("value"))


INDEX_SQL = """yearly AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) AS oni,
         avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pdo
  FROM orders GROUP BY 1),
longidx AS (SELECT 'oni' AS index, year, oni AS raw FROM yearly
            UNION ALL SELECT 'pdo', year, pdo FROM yearly),
idx AS (SELECT index, year, round((raw - avg(raw) OVER (PARTITION BY index))
               / stddev_pop(raw) OVER (PARTITION BY index), 6) AS value FROM longidx)"""


# --- model and observation pairs ------------------------------------------------

def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("site"), F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"), "l_quantity",
        (F.col("l_extendedprice") / 2000.0).alias("m"))
    return li.groupBy("site", "year", "month").agg(
        F.sum("m").alias("model"), F.sum("l_quantity").alias("obs"))


PAIRS_SQL = """pairs AS (
  SELECT l_suppkey AS site, CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(month(l_shipdate) AS INTEGER) AS month,
         sum(l_extendedprice / 2000.0) AS model, sum(l_quantity) AS obs
  FROM lineitem GROUP BY 1, 2, 3)"""


# --- river network: parts form a heap-shaped tree, part h drains to h // 2 ------------

def part_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("p_partkey") + 1
    code = F.expr("shiftright(p_partkey + 1, cast(length(bin(p_partkey + 1)) div 2 as int))")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("segment_id"), h.alias("u"), F.floor(h / 2).alias("v"),
        F.col("p_size").cast("double").alias("length"),
        F.lpad(code.cast("string"), 4, "0").alias("huc4"))


SEGMENTS_SQL = """seg AS (
  SELECT p_partkey AS segment_id, p_partkey + 1 AS u, (p_partkey + 1) // 2 AS v,
         CAST(p_size AS DOUBLE) AS length, length(bin(p_partkey + 1)) - 1 AS lvl,
         lpad(CAST((p_partkey + 1) >> CAST(length(bin(p_partkey + 1)) // 2 AS BIGINT) AS VARCHAR), 4, '0') AS huc4
  FROM part)"""


def part_reaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("p_partkey") + 1
    return table(spark, sf_dir, "part").select(
        h.alias("hydroseq"), F.floor(h / 2).alias("dnhydroseq"),
        F.col("p_size").cast("double").alias("q_incr"), "p_retailprice", "p_brand")
