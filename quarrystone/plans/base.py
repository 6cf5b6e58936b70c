"""The driver's tables seen as families, species and events, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to three tasks a core: for few bytes with much work a row, which Spark would read in few tasks."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their supplier's region."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    where = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", F.col("r_name").alias("species"))
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(where, lines.l_suppkey == where.s_suppkey)


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, species, n): first lines of a part in a region."""
    return supplied(spark, sf_dir).where("l_linenumber = 1").groupBy(F.col("l_partkey").alias("family"), "species").agg(F.count("*").alias("n"))


COPIES = """
copies AS (
  SELECT l_partkey AS family, r_name AS species, count(*) AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE l_linenumber = 1 GROUP BY 1, 2
)"""
