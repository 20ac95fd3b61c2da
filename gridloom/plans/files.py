"""Sinks and views: what is written to the shared folder and read back is the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.order import file_rows, scratch
from gridloom.plans.registry import query, table
from gridloom.sources import sinks, views


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment, c_custkey % 2 = 0 AS even, 'a \"b\", c' AS quoted FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types come from the text; empty cells are null; quotes and commas stay."""
    made = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"), (F.col("c_custkey") % 2 == 0).alias("even"), F.lit('a "b", c').alias("quoted"))
    path = scratch(spark, "csv")
    sinks.to_csv(made, path)
    return views.csv(spark, path).withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, o_orderstatus, o_orderdate::DATE::VARCHAR AS day FROM orders")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"), "o_orderstatus", F.col("o_orderdate").cast("date").cast("string").alias("day"))
    path = scratch(spark, "json")
    sinks.to_json(made, path)
    return views.json(spark, path, lines=True).select(*made.columns)


@query("SELECT c_nationkey, count(*)::BIGINT AS customers, round(sum(c_acctbal::DECIMAL(12,2)), 2)::DOUBLE AS balance FROM customer GROUP BY c_nationkey")
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by nation, which becomes a partition column, and read back."""
    path = scratch(spark, "parquet")
    sinks.to_parquet(table(spark, sf_dir, "customer"), path, by=["c_nationkey"])
    back = views.parquet(spark, path, {"c_custkey": "bigint", "c_acctbal": "double"})
    return back.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum(F.col("c_acctbal").cast("decimal(12,2)")).cast("double").alias("balance"))


@query("SELECT row_number() OVER () - 1 AS place, r_regionkey::BIGINT AS key, r_name FROM region")
def numbered_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file's own row numbers."""
    return file_rows(spark, f"{sf_dir}/region.parquet").select(F.col("__row").alias("place"), F.col("r_regionkey").cast("bigint").alias("key"), "r_name")
