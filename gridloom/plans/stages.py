"""Stages, sorts, limits, joins, lookups and distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import aggregates as A
from gridloom.functions import logic as L
from gridloom.operators import distinct, lookups, stages
from gridloom.plans.registry import query, table


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O')
ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def filter_select_sort_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stages.filter_rows(table(spark, sf_dir, "orders"), (F.col("o_totalprice") > 100000) & L.is_in("o_orderstatus", ["F", "O", None]))
    return stages.select(rows, "o_orderkey", "o_custkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC LIMIT 50")
def tail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return stages.tail(lines, 50, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("""SELECT p_partkey, p_name, p_retailprice FROM part
WHERE p_size BETWEEN 10 AND 20 AND p_retailprice > 950 AND p_name LIKE '%ring%' AND p_partkey >= 5 AND p_partkey < 1500""")
def grid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {"p_size": L.in_range("p_size", 10, 20), "p_retailprice": F.col("p_retailprice") > 950, "p_name": F.col("p_name").contains("ring"), "p_partkey": L.in_range("p_partkey", 5, 1500, without_high=True)}
    return stages.columns_at(stages.grid_filter(table(spark, sf_dir, "part"), tests), 0, 5).select("p_partkey", "p_name", "p_retailprice")


@query("""SELECT o_orderkey, o_totalprice, c_custkey, c_name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return stages.join(orders, customers, "c_custkey").select("o_orderkey", "o_totalprice", "c_custkey", "c_name", "c_acctbal")


@query("""SELECT c_custkey, c_name, count(o_orderkey)::BIGINT AS orders, coalesce(sum(o_totalprice::DECIMAL(12,2)), 0)::DOUBLE AS spent
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    joined = stages.join(table(spark, sf_dir, "customer"), orders, "c_custkey", how="left")
    return stages.group(joined, ["c_custkey", "c_name"], orders=A.count("o_orderkey"), spent=A.total("o_totalprice", 2).cast("double"))


@query("""SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_name AS n_name_right, b.n_nationkey AS n_nationkey_right
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey""")
def join_name_clash(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    return stages.join(nations, nations.select("*"), "n_regionkey").select("n_nationkey", "n_name", "n_regionkey", "n_name_right", "n_nationkey_right")


@query("""SELECT n.n_nationkey, n.n_name, coalesce(r.r_name, '?') AS region FROM nation n LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) r ON n.n_regionkey = r.r_regionkey""")
def lookup_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").where("r_regionkey <> 2")
    found = lookups.lookup(table(spark, sf_dir, "nation"), regions, "n_regionkey", "r_regionkey", {"region": ("r_name", F.lit("?"))})
    return found.select("n_nationkey", "n_name", "region")


@query("""SELECT c_custkey, count(o_orderkey)::BIGINT AS orders, coalesce(sum(o_totalprice::DECIMAL(12,2)), 0)::DOUBLE AS spent, max(o_totalprice) AS largest
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON o_custkey = c_custkey GROUP BY c_custkey""")
def conditional_aggregate_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    finished = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    made = lookups.conditional(table(spark, sf_dir, "customer"), finished, "c_custkey", "o_custkey", {"orders": F.lit(0), "spent": F.lit(0)}, orders=A.length(), spent=A.total("o_totalprice", 2), largest=A.maximum("o_totalprice"))
    return made.select("c_custkey", F.col("orders").cast("bigint").alias("orders"), F.col("spent").cast("double").alias("spent"), "largest")


@query("""WITH bands AS (SELECT i AS band, i * 1000.0::DOUBLE - 1000 AS low, i * 1500.0::DOUBLE + 500 AS high FROM range(0, 8) t(i))
SELECT band, count(c_custkey)::BIGINT AS customers, coalesce(sum(c_acctbal::DECIMAL(12,2)), 0)::DOUBLE AS balance
FROM bands LEFT JOIN customer ON c_acctbal >= low AND c_acctbal < high GROUP BY band""")
def conditional_aggregate_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.range(8).select(F.col("id").alias("band"), (F.col("id") * 1000.0 - 1000).alias("low"), (F.col("id") * 1500.0 + 500).alias("high"))
    made = lookups.conditional_range(bands, table(spark, sf_dir, "customer"), "low", "high", "c_acctbal", {"balance": F.lit(0)}, customers=("len", "c_acctbal"), balance=("sum", F.col("c_acctbal").cast("decimal(12,2)")))
    return made.select("band", F.col("customers").cast("bigint").alias("customers"), F.col("balance").cast("double").alias("balance"))


@query("""SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) = 1 AS is_unique, count(*) OVER (PARTITION BY c_nationkey) > 1 AS is_duplicated,
row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1 AS is_first, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) = 1 AS is_last FROM customer""")
def is_unique_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = distinct.mark_kinds(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "is_unique", "is_duplicated", "is_first", "is_last")
    return made.select("c_custkey", "is_unique", "is_duplicated", "is_first", "is_last")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def distinct_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return distinct.first_of_each(docs, "text", "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)""")
def selection_by_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("__row", F.col("o_orderkey"))
    mask = orders.select("__row", (F.col("o_totalprice") > 300000).alias("keep"))
    return stages.masked(orders, mask, "keep").select("o_orderkey", "o_custkey")


@query("""SELECT p.p_partkey, p.p_name, s.s_name FROM part p LEFT JOIN supplier s ON p.p_partkey = s.s_suppkey""")
def row_aligned_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("__row", F.col("p_partkey"))
    suppliers = table(spark, sf_dir, "supplier").withColumn("__row", F.col("s_suppkey"))
    return stages.aligned(parts, suppliers).select("p_partkey", "p_name", "s_name")


@query("""SELECT (SELECT count(*) FROM orders)::BIGINT AS orders, (SELECT sum(o_totalprice::DECIMAL(12,2)) FROM orders)::DOUBLE AS revenue,
(SELECT count(*) FROM customer)::BIGINT AS customers, (SELECT max(c_acctbal) FROM customer) AS richest, (SELECT count(DISTINCT p_brand) FROM part)::BIGINT AS brands""")
def summary_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(0).alias("__row")
    a = table(spark, sf_dir, "orders").agg(A.length().alias("orders"), A.total("o_totalprice", 2).cast("double").alias("revenue")).select("*", one)
    b = table(spark, sf_dir, "customer").agg(A.length().alias("customers"), A.maximum("c_acctbal").alias("richest")).select("*", one)
    c = table(spark, sf_dir, "part").agg(F.countDistinct("p_brand").alias("brands")).select("*", one)
    return stages.aligned(stages.aligned(a, b), c).drop("__row")


@query("""SELECT sum(v)::DOUBLE AS total, count(v)::BIGINT AS cells, max(v)::DOUBLE AS largest FROM
(SELECT unnest([l_quantity::DECIMAL(12,2), l_extendedprice::DECIMAL(12,2), l_tax::DECIMAL(12,2)]) AS v FROM lineitem)""")
def block_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = stages.stack(table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("decimal(12,2)").alias(c) for c in ("l_quantity", "l_extendedprice", "l_tax")]), "l_quantity", "l_extendedprice", "l_tax")
    return cells.agg(A.total("value", 2).cast("double").alias("total"), A.count("value").alias("cells"), A.maximum("value").cast("double").alias("largest"))


@query("""SELECT count(l_quantity)::BIGINT AS l_quantity_count, sum(l_quantity::DECIMAL(12,2))::DOUBLE AS l_quantity_sum, count(l_tax)::BIGINT AS l_tax_count, sum(l_tax::DECIMAL(12,2))::DOUBLE AS l_tax_sum FROM lineitem""")
def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("decimal(12,2)").alias("l_quantity"), F.col("l_tax").cast("decimal(12,2)").alias("l_tax"))
    made = stages.summary(lines, "l_quantity", "l_tax")
    return made.select("l_quantity_count", F.col("l_quantity_sum").cast("double").alias("l_quantity_sum"), "l_tax_count", F.col("l_tax_sum").cast("double").alias("l_tax_sum"))
