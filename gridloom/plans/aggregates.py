"""Grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import aggregates as A
from gridloom.functions.arithmetic import round_float
from gridloom.operators import quantiles as Q
from gridloom.operators import stages
from gridloom.operators.products import products
from gridloom.plans.registry import query, table


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(12,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(12,2))::DOUBLE AS sum_base_price,
sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)))::DOUBLE AS sum_disc_price, count(*)::BIGINT AS count_order,
round(sum(l_quantity::DECIMAL(12,2))::DOUBLE / count(l_quantity), 6) AS avg_qty FROM lineitem WHERE l_shipdate <= DATE '2000-09-02' GROUP BY l_returnflag, l_linestatus""")
def agg_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("date"))
    price, off = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)")
    made = stages.group(
        lines,
        ["l_returnflag", "l_linestatus"],
        sum_qty=A.total("l_quantity", 2, 12).cast("double"),
        sum_base_price=A.total("l_extendedprice", 2, 12).cast("double"),
        sum_disc_price=A.total(price * (1 - off), 4, 18).cast("double"),
        count_order=A.length(),
        avg_qty=F.round(A.mean("l_quantity", 2, 12).cast("double"), 6),
    )
    return made.orderBy("l_returnflag", "l_linestatus")


@query("""SELECT o_orderpriority, min(o_totalprice) AS least, max(o_totalprice) AS most, count(o_orderkey)::BIGINT AS n, min(o_orderdate)::VARCHAR AS first_day, max(o_orderstatus) AS last_status FROM orders GROUP BY o_orderpriority""")
def min_max_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.group(table(spark, sf_dir, "orders"), ["o_orderpriority"], least=A.minimum("o_totalprice"), most=A.maximum("o_totalprice"), n=A.count("o_orderkey"), first_day=F.date_format(A.minimum("o_orderdate"), "yyyy-MM-dd HH:mm:ss"), last_status=A.maximum("o_orderstatus"))


@query("""SELECT l_returnflag, s[(floor(0.5 * (n - 1) + 0.5))::BIGINT + 1] AS q50, s[(floor(0.9 * (n - 1) + 0.5))::BIGINT + 1] AS q90, s[1] AS q0, s[n] AS q100
FROM (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS s, count(l_extendedprice) AS n FROM lineitem GROUP BY l_returnflag)""")
def quantile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"q50": 0.5, "q90": 0.9, "q0": 0.0, "q100": 1.0})


@query("SELECT c_mktsegment, median(c_acctbal) AS median FROM customer GROUP BY c_mktsegment")
def median_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.medians(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal")


@query("SELECT median(o_totalprice) AS median FROM orders")
def median_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.medians(table(spark, sf_dir, "orders"), [], "o_totalprice")


@query("""SELECT p_brand, round(stddev_samp(p_retailprice), 6) AS std, round(stddev_pop(p_retailprice), 6) AS std0, round(var_samp(p_size), 6) AS var, round(var_pop(p_size), 6) AS var0 FROM part GROUP BY p_brand""")
def std_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stages.group(table(spark, sf_dir, "part"), ["p_brand"], std=A.std("p_retailprice"), std0=A.std("p_retailprice", 0), var=A.variance_exact("p_size", 0).cast("double"), var0=A.variance_exact("p_size", 0, 0).cast("double"))
    return made.select("p_brand", *[F.round(c, 6).alias(c) for c in ("std", "std0", "var", "var0")])


@query("""SELECT o_custkey, count(*)::BIGINT AS n, round(ln(product(1 + o_totalprice / 1000000)), 6) AS growth FROM orders GROUP BY o_custkey""")
def product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.group(table(spark, sf_dir, "orders"), ["o_custkey"], n=A.length(), growth=F.round(F.ln(A.product_float(1 + F.col("o_totalprice") / 1000000)), 6))


@query("""SELECT user_id, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id""")
def first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.group(table(spark, sf_dir, "events"), ["user_id"], first_value=A.first("value", "event_id"), last_value=A.last("value", "event_id"), last_type=A.last("event_type", "event_id"))


@query("""SELECT quality, coalesce(bool_and(toxic = 1), true) AS every, coalesce(bool_or(toxic = 1), false) AS some, NOT coalesce(bool_or(toxic = 1), false) AS none FROM labels GROUP BY quality""")
def bool_all_any_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = F.col("toxic") == 1
    return stages.group(table(spark, sf_dir, "labels"), ["quality"], every=A.all_(toxic), some=A.any_(toxic), none=A.none_(toxic))


@query("""SELECT 0::DOUBLE AS total, 1::DOUBLE AS product, 0::BIGINT AS n, NULL::DOUBLE AS least, true AS every, false AS some""")
def aggregates_of_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = table(spark, sf_dir, "orders").where("o_totalprice < 0")
    return none.agg(A.total("o_totalprice", 2).cast("double").alias("total"), A.product_float("o_totalprice").alias("product"), A.length().alias("n"), A.minimum("o_totalprice").alias("least"), A.all_(F.col("o_totalprice") > 0).alias("every"), A.any_(F.col("o_totalprice") > 0).alias("some"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity::DECIMAL(12,2) + l_tax::DECIMAL(12,2) + CASE WHEN l_discount > 0.05 THEN l_discount::DECIMAL(12,2) ELSE 0 END)::DOUBLE AS row_sum,
greatest(l_tax, l_discount) AS row_max, least(l_tax, l_discount) AS row_min, (2 + (l_discount > 0.05)::INT)::BIGINT AS row_count FROM lineitem""")
def row_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.when(F.col("l_discount") > 0.05, F.col("l_discount"))
    made = {"row_sum": A.row_sum("l_quantity", "l_tax", some).cast("double"), "row_max": A.row_max("l_tax", "l_discount"), "row_min": A.row_min("l_tax", "l_discount"), "row_count": A.row_count("l_quantity", "l_tax", some)}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c.alias(n) for n, c in made.items()])


@query("SELECT p_partkey, (p_size * (p_size + 1) // 2)::BIGINT AS up_to_size FROM part")
def range_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", A.range_sum(F.lit(1), F.col("p_size")).cast("bigint").alias("up_to_size"))


@query("""SELECT l_suppkey, round((sum(l_extendedprice::DECIMAL(12,2) * l_quantity::DECIMAL(12,2))::DOUBLE / count(*)), 2) AS worth, (sum(l_quantity::DECIMAL(12,2)) > 100)::BOOLEAN AS busy FROM lineitem GROUP BY l_suppkey""")
def aggregate_of_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    worth = F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_quantity").cast("decimal(12,2)")
    return stages.group(table(spark, sf_dir, "lineitem"), ["l_suppkey"], worth=round_float(A.total(worth, 4).cast("double") / A.length(), 2), busy=A.total("l_quantity", 2) > 100)


@query("""SELECT l_returnflag, sum((l_orderkey * 9000000000000)::HUGEINT)::DOUBLE AS wide FROM lineitem GROUP BY l_returnflag""")
def sum_past_64_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.col("l_orderkey").cast("decimal(18,0)") * F.lit(9000000000000).cast("decimal(13,0)")
    return stages.group(table(spark, sf_dir, "lineitem"), ["l_returnflag"], wide=A.total(wide, 0, 38).cast("double"))


@query("SELECT l_orderkey, product(CASE WHEN l_partkey % 5 = 0 THEN -l_linenumber ELSE l_linenumber END)::BIGINT AS product FROM lineitem GROUP BY l_orderkey")
def product_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_partkey") % 5 == 0, -n).otherwise(n).alias("n"))
    return products(lines, ["l_orderkey"], "n").select("l_orderkey", F.col("product").cast("bigint").alias("product"))
