"""Window functions, running values over the whole order, and positional references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import dates
from gridloom.functions import sequences as S
from gridloom.operators import prefix, ranks, recurrences
from gridloom.operators import windows as W
from gridloom.operators.order import number_rows
from gridloom.plans.registry import query, table

#: A value that is missing on every seventh event.
_SOME = "CASE WHEN event_id % 7 <> 0 THEN value END"
_BY = "PARTITION BY user_id ORDER BY ts, event_id"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("some", F.when(F.col("event_id") % 7 != 0, F.col("value")).cast("decimal(12,2)"))


_ORDER, _USER = ["ts", "event_id"], ["user_id"]


@query(f"""SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN sum(({_SOME})::DECIMAL(12,2)) OVER (w ROWS UNBOUNDED PRECEDING) END::DOUBLE AS cum_sum,
CASE WHEN event_id % 7 <> 0 THEN min({_SOME}) OVER (w ROWS UNBOUNDED PRECEDING) END AS cum_min, CASE WHEN event_id % 7 <> 0 THEN max({_SOME}) OVER (w ROWS UNBOUNDED PRECEDING) END AS cum_max,
count({_SOME}) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS cum_count FROM events WINDOW w AS ({_BY})""")
def cum_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.col("some")
    made = prefix.running(_events(spark, sf_dir), _ORDER, {"cum_sum": ("sum", some), "cum_min": ("min", some), "cum_max": ("max", some), "cum_count": ("count", some)}, _USER)
    return made.select("event_id", *[F.col(c).cast("double").alias(c) for c in ("cum_sum", "cum_min", "cum_max")], "cum_count")


@query("""SELECT event_id, sum(value::DECIMAL(12,2)) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS total, count(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS seen,
max(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM events""")
def cum_over_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = prefix.running(table(spark, sf_dir, "events"), ["ts", "event_id"], {"total": ("sum", F.col("value").cast("decimal(12,2)")), "seen": ("count", F.col("value")), "peak": ("max", F.col("value"))})
    return made.select("event_id", F.col("total").cast("double").alias("total"), "seen", "peak")


@query("""SELECT event_id, sum(value::DECIMAL(12,2)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS total FROM events""")
def cum_by_large_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = prefix.running(table(spark, sf_dir, "events"), ["ts", "event_id"], {"total": ("sum", F.col("value").cast("decimal(12,2)"))}, ["event_type"])
    return made.select("event_id", F.col("total").cast("double").alias("total"))


@query("""SELECT user_id, event_id, round(ln(product(1 + value / 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), 6) AS growth FROM events""")
def cum_prod_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = prefix.running(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), _ORDER, {"product": ("product", 1 + F.col("value") / 1000)}, _USER)
    return made.select("user_id", "event_id", F.round(F.ln("product"), 6).alias("growth"))


@query(f"""SELECT event_id, (({_SOME})::DECIMAL(12,2) - lag(({_SOME})::DECIMAL(12,2)) OVER ({_BY}))::DOUBLE AS diff, (value::DECIMAL(12,2) - lag(value::DECIMAL(12,2), 2) OVER ({_BY}))::DOUBLE AS diff2,
value / lag(value) OVER ({_BY}) - 1 AS pct FROM events""")
def diff_pct_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"diff": lambda w: W.diff("some", w).cast("double"), "diff2": lambda w: W.diff(F.col("value").cast("decimal(12,2)"), w, 2).cast("double"), "pct": lambda w: W.pct_change("value", w)}
    return prefix.near(_events(spark, sf_dir), made, _ORDER, _USER, before=2).select("event_id", *made)


@query("""SELECT c_custkey, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY c_nationkey, v IS NULL ORDER BY v) END::BIGINT AS least,
CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY c_nationkey, v IS NULL ORDER BY v) + count(*) OVER (PARTITION BY c_nationkey, v) - 1 END::BIGINT AS most,
CASE WHEN v IS NOT NULL THEN dense_rank() OVER (PARTITION BY c_nationkey, v IS NULL ORDER BY v DESC) END::BIGINT AS dense_desc,
CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY c_nationkey, v IS NULL ORDER BY v, c_custkey) END::BIGINT AS ordinal,
CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY c_nationkey, v IS NULL ORDER BY v) + (count(*) OVER (PARTITION BY c_nationkey, v) - 1) / 2 END::DOUBLE AS average
FROM (SELECT *, CASE WHEN c_custkey % 11 <> 0 THEN floor(c_acctbal / 500)::BIGINT END AS v FROM customer)""")
def rank_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 11 != 0, F.floor(F.col("c_acctbal") / 500)).alias("v"))
    wanted = {"least": ("min", False), "most": ("max", False), "dense_desc": ("dense", True), "ordinal": ("ordinal", False), "average": ("average", False)}
    return ranks.ranked_all(rows, "v", wanted, ["c_nationkey"], "c_custkey").select("c_custkey", *wanted)


@query(f"""SELECT event_id, last_value(({_SOME}) IGNORE NULLS) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS forward_fill,
first_value(({_SOME}) IGNORE NULLS) OVER ({_BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward_fill FROM events""")
def fill_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = prefix.filled(prefix.filled(_events(spark, sf_dir), "some", "forward_fill", _ORDER, _USER), "some", "backward_fill", _ORDER, _USER, back=True)
    return made.select("event_id", F.col("forward_fill").cast("double").alias("forward_fill"), F.col("backward_fill").cast("double").alias("backward_fill"))


_FULL = f"count({_SOME}) OVER ({_BY} ROWS 2 PRECEDING) = 3"


@query(f"""SELECT event_id, CASE WHEN {_FULL} THEN sum(({_SOME})::DECIMAL(12,2)) OVER ({_BY} ROWS 2 PRECEDING) END::DOUBLE AS rolling_sum,
CASE WHEN {_FULL} THEN round(sum(({_SOME})::DECIMAL(12,2)) OVER ({_BY} ROWS 2 PRECEDING)::DOUBLE / 3, 6) END AS rolling_mean,
CASE WHEN {_FULL} THEN min({_SOME}) OVER ({_BY} ROWS 2 PRECEDING) END AS rolling_min, CASE WHEN {_FULL} THEN max({_SOME}) OVER ({_BY} ROWS 2 PRECEDING) END AS rolling_max,
CASE WHEN {_FULL} THEN round(stddev_samp({_SOME}) OVER ({_BY} ROWS 2 PRECEDING), 4) END AS rolling_std FROM events""")
def rolling_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"rolling_sum": lambda w: W.rolling_sum("some", 3, w).cast("double"), "rolling_mean": lambda w: F.round(W.rolling_mean_exact("some", 3, w, 2).cast("double"), 6), "rolling_min": lambda w: W.rolling_min("some", 3, w).cast("double"), "rolling_max": lambda w: W.rolling_max("some", 3, w).cast("double"), "rolling_std": lambda w: F.round(W.rolling_std("some", 3, w), 4)}
    return prefix.near(_events(spark, sf_dir), made, _ORDER, _USER, before=2).select("event_id", *made)


@query(f"""SELECT event_id, lag(value) OVER ({_BY}) AS back, lead(value, 2) OVER ({_BY}) AS ahead, coalesce(lag(event_type) OVER ({_BY}), 'start') AS before FROM events""")
def shift_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"back": lambda w: W.shift("value", w), "ahead": lambda w: W.shift("value", w, -2), "before": lambda w: F.coalesce(W.shift("event_type", w), F.lit("start"))}
    return prefix.near(table(spark, sf_dir, "events"), made, _ORDER, _USER, before=1, after=2).select("event_id", *made)


@query("""SELECT event_id, lag(value, 3) OVER (ORDER BY event_id) AS back, lead(value) OVER (ORDER BY event_id) AS ahead,
sum(value::DECIMAL(12,2)) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)::DOUBLE AS around FROM events""")
def shift_over_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = number_rows(table(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    value = F.col("value").cast("decimal(12,2)")
    made = {"back": lambda w: F.lag("value", 3).over(w), "ahead": lambda w: F.lead("value").over(w), "around": lambda w: W.sliding(F.sum(value), 2, 1, w)}
    near = prefix.with_neighbours(rows, made, before=3, after=1, block=500)
    return near.select("event_id", "back", "ahead", F.col("around").cast("double").alias("around"))


@query(f"""SELECT event_id, round(sum(value::DECIMAL(12,2)) OVER ({_BY} ROWS UNBOUNDED PRECEDING)::DOUBLE / count(value) OVER ({_BY} ROWS UNBOUNDED PRECEDING), 6) AS prefix_mean,
sum(value::DECIMAL(12,2)) OVER ({_BY} ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)::DOUBLE AS around FROM events""")
def prefix_and_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value").cast("decimal(12,2)")
    so_far = prefix.running(table(spark, sf_dir, "events"), _ORDER, {"total": ("sum", v), "seen": ("count", v)}, _USER)
    made = prefix.near(so_far, {"around": lambda w: W.sliding(F.sum(v), 1, 2, w)}, _ORDER, _USER, before=1, after=2)
    return made.select("event_id", F.round(F.col("total").cast("double") / F.col("seen"), 6).alias("prefix_mean"), F.col("around").cast("double").alias("around"))


@query("""SELECT o_orderkey, (sum(o_totalprice::DECIMAL(12,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) + 100)::DOUBLE AS balance FROM orders""")
def recursive_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = recurrences.accumulated(table(spark, sf_dir, "orders"), F.col("o_totalprice").cast("decimal(12,2)"), "balance", ["o_orderdate", "o_orderkey"], ["o_custkey"], start=100)
    return made.select("o_orderkey", F.col("balance").cast("double").alias("balance"))


@query("""WITH placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT a.event_id, round(sum(b.value * pow(1 / 3.0::DOUBLE, a.n - b.n)), 6) AS level FROM placed a JOIN placed b ON a.user_id = b.user_id AND b.n <= a.n GROUP BY a.event_id""")
def decayed_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return recurrences.decayed(events, F.col("value"), 1 / 3, "level", _USER, _ORDER).select("event_id", F.round("level", 6).alias("level"))


@query("""SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place, (5 + 2 * (row_number() OVER (ORDER BY c_custkey) - 1))::BIGINT AS odd,
CASE WHEN 5 + 2 * (row_number() OVER (ORDER BY c_custkey) - 1) <= 99 THEN 5 + 2 * (row_number() OVER (ORDER BY c_custkey) - 1) END::BIGINT AS short,
(DATE '2025-01-01' + (7 * (row_number() OVER (ORDER BY c_custkey) - 1))::INT)::VARCHAR AS week,
['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][(1 + row_number() OVER (ORDER BY c_custkey)) % 7 + 1] AS day FROM customer""")
def sequence_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = number_rows(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    made = {"place": F.col("__row"), "odd": S.arithmetic("__row", 5, 7).cast("bigint"), "short": S.arithmetic("__row", 5, 7, 99).cast("bigint"), "week": dates.date_text(S.dates_by_days("__row", "2025-01-01", 7)), "day": S.cycle("__row", S.DAYS, "Wed", short=True)}
    return rows.select("c_custkey", *[c.alias(n) for n, c in made.items()])


_RANKED = "(SELECT *, CASE WHEN c_custkey % 11 <> 0 THEN floor(c_acctbal / 500)::BIGINT END AS v FROM customer)"


@query(f"""SELECT c_custkey, CASE WHEN v IS NOT NULL THEN rank() OVER (ORDER BY v IS NULL, v DESC) END::BIGINT AS least, CASE WHEN v IS NOT NULL THEN row_number() OVER (ORDER BY v IS NULL, v DESC, c_custkey) END::BIGINT AS ordinal,
CASE WHEN v IS NOT NULL THEN dense_rank() OVER (ORDER BY v IS NULL, v) END::BIGINT AS dense, CASE WHEN v IS NOT NULL THEN rank() OVER (ORDER BY v IS NULL, v) + (count(*) OVER (PARTITION BY v) - 1) / 2 END::DOUBLE AS average FROM {_RANKED}""")
def rank_over_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 != 0, F.floor(F.col("c_acctbal") / 500)).alias("v"))
    wanted = {"least": ("min", True), "ordinal": ("ordinal", True), "dense": ("dense", False), "average": ("average", False)}
    return ranks.ranked_all(rows, "v", wanted, row="c_custkey").drop("v")


@query("""SELECT event_id, last_value((CASE WHEN event_id % 7 = 0 THEN value END) IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events""")
def fill_over_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_id") % 7 == 0, F.col("value")).alias("some"))
    return prefix.filled(rows, "some", "filled", ["ts", "event_id"]).select("event_id", "filled")
