"""Medians and nearest-rank quantiles of groups of any size.

Equal values are counted first; ranks come from running counts over a range-partitioned order, so no group's values are
gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.prefix import running


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """The keys to group by, and those to show: without keys all rows are one group."""
    return (df, keys, keys) if keys else (df.withColumn("__all", F.lit(0)), ["__all"], [])


def _ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, value, n, upto, size``: each distinct value, its count, the count up to it and the group's."""
    tally = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = running(tally, [value], {"upto": ("sum", F.col("n"))}, keys)
    size = ranked.groupBy(*[F.col(k).alias(f"__g_{k}") for k in keys]).agg(F.sum("n").alias("size"))
    on = [F.col(k).eqNullSafe(F.col(f"__g_{k}")) for k in keys]
    return ranked.join(size, on).drop(*[f"__g_{k}" for k in keys])


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """``keys`` and for each ``name: q`` the value at place ``round(q * (n - 1))``, half away from zero, from 0."""
    df, keys, names = _keyed(df, keys)
    ranked = _ranked(df, keys, value)
    at = lambda q: F.floor(F.lit(q) * (F.col("size") - 1) + 0.5)
    pick = [F.max(F.when((F.col("upto") > at(q)) & (F.col("upto") - F.col("n") <= at(q)), F.col(value))).alias(n) for n, q in qs.items()]
    return ranked.groupBy(*keys).agg(*pick).select(*names, *qs)


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """The middle value, or the exact mean of the two in the middle."""
    df, keys, names = _keyed(df, keys)
    ranked = _ranked(df, keys, value)
    low, high = F.floor((F.col("size") - 1) / 2), F.floor(F.col("size") / 2)
    holds = lambda p: (F.col("upto") > p) & (F.col("upto") - F.col("n") <= p)
    a, b = F.max(F.when(holds(low), F.col(value))), F.max(F.when(holds(high), F.col(value)))
    return ranked.groupBy(*keys).agg(((a + b) / 2).alias(name)).select(*names, name)
