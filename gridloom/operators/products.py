"""Exact products of whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More factors of 2 and above than this cannot have a product of 38 digits.
MOST = 126


def products(df: DataFrame, keys: list[str], value: str, name: str = "product") -> DataFrame:
    """``keys, name``: 1 of nothing, nulls skipped; an error past 38 digits.

    Zeros, signs and ones are only counted; the other factors of a group are gathered where they are at most ``MOST``."""
    x = F.col(value).cast("decimal(38,0)")
    stats = df.groupBy(*keys).agg(F.count_if(x == 0).alias("__zeros"), F.count_if(x < 0).alias("__negative"), F.count_if(F.abs(x) >= 2).alias("__big"))
    mine = [F.col(k).alias(f"__k_{k}") for k in keys]
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] or F.lit(True)
    few = stats.where((F.col("__zeros") == 0) & F.col("__big").between(1, MOST)).select(*mine, F.lit(True).alias("__few"))
    factors = df.where(F.abs(x) >= 2).select(*keys, F.abs(x).alias("__x")).join(few if keys else F.broadcast(few), on, "left_semi")  # one row without keys
    made = factors.groupBy(*keys).agg(F.aggregate(F.collect_list("__x"), F.lit(1).cast("decimal(38,0)"), lambda a, b: (a * b).cast("decimal(38,0)")).alias("__product"))
    made = made.select(*mine, "__product")
    joined = stats.join(made if keys else F.broadcast(made), on, "left")
    sign = F.when(F.col("__negative") % 2 == 1, -1).otherwise(1)
    out = F.when(F.col("__zeros") > 0, F.lit(0)).when(F.col("__big") > MOST, F.raise_error(F.lit("a product past 38 digits")).cast("decimal(38,0)")).otherwise(F.coalesce("__product", F.lit(1)) * sign)
    return joined.select(*keys, out.cast("decimal(38,0)").alias(name))
