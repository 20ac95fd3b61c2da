"""Ranks over any number of rows: values are counted, counts are run up over ranges, and rows join their value's rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import windows
from gridloom.operators.order import ROW
from gridloom.operators.prefix import FEW, fits, running


TIES = ("average", "min", "max", "dense", "ordinal")


def ranked(df: DataFrame, column: str, name: str, ties: str = "average", desc: bool = False, by: list[str] | None = None, row: str = ROW) -> DataFrame:
    """Adds ``name``: ``average`` (a float), ``min``, ``max``, ``dense`` or ``ordinal``; null has no rank."""
    return ranked_all(df, column, {name: (ties, desc)}, by, row)


def ranked_all(df: DataFrame, column: str, wanted: dict[str, tuple[str, bool]], by: list[str] | None = None, row: str = ROW, few: int = FEW) -> DataFrame:
    """Several ranks ``name: (ties, desc)`` of one column, from one count of its values."""
    for ties, _ in wanted.values():
        if ties not in TIES:
            raise ValueError(f"no way to rank ties: {ties}")
    keys, names = by or [], df.columns
    if fits(df, by, few):
        return df.withColumns({n: windows.rank(column, ties, keys, desc, row) for n, (ties, desc) in wanted.items()})
    if any(ties == "ordinal" for ties, _ in wanted.values()):
        # The place among equal values is the place in the whole order less the values before.
        df = running(df, [column, row], {"__nth": ("sum", F.col(column).isNotNull().cast("bigint"))}, keys, few)
    tally = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__n"))
    tally = running(tally, [column], {"__upto": ("sum", F.col("__n")), "__dense": ("count", F.col("__n"))}, keys, few)
    if any(desc for _, desc in wanted.values()):
        whole = tally.groupBy(*[F.col(k).alias(f"__g_{k}") for k in keys]).agg(F.max("__upto").alias("__all"), F.max("__dense").alias("__kinds"))
        on = [F.col(k).eqNullSafe(F.col(f"__g_{k}")) for k in keys]
        tally = tally.join(whole, on) if keys else tally.join(F.broadcast(whole), F.lit(True))  # one row without keys
    carried = [c for c in ("__upto", "__n", "__dense", "__all", "__kinds") if c in tally.columns]
    looked = tally.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(column).alias("__value"), *carried)
    on = F.col(column) == F.col("__value")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))

    def rank(ties: str, desc: bool) -> Column:
        before = F.col("__upto") - F.col("__n")
        low, high = (F.col("__all") - F.col("__upto") + 1, F.col("__all") - before) if desc else (before + 1, F.col("__upto"))
        if ties == "dense":
            return F.col("__kinds") - F.col("__dense") + 1 if desc else F.col("__dense")
        if ties == "ordinal":
            return low + F.col("__nth") - before - 1
        return {"min": low, "max": high, "average": (low + high) / 2}[ties]

    return df.join(looked, on, "left").select(*names, *[rank(*how).alias(n) for n, how in wanted.items()])
