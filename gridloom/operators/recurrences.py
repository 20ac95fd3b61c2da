"""Columns that read themselves in earlier rows.

``Balance := ([Balance; *-1] // 0) + Amount`` and other linear recurrences with a constant factor become running sums, and
so scale like those. A rule that is not linear is worked out row by row within its partition; that is sequential by
nature, so it needs partition keys that keep partitions small.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from gridloom.operators.order import ROW, checkpointed, number_rows
from gridloom.operators.prefix import running, with_neighbours


def accumulated(df: DataFrame, amount: Column, name: str, order: list[str], by: list[str] | None = None, start: float = 0) -> DataFrame:
    """``name := ([name; *-1 by K] // start) + amount``; a null amount makes the rest of its partition null."""
    made = running(df, order, {"__sum": ("sum", amount), "__bad": ("sum", F.when(amount.isNull(), 1).otherwise(0))}, by)
    return made.select(*df.columns, F.when(F.col("__bad") == 0, F.col("__sum") + F.lit(start)).alias(name))


def decayed(df: DataFrame, amount: Column, factor: float, name: str, by: list[str], order: list[str], block: int = 200_000) -> DataFrame:
    """``name := ([name; *-1 by K] // 0) * factor + amount`` in floats; from a null or NaN amount on a partition's values
    are null.

    All rows stand in one order in which keys are together. Blocks of it are worked out side by side as if nothing came
    before; a block's outcome is a factor and an addend, and one row for each block is run through in order to give what
    each takes over. So no key needs to fit a task, and no power of the factor is divided by."""
    own = lambda c: "__sheet_row" if c == ROW else c
    placed = number_rows(df.withColumn("__amount", amount.cast("double")).withColumnRenamed(ROW, "__sheet_row"), *map(own, by), *map(own, order))
    # The first row of a key takes nothing over.
    fresh = with_neighbours(placed, {"__fresh": lambda w: F.lag(ROW).over(w).isNull()}, before=1, by=by)
    rows = fresh.select(ROW, "__fresh", "__amount", F.floor(F.col(ROW) / block).alias("__block"))

    def within(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(ROW, ignore_index=True)
        values, weights, value, weight = [], [], 0.0, 1.0
        for new, x in zip(part["__fresh"].to_numpy(), part["__amount"].to_numpy(float), strict=True):
            value, weight = (x, 0.0) if new else (value * factor + x, weight * factor)
            values.append(value)
            weights.append(weight)
        return pd.DataFrame({ROW: part[ROW], "__block": part["__block"], "__value": values, "__weight": weights})

    made = checkpointed(rows.groupBy("__block").applyInPandas(within, f"{ROW} long, __block long, __value double, __weight double"))

    def along(ends: pd.DataFrame) -> pd.DataFrame:
        ends = ends.sort_values("__block", ignore_index=True)
        taken, value = [], 0.0
        for x, w in zip(ends["__value"].to_numpy(float), ends["__weight"].to_numpy(float), strict=True):
            taken.append(value)
            value = x + w * value if w and value else x
        return pd.DataFrame({"__block": ends["__block"], "__taken": taken})

    # Two numbers for each block: one task holds them for 10^12 rows.
    ends = made.groupBy("__block").agg(F.max_by("__value", ROW).alias("__value"), F.max_by("__weight", ROW).alias("__weight"))
    taken = ends.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(along, "__block long, __taken double")
    whole = F.when((F.col("__weight") == 0) | (F.col("__taken") == 0), F.col("__value")).otherwise(F.col("__value") + F.col("__weight") * F.col("__taken"))
    answers = made.join(taken, "__block").select(F.col(ROW).alias("__at"), F.nanvl(whole, F.lit(None).cast("double")).alias(name))
    return placed.join(answers, F.col(ROW) == F.col("__at")).select(*[F.col(own(c)).alias(c) for c in df.columns], name)


def stepwise(df: DataFrame, rule: Callable[[dict, list], object], name: str, kind: str, by: list[str], order: list[str]) -> DataFrame:
    """Any rule ``(row, earlier results) -> result``, one partition of ``by`` at a time in order."""
    schema = StructType([*df.schema.fields, StructField(name, _parse_datatype_string(kind))])

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable", ignore_index=True)
        done: list = []
        for row in rows.to_dict("records"):
            done.append(rule(row, done))
        return rows.assign(**{name: pd.Series(done, dtype=object)})

    return df.groupBy(*by).applyInPandas(walk, schema)
