"""Stages of a sheet: filter, select, sort, head and tail, group and aggregate, join.

A frame that has ``__row`` keeps the sheet's order: sorts are stable by it and joins come in the left sheet's order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.order import ROW


def select(df: DataFrame, *columns: str | list[str]) -> DataFrame:
    """Named columns in that order; lists of names are spliced. The row number comes along."""
    names = [n for c in columns for n in (c if isinstance(c, list) else [c])]
    return df.select(*names, *([ROW] if ROW in df.columns and ROW not in names else []))


def columns_at(df: DataFrame, start: int, end: int) -> DataFrame:
    """Columns by position, ``start..end``; negative positions count from the end."""
    names = [c for c in df.columns if c != ROW]
    return select(df, names[start:][: (end if end >= 0 else len(names) + end) - (start if start >= 0 else len(names) + start) + 1])


def filter_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows of which the condition is true."""
    return df.filter(condition)


def grid_filter(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One test for each column, all of which must hold."""
    for test in tests.values():
        df = df.filter(test)
    return df


def sort(df: DataFrame, *keys: str, desc: bool = False) -> DataFrame:
    """One direction for all keys; null first ascending and last descending; ties in the sheet's order."""
    order = [F.col(k).desc() if desc else F.col(k).asc() for k in keys]
    return df.orderBy(*order, *([F.col(ROW)] if ROW in df.columns else []))


def head(df: DataFrame, n: int, *keys: str, desc: bool = False) -> DataFrame:
    """The first ``n`` rows in the order of the keys, or of the sheet: a top-k, not a full sort."""
    return sort(df, *keys, desc=desc).limit(n)


def tail(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The last ``n`` rows in the order of the keys, or of the sheet: a top-k from the end, put back in order."""
    names = [*keys, *([ROW] if ROW in df.columns else [])]
    return df.orderBy(*[F.col(k).desc() for k in names]).limit(n).orderBy(*names)


def rows_between(df: DataFrame, low: int, high: int) -> DataFrame:
    """``S[; low..high]`` for positions from the start, clamped to the sheet."""
    return df.filter(F.col(ROW).between(low, high))


def row_at(df: DataFrame, position: int) -> DataFrame:
    """One row; negative positions count from the end. A position outside the sheet is an error."""
    rows = df.agg(F.coalesce(F.max(ROW) + 1, F.lit(0)).alias("__rows"))  # one row
    at = F.lit(position) if position >= 0 else F.col("__rows") + position
    outside = F.raise_error(F.format_string(f"no row {position}: the sheet has %s", "__rows")).cast("long")
    wanted = rows.select(F.when((at >= 0) & (at < F.col("__rows")), at.cast("long")).otherwise(outside).alias("__at"))
    return wanted.join(df, F.col("__at") == F.col(ROW)).select(*df.columns)


def masked(df: DataFrame, mask: DataFrame, column: str) -> DataFrame:
    """``S[; mask]``: rows at whose position the mask's Boolean ``column`` is true; it must have a value for each row."""
    values, rows = mask.count(), df.count()
    if values != rows:
        raise ValueError(f"a mask of {values} values for {rows} rows")
    return df.join(mask.where(F.col(column)).select(ROW), ROW, "left_semi")


def group(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """A row for each value of the keys, null a value of its own. Unordered: sort the result where order shows."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def join(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Pairs of rows with equal keys; null matches nothing. Right key columns are dropped, a name that both have takes
    ``_right`` on the right's column. ``how``: ``inner`` or ``left``."""
    if how not in ("inner", "left"):
        raise ValueError(f"no such join: {how}")
    right = right.withColumnRenamed(ROW, "__row_right") if ROW in right.columns else right
    clash = {c: f"{c}_right" for c in right.columns if c in left.columns and c not in keys}
    return left.join(right.withColumnsRenamed(clash), list(keys), how).select(*left.columns, *[clash.get(c, c) for c in right.columns if c not in keys])


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row-aligned reading ``Other[C; *]``: the right sheet's columns at the same position, null past its end."""
    return left.join(right, ROW, "left")


def stack(df: DataFrame, *columns: str, name: str = "value") -> DataFrame:
    """A block's cells as one column, for aggregates over all of them."""
    return df.select(F.explode(F.array(*columns)).alias(name))


def pieces(*parts: tuple[DataFrame, str, int, int], name: str = "value") -> DataFrame:
    """``[A; 0..3], [B; 7..9]``: the cells of several vectors, each ``(frame, column, low, high)``, as one column in that
    order with ``__row``, for aggregates over all of them. Pieces may overlap; a cell then stands twice."""
    out, start = [], 0
    for df, column, low, high in parts:
        out.append(rows_between(df, low, high).select(F.col(column).alias(name), (F.col(ROW) - low + start).alias(ROW)))
        start += max(high - low + 1, 0)
    return reduce(DataFrame.unionByName, out)


def summary(df: DataFrame, *columns: str) -> DataFrame:
    """Count, sum and mean of each column in one row: what a selected block shows."""
    out = []
    for c in columns:
        out += [F.count(c).alias(f"{c}_count"), F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_sum"), F.avg(c).alias(f"{c}_mean")]
    return df.agg(*out)
