"""Running values and neighbours over order keys whose partitions may be of any size.

A window function sorts each partition in one task. Here the whole order is range-partitioned instead: running
aggregates work within the range and add what came before (one row for each range and partition key), and looks at
neighbours exchange only the rows at the borders. No key, and no lack of a key, puts all rows in one task.

Where every partition key holds few rows (``fits``, from a count by key), Spark's window is the cheaper plan, one shuffle
and nothing written, and gives the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.operators.order import ROW, number_rows, ranged

_JOIN = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b, "min": F.least, "max": F.greatest, "product": lambda a, b: a * b}
_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "product": F.product}


#: Rows of a key that one task sorts.
FEW = 1_000_000


def fits(df: DataFrame, by: list[str] | None, few: int = FEW) -> bool:
    """Whether there are partition keys and none holds more than ``few`` rows."""
    if not by:
        return False
    most = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0]
    return most is None or most <= few


def running(df: DataFrame, order: list[str], values: dict[str, tuple[str, Column]], by: list[str] | None = None, few: int = FEW) -> DataFrame:
    """Adds running values: ``name: (sum | count | min | max | product, column)`` over the rows so far.

    Nulls are skipped; where the column is null the answer is null too, but for ``count``."""
    names = df.columns
    wanted = {f"__v_{n}": c for n, (_, c) in values.items()}
    if fits(df, by, few):
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        made = df.withColumns(wanted).withColumns({f"__r_{n}": _AGG[kind](f"__v_{n}").over(w) for n, (kind, _) in values.items()})
        return made.select(*names, *[(F.col(f"__r_{n}") if kind == "count" else F.when(F.col(f"__v_{n}").isNotNull(), F.col(f"__r_{n}"))).alias(n) for n, (kind, _) in values.items()])
    by = by or []
    kept = ranged(df.withColumns(wanted), *by, *order)
    totals = kept.groupBy(*by, "__pid").agg(*[_AGG[kind](f"__v_{n}").alias(f"__t_{n}") for n, (kind, _) in values.items()])
    # Rows of this window: those ranges that hold one key, at most the number of partitions.
    past = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(k).alias(f"__k_{k}") for k in by], F.col("__pid").alias("__p"), *[(F.sum(f"__t_{n}") if kind == "count" else _AGG[kind](f"__t_{n}")).over(past).alias(f"__b_{n}") for n, (kind, _) in values.items()])
    on = F.col("__pid") == F.col("__p")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    w = Window.partitionBy("__pid", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = kept.withColumns({f"__r_{n}": _AGG[kind](f"__v_{n}").over(w) for n, (kind, _) in values.items()})
    joined = here.join(before, on, "left")
    out = []
    for n, (kind, _) in values.items():
        mine, past_value = F.col(f"__r_{n}"), F.col(f"__b_{n}")
        both = F.when(past_value.isNull(), mine).when(mine.isNull(), past_value).otherwise(_JOIN[kind](mine, past_value))
        out.append((both if kind == "count" else F.when(F.col(f"__v_{n}").isNotNull(), both)).alias(n))
    return joined.select(*df.columns, *out)


def with_neighbours(df: DataFrame, values: dict[str, Callable[[WindowSpec], Column]], before: int = 0, after: int = 0, block: int = 1_000_000, row: str = ROW, by: list[str] | None = None) -> DataFrame:
    """Adds columns over ``w``, a window that reaches ``before`` rows back and ``after`` rows on in the order of the dense
    ``row``: blocks of rows, each with copies of its neighbours' border rows. ``values``: ``name: function of a window``.
    With ``by`` the row number must put rows of equal keys together; windows then end where the keys change."""
    own = F.floor(F.col(row) / block)
    spread = F.sequence(F.floor((F.col(row) - after) / block), F.floor((F.col(row) + before) / block))
    dealt = df.withColumn("__own", own).withColumn("__block", F.explode(spread))
    w = Window.partitionBy("__block", *(by or [])).orderBy(row)
    made = dealt.withColumns({n: f(w) for n, f in values.items()})
    return made.where("__block = __own").select(*df.columns, *values)


def near(df: DataFrame, values: dict[str, Callable[[WindowSpec], Column]], order: list[str], by: list[str], before: int = 0, after: int = 0, few: int = FEW, block: int = 1_000_000) -> DataFrame:
    """``with_neighbours`` of rows in ``order`` within each of the keys ``by``."""
    if fits(df, by, few):
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumns({n: f(w) for n, f in values.items()})
    own = lambda c: "__sheet_row" if c == ROW else c
    placed = number_rows(df.withColumnRenamed(ROW, "__sheet_row"), *map(own, by), *map(own, order))
    return with_neighbours(placed, values, before, after, block, by=by).select(*[F.col(own(c)).alias(c) for c in df.columns], *values)


def shifted(df: DataFrame, column: str, n: int, name: str, block: int = 1_000_000) -> DataFrame:
    """``[C; *-n]`` (or ``*+n`` for negative n) in file order; null outside the sheet."""
    f = (lambda w: F.lag(column, n).over(w)) if n >= 0 else (lambda w: F.lead(column, -n).over(w))
    return with_neighbours(df, {name: f}, max(n, 0), max(-n, 0), block)


def filled(df: DataFrame, column: str, name: str, order: list[str], by: list[str] | None = None, back: bool = False, few: int = FEW) -> DataFrame:
    """``forward_fill``: a missing value takes the last one before it in the order; ranges pass on their last value. With
    ``back``, ``backward_fill``: the next one after it."""
    if fits(df, by, few):
        w = Window.partitionBy(*by).orderBy(*order)
        beyond = w.rowsBetween(0, Window.unboundedFollowing) if back else w.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, (F.first if back else F.last)(column, ignorenulls=True).over(beyond))
    if back:
        own = lambda c: "__sheet_row" if c == ROW else c
        placed = number_rows(df.withColumnRenamed(ROW, "__sheet_row"), *map(own, order)).withColumn("__back", -F.col(ROW))
        return filled(placed, column, name, ["__back"], by, few=0).select(*[F.col(own(c)).alias(c) for c in df.columns], name)
    by = by or []
    kept = ranged(df, *by, *order)
    there = F.when(F.col(column).isNotNull(), F.col("__pos"))
    totals = kept.groupBy(*by, "__pid").agg(F.max_by(column, there).alias("__last"))
    past = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(k).alias(f"__k_{k}") for k in by], F.col("__pid").alias("__p"), F.last("__last", ignorenulls=True).over(past).alias("__before"))
    on = F.col("__pid") == F.col("__p")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    w = Window.partitionBy("__pid", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = kept.withColumn("__here", F.last(column, ignorenulls=True).over(w))
    return here.join(before, on, "left").select(*df.columns, F.coalesce("__here", "__before").alias(name))
