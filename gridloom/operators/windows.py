"""Window functions: running, lagged, ranked, filled and rolling values, each with an order key and partitions.

These are Spark's windows, for partitions that fit a task's sort (it spills to disk). ``operators.prefix`` takes them
where every key is small, and for one partition of all rows or a large key has forms that split it.

Null stays null in running values and is skipped; a rolling value is null until the window is full, and where one of its
rows is null.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.functions.arithmetic import divide
from gridloom.functions.logic import ColumnOrName, col

_BACK = Window.unboundedPreceding


def _running(x: Column, f: Column, w: WindowSpec) -> Column:
    return F.when(x.isNotNull(), f.over(w.rowsBetween(_BACK, 0)))


def cum_sum(x: ColumnOrName, w: WindowSpec) -> Column:
    return _running(col(x), F.sum(col(x)), w)


def cum_min(x: ColumnOrName, w: WindowSpec) -> Column:
    return _running(col(x), F.min(col(x)), w)


def cum_max(x: ColumnOrName, w: WindowSpec) -> Column:
    return _running(col(x), F.max(col(x)), w)


def cum_prod(x: ColumnOrName, w: WindowSpec) -> Column:
    """In floats."""
    return _running(col(x), F.product(col(x).cast("double")), w)


def cum_count(x: ColumnOrName, w: WindowSpec) -> Column:
    """Also on null rows."""
    return F.count(col(x)).over(w.rowsBetween(_BACK, 0))


def diff(x: ColumnOrName, w: WindowSpec, n: int = 1) -> Column:
    return col(x) - F.lag(col(x), n).over(w)


def pct_change(x: ColumnOrName, w: WindowSpec, n: int = 1) -> Column:
    return divide(col(x), F.lag(col(x), n).over(w)) - 1


def shift(x: ColumnOrName, w: WindowSpec, n: int = 1) -> Column:
    """``[x; *-n by K]``, or ``*+n`` for a negative n."""
    return F.lag(col(x), n).over(w) if n >= 0 else F.lead(col(x), -n).over(w)


def rank(x: ColumnOrName, ties: str = "average", by: list[ColumnOrName] | None = None, desc: bool = False, row: ColumnOrName = "__row") -> Column:
    """``average`` (a float), ``min``, ``max``, ``dense`` or ``ordinal``; null has no rank and takes no part."""
    x = col(x)
    part = [*map(col, by or []), x.isNull()]
    w = Window.partitionBy(*part).orderBy(x.desc() if desc else x)
    same = F.count(F.lit(1)).over(Window.partitionBy(*part, x))
    made = {
        "min": lambda: F.rank().over(w).cast("bigint"),
        "max": lambda: F.rank().over(w) + same - 1,
        "dense": lambda: F.dense_rank().over(w).cast("bigint"),
        "ordinal": lambda: F.row_number().over(w.orderBy(x.desc() if desc else x, col(row))).cast("bigint"),
        "average": lambda: F.rank().over(w) + (same - 1) / 2,
    }
    if ties not in made:
        raise ValueError(f"no way to rank ties: {ties}")
    return F.when(x.isNotNull(), made[ties]())


def forward_fill(x: ColumnOrName, w: WindowSpec) -> Column:
    return F.last(col(x), ignorenulls=True).over(w.rowsBetween(_BACK, 0))


def backward_fill(x: ColumnOrName, w: WindowSpec) -> Column:
    return F.first(col(x), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def _rolling(x: Column, f: Column, n: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, f.over(frame))


def rolling_sum(x: ColumnOrName, n: int, w: WindowSpec) -> Column:
    return _rolling(col(x), F.sum(col(x)), n, w)


def rolling_mean(x: ColumnOrName, n: int, w: WindowSpec) -> Column:
    """In floats."""
    return _rolling(col(x), F.avg(col(x).cast("double")), n, w)


def rolling_mean_exact(x: ColumnOrName, n: int, w: WindowSpec, scale: int = 0) -> Column:
    """Of whole numbers or decimals, to ten places."""
    total = _rolling(col(x), F.sum(col(x).cast(f"decimal(17,{scale})")), n, w).cast("decimal(27,10)")
    return F.round(total / F.lit(n).cast("decimal(10,0)"), 10).cast("decimal(38,10)")


def rolling_min(x: ColumnOrName, n: int, w: WindowSpec) -> Column:
    return _rolling(col(x), F.min(col(x)), n, w)


def rolling_max(x: ColumnOrName, n: int, w: WindowSpec) -> Column:
    return _rolling(col(x), F.max(col(x)), n, w)


def rolling_std(x: ColumnOrName, n: int, w: WindowSpec) -> Column:
    """Of a sample; null for n = 1."""
    return _rolling(col(x), F.stddev_samp(col(x).cast("double")), n, w)


def prefix(f: Column, w: WindowSpec) -> Column:
    """``[C; 0..*]`` under an aggregate: over all rows so far."""
    return f.over(w.rowsBetween(_BACK, 0))


def sliding(f: Column, before: int, after: int, w: WindowSpec) -> Column:
    """``[C; *-a..*+b]`` under an aggregate: over the rows of the frame that exist."""
    return f.over(w.rowsBetween(-before, after))
