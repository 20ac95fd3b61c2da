"""Which values of a column are the only, first or last of their kind; null is a kind.

Counts and first rows are grouped with partial sums and joined back, so one value that fills the column is no single
task (a window over the value would be).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.order import ROW


def mark_kinds(df: DataFrame, column: str, row: str = ROW, unique: str | None = None, duplicated: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Adds the named Boolean columns. Ties in ``row`` are all first (or last)."""
    kinds = df.groupBy(F.col(column).alias("__kind")).agg(F.count(F.lit(1)).alias("__n"), F.min(row).alias("__lo"), F.max(row).alias("__hi"))
    made = {unique: F.col("__n") == 1, duplicated: F.col("__n") > 1, first: F.col(row) == F.col("__lo"), last: F.col(row) == F.col("__hi")}
    joined = df.join(kinds, df[column].eqNullSafe(kinds["__kind"]))
    return joined.select(*[df[c] for c in df.columns], *[v.alias(k) for k, v in made.items() if k])


def first_of_each(df: DataFrame, column: str, row: str = ROW) -> DataFrame:
    """The first row of each kind: ``filter(C.is_first_distinct())``, in one grouped pass."""
    others = [c for c in df.columns if c != row]
    best = df.groupBy(F.col(column).alias("__kind")).agg(F.min(F.struct(F.col(row), *others)).alias("__first"))
    return best.select("__first.*").select(*df.columns)
