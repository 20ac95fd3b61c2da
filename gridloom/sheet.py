"""The fluent surface: a named, typed, ordered sheet over a DataFrame.

Each method gives a new sheet and only builds a plan. ``df`` is the frame; where it has ``__row`` the sheet is ordered,
and positional and window methods without an order key follow that order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, IntegralType

from gridloom.functions import aggregates as A
from gridloom.operators import distinct, lookups, prefix, quantiles, ranks, recurrences, stages, windows
from gridloom.operators.order import ROW
from gridloom.operators.products import products
from gridloom.sources import sinks, views

_NEAR = {"diff": windows.diff, "pct_change": windows.pct_change, "shift": windows.shift}
_ROLLING = {"rolling_sum": windows.rolling_sum, "rolling_mean": windows.rolling_mean, "rolling_min": windows.rolling_min, "rolling_max": windows.rolling_max, "rolling_std": windows.rolling_std}
_RUNNING = {"cum_sum": "sum", "cum_min": "min", "cum_max": "max", "cum_prod": "product", "cum_count": "count"}


@dataclass(frozen=True)
class Sheet:
    df: DataFrame

    # Making sheets.

    @staticmethod
    def parquet(spark: SparkSession, path: str, ordered: bool = False, schema: dict[str, str] | None = None, names: dict[str, str] | None = None) -> Sheet:
        return Sheet(views.parquet(spark, path, schema, names, ordered))

    @staticmethod
    def csv(spark: SparkSession, path: str) -> Sheet:
        return Sheet(views.csv(spark, path))

    @staticmethod
    def json(spark: SparkSession, path: str, lines: bool = False) -> Sheet:
        return Sheet(views.json(spark, path, lines=lines))

    @staticmethod
    def inline(spark: SparkSession, table: str, **types: str) -> Sheet:
        return Sheet(views.inline(spark, table, types))

    def numbered(self, *keys: str) -> Sheet:
        """In the order of the keys, which should leave no ties."""
        return Sheet(number_rows(self.df.drop(ROW), *keys))

    # Columns and rows.

    def type_of(self, column: Column | str) -> DataType:
        return self.df.select(column).schema[0].dataType

    def with_columns(self, **columns: Column) -> Sheet:
        """Computed columns; each may read those before it."""
        df = self.df
        for name, c in columns.items():
            df = df.withColumn(name, c)
        return Sheet(df)

    def cells(self, column: str, formulas: dict[int, Column]) -> Sheet:
        return Sheet(views.patched(self.df, column, formulas))

    def select(self, *columns: str | list[str]) -> Sheet:
        return Sheet(stages.select(self.df, *columns))

    def filter(self, condition: Column) -> Sheet:
        return Sheet(stages.filter_rows(self.df, condition))

    def sort(self, *keys: str, desc: bool = False) -> Sheet:
        return Sheet(stages.sort(self.df, *keys, desc=desc))

    def head(self, n: int, *keys: str, desc: bool = False) -> Sheet:
        return Sheet(stages.head(self.df, n, *keys, desc=desc))

    def tail(self, n: int, *keys: str) -> Sheet:
        return Sheet(stages.tail(self.df, n, *keys))

    def rows(self, low: int, high: int) -> Sheet:
        return Sheet(stages.rows_between(self.df, low, high))

    def row(self, position: int) -> Sheet:
        return Sheet(stages.row_at(self.df, position))

    # Other sheets.

    def join(self, other: Sheet, *keys: str, how: str = "inner") -> Sheet:
        return Sheet(stages.join(self.df, other.df, *keys, how=how))

    def lookup(self, other: Sheet, key: str, other_key: str, **values: tuple[str, Column | None]) -> Sheet:
        return Sheet(lookups.lookup(self.df, other.df, key, other_key, values))

    def conditional(self, other: Sheet, key: str, other_key: str, empty: dict[str, Column] | None = None, **aggregates: Column) -> Sheet:
        return Sheet(lookups.conditional(self.df, other.df, key, other_key, empty or {}, **aggregates))

    def conditional_range(self, other: Sheet, low: str, high: str, value: str, empty: dict[str, Column] | None = None, **aggregates: tuple[str, Column | str]) -> Sheet:
        return Sheet(lookups.conditional_range(self.df, other.df, low, high, value, empty or {}, **aggregates))

    def aligned(self, other: Sheet) -> Sheet:
        return Sheet(stages.aligned(self.df, other.df))

    # Aggregates. ``Name=("Qty", "sum")`` picks the exact or float form by the column's type.

    def _aggregate(self, column: Column | str, how: str) -> Column:
        kind = self.type_of(column)
        scale = kind.scale if isinstance(kind, DecimalType) else 0
        exact = isinstance(kind, (IntegralType, DecimalType))
        plain: dict[str, Callable[[], Column]] = {
            "sum": lambda: A.total(column, scale) if exact else A.total_float(column) if isinstance(kind, (DoubleType, FloatType)) else A.total_duration(column),
            "mean": lambda: A.mean(column, scale) if exact else A.mean_float(column),
            "min": lambda: A.minimum(column),
            "max": lambda: A.maximum(column),
            "count": lambda: A.count(column),
            "len": A.length,
            "product": lambda: A.product_float(column),
            "std": lambda: A.std(column),
            "std0": lambda: A.std(column, 0),
            "var": lambda: A.variance_exact(column, scale) if exact else A.variance(column),
            "var0": lambda: A.variance_exact(column, scale, 0) if exact else A.variance(column, 0),
            "first": lambda: A.first(column, ROW),
            "last": lambda: A.last(column, ROW),
            "all": lambda: A.all_(column),
            "any": lambda: A.any_(column),
            "none": lambda: A.none_(column),
        }
        return plain[how]()

    def group_by(self, *keys: str, **aggregates: tuple[Column | str, str] | Column) -> Sheet:
        """A row for each value of the keys, null a value of its own, in the order of the keys."""
        return Sheet(self._grouped(list(keys), aggregates).orderBy(*keys))

    def _grouped(self, keys: list[str], aggregates: dict[str, tuple[Column | str, str] | Column]) -> DataFrame:
        """Exact products, which need more than a running state, are joined to the other aggregates."""
        whole = {n: a[0] for n, a in aggregates.items() if not isinstance(a, Column) and a[1] == "product" and isinstance(self.type_of(a[0]), IntegralType)}
        made = {n: a if isinstance(a, Column) else self._aggregate(*a) for n, a in aggregates.items() if n not in whole}
        out = self.df.groupBy(*keys).agg(*[c.alias(n) for n, c in (made or {"__n": A.length()}).items()])
        for n, column in whole.items():
            one = products(self.df.withColumn("__value", F.col(column) if isinstance(column, str) else column), keys, "__value", n)
            one = one.withColumnsRenamed({k: f"__k_{k}" for k in keys})
            on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
            out = out.join(one, on) if keys else out.join(F.broadcast(one), F.lit(True))  # one row without keys
        return out.select(*keys, *aggregates)

    def aggregate(self, **aggregates: tuple[Column | str, str] | Column) -> Sheet:
        """One row."""
        return Sheet(self._grouped([], aggregates))

    def quantiles(self, value: str, *keys: str, **qs: float) -> Sheet:
        return Sheet(quantiles.quantiles(self.df, list(keys), value, qs))

    def medians(self, value: str, *keys: str, name: str = "median") -> Sheet:
        return Sheet(quantiles.medians(self.df, list(keys), value, name))

    # Down a column.

    def window(self, name: str, function: str, column: str, n: int | None = None, order: str | None = None, by: list[str] | None = None) -> Sheet:
        """``name := column.function(n, order by keys)``. Running and filled values are worked out over ranges of the order
        (within each of the partition keys), looks at neighbours over blocks of rows, so no large key is sorted in one task."""
        keys = [k for k in (order, ROW) if k and k in self.df.columns]
        if function in _RUNNING:
            return Sheet(prefix.running(self.df, keys, {name: (_RUNNING[function], F.col(column))}, by))
        if function == "forward_fill":
            return Sheet(prefix.filled(self.df, column, name, keys, by))
        if function == "backward_fill":
            return Sheet(prefix.filled(self.df, column, name, keys, by, back=True))
        n = 1 if n is None else n
        f = (lambda w: _ROLLING[function](column, n, w)) if function in _ROLLING else (lambda w: _NEAR[function](column, w, n))
        if not by and keys == [ROW]:
            return Sheet(prefix.with_neighbours(self.df, {name: f}, max(n, 0), max(-n, 0)))
        return Sheet(prefix.near(self.df, {name: f}, keys, by or [], max(n, 0), max(-n, 0)))

    def rank(self, name: str, column: str, ties: str = "average", desc: bool = False, by: list[str] | None = None) -> Sheet:
        return Sheet(ranks.ranked(self.df, column, name, ties, desc, by))

    def accumulate(self, name: str, amount: Column, order: list[str], by: list[str] | None = None, start: float = 0) -> Sheet:
        return Sheet(recurrences.accumulated(self.df, amount, name, order, by, start))

    def mark_kinds(self, column: str, unique: str | None = None, duplicated: str | None = None, first: str | None = None, last: str | None = None) -> Sheet:
        return Sheet(distinct.mark_kinds(self.df, column, ROW, unique, duplicated, first, last))

    def distinct(self, column: str) -> Sheet:
        return Sheet(distinct.first_of_each(self.df, column))

    # Out.

    def collect(self) -> list[tuple]:
        df = self.df.orderBy(ROW).drop(ROW) if ROW in self.df.columns else self.df
        return [tuple(r) for r in df.collect()]

    def text(self, limit: int = 1000) -> str:
        return sinks.as_text(self.df, limit)
