"""Lookups and conditional aggregates: selections of another sheet that read this row's values, as joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.order import checkpointed
from gridloom.operators.prefix import running


def lookup(df: DataFrame, other: DataFrame, key: str, other_key: str, values: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """``Other[; other_key == key].column // default`` for each ``name: (column, default)``.

    No match gives the default (or null), one its value, several are an error. The other sheet is reduced to one row for
    each key first, so a match cannot multiply rows."""
    one = other.where(F.col(other_key).isNotNull()).groupBy(F.col(other_key).alias("__key"))
    slim = one.agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(f"__{n}") for n, (c, _) in values.items()])
    joined = df.join(slim, df[key] == slim["__key"], "left")
    many = F.raise_error(F.concat(F.lit(f"several rows of {other_key} "), F.col("__key").cast("string")))
    out = []
    for n, (_, default) in values.items():
        found = F.when(F.col("__n") > 1, many.cast(slim.schema[f"__{n}"].dataType)).otherwise(F.col(f"__{n}"))
        out.append((found if default is None else F.coalesce(found, default)).alias(n))
    return joined.select(*[df[c] for c in df.columns], *out)


def conditional(df: DataFrame, other: DataFrame, key: str, other_key: str, empty: dict[str, Column], **aggregates: Column) -> DataFrame:
    """``Other[; other_key == key]`` under aggregates: grouped once and joined. ``empty``: what an aggregate of nothing
    gives (0 for sums and counts), where that is not null."""
    grouped = other.where(F.col(other_key).isNotNull()).groupBy(F.col(other_key).alias("__key")).agg(*[c.alias(n) for n, c in aggregates.items()])
    joined = df.join(grouped, df[key] == grouped["__key"], "left")
    return joined.select(*[df[c] for c in df.columns], *[(F.coalesce(n, empty[n]) if n in empty else F.col(n)).alias(n) for n in aggregates])


# Each: what is kept of a span of values, and how spans are put together.
_PARTS: dict[str, tuple[Callable[[Column], Column], Callable[[Column | str], Column]]] = {
    "sum": (F.sum, F.sum),
    "count": (F.count, F.sum),
    "len": (lambda _: F.count(F.lit(1)), F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
}


def _bounds_upto(x: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most ``x``, by halving."""

    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low).cast("bigint")
        middle = (low + high) // 2
        return F.when(x < F.lit(bounds[middle]), part(low, middle)).otherwise(part(middle + 1, high))

    return part(0, len(bounds))


def _spans(low: Column, high: Column, levels: int) -> Column:
    """``low .. high - 1`` as spans of 2^level places that start at a multiple of their length, two of a level at most."""
    out = []
    for level in range(levels):
        a, b = -F.shiftright(-low, level), F.shiftright(high, level)
        span = lambda at: F.struct(F.lit(level).alias("__level"), at.alias("__span"))  # noqa: B023, E731
        out += [F.when((a < b) & (a % 2 == 1), span(a)), F.when((a < b) & (b % 2 == 1), span(b - 1))]
    return F.array_compact(F.array(*out))


def conditional_range(df: DataFrame, other: DataFrame, low: str, high: str, value: str, empty: dict[str, Column], most_bounds: int = 256, **aggregates: tuple[str, Column | str]) -> DataFrame:
    """``Other[; value >= low and value < high]`` under aggregates ``name: (sum | count | len | min | max, column)``, for
    bands that may overlap, be empty or have no end.

    No row meets a band. The bands' bounds cut the values into places; rows are aggregated by place, places into spans
    of 2, 4, 8 and so on, and each band is put together from at most two spans of each length. Up to ``most_bounds``
    different bounds stand in the expression that finds a row's place; more are sorted among the rows, by ranges."""
    bands = checkpointed(df.withColumn("__band", F.monotonically_increasing_id()))
    raw = bands.select(F.col(low).alias("__v")).union(bands.select(high))
    kind = other.select(value).union(raw).schema[0].dataType
    ends = raw.select(F.col("__v").cast(kind).alias("__v")).where(F.col("__v").isNotNull()).distinct()
    first = [r[0] for r in ends.limit(most_bounds + 1).orderBy("__v").collect()]
    rows = other.where(F.col(value).isNotNull()).select(F.col(value).cast(kind).alias("__v"), *[(F.col(c) if isinstance(c, str) else c).alias(f"__c_{n}") for n, (_, c) in aggregates.items()])
    if few := len(first) <= most_bounds:
        size = len(first)
        placed = rows.withColumn("__at", _bounds_upto(F.col("__v"), first))
        ranges = bands.select("__band", *[F.when(F.col(c).isNotNull(), _bounds_upto(F.col(c).cast(kind), first)).alias(f"__{n}") for n, c in (("low", low), ("high", high))])
    else:
        size = ends.count()
        both = rows.withColumn("__row_of", F.lit(1)).unionByName(ends.withColumn("__row_of", F.lit(0)), allowMissingColumns=True)
        made = running(both, ["__v", "__row_of"], {"__at": ("count", F.when(F.col("__row_of") == 0, 1))})
        placed, index = made.where("__row_of = 1"), made.where("__row_of = 0")
        ranges = bands.select("__band", F.col(low).cast(kind).alias("__from"), F.col(high).cast(kind).alias("__to"))
        for n, c in (("low", "__from"), ("high", "__to")):
            ranges = ranges.join(index.select(F.col("__v").alias(c), F.col("__at").alias(f"__{n}")), c)
    merged = lambda: [_PARTS[how][1](f"__c_{n}").alias(f"__c_{n}") for n, (how, _) in aggregates.items()]
    levels = max(1, size.bit_length())
    by_place = placed.groupBy("__at").agg(*[_PARTS[how][0](F.col(f"__c_{n}")).alias(f"__c_{n}") for n, (how, _) in aggregates.items()])
    spread = by_place.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    spans = spread.groupBy("__level", F.expr("shiftright(__at, __level)").alias("__span")).agg(*merged())
    if few:
        spans = F.broadcast(spans)  # at most 2 * most_bounds + levels rows
    wanted = ranges.select("__band", F.inline(_spans(F.col("__low"), F.col("__high"), levels)))
    got = wanted.join(spans, ["__level", "__span"]).groupBy("__band").agg(*merged())
    nothing = {n: F.lit(0) for n, (how, _) in aggregates.items() if how in ("count", "len")} | empty
    joined = bands.join(got, "__band", "left")
    return joined.select(*df.columns, *[(F.coalesce(f"__c_{n}", nothing[n]) if n in nothing else F.col(f"__c_{n}")).alias(n) for n in aggregates])
