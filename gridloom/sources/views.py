"""Views over Parquet, CSV and JSON files, read lazily and column by column, and small inline tables.

A view's schema lines are checked against the file, not coerced. Columns of lists, maps and structs are outside the
sheet's model: ``flat`` leaves them out and names them.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from gridloom.functions import convert
from gridloom.operators.order import file_rows


def checked(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """``df``, if its columns have the expected types (as ``bigint``, ``decimal(38,2)``)."""
    have = dict(df.dtypes)
    wrong = [f"{n}: declared {t}, the file has {have.get(n, 'no such column')}" for n, t in expected.items() if have.get(n) != t]
    if wrong:
        raise TypeError("; ".join(wrong))
    return df


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``new: 'Name in File'``."""
    return df.withColumnsRenamed({old: new for new, old in names.items()})


def flat(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Without nested columns, and their names."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType))]
    return df.drop(*nested), nested


def parquet(spark: SparkSession, path: str, schema: dict[str, str] | None = None, names: dict[str, str] | None = None, ordered: bool = False) -> DataFrame:
    """A Parquet view; with ``ordered`` its rows are numbered by ``__row``, for positional operators."""
    df = renamed(file_rows(spark, path) if ordered else spark.read.parquet(path), names or {})
    return checked(df, schema or {})


# Each: the text's pattern and how a column of it is read. Fixed values, in the order they are tried.
_CSV = [
    (r"^-?\d{1,18}$", lambda c, _: c.cast("bigint")),
    (r"^-?\d{1,3}(_\d{3})+$", lambda c, _: F.replace(c, F.lit("_"), F.lit("")).cast("bigint")),
    (r"^-?\d+\.\d{1,18}$", lambda c, places: c.cast(f"decimal(38,{places})")),
    (r"^-?\d{1,17}(\.\d{1,8})?%$", lambda c, _: convert.number_cell(c)),
    (r"^-?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$|^-?Inf$|^NaN$", lambda c, _: F.regexp_replace(c, "Inf", "Infinity").cast("double")),
    (r"^\d{4}-\d\d-\d\d$", lambda c, _: c.cast("date")),
    (r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?$", lambda c, _: c.cast("timestamp_ntz")),
    (r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,9})?)?$", lambda c, _: convert.time_cell(c)),
    (r"^-?P(?=.)(\d+W)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$", lambda c, _: convert.duration_cell(c)),
    (r"^(true|false)$", lambda c, _: c.cast("boolean")),
    (r"^0x[0-9a-fA-F]{1,15}$", lambda c, _: F.conv(F.substring(c, 3, 64), 16, 10).cast("bigint")),
]


_MIXED = r"^-?\d{1,18}(\.\d{1,18})?$"  # whole numbers among decimals


def _places(name: str) -> Column:
    return F.coalesce(F.max(F.char_length(F.regexp_extract(F.col(f"`{name}`"), r"\.(\d+)$", 1))), F.lit(0))


def _all_like(name: str, pattern: str) -> Column:
    return F.coalesce(F.bool_and(F.col(f"`{name}`").rlike(pattern)), F.lit(False))


def _inferred(rows: DataFrame) -> list[tuple[int | None, str | None, int]]:
    """Of each column: its place in ``_CSV``, the pattern of all its cells (none for text) and its decimal places."""
    names = rows.columns
    # Aggregates: one row for the whole of it, whatever the number of columns.
    tests = [_all_like(n, p).alias(f"t{i}_{k}") for i, n in enumerate(names) for k, (p, _) in enumerate(_CSV)]
    mixed = [_all_like(n, _MIXED).alias(f"m{i}") for i, n in enumerate(names)]
    there = [F.count(F.col(f"`{n}`")).alias(f"n{i}") for i, n in enumerate(names)]
    got = rows.agg(*tests, *mixed, *there, *[_places(n).alias(f"p{i}") for i, n in enumerate(names)]).first()
    out = []
    for i in range(len(names)):
        kind = next((k for k in range(len(_CSV)) if got[f"t{i}_{k}"]), None)
        pattern = _CSV[kind][0] if kind is not None else None if got[f"n{i}"] else "^$"
        if got[f"m{i}"] and got[f"p{i}"]:
            kind, pattern = 2, _MIXED
        out.append((kind, pattern, got[f"p{i}"]))
    return out


def _holds(rows: DataFrame, kinds: list[tuple[int | None, str | None, int]]) -> bool:
    """Whether all cells have their column's pattern, and decimals no more than its places."""
    checks = [F.coalesce(F.bool_and(F.col(f"`{n}`").rlike(p)), F.lit(True)) & ((_places(n) <= most) if k == 2 else F.lit(True)) for n, (k, p, most) in zip(rows.columns, kinds, strict=True) if p is not None]
    return not checks or rows.agg(reduce(lambda a, b: a & b, checks)).first()[0]


def csv(spark: SparkSession, path: str, infer_rows: int = 10_000, delimiter: str = ",") -> DataFrame:
    """A CSV view with a header. Types come from the first ``infer_rows`` rows: whole numbers, exact decimals at the
    greatest number of places, percentages, floats, ISO dates, times (nanoseconds), durations, ``true``/``false`` (in that
    case only) and ``0x`` numbers; else text. Empty cells are null. All rows are then checked, and where a later cell does
    not fit (or has more places) types are worked out again from every row, so no cell is rounded or dropped.

    Quoted cells may hold line breaks; a file with such cells is read whole by one task, others are split."""
    # A record that goes on in the next line leaves a quote open in its first.
    broken = spark.read.text(path).where(F.pmod(F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2)) == 1)
    several = bool(broken.head(1))
    read = spark.read.option("header", True).option("multiLine", several).option("sep", delimiter).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)
    kinds = _inferred(read.limit(infer_rows))
    if not _holds(read, kinds):
        kinds = _inferred(read)
    return read.select(*[(F.col(f"`{n}`") if k is None else _CSV[k][1](F.col(f"`{n}`"), places)).alias(n) for n, (k, _, places) in zip(read.columns, kinds, strict=True)])


def json(spark: SparkSession, path: str, schema: StructType | None = None, lines: bool = False) -> DataFrame:
    """A list of objects, or one object a line; nested values are kept as JSON text."""
    reader = spark.read.option("multiLine", not lines)
    df = (reader.schema(schema) if schema else reader).json(path)
    nested = {f.name: F.to_json(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType))}
    return df.withColumns(nested)


def json_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """``f.json#Sheet``: one sheet of an object of lists of objects."""
    df = spark.read.option("multiLine", True).json(path)
    rows = df.select(F.explode(F.col(f"`{sheet}`")).alias("r")).select("r.*")
    nested = {f.name: F.to_json(F.col(f"`{f.name}`")) for f in rows.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType))}
    return rows.withColumns(nested)


def _cell(text: str) -> str | None:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] == '"' else text or None


def inline(spark: SparkSession, table: str, types: dict[str, str] | None = None) -> DataFrame:
    """A small Markdown table with ``__row``; columns are text unless ``types`` casts them."""
    framed = table.strip().startswith("|")
    lines = [ln.strip().strip("|") if framed else ln for ln in table.strip().splitlines()]
    lines = [ln for ln in lines if not re.fullmatch(r"[\s|:-]*-[\s|:-]*", ln)]
    names = [c.strip() for c in lines[0].split("|")]
    rows = [(i, *(_cell(c) for c in (ln.split("|") + [""] * len(names))[: len(names)])) for i, ln in enumerate(lines[1:])]
    df = spark.createDataFrame(rows, "__row long, " + ", ".join(f"`{n}` string" for n in names))
    return df.withColumns({n: F.col(f"`{n}`").cast(t) for n, t in (types or {}).items()})


def patched(df: DataFrame, column: str, cells: dict[int, Column]) -> DataFrame:
    """Formulas of single cells, ``row: expression``."""
    chain = reduce(lambda acc, kv: F.when(F.col("__row") == kv[0], kv[1]).otherwise(acc), cells.items(), F.col(column))
    return df.withColumn(column, chain)
