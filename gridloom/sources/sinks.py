"""Sinks: CSV, JSON and Parquet written by the cluster, and small sheets as text, Markdown or a workbook."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from gridloom.operators.order import ROW


def _visible(df: DataFrame) -> DataFrame:
    return df.drop(ROW)


def to_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """With a header; ``one_file`` is for results known to be small."""
    out = _visible(df)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _plain(df: DataFrame) -> DataFrame:
    """JSON has no Inf or NaN: columns of floats that hold any are written as text, the others as numbers."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)]
    odd = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    held = df.agg(*[F.coalesce(F.bool_or(odd(F.col(f"`{n}`"))), F.lit(False)) for n in floats]).first() if floats else ()
    out = {}
    for n in (n for n, any_odd in zip(floats, held, strict=True) if any_odd):
        c = F.col(f"`{n}`")
        out[n] = F.when(F.isnan(c), "NaN").when(c == float("inf"), "Inf").when(c == float("-inf"), "-Inf").otherwise(c.cast("string"))
    return df.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in df.columns])


def to_json(df: DataFrame, path: str, inf_as_text: bool = False) -> None:
    """A file of one object a row; with ``inf_as_text`` columns of floats with an Inf or NaN are written as text."""
    (_plain(_visible(df)) if inf_as_text else _visible(df)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def to_json_sheets(sheets: dict[str, DataFrame], path: str, inf_as_text: bool = False) -> None:
    """One file of an object of sheets, each a list of its rows as objects: a report's format, so the driver writes it, in
    the rows' order and one partition at a time. ``sources.views.json_sheet`` reads it."""
    with open(path, "w", encoding="utf-8") as out:
        for i, (name, df) in enumerate(sheets.items()):
            rows = df.orderBy(ROW) if ROW in df.columns else df
            shown_rows = _plain(_visible(rows)) if inf_as_text else _visible(rows)
            out.write(("," if i else "{") + json.dumps(name, ensure_ascii=False) + ":[")
            line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in shown_rows.columns]), {"ignoreNullFields": "false"})
            for k, r in enumerate(shown_rows.select(line).toLocalIterator()):
                out.write(",\n" if k else "\n")
                out.write(r[0])
            out.write("]")
        out.write("}\n" if sheets else "{}\n")


def to_parquet(df: DataFrame, path: str, by: list[str] | None = None, metadata: dict[str, dict] | None = None) -> None:
    """Field metadata (format, unit, zone) goes along in the footer."""
    out = _visible(df)
    if metadata:
        out = out.select(*[F.col(f"`{c}`").alias(c, metadata=metadata[c]) if c in metadata else F.col(f"`{c}`") for c in out.columns])
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def shown(value: object) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def as_text(df: DataFrame, limit: int = 1000, columns: dict[str, Column] | None = None) -> str:
    """Aligned text of the first ``limit`` rows: a display, so it is bounded. ``columns``: formats for some of them."""
    df = (df.orderBy(ROW) if ROW in df.columns else df).withColumns(columns or {})
    rows = _visible(df).limit(limit).collect()
    names = _visible(df).columns
    grid = [names, *[[shown(v) for v in r] for r in rows]]
    wide = [max(len(r[i]) for r in grid) for i in range(len(names))]
    number = [all(not r[i] or re.fullmatch(r"-?[\d.,%eE+-]+", r[i]) for r in grid[1:]) and len(grid) > 1 for i in range(len(names))]
    line = lambda r: " | ".join(c.rjust(w) if n else c.ljust(w) for c, w, n in zip(r, wide, number, strict=True)).rstrip()
    return "\n".join([line([n.ljust(w) for n, w in zip(names, wide, strict=True)]), "-|-".join("-" * w for w in wide), *map(line, grid[1:])])


def as_markdown(df: DataFrame, limit: int = 1000) -> str:
    rows = _visible(df.orderBy(ROW) if ROW in df.columns else df).limit(limit).collect()
    names = _visible(df).columns
    return "\n".join(["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |", *("| " + " | ".join(shown(v).replace("|", "\\|") for v in r) + " |" for r in rows)])


def as_html(df: DataFrame, limit: int = 1000) -> str:
    """A table element of the first ``limit`` rows."""
    rows = _visible(df.orderBy(ROW) if ROW in df.columns else df).limit(limit).collect()
    line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(shown(c))}</{tag}>" for c in cells) + "</tr>"
    return "\n".join(["<table>", line(_visible(df).columns, "th"), *(line(r, "td") for r in rows), "</table>"])


def render(template: str, values: dict[str, Callable[[], object]], as_table: Callable[[DataFrame], str] = as_markdown) -> str:
    """A template with ``{{ name }}`` replaced: a frame by its table (``as_markdown`` or ``as_html``), other values by their
    text, which HTML escapes. Fenced blocks are left as they are."""

    def put(m: re.Match) -> str:
        v = values[m[1]]()
        return as_table(v) if isinstance(v, DataFrame) else html.escape(shown(v)) if as_table is as_html else shown(v)

    # Odd parts are fenced: from a line of three or more marks to the next that has as many.
    parts = re.split(r"(?ms)(^ {0,3}(?P<marks>`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}(?P=marks)[`~]*[ \t]*$|\Z))", template)
    return "".join(part if i % 3 == 1 else re.sub(r"\{\{\s*(\w+)\s*\}\}", put, part) for i, part in enumerate(parts) if i % 3 < 2)


def schema_of(df: DataFrame) -> StructType:
    return _visible(df).schema
