"""Sources and sinks: what is written comes back, and awkward files are read."""

from __future__ import annotations

import datetime
import json
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridloom.sheet import Sheet
from gridloom.sources import sinks, views, workbooks


def _csv(tmp_path, text, name="f.csv"):
    (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path / name)


def test_csv_types(spark, tmp_path):
    path = _csv(tmp_path, "i,d,p,f,on,at,b,t,hex,dur,big,s,n\n1,1.5,20%,1e3,2025-01-31,2025-01-31T09:30,true,09:30,0xff,PT1H,1_000,TRUE,\n2,22,12.5%,-2.5e-1,2025-02-01,2025-02-01T10:00,false,10:00:01,0x10,PT90M,22_000,x,\n")
    df = views.csv(spark, path)
    assert dict(df.dtypes) == {"i": "bigint", "d": "decimal(38,1)", "p": "decimal(38,10)", "f": "double", "on": "date", "at": "timestamp_ntz", "b": "boolean", "t": "bigint", "hex": "bigint", "dur": "interval day to second", "big": "bigint", "s": "string", "n": "string"}
    r = df.collect()[1]
    assert (r.i, r.d, r.p, r.f, r.on, r.b, r.hex, r.big, r.s, r.n) == (2, Decimal("22.0"), Decimal("0.125"), -0.25, datetime.date(2025, 2, 1), False, 16, 22000, "x", None)
    assert r.dur == datetime.timedelta(minutes=90)


@pytest.mark.parametrize("text", ["a,b\n1,x\n2,y\n", "a,b\r\n1,x\r\n2,y\r\n", "a,b\n1,x\n2,y", '﻿a,b\n1,x\n2,y\n'])
def test_awkward_csv(spark, tmp_path, text):
    df = views.csv(spark, _csv(tmp_path, text))
    assert [tuple(r) for r in df.select(df.columns[0], "b").collect()] == [(1, "x"), (2, "y")]


def test_csv_cells_after_the_sample(spark, tmp_path):
    """A later cell that the first rows' types would round or drop: types come from every row."""
    path = _csv(tmp_path, "d,p,n,k,late\n1.25,20%,1,1,\n2.50,30%,2,2,\n1.2345,40%,3,x,7\n7,0.5,4,3,8\n")
    df = views.csv(spark, path, infer_rows=2)
    assert dict(df.dtypes) == {"d": "decimal(38,4)", "p": "string", "n": "bigint", "k": "string", "late": "bigint"}
    assert [tuple(r) for r in df.collect()][2:] == [(Decimal("1.2345"), "40%", 3, "x", 7), (Decimal("7.0000"), "0.5", 4, "3", 8)]


def test_csv_quoted_line_breaks(spark, tmp_path):
    df = views.csv(spark, _csv(tmp_path, 'a,b\n1,"x\ny, ""z"""\n2,"w"\n'))
    assert [tuple(r) for r in df.collect()] == [(1, 'x\ny, "z"'), (2, "w")]


def test_csv_percentages_keep_their_places(spark, tmp_path):
    got = [r.a for r in views.csv(spark, _csv(tmp_path, "a\n12.12345678%\n1%\n")).collect()]
    assert got == [Decimal("0.1212345678"), Decimal("0.01")]
    assert [r.a for r in views.csv(spark, _csv(tmp_path, "a\n12.123456789%\n", "g.csv")).collect()] == ["12.123456789%"]


def test_csv_without_rows(spark, tmp_path):
    assert views.csv(spark, _csv(tmp_path, "a,b\n")).count() == 0


def test_csv_round_trip(spark, tmp_path):
    s = Sheet.inline(spark, 'A | B\n1 | "x, y"\n2 | ', A="bigint")
    sinks.to_csv(s.df, str(tmp_path / "out"), one_file=True)
    assert sorted(map(tuple, views.csv(spark, str(tmp_path / "out")).collect())) == [(1, "x, y"), (2, None)]


def test_json(spark, tmp_path):
    (tmp_path / "f.json").write_text('[{"a": 1, "b": {"c": [1, 2]}}, {"a": null, "b": null}]')
    df = views.json(spark, str(tmp_path / "f.json"))
    assert [tuple(r) for r in df.collect()] == [(1, '{"c":[1,2]}'), (None, None)]
    (tmp_path / "g.json").write_text('{"S": [{"a": 1}, {"a": 2}], "T": [{"z": "q"}]}')
    assert [r.a for r in views.json_sheet(spark, str(tmp_path / "g.json"), "S").collect()] == [1, 2]
    floats = spark.createDataFrame([(1.5,), (float("inf"),), (float("nan"),), (None,)], "x double")
    sinks.to_json(floats, str(tmp_path / "out"), inf_as_text=True)
    assert {r.x for r in views.json(spark, str(tmp_path / "out"), lines=True).collect()} == {"1.5", "Inf", "NaN", None}


def test_parquet_keeps_metadata_and_checks_types(spark, tmp_path):
    s = Sheet.inline(spark, "A\n1", A="bigint")
    sinks.to_parquet(s.df, str(tmp_path / "p"), metadata={"A": {"unit": "kg"}})
    back = views.parquet(spark, str(tmp_path / "p"), {"A": "bigint"})
    assert back.schema["A"].metadata == {"unit": "kg"}
    with pytest.raises(TypeError, match="declared"):
        views.parquet(spark, str(tmp_path / "p"), {"A": "string"})
    ordered = Sheet.parquet(spark, str(tmp_path / "p"), ordered=True, names={"B": "A"})
    assert ordered.df.columns == ["B", "__row"]


def test_nested_columns_are_left_out_by_name(spark, sf_dir):
    df, left_out = views.flat(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    assert left_out == ["embedding"] and df.columns == ["vec_id", "label"]


def test_workbook_round_trip(spark, tmp_path):
    s = Sheet.inline(spark, "Name | N | On\nAda <&> | 1.5 | 2025-01-31\n | 2 | ", N="double", On="date")
    path = str(tmp_path / "f.xlsx")
    workbooks.write({"First": s.df, "Second": s.select("N").df}, path)
    assert [tuple(r)[1:] for r in workbooks.read(spark, path).orderBy("__row").collect()] == [("Ada <&>", 1.5, datetime.date(2025, 1, 31)), (None, 2.0, None)]
    assert [r.N for r in workbooks.read(spark, path, "Second").orderBy("__row").collect()] == [1.5, 2.0]
    with pytest.raises(KeyError):
        workbooks.read(spark, path, "Third")


def test_workbook_dates(spark, tmp_path):
    days = ["1900-01-01", "1900-02-28", "1900-03-01", "1969-07-20", "2024-02-29", "9999-12-31"]
    rows = spark.createDataFrame([(i, d, d + "T13:05:07", d if i else "soon") for i, d in enumerate(days)], "__row long, d string, t string, m string")
    df = rows.select("__row", F.col("d").cast("date"), F.col("t").cast("timestamp_ntz"), "m")
    path = str(tmp_path / "f.xlsx")
    workbooks.write({"S": df}, path)
    back = workbooks.read(spark, path)
    assert back.dtypes == [("__row", "bigint"), ("d", "date"), ("t", "timestamp_ntz"), ("m", "string")]
    assert [tuple(r) for r in back.orderBy("__row").collect()] == [tuple(r) for r in df.orderBy("__row").collect()]
    with zipfile.ZipFile(path) as book:
        assert '<c r="A4" s="1"><v>61.0</v></c>' in book.read("xl/worksheets/sheet1.xml").decode()


def test_json_of_several_sheets(spark, tmp_path):
    one = Sheet.inline(spark, 'A | B\n2 | "x"\n1 | ', A="bigint")
    path = str(tmp_path / "f.json")
    sinks.to_json_sheets({"One": one.df, "Tw\"o": spark.createDataFrame([(float("inf"),), (0.5,)], "x double"), "None": one.filter(F.col("A") > 9).df}, path, inf_as_text=True)
    with open(path) as f:
        assert json.load(f) == {"One": [{"A": 2, "B": "x"}, {"A": 1, "B": None}], 'Tw"o': [{"x": "Inf"}, {"x": "0.5"}], "None": []}
    assert [tuple(r) for r in views.json_sheet(spark, path, "One").collect()] == [(2, "x"), (1, None)]


def test_html_and_fenced_blocks(spark):
    s = Sheet.inline(spark, "Region | Count\nU<K | 1", Count="bigint")
    template = "<p>{{ n }}</p>\n```\n{{ n }}\n```\n{{ t }}\n~~~~ text\n```\n{{ t }}"
    made = sinks.render(template, {"n": lambda: "a&b", "t": lambda: s.df}, sinks.as_html)
    table = "<table>\n<tr><th>Region</th><th>Count</th></tr>\n<tr><td>U&lt;K</td><td>1</td></tr>\n</table>"
    assert made == f"<p>a&amp;b</p>\n```\n{{{{ n }}}}\n```\n{table}\n~~~~ text\n```\n{{{{ t }}}}"


def test_text_and_render(spark):
    s = Sheet.inline(spark, "Region | Count\nUK | 1\nUS | 22", Count="bigint")
    assert s.text() == "Region | Count\n-------|------\nUK     |     1\nUS     |    22"
    made = sinks.render("n={{ n }}\n{{ t }}", {"n": lambda: 3, "t": lambda: s.df})
    assert made.startswith("n=3\n| Region | Count |") and made.endswith("| US | 22 |")
