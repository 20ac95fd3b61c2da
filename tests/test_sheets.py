"""Answers worked out by hand for small sheets."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridloom.functions import aggregates as A
from gridloom.functions.arithmetic import times
from gridloom.functions.formats import percent
from gridloom.functions.logic import if_else, is_in
from gridloom.operators import recurrences
from gridloom.sheet import Sheet

LEDGER = """
Day        | Shop | Sold
2024-05-04 | N    | 8
2024-05-02 | S    | 3
2024-05-06 | N    |
2024-05-01 | N    | 12
2024-05-05 | S    | 6
2024-05-03 | S    | 9
2024-05-07 | N    | 4
"""


@pytest.fixture(scope="module")
def ledger(spark):
    return Sheet.inline(spark, LEDGER, Day="date", Sold="bigint")


def column(sheet: Sheet, name: str) -> list:
    return [r[0] for r in sheet.df.orderBy("__row").select(name).collect()]


@pytest.mark.parametrize(
    ("function", "n", "order", "by", "want"),
    [
        ("cum_sum", None, None, None, [8, 11, None, 23, 29, 38, 42]),
        ("cum_sum", None, "Day", None, [32, 15, None, 12, 38, 24, 42]),
        ("cum_sum", None, "Day", ["Shop"], [20, 3, None, 12, 18, 12, 24]),
        ("cum_max", None, "Day", None, [12, 12, None, 12, 12, 12, 12]),
        ("cum_min", None, "Day", None, [3, 3, None, 12, 3, 3, 3]),
        ("cum_min", None, "Day", ["Shop"], [8, 3, None, 12, 3, 3, 4]),
        ("cum_count", None, "Day", None, [4, 2, 5, 1, 5, 3, 6]),
        ("cum_count", None, "Day", ["Shop"], [2, 1, 2, 1, 3, 2, 3]),
        ("diff", 1, "Day", ["Shop"], [-4, None, None, None, -3, 6, None]),
        ("pct_change", 1, "Day", ["Shop"], [8 / 12 - 1, None, None, None, 6 / 9 - 1, 2.0, None]),
        ("forward_fill", None, "Day", None, [8, 3, 6, 12, 6, 9, 4]),
        ("forward_fill", None, "Day", ["Shop"], [8, 3, 8, 12, 6, 9, 4]),
        ("backward_fill", None, "Day", None, [8, 3, 4, 12, 6, 9, 4]),
        ("rolling_sum", 2, "Day", None, [17, 15, None, None, 14, 12, None]),
        ("rolling_mean", 2, "Day", None, [8.5, 7.5, None, None, 7.0, 6.0, None]),
        ("shift", 1, None, None, [None, 8, 3, None, 12, 6, 9]),
        ("shift", 0, None, None, [8, 3, None, 12, 6, 9, 4]),
        ("shift", -2, None, None, [None, 12, 6, 9, 4, None, None]),
        ("diff", 1, None, None, [None, -5, None, None, -6, 3, -5]),
    ],
)
def test_windows(ledger, function, n, order, by, want):
    assert column(ledger.window("x", function, "Sold", n, order, by), "x") == want


@pytest.mark.parametrize(("ties", "desc", "by", "want"), [("min", False, None, [4, 1, None, 6, 3, 5, 2]), ("min", True, None, [3, 6, None, 1, 4, 2, 5]), ("dense", False, ["Shop"], [2, 1, None, 3, 2, 3, 1])])
def test_ranks(ledger, ties, desc, by, want):
    assert column(ledger.rank("x", "Sold", ties, desc, by), "x") == want


def test_unknown_rank_is_refused(ledger):
    with pytest.raises(ValueError, match="sideways"):
        ledger.rank("x", "Sold", "sideways")


def test_lookups_and_running_totals(spark):
    drivers = Sheet.inline(spark, "ID | Name | Town\n7 | Iris | Leeds\n8 | Jo | York\n9 | Kim | Hull", ID="bigint")
    table = """At | Driver | Hours | Rate
    2024-02-01T08:00 | 8 | 4 | 12.50
    2024-02-01T13:30 | 5 | 2 | 30
    2024-02-02T09:15 | 7 | 9 | 11.25
    2024-02-03T10:00 | 8 | 3 | 20.10"""
    trips = Sheet.inline(spark, table, At="timestamp_ntz", Driver="bigint", Hours="bigint", Rate="decimal(18,2)")
    trips = trips.lookup(drivers, "Driver", "ID", Name=("Name", F.lit("nobody")), Town=("Town", F.lit("?")))
    trips = trips.with_columns(Pay=times(F.col("Hours"), F.col("Rate"), 2))
    trips = trips.with_columns(
        Bonus=if_else((F.col("Pay") > 55) & is_in("Town", ["Leeds", "York"]), (F.col("Pay").cast("decimal(18,3)") / 10).cast("decimal(18,3)"), F.lit(0).cast("decimal(18,3)")),
        First=F.col("At") < F.lit("2024-02-02T00:00:00").cast("timestamp_ntz"),
    )
    trips = trips.accumulate("Earned", F.col("Pay"), ["__row"], ["Driver"])
    got = trips.df.orderBy("__row").select("Name", "Town", F.col("Pay").cast("double"), F.col("Bonus").cast("double"), "First", F.col("Earned").cast("double")).collect()
    assert [tuple(r) for r in got] == [("Jo", "York", 50.0, 0.0, True, 50.0), ("nobody", "?", 60.0, 0.0, True, 60.0), ("Iris", "Leeds", 101.25, 10.125, False, 101.25), ("Jo", "York", 60.3, 6.03, False, 110.3)]
    towns = Sheet.inline(spark, "Town\nLeeds\nYork\nHull")
    towns = towns.conditional(trips, "Town", "Town", {"Trips": F.lit(0), "Paid": F.lit(0)}, Trips=A.length(), Paid=A.total("Pay", 2))
    assert [(r[0], r[1], float(r[2])) for r in towns.collect()] == [("Leeds", 1, 101.25), ("York", 2, 110.3), ("Hull", 0, 0.0)]


def test_several_matches_of_a_lookup_are_an_error(spark):
    two = Sheet.inline(spark, "K | V\na | 1\na | 2")
    asked = Sheet.inline(spark, "K\na").lookup(two, "K", "K", Found=("V", None))
    with pytest.raises(Exception, match="several rows"):
        asked.collect()


def test_a_cell_with_a_formula_and_a_left_join(spark):
    plots = Sheet.inline(spark, "Plot | Grown | Lost\nA | 800 | 200\nB | 1200 | 450\nC |  | 500", Grown="decimal(18,2)", Lost="decimal(18,2)")
    before = plots.window("Back", "shift", "Grown", 1)
    plots = before.cells("Grown", {2: (F.col("Back").cast("decimal(18,2)") * F.lit("1.25").cast("decimal(4,2)")).cast("decimal(18,2)")}).select("Plot", "Grown", "Lost")
    plots = plots.with_columns(Kept=F.col("Grown") - F.col("Lost"))
    plots = plots.with_columns(Share=percent(F.col("Kept").cast("decimal(18,4)") / F.col("Grown").cast("decimal(9,0)")))
    assert [(r["Plot"], float(r["Grown"]), float(r["Kept"]), r["Share"]) for r in plots.df.orderBy("__row").collect()] == [("A", 800, 600, "75%"), ("B", 1200, 750, "62.5%"), ("C", 1500, 1000, "66.67%")]
    aims = Sheet.inline(spark, "Plot | Aim | Who\nA | 700 | X\nC | 900 | Y\nC | 950 | Z\nD | 10 | X", Aim="bigint")
    against = plots.select("Plot", "Grown").join(aims, "Plot", how="left").df.orderBy("__row", "__row_right")
    assert [(r["Plot"], r["Aim"], r["Who"]) for r in against.collect()] == [("A", 700, "X"), ("B", None, None), ("C", 900, "Y"), ("C", 950, "Z")]


def test_null_groups_and_order(spark):
    s = Sheet.inline(spark, "K | V\nb | 1\n | 2\na | 3\n | 4\nb |", V="bigint").group_by("K", Total=("V", "sum"), N=("V", "count"), Rows=("V", "len"), First=("V", "first"), Last=("V", "last"))
    assert [tuple(r) for r in s.collect()] == [(None, 6, 2, 2, 2, 4), ("a", 3, 1, 1, 3, 3), ("b", 1, 1, 2, 1, None)]


def test_positions(spark):
    s = Sheet.inline(spark, "V\na\nb\nc\nd", V="string")
    assert s.head(2).collect() == [("a",), ("b",)]
    assert s.tail(2).collect() == [("c",), ("d",)]
    assert s.rows(1, 9).collect() == [("b",), ("c",), ("d",)]
    assert s.row(-1).collect() == [("d",)] and s.row(1).collect() == [("b",)] and s.row(-4).collect() == [("a",)]
    assert s.tail(2, "V").collect() == [("c",), ("d",)] and [r.V for r in s.tail(3, "V").df.collect()] == ["b", "c", "d"]
    for position in (4, -5, 99):
        with pytest.raises(Exception, match="no row"):
            s.row(position).collect()


def test_masks_have_a_value_for_each_row(spark):
    from gridloom.operators import stages

    s = Sheet.inline(spark, "V\na\nb\nc")
    mask = Sheet.inline(spark, "M\ntrue\nfalse\ntrue", M="boolean")
    assert [r.V for r in stages.masked(s.df, mask.df, "M").orderBy("__row").collect()] == ["a", "c"]
    with pytest.raises(ValueError, match="2 values for 3 rows"):
        stages.masked(s.df, mask.head(2).df, "M")


def test_products_of_whole_numbers_are_exact(spark):
    s = Sheet.inline(spark, "K | V\na | 1000003\na | 1000033\na | 1000037\nb | 7", V="bigint")
    assert s.group_by("K", P=("V", "product"), N=("V", "len")).collect() == [("a", Decimal(1000003 * 1000033 * 1000037), 3), ("b", Decimal(7), 1)]
    assert s.aggregate(P=("V", "product")).collect() == [(Decimal(1000003 * 1000033 * 1000037 * 7),)]


def test_stable_sort_and_distinct(spark):
    s = Sheet.inline(spark, "K | V\nx | 2\ny | 1\nx | 1\nz |", V="bigint")
    assert [r["K"] for r in s.sort("V").df.collect()] == ["z", "y", "x", "x"]
    assert [r["K"] for r in s.sort("V", desc=True).df.collect()] == ["x", "y", "x", "z"]
    assert s.distinct("K").collect() == [("x", 2), ("y", 1), ("z", None)]
    marked = s.mark_kinds("K", "u", "d", "f", "l").df.orderBy("__row").select("u", "d", "f", "l").collect()
    assert [tuple(r) for r in marked] == [(False, True, True, False), (True, False, True, True), (False, True, False, True), (True, False, True, True)]


def test_recurrences(spark):
    s = Sheet.inline(spark, "K | A\na | 1\nb | 10\na | 2\na | 3\nb | 20", A="double")
    made = recurrences.stepwise(s.df, lambda row, done: (done[-1] if done else 0.0) * 2 + row["A"], "x", "double", ["K"], ["__row"])
    assert [r.x for r in made.orderBy("__row").collect()] == [1, 10, 4, 11, 40]
    closed = recurrences.decayed(s.df, F.col("A"), 2.0, "x", ["K"], ["__row"])
    assert closed.columns == ["__row", "K", "A", "x"]
    assert [r.x for r in closed.orderBy("__row").collect()] == [1, 10, 4, 11, 40]


@pytest.mark.parametrize("factor", [0.5, -0.9, 1e-9, 0.0, 1.0])
def test_decayed_values_are_those_of_a_plain_loop(spark, factor):
    rows = [(i, None if i % 10 == 7 else "abc"[i % 3 % 2], None if i == 2900 else float(i % 13)) for i in range(3000)]
    df = spark.createDataFrame(rows, "at int, k string, v double").repartition(5)
    got = {r["at"]: r.x for r in recurrences.decayed(df, F.col("v"), factor, "x", ["k"], ["at"], block=100).collect()}
    last: dict = {}
    for at, k, v in rows:
        before = last.get(k, 0.0)
        last[k] = None if before is None or v is None else before * factor + v
        assert got[at] == (None if last[k] is None else pytest.approx(last[k], rel=1e-9, abs=1e-12)), at


def test_null_amount_stops_a_balance(spark):
    s = Sheet.inline(spark, "A\n1\n2\n\n4", A="bigint")
    assert column(s.accumulate("b", F.col("A"), ["__row"], start=5), "b")[:2] == [6, 8]


def test_dates_survive(ledger):
    assert ledger.aggregate(last=("Day", "max")).collect() == [(datetime.date(2024, 5, 7),)]


def test_streams_take_the_same_aggregates(spark, tmp_path):
    from gridloom.streaming.running import tumbling

    rows = spark.createDataFrame([("2025-01-01 00:10:00", 1), ("2025-01-01 00:50:00", 2), ("2025-01-01 01:10:00", 4)], "ts string, v int").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = tumbling(stream, "ts", "1 hour", "10 minutes", [], total=F.sum("v"))
    q = out.writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.total for r in spark.sql("select total from totals").collect()) == [3, 4]
