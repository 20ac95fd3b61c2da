"""Edge values of scalar functions and aggregates: null, NaN, infinities, zero divisors, carries and bounds."""

from __future__ import annotations

import cmath
import datetime
import math
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gridloom.functions import aggregates as A
from gridloom.functions import arithmetic as Ar
from gridloom.functions import complexes as C
from gridloom.functions import convert, dates, formats, fractions, logic, maths, quantities, sequences, text, vectors
from gridloom.functions import uncertain as U
from gridloom.operators import lookups, prefix, quantiles, ranks, stages
from gridloom.operators.order import file_rows, number_rows
from gridloom.operators.products import products
from gridloom.operators.windows import rolling_std
from gridloom.operators.order import in_order

INF, NAN = math.inf, math.nan


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def same(a, b):
    return a is b or a == b or isinstance(a, float) and isinstance(b, float) and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-15))


def lit(x, kind="double"):
    return F.lit(x).cast(kind)


@pytest.mark.parametrize(("x", "y", "want"), [(1, 0, INF), (-1, 0, -INF), (0, 0, NAN), (NAN, 0, NAN), (6, 4, 1.5), (None, 0, None), (1, None, None), (INF, 2, INF)])
def test_divide(spark, x, y, want):
    assert same(value(spark, Ar.divide(lit(x), lit(y))), want)


@pytest.mark.parametrize(("x", "y", "want"), [(7, 3, 1), (-7, 3, 2), (7, -3, -2), (-7, -3, -1), (6, 3, 0), (None, 3, None), (5, 0, None)])
def test_floor_mod(spark, x, y, want):
    assert value(spark, Ar.floor_mod(lit(x, "bigint"), lit(y, "bigint"))) == want


@pytest.mark.parametrize(("x", "y", "want"), [(7.5, 2, 1.5), (-7.5, 2, 0.5), (1, 0, NAN), (None, 0, None)])
def test_floor_mod_float(spark, x, y, want):
    assert same(value(spark, Ar.floor_mod_float(lit(x), lit(y))), want)


@pytest.mark.parametrize(("x", "n", "want"), [(1.005, 2, 1.0), (-2.5, 0, -3.0), (2.5, 0, 3.0), (INF, 2, INF), (NAN, 2, NAN), (1e300, 17, 1e300), (0.49999999999999994, 0, 0.0), (None, 1, None)])
def test_round_float(spark, x, n, want):
    assert same(value(spark, Ar.round_float(lit(x), n)), want)


def test_exact_products_and_quotients(spark):
    assert value(spark, Ar.times(lit("19.99", "decimal(18,2)"), lit("1.5", "decimal(18,2)"), 2)) == Decimal("29.99")
    assert value(spark, Ar.times(lit("19.99", "decimal(18,3)"), lit("1.5", "decimal(18,3)"), 3)) == Decimal("29.985")
    assert value(spark, Ar.over(lit("1.0", "decimal(10,1)"), lit(3, "int"))) == Decimal("0.3333333333")
    assert value(spark, Ar.over(lit("2", "decimal(10,1)"), lit(3, "int"))) == Decimal("0.6666666667")
    assert value(spark, Ar.over(lit("2", "decimal(10,1)"), lit(0, "int"))) is None


def test_shifts(spark):
    assert value(spark, Ar.shift_right(lit(-16, "bigint"), 2)) == -4
    assert value(spark, Ar.shift_left(lit(5, "bigint"), 2)) == 20
    assert value(spark, Ar.bit_not(lit(0xFF, "bigint"))) == -256
    for bad in (Ar.shift_left(lit(1, "bigint"), 64), Ar.shift_left(lit(1, "bigint"), 63), Ar.shift_right(lit(1, "bigint"), -1)):
        with pytest.raises(Exception, match="shift of"):
            value(spark, bad)


def test_logic_of_missing_values(spark):
    null = lit(None, "boolean")
    t, f = F.lit(True), F.lit(False)
    assert value(spark, logic.if_else(null, F.lit(1), F.lit(2))) is None
    assert value(spark, logic.is_in(F.lit(3), [1, None])) is False
    assert value(spark, logic.is_in(lit(None, "int"), [1])) is None
    assert value(spark, logic.is_in(F.lit(3), [])) is False
    assert [value(spark, logic.xor(a, b)) for a, b in ((t, f), (t, t), (f, f), (null, t), (null, f))] == [True, False, False, None, None]
    assert [value(spark, logic.nand(a, b)) for a, b in ((t, f), (t, t), (null, f))] == [True, False, None]
    assert [value(spark, logic.nor(a, b)) for a, b in ((f, f), (t, null), (null, f))] == [True, False, None]
    assert value(spark, logic.is_nan(lit(None))) is None and value(spark, logic.is_nan(lit(NAN))) is True
    assert [value(spark, logic.is_finite(lit(x))) for x in (1, INF, NAN, None)] == [True, False, False, None]
    assert [value(spark, logic.is_infinite(lit(x))) for x in (1, -INF, NAN, None)] == [False, True, False, None]
    assert value(spark, logic.approximately(F.sin(F.lit(math.pi)), F.lit(0.0))) is True
    assert value(spark, logic.approximately(lit(NAN), lit(NAN))) is False
    assert value(spark, logic.approximately(lit(1.0), lit(1.1))) is False


def test_nan_is_greatest_and_equal_to_itself(spark):
    df = spark.createDataFrame([(NAN,), (INF,), (1.0,), (None,)], "x double")
    assert math.isnan(df.agg(A.maximum("x")).first()[0])
    assert df.where("x = double('nan')").count() == 1


@pytest.mark.parametrize(("f", "x", "want"), [(maths.ln, 0, -INF), (maths.log10, 1000, 3.0), (maths.log2, 8, 3.0), (maths.sqrt, 9, 3.0), (maths.ln, NAN, NAN), (maths.arctanh, 1, INF), (maths.arctanh, -1, -INF), (maths.arccosh, 1, 0.0), (maths.ln, None, None)])
def test_maths(spark, f, x, want):
    assert same(value(spark, f(lit(x))), want)


@pytest.mark.parametrize("f", [maths.ln, maths.sqrt])
def test_past_the_domain(spark, f):
    with pytest.raises(Exception, match="complex"):
        value(spark, f(lit(-4)))
    assert math.isnan(value(spark, f(lit(-4), strict=False)))


NUMBERS = [3 + 4j, -1 + 0j, 1j, -2 - 0.5j, 0.3 - 0.7j, 2 + 0j]


@pytest.mark.parametrize("name", ["exp", "ln", "sqrt", "sin", "cos", "tan", "sinh", "cosh", "tanh", "arcsin", "arccos", "arctan", "arcsinh", "arccosh", "arctanh", "log10"])
def test_complex_functions(spark, name):
    known = {"ln": cmath.log, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "arcsinh": cmath.asinh, "arccosh": cmath.acosh, "arctanh": cmath.atanh}
    for z in NUMBERS:
        if name in ("arctan", "arctanh") and z in (1j, 2 + 0j, -1 + 0j) or name in ("arcsin", "arccos") and z == 2:
            continue  # poles, and the side of a cut that depends on the sign of zero
        got = value(spark, getattr(C, name)(C.complex_(F.lit(z.real), F.lit(z.imag))))
        want = known.get(name, getattr(cmath, name, None))(z)
        assert abs(complex(got.re, got.im) - want) < 1e-9, (name, z)


def test_complex_arithmetic(spark):
    z = lambda x: C.complex_(F.lit(x.real), F.lit(x.imag))
    got = lambda c: (lambda r: complex(r.re, r.im))(value(spark, c))
    assert got(C.times(z(1 + 2j), z(3 - 1j))) == 5 + 5j
    assert value(spark, C.magnitude(z(3 + 4j))) == 5
    assert got(C.sqrt(z(-4 + 0j))) == 2j
    assert got(C.conj(z(3 + 4j))) == 3 - 4j
    assert got(C.power(z(1 + 1j), 2)) == 2j
    assert abs(got(C.over(z(1 + 2j), z(3 - 1j))) - (1 + 2j) / (3 - 1j)) < 1e-12


def test_uncertain(spark):
    m = lambda v, s: U.measured(lit(v), lit(s))
    got = lambda c: (lambda r: (round(r.value, 6), round(r.sigma, 6)))(value(spark, c))
    assert got(U.plus(m(10, 1), m(20, 2))) == (30, round(math.sqrt(5), 6))
    assert got(U.times(m(10, 0.1), U.certain(lit(2)))) == (20, 0.2)
    assert got(U.sin(m(0.5, 0.01))) == (round(math.sin(0.5), 6), round(0.01 * math.cos(0.5), 6))
    assert got(U.ln(m(100, 1))) == (round(math.log(100), 6), 0.01)
    assert got(U.minus(m(10, 1), m(10, 1))) == (0, round(math.sqrt(2), 6))
    assert value(spark, U.equal(m(10, 1), m(11, 0.5))) is True


def test_fractions_reduce_in_few_steps(spark):
    """Numbers of Fibonacci take the most steps; steps follow the digits, and no operand is worked out twice."""
    fib = [1, 1]
    while len(fib) < 170:
        fib.append(fib[-1] + fib[-2])
    pairs = [(fib[i] * k, fib[i + 1] * k) for i in range(1, 85) for k in (1, 6) if fib[i + 1] * k < 10**18]
    pairs += [(fib[i], fib[i + 1]) for i in range(85, 150, 7)] + [(0, 7), (-6, 4), (6, -4), (12, 12), (10**18 - 1, 3), (10**18, 10**18), (7, 10**20)]
    rows = spark.createDataFrame([(Decimal(a), Decimal(b)) for a, b in pairs], "n decimal(38,0), d decimal(38,0)")
    got = rows.select("n", "d", fractions.fraction("n", "d").alias("x")).collect()
    assert [Fraction(int(r.x.num), int(r.x.den)) for r in got] == [Fraction(int(r.n), int(r.d)) for r in got]
    assert all(r.x.den > 0 and math.gcd(int(r.x.num), int(r.x.den)) == 1 for r in got)
    # Sums of sums: each operand stands once in the plan, with its two ways to reduce.
    x = fractions.fraction("n", "d")
    plan = rows.select(fractions.as_float(fractions.plus(fractions.plus(x, x), x)).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") == 2 * 5
    plain = rows.select(fractions.fraction(6, -4).alias("a"), fractions.fraction(1, 0).alias("b"), fractions.fraction("d", 12).alias("c")).first()
    assert (int(plain.a.num), int(plain.a.den)) == (-3, 2) and plain.b is None and (int(plain.c.num), int(plain.c.den)) == (1, 6)


def test_fractions(spark):
    f = lambda a, b: fractions.fraction(lit(a, "bigint"), lit(b, "bigint"))
    show = lambda c: value(spark, fractions.show(c))
    assert show(fractions.plus(f(1, 3), f(1, 6))) == "1/2"
    assert show(fractions.times(f(1, 7), f(7, 1))) == "1"
    assert show(f(7, 3)) == "2 1/3" and show(f(-7, 3)) == "-2 1/3" and show(f(6, -8)) == "-3/4"
    assert show(fractions.over(f(1, 2), f(3, 4))) == "2/3"
    assert value(spark, f(1, 0)) is None
    assert value(spark, fractions.as_decimal(f(1, 7))) == Decimal("0.1428571429")
    assert show(f(2**40 * 3, 2**40 * 9)) == "1/3"


def test_quantities(spark):
    q = lambda v, u: quantities.quantity(lit(v), u)
    got = lambda x: round(value(spark, x.value), 9)
    assert got(q(5, "kg") + q(300, "g")) == 5.3 and got(q(300, "g") + q(5, "kg")) == 5300
    assert (q(2, "m") * q(3, "m")).unit.name == "m^2" and got(q(2, "m") * q(3, "m")) == 6
    assert got((q(10, "m") / q(4, "s"))) == 2.5 and (q(10, "m") / q(4, "s")).unit.name == "m.s^-1"
    assert got(q(4, "GiB") + q(512, "MiB")) == 4.5
    assert got((q(10, "MB.s^-1") * q(3, "s")).to("MB")) == 30
    assert got(q(1, "KiB").to("B")) == 1024
    assert got(q(6, "m") / q(3, "cm")) == 200
    assert got(q(5, "kg").to("g")) == 5000
    assert got((q(9, "m") ** 2).sqrt()) == 9
    assert got(q(20, "°C").to("K")) == 293.15 and got(q(300, "K").to("°C")) == 26.85
    assert round(value(spark, F.sin(q(30, "°").angle())), 9) == 0.5
    assert value(spark, quantities.dms(q(45.5, "°"))) == "45°30′0″"
    assert value(spark, q(1, "kg") > q(900, "g")) is True
    with pytest.raises(ValueError, match="different things"):
        q(5, "kg") + q(3, "m")
    for bad in ("ft", "lb", "min", "kkg"):
        with pytest.raises(ValueError, match="not a unit"):
            quantities.unit(bad)


@pytest.mark.parametrize(("x", "want"), [("AY", "AZ"), ("AZ", "BA"), ("Z", "AA"), ("z", "aa"), ("9", "10"), ("99", "100"), ("job-A9", "job-B0"), ("a-1.", "a-2."), ("", ""), ("--", "--"), ("Zz9", "AAa0"), (None, None)])
def test_succ(spark, x, want):
    assert value(spark, text.succ(lit(x, "string"))) == want


def test_text(spark):
    assert value(spark, text.starts_within(F.lit("Cat"), "A", "C")) is True and value(spark, text.starts_within(F.lit("Dog"), "A", "C")) is False
    assert value(spark, text.contains_any(lit(None, "string"), ["a"])) is None
    assert value(spark, text.len_chars(F.lit("añ😀"))) == 3
    assert value(spark, text.email(F.lit("a@b.org"))) == "a@b.org"
    with pytest.raises(Exception, match="not an e-mail"):
        value(spark, text.email(F.lit("a@b")))


@pytest.mark.parametrize(("x", "want"), [("42", 42), ("1_000", 1000), ("20%", Decimal("0.2")), ("12.5%", Decimal("0.125")), ("1/8", Decimal("0.125")), ("2 3/4", Decimal("2.75")), ("-1/4", Decimal("-0.25")), ("0xff", 255), ("0o17", 15), ("0b101", 5), ("abc", None), ("", None), (None, None), ("19.99", Decimal("19.99"))])
def test_number_cells(spark, x, want):
    got = value(spark, convert.number_cell(lit(x, "string")))
    assert got == want


def test_cells_of_time(spark):
    assert value(spark, convert.time_cell(F.lit("09:30:15.5"))) == ((9 * 60 + 30) * 60 + 15) * 10**9 + 5 * 10**8
    assert value(spark, convert.time_cell(F.lit("24:00"))) is None
    assert value(spark, convert.duration_cell(F.lit("P1DT2H30M"))) == datetime.timedelta(days=1, hours=2, minutes=30)
    assert value(spark, convert.duration_cell(F.lit("-PT1.5S"))) == datetime.timedelta(seconds=-1.5)
    assert value(spark, convert.integer(lit("-19.99", "decimal(10,2)"))) == -19
    assert [value(spark, convert.boolean_cell(F.lit(x))) for x in ("x", "o", "1", "false")] == [True, False, True, False]


def test_dates(spark):
    d = F.lit("2025-01-31").cast("date")
    t = F.lit("2025-01-31T09:30:15.123456").cast("timestamp_ntz")
    assert value(spark, dates.add_months(d, 1)) == datetime.date(2025, 2, 28)
    assert value(spark, dates.add_months(t, 1, is_datetime=True)) == datetime.datetime(2025, 2, 28, 9, 30, 15, 123456)
    assert value(spark, dates.month_end(t, is_datetime=True)) == datetime.datetime(2025, 1, 31, 9, 30, 15, 123456)
    assert value(spark, dates.weekday(d)) == 5
    assert value(spark, dates.week(F.lit("2024-12-30").cast("date"))) == 1
    assert [value(spark, dates.is_leap_year(F.lit(f"{y}-01-01").cast("date"))) for y in (1900, 2000, 2024, 2025)] == [False, True, True, False]
    assert (value(spark, dates.millisecond(t)), value(spark, dates.microsecond(t)), value(spark, dates.nanosecond(t))) == (123, 123456, 123456000)
    assert value(spark, dates.time_plus(F.lit(86_399 * 10**9), F.lit(2))) == 10**9
    assert value(spark, dates.total_hours(convert.duration_cell(F.lit("PT1H30M")))) == Decimal("1.5")
    assert value(spark, dates.duration(t, d.cast("timestamp_ntz"))) == datetime.timedelta(hours=9, minutes=30, seconds=15, microseconds=123456)
    assert value(spark, dates.date_and_time(d, F.lit(3_600_000_000_000))) == datetime.datetime(2025, 1, 31, 1)
    assert value(spark, dates.scale_duration(convert.duration_cell(F.lit("PT3S")), F.lit(0.5))) == datetime.timedelta(seconds=1.5)


def test_zones(spark):
    utc = lambda s: value(spark, dates.utc(F.lit(s).cast("timestamp_ntz"), "Europe/London"))
    assert utc("2025-03-30T01:30:00") == datetime.datetime(2025, 3, 30, 1, 30)
    assert utc("2025-10-26T01:30:00") == datetime.datetime(2025, 10, 26, 0, 30)
    assert value(spark, dates.utc_offset(F.lit("2025-07-01T12:00:00").cast("timestamp_ntz"), "Europe/London")) == 3600
    assert value(spark, dates.base_utc_offset(F.lit("2025-07-01T12:00:00").cast("timestamp_ntz"), "Europe/London")) == 0
    n = F.lit("2025-01-01T12:00:00").cast("timestamp_ntz")
    assert value(spark, dates.instants_between(n, "Europe/London", n, "Asia/Tokyo")) == datetime.timedelta(hours=9)


def test_sequences(spark):
    rows = spark.range(30).withColumnRenamed("id", "__row")
    got = lambda c: [r[0] for r in rows.orderBy("__row").select(c).collect()]
    assert got(sequences.arithmetic("__row", 1, 3, 9))[:7] == [1, 3, 5, 7, 9, None, None]
    assert got(sequences.geometric("__row", 1, 2))[:4] == [1, 2, 4, 8]
    assert [str(d) for d in got(sequences.dates_by_months("__row", "2025-01-31", 1, 31))[:3]] == ["2025-01-31", "2025-02-28", "2025-03-31"]
    assert got(sequences.cycle("__row", sequences.DAYS, "Sunday"))[:2] == ["Sunday", "Monday"]
    assert got(sequences.months_with_year("__row", "Nov-2026", 3))[:2] == ["Nov-2026", "Feb-2027"]
    assert got(sequences.letters("__row", "Y"))[:4] == ["Y", "Z", "AA", "AB"]


def test_formats(spark):
    t = F.lit("2025-01-31T09:05:00").cast("timestamp_ntz")
    assert value(spark, formats.show_date(t, "%a %-d %b %Y at %H:%M")) == "Fri 31 Jan 2025 at 09:05"
    assert value(spark, formats.grouped(F.lit(1234567.891), 2)) == "1,234,567.89"
    assert value(spark, formats.fixed(F.lit(2.345), 2)) == "2.35"
    assert value(spark, formats.based(F.lit(255), 16, "0x")) == "0xff"
    assert value(spark, formats.scientific(F.lit(12345.678), 2)) == "1.23e+04"


def test_signs_widths_and_powers(spark):
    df = spark.createDataFrame([("1.5",), ("-2.25",), ("0",), (None,)], "t string").withColumn("x", F.col("t").cast("decimal(20,4)"))
    plus = formats.signed("x", formats.fixed("x", 1))
    made = {"plus": plus, "wide": formats.padded(plus, 7), "zeros": formats.padded(plus, 7, "0"), "left": formats.padded(plus, 6, left=True), "short": formats.padded(plus, 2), "milli": formats.powers_of_thousand("x", 2, -3)}
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in made.items()]).collect()]
    assert got == [("+1.5", "   +1.5", "+0001.5", "+1.5  ", "+1.5", "1500.00e-03"), ("-2.3", "   -2.3", "-0002.3", "-2.3  ", "-2.3", "-2250.00e-03"), ("0.0", "    0.0", "00000.0", "0.0   ", "0.0", "0.00e-03"), (None,) * 6]


def test_own_terms(spark):
    terms = sequences.own_terms([0, 1], lambda t: t[-1] + t[-2], 60)
    assert terms == [0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55]
    assert [r[0] for r in spark.range(13).select(sequences.listed("id", terms)).collect()] == [*terms, None, None]
    assert sequences.own_terms([5, 9], lambda t: t[-1] + 1, 6) == [5]
    with pytest.raises(ValueError, match="in 10 terms"):
        sequences.own_terms([1], lambda t: t[-1], 6, most=10)


def test_pieces_of_vectors(spark):
    a, b = spark.createDataFrame([(i, i * 10) for i in range(6)], "__row long, a int"), spark.createDataFrame([(i, i) for i in range(9)], "__row long, b int")
    made = stages.pieces((a, "a", 0, 2), (b, "b", 7, 8), (a, "a", 2, 2))
    assert [r["value"] for r in made.orderBy("__row").collect()] == [0, 10, 20, 7, 8, 20]


def test_aggregates_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(None, None)], "x bigint, b boolean")
    for rows in (df, df.limit(0)):
        got = rows.agg(A.total("x"), A.product_float("x"), A.mean("x"), A.minimum("x"), A.std("x"), A.all_("b"), A.any_("b"), A.none_("b"), A.count("x")).first()
        assert tuple(got) == (0, 1.0, None, None, None, True, False, True, 0)


def test_row_sums_keep_their_places(spark):
    df = spark.createDataFrame([(Decimal("0.0050"), Decimal("0.0051"), 3), (Decimal("1.2345"), None, 0)], "x decimal(10,4), y decimal(12,4), n bigint")
    assert [r[0] for r in df.select(A.row_sum("x", "y", "n", scale=4)).collect()] == [Decimal("3.0101"), Decimal("1.2345")]
    with pytest.raises(Exception, match="more than 2 places"):
        df.select(A.row_sum("x", "y")).collect()


def test_sums_past_64_bits(spark):
    df = spark.createDataFrame([(2**63 - 1,), (2**63 - 1,)], "x bigint")
    assert df.agg(A.total("x", 0, 38)).first()[0] == 2**64 - 2


def test_exact_mean_and_variance(spark):
    df = spark.createDataFrame([(1,), (2,), (4,)], "x bigint")
    got = df.agg(A.mean("x"), A.variance_exact("x", 0), A.variance_exact("x", 0, 0), A.variance("x", 3)).first()
    assert tuple(got) == (Decimal("2.3333333333"), Decimal("2.3333333333"), Decimal("1.5555555556"), None)


def test_range_sums(spark):
    assert [value(spark, A.range_sum(F.lit(a), F.lit(b))) for a, b in ((1, 10), (5, 4), (-3, 3))] == [55, 0, 0]


def test_quantiles_and_medians(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 3, 3, None)] + [(None, 7), ("b", None)], "k string, v bigint")
    got = {r.k: tuple(r)[1:] for r in quantiles.quantiles(df, ["k"], "v", {"q0": 0.0, "q5": 0.5, "q9": 0.9}).collect()}
    assert got == {"a": (1, 3, 5), None: (7, 7, 7)}
    assert {r.k: r.median for r in quantiles.medians(df, ["k"], "v").collect()} == {"a": 3.0, None: 7.0}


def test_running_values_split_one_key(spark):
    df = spark.range(2000).select("id", (F.col("id") % 5).alias("v"))
    made = prefix.running(df.repartition(7), ["id"], {"s": ("sum", F.col("v")), "m": ("max", F.when(F.col("v") < 4, F.col("v")))})
    got = {r.id: (r.s, r.m) for r in made.collect()}
    total = 0
    for i in range(2000):
        total += i % 5
        assert got[i][0] == total
        assert got[i][1] == (None if i % 5 == 4 else min(3, i) if i < 4 else 3)


def test_large_keys_are_split_and_give_the_same(spark):
    """Each form with every key taken for a large one, and with none."""
    rows = [((i * 37) % 400, None if i % 9 == 4 else "ab"[i % 7 > 4], None if i % 5 == 3 else i % 11) for i in range(400)]
    df = spark.createDataFrame(rows, "__row long, k string, v long").repartition(6)
    by = ["k"]
    made = {
        "running": lambda few: prefix.running(df, ["__row"], {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "m": ("min", F.col("v"))}, by, few=few),
        "filled": lambda few: prefix.filled(df, "v", "x", ["__row"], by, few=few),
        "back": lambda few: prefix.filled(df, "v", "x", ["__row"], by, back=True, few=few),
        "near": lambda few: prefix.near(df, {"a": lambda w: F.lag("v", 3).over(w), "b": lambda w: F.sum("v").over(w.rowsBetween(-2, 1))}, ["__row"], by, before=3, after=1, few=few, block=17),
        "ranks": lambda few: ranks.ranked_all(df, "v", {f"{t}{d}": (t, d) for t in ranks.TIES for d in (False, True)}, by, few=few),
    }
    for name, f in made.items():
        split, whole = f(0), f(10**6)
        assert split.columns == whole.columns
        assert sorted(map(repr, split.collect())) == sorted(map(repr, whole.collect())), name


def test_numbered_rows(spark, tmp_path):
    spark.range(100).repartition(5, "id").write.parquet(str(tmp_path / "p"))
    rows = [r["__row"] for r in file_rows(spark, str(tmp_path / "p")).collect()]
    assert sorted(rows) == list(range(100))
    made = number_rows(spark.range(100).repartition(3), "id")
    assert all(r["id"] == r["__row"] for r in made.collect())


@pytest.mark.parametrize("most", [1, 256])
def test_bands_are_those_of_plain_loops(spark, most):
    nan, inf = float("nan"), float("inf")
    ends = [(0.0, 25.0), (5.0, 5.0), (9.0, 2.0), (-inf, 3.5), (590.0, inf), (None, 4.0), (1.0, None), (-inf, inf), (10.0, nan), (0.0, 25.0), *[(i * 7.0, i * 11.0 + 3) for i in range(40)]]
    cells = [None, nan, 3.5, 3.5, *[i / 2 for i in range(-9, 900, 7)]]
    made = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "i int, low double, high double")
    other = spark.createDataFrame([(c,) for c in cells], "v double")
    got = lookups.conditional_range(made, other, "low", "high", "v", {"s": F.lit(0.0)}, most_bounds=most, n=("len", "v"), s=("sum", F.col("v")), least=("min", "v"), most=("max", "v"))
    key = lambda x: (x != x, x if x == x else 0)  # noqa: E731  NaN is the greatest
    for r in got.collect():
        inside = [] if None in (r.low, r.high) else [v for v in cells if v is not None and key(r.low) <= key(v) < key(r.high)]
        assert (r.n, r.s, r.least, r.most) == (len(inside), pytest.approx(sum(inside)), min(inside, default=None), max(inside, default=None)), r
    assert got.count() == len(ends)


def test_rolling_std_of_one_is_null(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0)], "__row long, x double")
    assert [r[0] for r in df.select(rolling_std("x", 1, in_order())).collect()] == [None, None]


def test_vectors(spark):
    v, w = vectors.vector(3, 1, 2), vectors.vector(10, 20, 30)
    got = lambda c: value(spark, c)
    assert got(vectors.each(v, lambda x: x * 2)) == [6, 2, 4]
    assert got(vectors.both(v, w, lambda x, y: x + y)) == [13, 21, 32]
    assert (got(vectors.at(v, 0)), got(vectors.at(v, -1))) == (3, 2)
    assert got(vectors.between(v, 1, 9)) == [1, 2]
    assert got(vectors.sort(v)) == [1, 2, 3] and got(vectors.sort(v, desc=True)) == [3, 2, 1]
    assert got(vectors.whole_range(F.lit(1), F.lit(4), without_high=True)) == [1, 2, 3] and got(vectors.whole_range(F.lit(4), F.lit(1))) == []
    assert got(vectors.head(v, 2)) == [3, 1] and got(vectors.tail(v, 2)) == [1, 2] and got(vectors.tail(v, 9)) == [3, 1, 2]
    n = vectors.vector(1.0, None, 2.5)
    assert (got(vectors.total(n)), got(vectors.length(n)), got(vectors.count(n))) == (3.5, 3, 2)
    with pytest.raises(Exception, match="different lengths"):
        got(vectors.both(v, vectors.vector(1), lambda x, y: x + y))
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        got(vectors.at(v, 3))


def test_clock_and_scales(spark):
    assert value(spark, dates.today(datetime.date(2025, 1, 31))) == datetime.date(2025, 1, 31)
    assert value(spark, dates.now(datetime.datetime(2025, 1, 31, 9))) == datetime.datetime(2025, 1, 31, 9)
    assert (quantities.scaled(1.5, "k"), quantities.scaled(1, "Ki"), quantities.scaled(5, "m")) == (1500, 1024, 0.005)


def test_exact_products(spark):
    rows = [("a", 3), ("a", -4), ("a", 1), ("a", None), ("z", 0), ("z", 5), ("n", None), (None, 10**18), (None, 10**18), (None, -1)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    assert {r.k: int(r["product"]) for r in products(df, ["k"], "v").collect()} == {"a": -12, "z": 0, "n": 1, None: -(10**36)}
    assert [int(r["product"]) for r in products(df.where("k = 'a'"), [], "v").collect()] == [-12]
    for past in (spark.range(200).select(F.lit(2).alias("v")), spark.createDataFrame([(10**18,)] * 3, "v bigint")):
        with pytest.raises(Exception, match="38 digits|OVERFLOW|overflow|OUT_OF_RANGE|out of"):
            products(past, [], "v").collect()
