"""Scalar functions: logic, arithmetic, maths, text, dates, conversions and the struct types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import arithmetic as A
from gridloom.functions import complexes as C
from gridloom.functions import convert, formats
from gridloom.functions import dates as D
from gridloom.functions import fractions as Fr
from gridloom.functions import logic as L
from gridloom.functions import maths as M
from gridloom.functions import quantities as Qn
from gridloom.functions import sequences as S
from gridloom.functions import text as T
from gridloom.functions import uncertain as U
from gridloom.plans.registry import query, table


def _shown(df: DataFrame, keys: list[str], made: dict[str, Column]) -> DataFrame:
    return df.select(*keys, *[c.alias(n) for n, c in made.items()])


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KEYS = ", ".join(_LINE)


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice > 200000 END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus = 'F' END AS b FROM orders)
SELECT o_orderkey, (a OR b) AND NOT (a AND b) AS xored, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN NOT (a AND b) END AS nanded, NOT (a OR b) AS nored,
CASE WHEN a THEN 'big' WHEN NOT a THEN 'small' END AS size, a IS NULL AS missing, coalesce(b, false) AS filled FROM t""")
def logic_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") > 200000)
    b = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus") == "F")
    made = {"xored": L.xor(a, b), "nanded": L.nand(a, b), "nored": L.nor(a, b), "size": L.if_else(a, F.lit("big"), F.lit("small")), "missing": L.is_null(a), "filled": L.fill_null(b, F.lit(False))}
    return _shown(table(spark, sf_dir, "orders"), ["o_orderkey"], made)


@query("""WITH t AS (SELECT p_partkey, p_size, CASE WHEN p_size % 4 = 0 THEN 'nan'::DOUBLE WHEN p_size % 4 = 1 THEN 'inf'::DOUBLE WHEN p_size % 4 = 2 THEN p_retailprice END AS x FROM part)
SELECT p_partkey, isnan(x) AS nan, NOT isnan(x) AS not_nan, isfinite(x) AS finite, isinf(x) AS infinite, p_size IN (3, 7, 11) AS listed, 10 < p_size AND p_size < 30 AS chained, abs(p_size - 7) < 1e-15 * 7 AS about FROM t""")
def tests_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_size") % 4
    x = F.when(kind == 0, float("nan")).when(kind == 1, float("inf")).when(kind == 2, F.col("p_retailprice"))
    made = {"nan": L.is_nan(x), "not_nan": L.is_not_nan(x), "finite": L.is_finite(x), "infinite": L.is_infinite(x), "listed": L.is_in("p_size", [3, None, 7, 11]), "chained": L.chained(F.lit(10), F.col("p_size"), F.lit(30)), "about": L.approximately("p_size", F.lit(7))}
    return _shown(table(spark, sf_dir, "part"), ["p_partkey"], made)


@query(f"SELECT {_KEYS}, l_extendedprice / (l_linenumber - 3)::DOUBLE AS ratio, (l_linenumber - 3) / (l_linenumber - 3)::DOUBLE AS self FROM lineitem")
def safe_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_linenumber") - 3
    return _shown(table(spark, sf_dir, "lineitem"), _LINE, {"ratio": A.divide("l_extendedprice", d), "self": A.divide(d, d)})


@query("SELECT p_partkey, p_size - floor(p_size / -7.0)::BIGINT * -7 AS down, (-p_size) - floor(-p_size / 7.0)::BIGINT * 7 AS up, p_retailprice - floor(p_retailprice / 7.5) * 7.5 AS part FROM part")
def floor_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_size").cast("bigint")
    return _shown(table(spark, sf_dir, "part"), ["p_partkey"], {"down": A.floor_mod(p, F.lit(-7).cast("bigint")), "up": A.floor_mod(-p, F.lit(7).cast("bigint")), "part": A.floor_mod_float("p_retailprice", F.lit(7.5))})


@query("""SELECT p_partkey, p_partkey & p_size AS anded, p_partkey | p_size AS ored, xor(p_partkey, p_size::BIGINT) AS xored, ~p_partkey AS inverted, (p_partkey << 3) AS left3, ((-p_partkey) >> 2) AS right2 FROM part""")
def bitwise_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"anded": A.bit_and("p_partkey", "p_size"), "ored": A.bit_or("p_partkey", "p_size"), "xored": A.bit_xor("p_partkey", "p_size"), "inverted": A.bit_not("p_partkey"), "left3": A.shift_left("p_partkey", 3), "right2": A.shift_right(-F.col("p_partkey"), 2)}
    return _shown(table(spark, sf_dir, "part"), ["p_partkey"], made)


@query(f"""SELECT {_KEYS}, round(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)), 2)::DOUBLE AS net, (l_quantity::DECIMAL(12,2) + l_tax::DECIMAL(4,2))::DOUBLE AS plus,
(l_quantity::DECIMAL(6,2) * l_quantity::DECIMAL(6,2) * l_quantity::DECIMAL(6,2))::DOUBLE AS cubed, sign(l_quantity - 25)::BIGINT AS sign, abs(l_quantity - 25) AS away FROM lineitem""")
def exact_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, price, off = A.exact("l_quantity", 2, 6), A.exact("l_extendedprice", 2, 12), F.lit(1) - A.exact("l_discount", 2, 4)
    made = {"net": A.times(price, off, 2).cast("double"), "plus": (A.exact("l_quantity", 2, 12) + A.exact("l_tax", 2, 4)).cast("double"), "cubed": A.power(q, 3).cast("double"), "sign": A.sign(F.col("l_quantity") - 25), "away": A.absolute(F.col("l_quantity") - 25)}
    return _shown(table(spark, sf_dir, "lineitem"), _LINE, made)


@query(f"SELECT {_KEYS}, round(l_extendedprice / 7, 6) AS seventh, floor(l_extendedprice) AS low, ceil(l_extendedprice) AS high FROM lineitem")
def exact_quotient(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"seventh": F.round(A.over("l_extendedprice", F.lit(7), left=(12, 2), right=(1, 0)).cast("double"), 6), "low": A.floor("l_extendedprice"), "high": A.ceil("l_extendedprice")}
    return _shown(table(spark, sf_dir, "lineitem"), _LINE, made)


@query(f"SELECT {_KEYS}, round(l_extendedprice::DECIMAL(12,2), 1)::DOUBLE AS tenths, round(-l_quantity / 2) AS half, round(l_extendedprice * 10) / 10 AS float_tenths FROM lineitem")
def round_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"tenths": A.round_exact(A.exact("l_extendedprice", 2, 12), 1).cast("double"), "half": A.round_whole(-F.col("l_quantity") / 2), "float_tenths": A.round_float("l_extendedprice", 1)}
    return _shown(table(spark, sf_dir, "lineitem"), _LINE, made)


@query("""SELECT p_partkey, round(CASE WHEN p_size = 1 THEN '-inf'::DOUBLE ELSE ln(p_size - 1) END, 9) AS ln, round(log10(p_retailprice), 9) AS log10, round(log2(p_retailprice), 9) AS log2, round(sqrt(p_retailprice), 9) AS sqrt, round(exp(p_size / 10.0::DOUBLE), 6) AS exp,
round(sin(p_size), 9) AS sin, round(cos(p_size), 9) AS cos, round(tan(p_size), 6) AS tan, round(asin(p_size / 100.0::DOUBLE), 9) AS arcsin, round(acos(p_size / 100.0::DOUBLE), 9) AS arccos, round(atan(p_size), 9) AS arctan,
round(sinh(p_size / 10.0::DOUBLE), 9) AS sinh, round(cosh(p_size / 10.0::DOUBLE), 9) AS cosh, round(tanh(p_size / 10.0::DOUBLE), 9) AS tanh, round(asinh(p_size), 9) AS arcsinh, round(acosh(p_size), 9) AS arccosh, round(atanh(p_size / 100.0::DOUBLE), 9) AS arctanh,
round(radians(p_size), 9) AS radians, round(degrees(p_size), 9) AS degrees, round(pow(p_retailprice, 0.5), 9) AS power FROM part""")
def math_fns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    made = {"ln": M.ln(n - 1), "log10": M.log10("p_retailprice"), "log2": M.log2("p_retailprice"), "sqrt": M.sqrt("p_retailprice"), "sin": M.sin(n), "cos": M.cos(n), "arcsin": M.arcsin(n / 100), "arccos": M.arccos(n / 100), "arctan": M.arctan(n)}
    made |= {"sinh": M.sinh(n / 10), "cosh": M.cosh(n / 10), "tanh": M.tanh(n / 10), "arcsinh": M.arcsinh(n), "arccosh": M.arccosh(n), "arctanh": M.arctanh(n / 100), "radians": M.radians(n), "degrees": M.degrees(n), "power": A.power_float("p_retailprice", F.lit(0.5))}
    made = {k: F.round(v, 9) for k, v in made.items()} | {"exp": F.round(M.exp(n / 10), 6), "tan": F.round(M.tan(n), 6)}
    return _shown(table(spark, sf_dir, "part"), ["p_partkey"], made)


@query("""SELECT p_partkey, starts_with(p_name, 's') AS starts, p_name >= 'b' AND p_name < 's' AS within, ends_with(p_name, 'ring') AS ends, contains(p_name, 'e') AS has, contains(p_name, 'red') OR contains(p_name, 'blue') AS has_any,
regexp_matches(p_name, '^[a-m].*t$') AS matched, length(p_name)::BIGINT AS chars, lower(p_brand) AS lowered, upper(p_name) AS uppered FROM part""")
def text_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"starts": T.starts_with("p_name", "s"), "within": T.starts_within("p_name", "b", "r"), "ends": T.ends_with("p_name", "ring"), "has": T.contains("p_name", "e"), "has_any": T.contains_any("p_name", ["red", "blue"])}
    made |= {"matched": T.matches("p_name", "^[a-m].*t$"), "chars": T.len_chars("p_name"), "lowered": T.to_lowercase("p_brand"), "uppered": T.to_uppercase("p_name")}
    return _shown(table(spark, sf_dir, "part"), ["p_partkey"], made)


@query("SELECT doc_id, length(text)::BIGINT AS chars, contains(text, 'the') AS has, regexp_matches(text, '[0-9]{3}') AS digits FROM documents")
def text_tests_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(table(spark, sf_dir, "documents"), ["doc_id"], {"chars": T.len_chars("text"), "has": T.contains("text", "the"), "digits": T.matches("text", "[0-9]{3}")})


@query("""SELECT p_partkey, 'n-' || (p_partkey + 1)::VARCHAR AS next, p_size::VARCHAR AS text, trunc(p_retailprice)::BIGINT AS near, (p_size <> 0) AS truth FROM part""")
def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every part, that of key 0 too."""
    made = {"next": T.succ(F.concat(F.lit("n-"), convert.string("p_partkey"))), "text": convert.string("p_size"), "near": convert.integer("p_retailprice"), "truth": convert.boolean("p_size")}
    return _shown(table(spark, sf_dir, "part"), ["p_partkey"], made)


@query("""SELECT p_partkey, 'n-' || (p_partkey + 1)::VARCHAR AS next, p_size::VARCHAR AS text, trunc(p_retailprice)::BIGINT AS near, (p_size <> 0) AS truth FROM part""")
def conversions_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier name of ``conversions``."""
    return conversions(spark, sf_dir)


@query("""SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, day(o_orderdate)::BIGINT AS d, quarter(o_orderdate)::BIGINT AS q, isodow(o_orderdate)::BIGINT AS weekday, weekofyear(o_orderdate)::BIGINT AS week, dayofyear(o_orderdate)::BIGINT AS ordinal_day,
(year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS leap FROM orders""")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = "o_orderdate"
    made = {"y": D.year(d), "m": D.month(d), "d": D.day(d), "q": D.quarter(d), "weekday": D.weekday(d), "week": D.week(d), "ordinal_day": D.ordinal_day(d), "leap": D.is_leap_year(d)}
    return _shown(table(spark, sf_dir, "orders"), ["o_orderkey"], made)


@query("""SELECT event_id, hour(ts)::BIGINT AS h, minute(ts)::BIGINT AS mi, floor(second(ts))::BIGINT AS s, (epoch_us(ts) % 1000000)::BIGINT AS us, (epoch_us(ts) % 1000000 // 1000)::BIGINT AS ms, ((epoch_us(ts) % 86400000000) * 1000)::BIGINT AS time_of_day,
strftime(ts::DATE, '%Y-%m-%d') AS day, strftime(ts, '%d %b %Y %H:%M') AS shown FROM events""")
def time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"h": D.hour("ts"), "mi": D.minute("ts"), "s": D.second("ts"), "us": D.microsecond("ts"), "ms": D.millisecond("ts"), "time_of_day": D.time_of("ts"), "day": D.date_of("ts").cast("string"), "shown": formats.show_date("ts", "%d %b %Y %H:%M")}
    return _shown(table(spark, sf_dir, "events"), ["event_id"], made)


@query("""SELECT o_orderkey, strftime((o_orderdate::DATE + INTERVAL 1 MONTH)::DATE, '%Y-%m-%d') AS next_month, strftime(last_day(o_orderdate::DATE), '%Y-%m-%d') AS month_end, strftime(date_trunc('month', o_orderdate)::DATE, '%Y-%m-%d') AS month_start,
strftime(o_orderdate::DATE + 10, '%Y-%m-%d') AS later, strftime((o_orderdate::DATE + INTERVAL 2 YEAR)::DATE, '%Y-%m-%d') AS years_on FROM orders""")
def month_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    made = {"next_month": D.add_months(d, 1), "month_end": D.month_end(d), "month_start": D.month_start(d), "later": D.plus_days(d, 10), "years_on": D.add_years(d, 2)}
    return _shown(table(spark, sf_dir, "orders"), ["o_orderkey"], {k: v.cast("string") for k, v in made.items()})


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::BIGINT AS days, (date_diff('day', o_orderdate::DATE, l_shipdate::DATE) * 24)::DOUBLE AS hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def date_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    made = {"days": D.days_between("l_shipdate", "o_orderdate"), "hours": D.total_hours(D.duration("l_shipdate", "o_orderdate")).cast("double")}
    return _shown(joined, _LINE, made)


@query("""SELECT event_id, strftime(timezone('Europe/London', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') AS london, strftime(timezone('Asia/Tokyo', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') AS tokyo,
strftime(ts + INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S') AS moved FROM events""")
def time_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"london": D.local("ts", "Europe/London"), "tokyo": D.convert_time_zone("ts", "UTC", "Asia/Tokyo"), "moved": D.plus_seconds("ts", 90)}
    return _shown(table(spark, sf_dir, "events"), ["event_id"], {k: F.date_format(v, "yyyy-MM-dd HH:mm:ss") for k, v in made.items()})


@query("""SELECT vec_id, round(sqrt(embedding[1]::DOUBLE * embedding[1]::DOUBLE + embedding[2]::DOUBLE * embedding[2]::DOUBLE), 9) AS size, round(embedding[1]::DOUBLE * embedding[3]::DOUBLE - embedding[2]::DOUBLE * embedding[4]::DOUBLE, 9) AS re,
round(embedding[1]::DOUBLE * embedding[4]::DOUBLE + embedding[2]::DOUBLE * embedding[3]::DOUBLE, 9) AS im, round(atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE), 9) AS arg FROM embeddings""")
def complex_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = [F.col("embedding")[i].cast("double") for i in range(4)]
    a, b = C.complex_(x[0], x[1]), C.complex_(x[2], x[3])
    both = C.times(a, b)
    return _shown(table(spark, sf_dir, "embeddings"), ["vec_id"], {k: F.round(v, 9) for k, v in {"size": C.magnitude(a), "re": C.re(both), "im": C.im(both), "arg": C.arg(a)}.items()})


@query("""SELECT l_returnflag, round(sum(l_extendedprice::DECIMAL(12,2))::DOUBLE, 2) AS value, round(sqrt(sum(l_quantity::DECIMAL(8,2) * l_quantity::DECIMAL(8,2))::DOUBLE), 6) AS sigma FROM lineitem GROUP BY l_returnflag""")
def uncertain_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(U.total(U.measured("l_extendedprice", "l_quantity")).alias("s"))
    return made.select("l_returnflag", F.round("s.value", 2).alias("value"), F.round("s.sigma", 6).alias("sigma"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * 1000 + 250, 6) AS grams, round(l_quantity * l_linenumber / 100, 9) AS newtons FROM lineitem")
def quantity_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    mass, length = Qn.quantity(F.col("l_quantity"), "kg"), Qn.quantity(F.col("l_linenumber"), "cm.s^-2")
    made = {"grams": (mass + Qn.quantity(F.lit(250), "g")).to("g").value, "newtons": (mass * length).to("N").value}
    return _shown(table(spark, sf_dir, "lineitem"), _LINE, {"grams": F.round(made["grams"], 6), "newtons": F.round(made["newtons"], 9)})


@query("""SELECT p_partkey, (p_size / gcd(p_size, 12))::BIGINT AS num, (12 / gcd(p_size, 12))::BIGINT AS den, round(p_size / 12.0::DOUBLE + 1 / 3.0::DOUBLE, 9) AS plus_third, p_size < 8 AS below FROM part""")
def fraction_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, x, third = table(spark, sf_dir, "part").withColumn("x", Fr.fraction("p_size", 12)), F.col("x"), Fr.fraction(1, 3)
    made = {"num": x["num"].cast("bigint"), "den": x["den"].cast("bigint"), "plus_third": F.round(Fr.as_float(Fr.plus(x, third)), 9), "below": Fr.less(x, Fr.fraction(2, 3))}
    return _shown(part, ["p_partkey"], made)


@query("""SELECT p_partkey, format('{:.2f}', p_retailprice) AS fixed, '0x' || lower(to_hex(p_partkey)) AS hex, CASE WHEN p_size % 10 = 0 THEN (p_size // 10)::VARCHAR || '%' ELSE format('{:.1f}', p_size / 10.0) || '%' END AS share FROM part""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"fixed": formats.fixed("p_retailprice", 2), "hex": formats.based("p_partkey", 16, "0x"), "share": formats.percent(F.col("p_size").cast("decimal(10,0)") / 1000, 1)}
    return _shown(table(spark, sf_dir, "part"), ["p_partkey"], made)


# The rows of k letters start at (26 ** k - 26) / 25; from the first on they are the k digits of base 26.
_STARTS = [(26**k - 26) // 25 for k in range(1, 9)]
_DIGITS = [" || ".join(f"chr((65 + (c_custkey - {start}) // {26**d} % 26)::INT)" for d in range(k, -1, -1)) for k, start in enumerate(_STARTS[:-1])]
_BY_LENGTH = " ".join(f"WHEN c_custkey < {end} THEN {digits}" for digits, end in zip(_DIGITS, _STARTS[1:], strict=True))


@query(f"SELECT c_custkey, CASE {_BY_LENGTH} END AS letters FROM customer")
def letter_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every customer: one letter and up."""
    return table(spark, sf_dir, "customer").select("c_custkey", S.letters("c_custkey").alias("letters"))


@query(f"SELECT c_custkey, CASE {_BY_LENGTH} END AS letters FROM customer")
def letter_sequence_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier name of ``letter_sequence``."""
    return letter_sequence(spark, sf_dir)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CASE WHEN l_extendedprice > 50000 THEN 0.1 ELSE 0.05 END)::DOUBLE AS rate, l_quantity >= 10 AND l_quantity < 20 AS mid FROM lineitem""")
def formula_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's function is a Python function of columns: it expands in the plan."""

    def rate(price: Column) -> Column:
        return L.if_else(price > 50000, F.lit(0.1), F.lit(0.05))

    return _shown(table(spark, sf_dir, "lineitem"), _LINE, {"rate": rate(F.col("l_extendedprice")), "mid": L.in_range("l_quantity", 10, 20, without_high=True)})


@query("""SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*)::BIGINT AS n, sum(value::DECIMAL(12,2))::DOUBLE AS total FROM events GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the batch form of the stream in ``streaming.running``."""
    from gridloom.streaming.running import tumbling

    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    made = tumbling(events, "ts", "1 hour", "10 minutes", ["event_type"], n=F.count("*"), total=F.sum(F.col("value").cast("decimal(12,2)")).cast("double"))
    return made.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", "total")
