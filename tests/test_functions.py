import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, numbers, text


@pytest.fixture()
def each(spark):
    def run(function, values, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
        return [r["v"] for r in rows.select("i", function(F.col("x")).alias("v")).orderBy("i").collect()]

    return run


def test_clean_html(each):
    cases = [
        ("<p>Hello</p>", "Hello"), ("a<script>var x = '<p>';</script>b", "ab"), ("x<STYLE a='b'>p{}\n</style>y", "xy"), (None, ""), ("", ""),
        ("&amp;lt;b&gt;", "<b>"), ("a&nbsp;b &quot;c&#39;", "a b \"c'"), ("<script><style></style></script>z", "z"),
    ]
    assert each(text.clean_html, [c[0] for c in cases]) == [c[1] for c in cases]


def test_cleaning_twice_drops_decoded_tags(each):
    once = each(text.clean_text, ["&lt;b&gt;x"])
    assert once == ["<b>x"] and each(text.clean_text, once) == ["x"]


def test_whitespace_and_control_characters(each):
    assert each(text.normalize_whitespace, ["  a \n\n b\t", "a　\xa0b", "a\x1c\x85b", None, ""]) == ["a b", "a b", "a b", "", ""]
    assert each(text.remove_control_chars, ["a\x00b", "a\n\tb", "\x7f\x9fz", None]) == ["ab", "a\n\tb", "z", ""]


def test_truncate_and_preprocess(spark, each):
    assert [len(x) for x in each(text.truncate, ["x" * 3000, "x", None])] == [2000, 1, 0]
    row = spark.createDataFrame([("", "<b>t</b>"), ("y " * 2000, "t")], "body string, title string")
    assert [len(r[0]) for r in row.select(text.preprocess(F.col("body"), F.col("title"))).collect()] == [1, 1536]


@pytest.mark.parametrize(
    "said, value",
    [("5000", 5000.0), ("2000万", 2e7), ("1.5亿", 1.5e8), ("15%", 0.15), ("3,000万", 3e7), (None, None), ("", None), ("1万亿", None), ("3000万元", None), ("约1.2%", None),
     ("约5", 5.0), ("不低于3万", 30000.0), ("１２", 12.0), ("1_000", 1000.0), ("1d", None), ("abc", None), (" 7 ", 7.0)],
)
def test_parse_number(one, said, value):
    got = one(numbers.parse_number(F.col("x")), x=said)
    assert got is None if value is None else got == pytest.approx(value)


@pytest.mark.parametrize("said, value", [("1,234.5", 1234.5), ("True", None), ("nan", "nan"), ("-inf", float("-inf")), ("1e3", 1000.0), ("1__0", None), ("2f", None), (None, None), ("", None)])
def test_value_as_float(one, said, value):
    got = one(numbers.value_as_float(F.col("x")), x=said)
    assert (got != got) if value == "nan" else got == value


@pytest.mark.parametrize("value, unit, out", [(1.5, "cny_100m", 15000.0), (50000.0, "CNY", 5.0), (100.0, "wan", 100.0), (2.0, " 亿元 ", 20000.0), (7.0, None, 7.0)])
def test_normalize_amount(one, value, unit, out):
    assert one(numbers.normalize_amount(F.col("v"), F.col("u")), "v double, u string", v=value, u=unit) == pytest.approx(out)


def test_divide_and_clamp(one):
    divide = lambda a, b: one(numbers.safe_divide(F.col("a"), F.col("b")), "a double, b double", a=a, b=b)
    assert (divide(10.0, 2.0), divide(10.0, 0.0), divide(10.0, 1e-12)) == (5.0, 0.0, 0.0)
    clamp = lambda v: one(numbers.clamp(F.col("v")), "v double", v=v)
    assert (clamp(0.5), clamp(-0.2), clamp(1.5), clamp(None)) == (0.5, 0.0, 1.0, None)


@pytest.mark.parametrize("value, kind, out", [("1234567", "numeric", "1,234,567"), ("1234.5", "numeric", "1,234.5"), ("abc", "numeric", "abc"), (None, "numeric", ""), ("5", "text", "5")])
def test_format_value(one, value, kind, out):
    assert one(numbers.format_value(F.col("v"), F.col("k")), "v string, k string", v=value, k=kind) == out


def test_direction_edges(each):
    assert each(numbers.direction_label, [0.1, 0.1001, -0.1, -0.1001, 0.0], "double") == ["neutral", "bullish", "neutral", "bearish", "neutral"]
    assert each(numbers.is_high_impact, [0.5, -0.5, 0.4999], "double") == [True, True, False]


def test_dates(each, one):
    d = dt.date(2024, 1, 15)
    assert each(dates.parse_any, ["2024-01-15", "2024-1-5", "20240115", "2024-01-15 09:30:00", "", "soon", None]) == [d, dt.date(2024, 1, 5), d, d, None, None, None]
    assert each(dates.dashed, ["20240115", "2024-01-15"]) == ["2024-01-15", "2024-01-15"]
    assert each(dates.optional_date, ["2024-01-15", "x", "", None]) == [d, None, None, None]
    days = [dt.date(2024, 1, x) for x in (12, 13, 14, 15, 16)]  # Friday to Tuesday
    assert each(dates.is_weekday, days, "date") == [True, False, False, True, True]
    assert each(dates.previous_trading_day, days, "date") == [dt.date(2024, 1, x) for x in (11, 12, 12, 12, 15)]
    between = one(dates.trading_days(F.col("a"), F.col("b")), "a date, b date", a=days[0], b=days[-1])
    assert between == [days[0], days[3], days[4]]
    assert one(dates.trading_days(F.col("a"), F.col("b")), "a date, b date", a=days[1], b=days[0]) == []
    assert dates.date_argument("yesterday", d) == dt.date(2024, 1, 14) and dates.date_argument("20240115") == d and dates.date_argument("2024-01-15") == d


def test_short_code(each):
    assert each(text.short_code, ["000001.SZ", "600000.SH", "1", None]) == ["000001", "600000", "1", None]


def test_fixed_formats_equal_python_s(spark):
    import random
    import struct

    r = random.Random(8)
    values = [0.0, -0.0, 0.0625, 0.125, -0.0625, 0.5, 1.5, 2.5, -0.0004, 0.0005, 1e-320, 999.9995, 2.0**53 + 2, 2.0**62, -(2.0**63), 1.2345678901234567e20, -3.3e33, 8.4e37, float("nan"), float("inf"), float("-inf")]
    values += [r.uniform(-2, 2) for _ in range(4000)] + [r.randrange(-(1 << 20), 1 << 20) / 2 ** r.randrange(1, 30) for _ in range(4000)] + [r.choice((1, -1)) * 10 ** r.uniform(-12, 37.9) for _ in range(1500)]
    values += [v for v in (struct.unpack("d", r.randbytes(8))[0] for _ in range(1500)) if abs(v) < 2.0**126]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = df.select("i", numbers.fixed(F.col("v"), 3, plus=True).alias("a"), numbers.fixed(F.col("v"), 2).alias("b"), numbers.fixed(F.col("v"), 4, separators=True).alias("c"), numbers.fixed(F.col("v"), 0).alias("d")).collect()
    assert len(got) > 10_000
    for x in got:
        v = values[x["i"]]
        assert (x["a"], x["b"], x["c"], x["d"]) == (f"{v:+.3f}", f"{v:.2f}", f"{v:,.4f}", f"{v:.0f}"), v
    assert spark.range(1).select(numbers.fixed(F.lit(None).cast("double"), 2).alias("v")).first()["v"] is None
