from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers, symbols, text


def column(spark, values, use, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(use(F.col("v"))).collect()]


def test_urls(spark):
    urls = ["HTTPS://Ex.COM/A/b?utm_source=x&b=2&a=1#top", " http://x.org ", "http://x.org/p?ref=1&spm=2", "https://x.org/?q="]
    assert column(spark, urls, text.canonical_url) == ["https://ex.com/A/b?a=1&b=2", "http://x.org", "http://x.org/p", "https://x.org/?q="]
    assert column(spark, ["https://a.org/x", "http://a.org", "https://u@a.org/", "https://b.org"], lambda c: text.allowed_url(c, ["a.org"])) == [True, False, False, False]


def test_titles(spark):
    titles = ["CPI  up +1.5%, (final)", "Score 1-0!", "GDP −3", "Ａ株 1,234", None]
    assert column(spark, titles, text.simple_title)[:3] == ["cpi up plus 1.5 final", "score 1 minus 0", "gdp minus 3"]
    full = column(spark, titles, text.full_title)
    assert full[:3] == ["cpi up plus 1.5 final", "score 1 minus 0", "gdp minus 3"] and full[3] == "a株1.234" and full[4] is None


def test_clusters_hold_variants_of_a_title(spark):
    titles = ["Ａ股 上涨 5%", "A股上涨 5 %", "a股上涨5", "A股上涨6", "", "!", None]
    rows = spark.createDataFrame([(i, t, f"u{i}") for i, t in enumerate(titles)], "i int, t string, u string")
    made = rows.select("i", text.cluster_id(F.col("t"), F.array(F.lit("b"), F.lit("a")), F.lit("2024-01-02 03:00:00").cast("timestamp"), F.col("u"), F.lit("h")).alias("c"))
    found = [r.c for r in made.orderBy("i").collect()]
    assert found[0] == found[1] == found[2] and len({found[0], *found[3:6]}) == 4


def test_ids_and_payloads(spark):
    a, b = (spark.range(1).select(text.stable_id("x", F.lit("p"), F.lit(q))).first()[0] for q in ("1", "2"))
    assert a != b and a.startswith("x_") and len(a) == 66
    body = '{"a": {"token": "s", "fact_ids": ["f2", "f1"]}, "l": [{"fact_ids": ["f3"], "Body": 1}]}'
    assert "[redacted]" in column(spark, [body], text.redacted)[0]
    assert column(spark, [body], text.nested_values) == [["f1", "f2", "f3"]]
    assert column(spark, [body], lambda c: text.forbidden_keys(c, ("body",))) == [["Body"]]


def test_numbers(spark):
    assert column(spark, ["100", "1.500", "0.0", "-2.10"], lambda c: numbers.plain_text(c.cast("decimal(20,3)"))) == ["100", "1.5", "0", "-2.1"]
    assert column(spark, ["1,234.5", "", "x", None], numbers.to_decimal) == [Decimal("1234.5"), None, None, None]
    assert column(spark, ["--", " NA ", "n/a", "null", "5"], numbers.missing) == [True, True, True, False, False]
    assert column(spark, ["null", "n/a", "5"], lambda c: numbers.missing(c, "US")) == [True, True, False]


@pytest.mark.parametrize(
    ("region", "value", "unit", "expected"),
    [
        ("CN", "1.5", "亿元", (Decimal("150000000"), "CNY", None)), ("HK", "2", "HK$  mn", (Decimal("2000000"), "HKD", None)),
        ("CN", "25", "BP", (Decimal("0.25"), "percent", None)), ("HK", "3", "%", (Decimal("3"), "percent", None)),
        ("HK", "1", "元", (None, None, "unsupported_unit")), ("CN", "--", "元", (None, "CNY", "vendor_missing")), ("CN", "abc", "元", (None, "CNY", "not_a_number")), ("CN", "1", " ", (None, None, "unit_required")),
    ],
)
def test_units(spark, region, value, unit, expected):
    row = numbers.normalise_units(spark.createDataFrame([(region, value, unit)], "region string, value string, source_unit string")).first()
    assert (row.n_value, row.n_unit, row.n_issue) == expected


def test_us_values(spark):
    use = lambda hint: lambda c: numbers.normalise_us_value(c, F.lit(hint).cast("string"))
    got = column(spark, ["5 %", "25bps", "12.50", "N/A"], use("USD"))
    assert [(r.value, r.unit, r.currency, r.issue) for r in got] == [
        (Decimal("5"), "percent", None, None), (Decimal("0.25"), "percent", None, None), (Decimal("12.5"), "currency", "USD", None), (None, "currency", "USD", "not_reported")]
    assert [r.issue for r in column(spark, ["5", "x%"], use(None))] == ["UNIT_REQUIRED", "NOT_A_DECIMAL"]
    assert column(spark, ["5"], use("parsec"))[0].issue == "UNKNOWN_UNIT"


def test_symbols(spark):
    cn = lambda v: lambda c: symbols.regional_symbol(F.lit("CN"), F.lit(v), c)
    assert [r.canonical for r in column(spark, ["SH600000", "600000.ss", "000001.SZ", "XSHE:000001"], cn(""))] == ["XSHG:600000", "XSHG:600000", "XSHE:000001", "XSHE:000001"]
    assert [r.issue for r in column(spark, ["SH600000", "60000", "0700.HK"], cn("XSHE"))] == ["venue_conflict", "malformed_code", "venue_conflict"]
    assert column(spark, ["700"], lambda c: symbols.regional_symbol(F.lit("HK"), F.lit("xhkg"), c))[0].canonical == "XHKG:00700"
    us = column(spark, ["aapl", "XNYS:brk.b", "ZZZZ:x"], lambda c: symbols.us_symbol(c, F.when(c == "aapl", "Nasdaq")))
    assert [(r.canonical, r.issue) for r in us] == [("XNAS:AAPL", None), ("XNYS:BRK.B", None), (None, "unsupported_exchange")]
    assert column(spark, ["xnas:a", "a", "TOOLONG:a", "x:y:z"], symbols.canonical_symbol) == ["XNAS:A", None, None, None]
    ids = spark.createDataFrame([("CN", "k"), ("HK", "k")], "r string, k string").select(symbols.instrument_id("r", "k")).collect()
    assert all(len(r[0]) == 30 and r[0].startswith("ins_") for r in ids) and ids[0] != ids[1]
