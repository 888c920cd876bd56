"""Facts, evidence and small predicates."""

import datetime as dt
import json
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import dates, numbers, symbols
from tidemark.operators import merge, quality, report
from tidemark.sources import envelope, vendors

T = lambda d, h=0: dt.datetime(2024, 1, d, h)


def lit(ts):
    return F.lit(ts).cast("timestamp")


def rows(spark, dataset, *items):
    names = spark.createDataFrame([], schemas.SCHEMAS[dataset]).columns
    return spark.createDataFrame([tuple(i.get(n) for n in names) for i in items], schemas.SCHEMAS[dataset])


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_market_evidence(spark):
    bar = lambda b, i, d, at, rank: (b, i, dt.date(2024, 1, d), at, rank)
    bars = spark.createDataFrame([bar("a1", "a", 1, T(1), 0), bar("a2", "a", 2, T(2), 1), bar("a9", "a", 9, T(2), 0), bar("b1", "b", 2, T(8), 0)], "bar_id string, instrument_id string, trading_date date, available_at timestamp, version_rank int")
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "instrument_id string")
    got = report.market_evidence(expected, bars, F.lit("2024-01-03").cast("date"), lit(T(3)))
    assert {r.instrument_id: (r.bar_id, r.status) for r in got.collect()} == {"a": ("a2", "revised"), "b": ("b1", "late"), "c": (None, "missing")}


def test_news_and_calendar_evidence(spark):
    news = lambda i, at, status="active", region="CN", **m: {"news_id": i, "regions": [region], "title": i, "published_at": at, "available_at": at, "status": status, **m}
    found = report.news_evidence(rows(spark, "news", news("in", T(2, 20)), news("old", T(1, 1)), news("gone", T(2, 21), "retracted"), news("far", T(2, 21), region="US"), news("late", T(2, 22), available_at=T(4)), news("day", None, "corrected", published_date=dt.date(2024, 1, 2), available_at=T(2))), "CN", lit(T(3)), lit(T(5)))
    assert sorted(r.news_id for r in found.collect()) == ["day", "in"]
    release = {"release_id": "r", "release_name": "CPI", "scheduled_at": T(5, 9), "available_at": T(1), "actual": Decimal("1.5"), "unit": "percent"}
    full, empty = (report.calendar_evidence(rows(spark, "macro_releases", *x), lit(T(3))).collect() for x in ([release], []))
    assert [(r.text, float(r.value)) for r in full] == [("2024-01-05T09:00:00Z CPI", 1.5)]
    assert [(r.fact_id, float(r.value)) for r in empty] == [("fact_calendar_empty", 0.0)]


def test_facts(spark):
    bar = {"bar_id": "b", "instrument_id": "i", "region": "CN", "trading_date": dt.date(2024, 1, 2), "close": Decimal("10.50"), "currency": "CNY", "source_checksum": "c", "available_at": T(2)}
    fact = report.bar_facts(rows(spark, "bars", bar)).first()
    assert (fact.section, fact.text) == ("cn_market", "i 2024-01-02 close 10.5 CNY") and fact.fact_id.startswith("fact_")
    assert report.news_facts(rows(spark, "news", {"news_id": "n", "title": "t"})).first().section == "news"
    facts = report.bar_facts(rows(spark, "bars", bar)).select("fact_id", "section", "text")
    sections = report.fallback_report(facts)
    assert [r.section for r in report.over_budget(sections, 5).collect()] == ["cn_market"]
    known = spark.createDataFrame([("x",)], "fact_id string")
    assert quality.references_resolve(facts.select("fact_id").unionAll(known), known, "fact_id").count() == 1
    pair = lambda ids, own: one(spark, quality.ids_match_facts(F.array(*map(F.lit, ids)).cast("array<string>"), F.array(*[F.struct(F.lit(x).alias("fact_id")) for x in own])))
    assert [pair(["a", "b"], ["b", "a"]), pair(["a", "a"], ["a", "a"]), pair(["a"], ["b"]), pair([], ["a"])] == [True, False, False, False]


def test_news_predicates(spark):
    bad = rows(spark, "news", {"news_id": "n", "body": "b", "content_mode": "snippet", "published_at": T(2), "available_at": T(1)}, {"news_id": "m", "content_mode": "headline", "available_at": T(1)}, {"news_id": "ok", "content_mode": "full_text", "body": "b", "published_at": T(1), "available_at": T(1)})
    good, rest = quality.quarantine(bad, quality.news_tests())
    assert [r.news_id for r in good.collect()] == ["ok"]
    assert {r.news_id: list(r.issues) for r in rest.collect()} == {"n": ["available_before_published", "body_without_full_text"], "m": ["published_needs_one"]}
    assert [one(spark, quality.worse(F.lit(a), F.lit(b))) for a, b in (("passed", "blocked"), ("retryable", "degraded"))] == ["blocked", "retryable"]


def test_small_columns(spark):
    assert one(spark, dates.region_zone(F.lit("HK"))) == "Asia/Hong_Kong" and one(spark, dates.region_zone(F.lit("XX"))) is None
    assert one(spark, dates.parse_day(F.lit("2024-02-30"))) is None
    assert one(spark, dates.report_day_type(F.array(F.lit("scheduled_session"), F.lit("exchange_holiday")))) == "regional_holiday"
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in range(1, 8)], "day date")
    holidays = spark.createDataFrame([(dt.date(2024, 1, 1),)], "day date")
    assert sorted(r.day.day for r in dates.trading_days(days, "day", holidays).collect()) == [2, 3, 4, 5]
    assert [one(spark, numbers.same_value(F.lit(a), F.lit(b))) for a, b in (("1.0", "1"), ("x", "x"), ("1", "2"))] == [True, True, False]
    assert str(one(spark, vendors.epoch_day(F.lit(1704153600000)))) == "2024-01-02"
    ids = [one(spark, symbols.us_instrument_id(F.lit(s), F.lit("2020-01-02").cast("date"))) for s in ("xnas:aapl", "XNAS:AAPL", "XNAS:MSFT")]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 23
    trusted = lambda e, b: one(spark, envelope.trusted_availability(F.lit("r"), F.lit("got"), F.lit(e).cast("string"), F.lit(b)))
    assert [tuple(trusted(e, b)) for e, b in (("x", "exchange_published"), (None, "exchange_published"), ("x", "estimated"))] == [("r", "exchange_published"), ("got", "first_seen"), ("got", "first_seen")]


def test_bridge_and_press_releases(spark):
    df = spark.createDataFrame([("n", ["CN", "HK", "CN"]), ("m", [])], "news_id string, regions array<string>")
    assert sorted(map(tuple, merge.bridge(df, "news_id", "regions", "region").collect())) == [("n", "CN"), ("n", "HK")]
    body = json.dumps({"header": {"success": "true"}, "result": {"datasize": 3, "records": [{"title": "a", "link": "l1", "date": "2024-01-01"}, {"title": "b", "link": "l2", "date": "2024-01-03"}, {"title": "a", "link": "l1", "date": "2024-01-01"}]}})
    got = vendors.press_releases(spark.createDataFrame([(body,)], "value string")).collect()
    assert [r.title for r in got] == ["b", "a"]
