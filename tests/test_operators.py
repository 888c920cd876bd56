import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import dates
from tidemark.operators import context, merge, paging, pit, quality, report
from tidemark.operators import queries as reads

T = lambda h: dt.datetime(2024, 1, 1, h)
BAR = "bar_id string, instrument_id string, available_at timestamp, close int, source_checksum string"


def lit(ts):
    return F.lit(ts).cast("timestamp")


def test_base_revision_and_return_to_base(spark):
    base = spark.createDataFrame([("b", "i", T(1), 10, "A")], BAR)
    revisions = spark.createDataFrame([("b", "i", T(2), 11, "B"), ("b", "i", T(3), 10, "A")], BAR).drop("instrument_id").withColumn("instrument_id", F.lit("x"))
    at = lambda h: pit.as_of_latest(base, revisions, "bar_id", ["bar_id", "instrument_id"], lit(T(h))).collect()
    assert at(0) == []
    assert [r.close for h in (1, 2, 3) for r in at(h)] == [10, 11, 10]
    assert {r.instrument_id for r in at(3)} == {"i"}  # key columns come from the base row


def test_revision_wins_at_equal_time_and_orphans_fall_out(spark):
    base = spark.createDataFrame([("b", "i", T(1), 10, "Z")], BAR)
    revisions = spark.createDataFrame([("b", "i", T(1), 11, "A"), ("orphan", "i", T(1), 1, "A")], BAR)
    assert [(r.bar_id, r.close) for r in pit.as_of_latest(base, revisions, "bar_id", ["bar_id", "instrument_id"], lit(T(5))).collect()] == [("b", 11)]


def test_no_row_from_the_future(spark):
    random.seed(7)
    rows = [(i, random.randrange(40), "p", T(random.randrange(24)), random.randrange(5)) for i in range(10_000)]
    df = spark.createDataFrame(rows, "observation_id int, series_id int, period_end string, available_at timestamp, revision_no int")
    for policy in ("all_vintages", "latest_as_of", "first_release"):
        assert pit.revision_policy(df, ["series_id"], policy, lit(T(9))).where(F.col("available_at") > lit(T(9))).count() == 0
    with pytest.raises(ValueError):
        pit.revision_policy(df, ["series_id"], "other", lit(T(9)))


def test_merge_policies(spark):
    schema = "k string, at timestamp, c string"
    arrivals = spark.createDataFrame([("k", T(1), "A"), ("k", T(2), "B"), ("k", T(3), "A"), ("k", T(4), "A")], schema)
    changes = merge.append_on_change(arrivals, ["k"], [F.col("at")], "c").orderBy("at").collect()
    assert [(r.c, r.version_no) for r in changes] == [("A", 1), ("B", 2), ("A", 3)]
    assert [r.c for r in merge.append_if_unlike_base(arrivals, ["k"], [F.col("at")], "c").orderBy("at").collect()] == ["A", "B"]
    base, revs = spark.createDataFrame([], BAR), spark.createDataFrame([], BAR)
    for h, checksum in ((1, "A"), (2, "A"), (3, "B"), (4, "A")):
        page = spark.createDataFrame([("b", "i", T(h), h, checksum)], BAR)
        base, revs = (spark.createDataFrame(x.collect(), BAR) for x in merge.merge_versions(base, revs, page, "bar_id"))
    assert [r.source_checksum for r in base.collect()] == ["A"]
    assert sorted((r.available_at.hour, r.source_checksum) for r in revs.collect()) == [(3, "B"), (4, "A")]


def test_immutable_put_and_compare_and_set(spark):
    held = spark.createDataFrame([("a", "1")], "k string, c string")
    assert merge.immutable_put(held, held, "k", "c").count() == 1
    with pytest.raises(ValueError):
        merge.immutable_put(held, spark.createDataFrame([("a", "2")], "k string, c string"), "k", "c")
    state = spark.createDataFrame([("t", "pending", 1), ("u", None, 1)], "k string, status string, n int")
    done, n = merge.compare_and_set(state, F.col("status") == "pending", {"status": F.lit("sent"), "n": F.col("n") + 1})
    assert n == 1 and {(r.k, r.status, r.n) for r in done.collect()} == {("t", "sent", 2), ("u", None, 1)}


def test_empty_tables_give_empty_results(spark):
    bars = schemas.empty(spark, "bars")
    assert reads.list_bars(bars, bars, None, lit(T(0)), lit(T(9)), lit(T(9))).count() == 0
    assert reads.list_snapshots(bars, bars, ["x"], lit(T(9))).count() == 0
    assert reads.list_news(schemas.empty(spark, "news"), lit(T(0)), lit(T(9)), lit(T(9)), regions=["CN"]).count() == 0
    assert reads.list_macro_releases(schemas.empty(spark, "macro_releases"), schemas.empty(spark, "macro_releases"), lit(T(0)), lit(T(9)), lit(T(9))).count() == 0


NEWS = "news_id string, regions array<string>, title string, summary string, body string, content_mode string, published_at timestamp, published_date date, available_at timestamp, supersedes_news_id string"


def test_superseded_news_goes_after_the_limit(spark):
    rows = [(f"n{i}", ["CN"], "t", "s", "b", "full_text", T(i), None, T(i), "n1" if i == 5 else "n4" if i == 2 else None) for i in range(1, 6)]
    rows.append(("d", ["CN", "HK"], "t", "s", None, "snippet", None, dt.date(2024, 1, 1), T(3), None))
    news = spark.createDataFrame(rows, NEWS)
    page = lambda **k: [r.news_id for r in reads.list_news(news, lit(T(0)), lit(T(23)), lit(T(20)), regions=["CN"], **k).collect()]
    assert page(limit=10) == ["n5", "n3", "n2", "d"]  # n1 and n4 are replaced
    assert page(limit=2) == ["n5", "n4"]  # what replaces n4 is not on the page
    assert page(limit=10, include_superseded=True) == ["n5", "n4", "n3", "n2", "n1", "d"]
    trimmed = reads.trim_content(news, "headline").collect()
    assert all(r.summary is None and r.body is None and r.content_mode == "headline" for r in trimmed)
    assert {r.content_mode for r in reads.trim_content(news, "snippet").collect()} == {"snippet"}


def test_coverage_has_empty_cells_and_fingerprint_ignores_order(spark):
    rows = spark.createDataFrame([("CN", "market", "p2", T(1)), ("CN", "market", "p1", T(2))], "region string, dataset string, provider_id string, available_at timestamp")
    found = context.coverage(rows, context.spine(spark, ["CN", "US"]), ["region", "dataset"]).collect()
    assert len(found) == 6 and sum(r.status == "complete" for r in found) == 1
    assert next(r for r in found if r.record_count).providers == ["p1", "p2"]
    one = context.fingerprint({"a": rows}, lit(T(1))).first()[0]
    assert one == context.fingerprint({"a": rows.orderBy(F.desc("provider_id")).repartition(3)}, lit(T(1))).first()[0]
    assert one != context.fingerprint({"a": rows.limit(1)}, lit(T(1))).first()[0]


def test_gate_lattice(spark):
    expected = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "input_id string, required boolean")
    status = lambda *s: spark.createDataFrame(list(zip("abc", s, strict=True)), "input_id string, status string")
    decide = lambda q: quality.gate_decision(quality.gate_issues(expected, q)).first()[0]
    assert decide(status("available", "available", "denied")) == "passed"
    assert decide(status("available", "revised", "denied")) == "degraded"
    assert decide(status("retryable", "revised", "available")) == "retryable"
    assert decide(status("retryable", "stale", "available")) == "blocked"
    assert decide(status("available", "odd", "available")) == "blocked"


def test_paging(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    got, after = [], None
    while rows := [tuple(r) for r in paging.keyset_page(df.select("g", "id"), ["g", "id"], after, 17).collect()]:
        got += rows
        after = rows[-1]
    assert got == sorted((i % 3, i) for i in range(100))
    with pytest.raises(paging.CursorError):
        paging.offset_page(df, ["id"], 10, 5, expected_before=(3,))
    mark = paging.fingerprint({"regions": {"b", "a"}, "cursor": "x"}, "t", "1")
    assert mark == paging.fingerprint({"regions": {"a", "b"}, "cursor": None}, "t", "1")
    cursor = paging.encode_cursor(b"k", "bars", mark, {"offset": 5})
    assert paging.decode_cursor(b"k", cursor, "bars", mark) == {"offset": 5}
    for bad in (cursor[:-1] + "0", "x.y"):
        with pytest.raises(paging.CursorError):
            paging.decode_cursor(b"k", bad, "bars", mark + "!")


def test_report_sections(spark):
    facts = spark.createDataFrame([("f1", "news", "hello"), ("f2", "news", "world")], "fact_id string, section string, text string")
    sections = [r.asDict() for r in report.fallback_report(facts).collect()]
    assert [s["section"] for s in sections] == report.SECTIONS
    assert next(s for s in sections if s["section"] == "news")["fact_ids"] == ["f1", "f2"]
    assert len(report.card(sections)["elements"]) == 8 and report.card(sections)["header"]["template"] == "orange"
    levels = spark.createDataFrame([(79, 100), (80, 100), (95, 100), (1, 0)], "u int, t int").select(report.capacity_level(F.col("u"), F.col("t")))
    assert [r[0] for r in levels.collect()] == ["ok", "warning", "critical", "unavailable"]


def test_days_and_zones(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(dates.parse_instant(F.lit("2026-03-09T09:30:00"))) is None
    assert one(dates.iso_instant(dates.parse_instant(F.lit("2026-03-09T09:30:00.5-04:00")))) == "2026-03-09T13:30:00.500000Z"
    assert one(dates.in_gap(lit("2026-03-08 02:30:00"), "America/New_York")) is True
    assert one(dates.in_gap(lit("2026-03-08 03:30:00"), "America/New_York")) is False
    assert one(dates.day_overlaps(F.lit("2024-01-01").cast("date"), lit("2024-01-01 23:00:00"), lit("2024-01-02 05:00:00"))) is True
    assert one(dates.excel_day(F.lit(45292))) == dt.date(2024, 1, 1)
    calendar = {str(r.day): r for r in dates.us_calendar(spark).collect()}
    assert calendar["2026-11-26"].status == "closed" and calendar["2026-11-27"].status == "early_close"
    assert calendar["2026-11-27"].close_at == dt.datetime(2026, 11, 27, 18)
    assert dates.retry_after_seconds("30", dt.datetime.now(dt.UTC)) == 30
    with pytest.raises(Exception, match="no US calendar"):
        one(dates.require_us_year(F.lit("2030-01-01").cast("date")))


def test_status_of_runs(spark):
    from tidemark.operators import workflow

    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(workflow.combined_status(F.lit(w), F.lit(q))) for w, q in (("locked", "blocked"), ("succeeded", "blocked"), ("retryable", "passed"), ("succeeded", "degraded"), ("succeeded", "passed"))] == ["locked", "blocked", "retryable", "degraded", "succeeded"]
    runs = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<string>")
    cases = [(None, 0, runs("r")), ("succeeded", 2, runs("r")), ("succeeded", 0, runs()), ("succeeded", 0, runs("r")), ("retryable", 0, runs()), ("failed", 0, runs())]
    assert [one(workflow.task_problem(F.lit(s).cast("string"), F.lit(n), r)) for s, n, r in cases] == ["unavailable", "quarantined", "unavailable", None, "retryable", "unavailable"]
    policy = spark.createDataFrame([(["market.cn", "news.cn"], ["market.hk", "market.us"])], "required array<string>, optional array<string>")
    evidence = spark.createDataFrame([("market.cn", "stale", False), ("market.hk", "late", True), ("other", "late", True)], "input_id string, status string, required boolean")
    got = {r.input_id: (r.status, r.required) for r in workflow.apply_day_policy(evidence, policy).collect()}
    assert got == {"market.cn": ("stale", True), "market.hk": ("unavailable", False), "market.us": ("unavailable", False), "other": ("late", True)}
    issues = spark.createDataFrame([("a", "STALE_REQUIRED_INPUT"), ("a", "STALE_REQUIRED_INPUT"), ("b", "REQUIRED_INPUT_UNAVAILABLE"), ("c", "X")], "input_id string, code string")
    assert {r.bucket: list(r.entries) for r in workflow.issue_buckets(issues).collect()} == {"stale_inputs": ["a:STALE_REQUIRED_INPUT"], "missing_required_inputs": ["b:REQUIRED_INPUT_UNAVAILABLE"], "unavailable_inputs": ["c:X"]}
    assert [one(workflow.report_status(F.lit(s), F.lit(e), F.lit(w))) for s, e, w in (("complete", 1, 0), ("complete", 0, 1), ("complete", 0, 0), ("incomplete", 0, 0))] == ["incomplete", "degraded", "complete", "incomplete"]
    assert workflow.retry_delays(4) == [1, 2, 4] and workflow.retry_delays(3, 60) == [30, 30] and workflow.retry_delays(5, left=4) == [1, 2]
    reported = spark.createDataFrame([("r1", 5), ("r2", None)], "run_id string, reported int")
    kept = spark.createDataFrame([("r1",), ("r2",), ("r2",)], "run_id string")
    assert {r.run_id: r.rejections for r in workflow.rejection_counts(reported, kept).collect()} == {"r1": 5, "r2": 2}


def test_windows_of_days(spark):
    row = spark.range(1).select(dates.local_window(F.lit("2024-03-10").cast("date"), "America/New_York", 1, 1).alias("w"), dates.day_range(F.lit("2024-02-28").cast("date"), F.lit("2024-03-01").cast("date")).alias("d"), dates.day_range(F.lit("2024-03-02").cast("date"), F.lit("2024-03-01").cast("date")).alias("e")).first()
    assert (str(row.w.start), str(row.w.end)) == ("2024-03-09 05:00:00", "2024-03-11 04:00:00") and len(row.d) == 3 and row.e == []
