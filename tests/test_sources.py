import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import documents, envelope, registry, vendors
from tidemark.streaming.ingest import PageStore, advance, ingest_stream, lease


def put(folder, name, payload):
    (folder / name).write_text(payload if isinstance(payload, str) else json.dumps(payload))


def test_envelopes(spark, tmp_path):
    item = {"record_id": "r1", "v": "1"}
    put(tmp_path, "ok.json", {"status": "ok", "source_watermark": "w", "pages": {"bars": [{"cursor": None, "next_cursor": "c", "items": [item]}, {"cursor": "c", "items": [dict(item, record_id="r2", odd="x"), {"record_id": "r3"}, item]}], "news": {"items": []}}})
    found = envelope.raise_for_errors(envelope.read_envelopes(spark, str(tmp_path / "ok.json"))).cache()
    assert found.where("dataset = 'news' AND record IS NULL").count() == 1
    assert envelope.page_at(found, "bars", None).count() == 1
    with pytest.raises(envelope.SourceError, match="INVALID_PAGINATION"):
        envelope.page_at(found, "bars", "zzz")
    assert [r.record_id for r in envelope.repeated_records(found).collect()] == ["r1"]
    good, bad = envelope.typed(envelope.page_at(found, "bars", "c"), ["record_id", "v"])
    assert [r.record_id for r in good.collect()] == ["r1"] and bad.count() == 2


@pytest.mark.parametrize(
    ("payload", "code"),
    [("<!DOCTYPE html><HTML>", "SCHEMA_ERROR"), ("{broken", "SCHEMA_ERROR"), ("[1]", "SCHEMA_ERROR"), ({"status": "error", "error": {"code": "429", "retry_after_seconds": 30}}, "RATE_LIMITED"), ({"status": "error", "error": {"code": "boom"}}, "UNAVAILABLE")],
)
def test_envelope_errors(spark, tmp_path, payload, code):
    put(tmp_path, "x.json", payload)
    with pytest.raises(envelope.SourceError, match=code) as e:
        envelope.raise_for_errors(envelope.read_envelopes(spark, str(tmp_path)))
    assert e.value.retryable == (code in ("RATE_LIMITED", "UNAVAILABLE")) and e.value.retry_after == (30 if code == "RATE_LIMITED" else None)


def test_vendor_bars_and_statistics(spark):
    day = lambda d, v="5": {"datetime": d, "open": "1", "high": "2", "low": "1", "close": "2", "volume": v}
    body = json.dumps({"meta": {"symbol": "A", "interval": "1day", "currency": "USD"}, "values": [day("2024-01-02"), day("2024-01-04"), day("2024-01-03", None)]})
    texts = spark.createDataFrame([(body,)], "value string")
    assert [str(r.trading_date) for r in vendors.not_ascending(vendors.positioned(texts)).collect()] == ["2024-01-03"]
    rows = vendors.daily_rows(texts).withColumns({"instrument_id": F.col("symbol"), "turnover": F.lit(None).cast("decimal(38,18)")})
    bars = vendors.regional_bars(rows, "CN", F.lit("2024-01-05 00:00:00").cast("timestamp")).orderBy("trading_date").collect()
    assert [list(b.quality_flags) for b in bars] == [["TURNOVER_MISSING"], ["VOLUME_MISSING", "TURNOVER_MISSING"], ["TURNOVER_MISSING"]]
    assert bars[0].bar_start.hour == 1 and len({b.source_checksum for b in bars}) == 2
    data = json.dumps({"header": {}, "dataSet": [{"freq": "M", "period": "202402", "sv": "CPI", "svDesc": "prices", "figure": "1.7"}, {"freq": "Y", "period": "2024", "sv": "CPI", "svDesc": "prices", "figure": "2"}]})
    month = vendors.statistics_rows(spark.createDataFrame([(data,)], "value string")).collect()
    assert len(month) == 1 and str(month[0].period_end) == "2024-02-29"
    known = spark.createDataFrame([("CPI", "other")], "series_id string, name string")
    assert vendors.check_registry(vendors.series_of(vendors.statistics_rows(spark.createDataFrame([(data,)], "value string"))), known).first().issue == "SERIES_METADATA_MISMATCH"


def test_html_and_xlsx(spark):
    months = lambda cells: "".join(f"<td>{cells.get(m, '')}</td>" for m in range(1, 13))
    html = f"<table><tr><td>1</td><td>CPI</td>{months({1: '9/二 09:30', 2: '15/四'})}</tr><tr>{months({2: '10:00'})}</tr><tr><td>2</td><td>GDP</td>{months({3: '31/日'})}</tr></table><a href='https://a.org/x?utm_a=1'>One</a><a href='https://a.org/x'>Two</a><a href='http://b.org'>Three</a>"
    pages = spark.createDataFrame([(1, html), (2, None)], "id int, html string")
    found = documents.month_calendar(documents.html_tables(pages, "id"), "id", F.lit(2024)).orderBy("day").collect()
    assert [(r.name, str(r.day), str(r.scheduled_at), str(r.scheduled_date)) for r in found] == [
        ("CPI", "2024-01-09", "2024-01-09 01:30:00", "None"), ("CPI", "2024-02-15", "2024-02-15 02:00:00", "None"), ("GDP", "2024-03-31", "None", "2024-03-31")]
    assert [(r.url, r.label) for r in documents.headline_list(documents.html_links(pages, "id"), "id", ["a.org"]).collect()] == [("https://a.org/x", "One")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>Title</t></si><si><t>Date</t></si><si><t>CPI</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>45292</v></c></row></sheetData></worksheet>')
    files = spark.createDataFrame([("f", bytearray(out.getvalue()))], "path string, content binary")
    rows = documents.xlsx_rows(files)
    assert [(r.title, str(r.day)) for r in documents.sheet_releases(rows, ["Title", "Date"]).collect()] == [("CPI", "2024-01-01")]
    with pytest.raises(ValueError, match="header"):
        documents.sheet_releases(rows, ["Other", "Date"])


def test_registry():
    made = registry.Registry()
    fixture = registry.Provider("f", frozenset({"bars"}), frozenset({"CN"}), lambda: None, fixture=True)
    with pytest.raises(ValueError):
        made.bind("news", fixture, {"news"})
    made.bind("bars", fixture, {"bars"})
    assert made.resolve("bars") is fixture
    with pytest.raises(ValueError):
        made.assert_production_safe()
    with pytest.raises(KeyError):
        made.resolve("other")


def test_a_page_is_committed_once(spark, tmp_path):
    store = PageStore(spark, f"file://{tmp_path}", "bars")
    page = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert store.watermark() == (None, None)
    assert store.commit(page, "q", "w1", "c1")
    assert not store.commit(page.orderBy(F.desc("id")), "q", "w1", "c1")
    assert store.commit(page.limit(1), "q", "w2") and store.watermark() == ("w2", None)
    page.write.parquet(f"file://{tmp_path}/facts/bars/page=crashed")  # written, but never in the manifest
    assert store.facts(page.schema).count() == 3


def test_stream_replay_adds_nothing(spark, tmp_path):
    source = tmp_path / "in"
    for k in range(2):
        spark.createDataFrame([(k, "x"), (k + 10, None)], "id int, v string").coalesce(1).write.mode("append").parquet(f"file://{source}")
    store = PageStore(spark, f"file://{tmp_path}/store", "facts")
    split = lambda b: (b.where("v IS NOT NULL"), b.where("v IS NULL"))
    for _ in range(2):
        stream = spark.readStream.schema("id int, v string").option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
        ingest_stream(stream, store, f"file://{tmp_path}/checkpoint", split).awaitTermination()
    assert sorted(r.id for r in store.facts("id int, v string").collect()) == [0, 1]
    assert spark.read.parquet(f"file://{tmp_path}/store/rejects/facts").count() == 2


def test_task_leases(spark):
    state = spark.createDataFrame([("t", "me", 1, "active", 0, ["r0"])], "task string, owner string, epoch int, status string, accepted int, run_ids array<string>")
    state, n = lease(state, "t", "you")
    assert n == 1
    _, old = advance(state, "t", "me", 1, ["r1"], 5)
    done, new = advance(state, "t", "you", 2, ["r0", "r1"], 5)
    assert (old, new) == (0, 1) and done.first().accepted == 5 and list(done.first().run_ids) == ["r0", "r1"]


def test_late_rows_and_replays_in_a_stream(spark, tmp_path):
    from tidemark.streaming.windows import windowed, without_repeats

    folder = f"file://{tmp_path}/in"
    schema = "id int, ts timestamp, v int"
    batches = [[(1, "2024-01-01 00:01:00", 1), (2, "2024-01-01 00:02:00", 2), (2, "2024-01-01 00:02:00", 2)], [(3, "2024-01-01 01:30:00", 4)], [(4, "2024-01-01 00:03:00", 100)], [(5, "2024-01-01 04:00:00", 8)]]
    sink, query = f"late_{tmp_path.name}".replace("-", "_"), None
    for rows in batches:
        df = spark.createDataFrame(rows, "id int, ts string, v int").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(folder)
        if query is None:
            stream = without_repeats(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), "ts", "10 minutes", ["id"])
            query = windowed(stream, "ts", "1 hour", [], "v").writeStream.outputMode("append").format("memory").queryName(sink).start()
        query.processAllAvailable()
    query.stop()
    got = {r.start.hour: (r.n, r.total) for r in spark.table(sink).collect()}
    assert got[0] == (2, 3) and got[1] == (1, 4)


def test_schedules_and_links(spark):
    html = "<p>2026 schedule</p><table><tr><td>January 25 8:30 AM</td><td>GDP</td></tr><tr><td>TBD</td><td>Other</td></tr></table><a href='/a2025.pdf'>2025</a><a href='/b2025.pdf'>2025 again</a><a href='/x'>about</a>"
    pages = spark.createDataFrame([(1, html)], "id int, html string")
    got = documents.clock_schedule(documents.html_tables(pages, "id"), F.lit(2026)).collect()
    assert [(r.title, str(r.scheduled_at)) for r in got] == [("GDP", "2026-01-25 13:30:00")]
    assert [(r.year, r.href) for r in documents.year_links(documents.html_links(pages, "id")).collect()] == [(2025, "/a2025.pdf")]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(documents.page_year(F.lit("in 2026 and 2026"))) == 2026 and one(documents.page_year(F.lit("2025, 2026"))) is None
    assert one(documents.symbol_list(F.lit("a.hk, b.HK,,A.HK "))) == ["A.HK", "B.HK"]
