"""From an envelope to the store: typed records, quarantine, pages, runs and what becomes of them."""

import base64
import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import dates, symbols, text
from tidemark.manifest import Conflict, Manifest
from tidemark.operators import checks, evidence, extensions, paging, pit
from tidemark.operators import queries as reads
from tidemark.sources import documents, envelope, records, vendors
from tidemark.store import FactStore
from tidemark.streaming.ingest import Audits, PageStore, ingest_all, ingest_page
from tidemark.streaming.runs import Actions, Deliveries, Immutable, Runs, StateTable, Task, Tasks, Worker, request_hash

AT = "2024-01-05T08:00:00Z"
COMMON = {"record_id": "r1", "source_url": "https://example.org/a", "retrieved_at": AT}
KNOWN = {"available_at": AT, "availability_basis": "provider_disseminated", "quality_flags": []}
RIGHTS = {r: True for r in records.RIGHTS}
NAME = {"source_name": "n"}
CN_BAR = {"symbol": "600000.SH", "mic": "XSHG", "interval": "1d", "bar_start": "2024-01-04T01:30:00Z", "bar_end": "2024-01-04T07:00:00Z", "trading_date": "2024-01-04", "open": "1", "high": "2", "low": "1", "close": "1.5", "volume": "1,000", "currency": "CNY", "adjustment": "raw", **KNOWN, **COMMON}
OBS = {"series_id": "S", "period_start": "2024-01-01", "period_end": "2024-01-31", "value": "1.5", "unit": "%", "transformation": "yoy", "vintage_id": "v1", "revision_no": 0, "value_status": "reported", **KNOWN, **COMMON}
RELEASE = {"series_id": "S", "release_name": "CPI", "scheduled_date": "2024-02-09", "period_start": "2024-01-01", "period_end": "2024-01-31", "actual": "--", "unit": "%", "status": "scheduled", "available_at": AT, **COMMON}
NEWS = {"title": "Big　news +5", "body": "text", "summary": "s", "content_mode": "full_text", "language": "zh", "source_name": "n", "source_tier": "official", "canonical_url": "https://Example.org/x?utm_a=1", "published_at": "2024-01-05T07:00:00Z", "first_seen_at": AT, "topics": ["t"], "entities": [{"entity_type": "company", "entity_id": "e1", "confidence": "0.9"}], "rights": dict(RIGHTS), **KNOWN, **COMMON}
ID = {"symbol": "AAA", "exchange": "NASDAQ", "first_canonical_symbol": "XNAS:AAA", "first_valid_from": "2020-01-01", "valid_from": "2020-01-01"}
GOOD = {
    ("CN", "instruments"): {"symbol": "600000", "mic": "XSHG", "name": "n", "asset_class": "equity", "currency": "CNY", "timezone": "Asia/Shanghai", "status": "active", "valid_from": "2020-01-01", "lot_size": "100", **COMMON},
    ("CN", "bars"): CN_BAR,
    ("CN", "market_observations"): {"scope_type": "market", "scope_id": "CN", "metric_code": "flow", "value": "3", "unit": "亿元", "period_start": AT, "period_end": AT, "observed_at": AT, "raw_observed_at": "2024-01-05 16:00", "raw_timezone": "Asia/Shanghai", "dimensions": {"a": "b"}, **KNOWN, **COMMON},
    ("CN", "macro_observations"): OBS, ("CN", "macro_releases"): RELEASE, ("CN", "news"): NEWS,
    ("US", "instruments"): {**ID, "name": "n", "asset_class": "etf", "currency": "USD", "timezone": "America/New_York", "status": "active", **NAME, **COMMON},
    ("US", "bars"): {**ID, **{k: v for k, v in CN_BAR.items() if k not in ("symbol", "mic")}, "bar_start": "2024-01-04T14:30:00Z", "bar_end": "2024-01-04T21:00:00Z", "currency": "USD", **NAME},
    ("US", "market_observations"): {"scope_type": "market", "scope_id": "US", "metric_code": "m", "value": "25 bp", "unit": "percent", "period_start": AT, "period_end": AT, "observed_at": AT, "dimensions": {}, **KNOWN, **NAME, **COMMON},
    ("US", "macro_series"): {"series_id": "S", "authority": "BLS", "code": "C", "name": "n", "frequency": "monthly", "unit": "percent", "transformation": "yoy", "seasonal_adjustment": "adjusted", **NAME, **COMMON},
    ("US", "macro_observations"): {**OBS, "unit": "percent", "released_at": AT, **NAME}, ("US", "macro_releases"): {**{k: v for k, v in RELEASE.items() if k != "scheduled_date"}, "scheduled_at": AT, "unit": "percent", **NAME},
    ("US", "news"): {k: v for k, v in NEWS.items() if k not in ("body", "content_mode")},
}


def page(spark, *items):
    rows = [("f", "d", 0, None, None, json.dumps(i, sort_keys=True, ensure_ascii=False), envelope._checksum(i), "w", None) for i in items]
    return spark.createDataFrame(rows, "path string, dataset string, page int, cursor string, next_cursor string, record string, checksum string, watermark string, error string")


@pytest.fixture
def parse(spark):
    registry = spark.createDataFrame([("XSHG", "600000", "key1")], "venue_mic string, local_symbol string, instrument_key string")

    def run(region, dataset, rows):
        return records.us_records(rows, dataset) if region == "US" else records.regional_records(rows, dataset, region, "cn-fixture", registry)

    return run


@pytest.mark.parametrize(("region", "dataset"), sorted(GOOD))
def test_records_of_each_dataset(spark, parse, region, dataset):
    """A good record becomes a row of the store's schema; with a field too many, absent or unreadable it is set aside with its issue."""
    item = GOOD[region, dataset]
    late = "valid_from" if "valid_from" in item else "retrieved_at"
    bad = [dict(item, odd=1), {k: v for k, v in item.items() if k != "source_url"}, dict(item, **{late: "yesterday"})]
    later = dict(item, retrieved_at="2024-01-06T08:00:00Z")
    good, rejects = parse(region, dataset, page(spark, item, later, *bad))
    assert good.schema.simpleString() == spark.createDataFrame([], schemas.SCHEMAS[dataset]).schema.simpleString()
    kept = good.collect()
    assert len(kept) == 2 and len({r.source.source_checksum for r in kept}) == 1  # when it was fetched doesn't count
    assert sorted(i for r in rejects.collect() for i in r.issues if not i.endswith("order")) == sorted([f"INVALID:{late}", "MISSING:source_url", "UNKNOWN_FIELD"])


def variants(spark, parse, region, dataset, base=None, **changes):
    """What becomes of variants of a good record: a row, or the issues it is set aside for, by name."""
    items = {n: dict(base or GOOD[region, dataset], record_id=n, **c) for n, c in changes.items()}
    good, bad = parse(region, dataset, page(spark, *items.values()))
    rows = {r.source.source_checksum: r for r in good.collect()}
    issues = {json.loads(r.record)["record_id"]: r.issues for r in bad.collect()}
    return {n: issues[n] if n in issues else rows[envelope._checksum(i)] for n, i in items.items()}


def test_values_are_normalised(spark, parse):
    got = variants(spark, parse, "CN", "market_observations", plain={})["plain"]
    assert got.value == 3 * 10**8 and got.currency == "CNY"
    got = variants(spark, parse, "CN", "bars", weekend={"trading_date": "2024-01-06"}, low={"low": "9"}, unknown={"symbol": "600001.SH"}, odd={"adjustment": "odd"})
    assert "NOT_A_TRADING_DAY" in got["weekend"] and "low_above_body" in got["low"] and "INSTRUMENT_UNREGISTERED" in got["unknown"] and "INVALID:adjustment" in got["odd"]
    assert "TRADING_DATE_MISMATCH" in variants(spark, parse, "US", "bars", day={"trading_date": "2024-01-05"})["day"]
    assert "UNKNOWN_UNIT" in variants(spark, parse, "CN", "macro_observations", unit={"unit": "parsec"})["unit"]
    got = variants(spark, parse, "CN", "macro_releases", both={"scheduled_at": AT}, day={})
    assert "schedule_needs_one" in got["both"] and got["day"].time_precision == "date" and got["day"].actual is None
    # without evidence the reported time doesn't count
    got = variants(spark, parse, "US", "market_observations", seen={}, told={"provider_updated_at": AT, "retrieved_at": "2024-01-07T08:00:00Z"})
    assert float(got["seen"].value) == 0.25 and got["seen"].availability_basis == "first_seen"
    assert got["told"].availability_basis == "provider_disseminated" and got["told"].available_at == dt.datetime(2024, 1, 5, 8)


def test_news_and_filings(spark, parse):
    got = variants(spark, parse, "CN", "news", plain={}, barred={"rights": dict(RIGHTS, storage_allowed=False)})
    assert got["plain"].body == "text" and got["plain"].canonical_url == "https://example.org/x" and got["plain"].content_mode == "full_text"
    assert got["barred"].body is None and got["barred"].quality_flags == ["body_omitted_by_rights"] and got["barred"].content_mode == "snippet"
    url = "https://www.sec.gov/Archives/edgar/data/1/000124000001.txt"
    filing = {k: v for k, v in GOOD["US", "news"].items() if k not in ("title", "published_at", "topics")} | {"accession_number": "0001-24-000001", "form": "8-k", "company_name": "Co", "filing_date": "2024-01-04", "source_url": url, "canonical_url": url}
    got = variants(spark, parse, "US", "news", filing, plain={}, timed={"acceptance_datetime": "2024-01-04T20:00:00Z"}, odd={"form": "X"}, elsewhere={"source_url": "https://example.org/x"})
    plain = got["plain"]
    assert plain.title == "SEC filing: 8-K Co" and plain.topics == ["filing", "corporate_action"] and plain.quality_flags == ["PUBLISHED_AT_FALLBACK_TO_FIRST_SEEN"] and plain.available_at == plain.published_at
    assert got["timed"].availability_basis == "provider_disseminated" and got["odd"].quality_flags[-1] == "SEC_FORM_UNMAPPED" and "INVALID:source_url" in got["elsewhere"]


@pytest.mark.parametrize("payload", ['{"status":"error","error":"boom"}', '{"status":"ok","pages":[1]}', '{"status":"ok","pages":{"bars":"x"}}', '{"status":"ok","pages":{"bars":{"items":null}}}', '{"status":"ok","pages":null}', '{"status":"ok"', "[[[[", '"x"'])
def test_malformed_envelopes_are_schema_errors(spark, tmp_path, payload):
    (tmp_path / "x.json").write_text(payload)
    with pytest.raises(envelope.SourceError, match="SCHEMA_ERROR"):
        envelope.raise_for_errors(envelope.read_envelopes(spark, str(tmp_path)))


def test_records_that_are_no_objects_are_set_aside(spark, tmp_path, parse):
    (tmp_path / "x.json").write_text(json.dumps({"status": "ok", "pages": {"macro_observations": {"items": ["x", None, 5, GOOD["CN", "macro_observations"]]}}}))
    good, bad = parse("CN", "macro_observations", envelope.read_envelopes(spark, str(tmp_path)))
    assert good.count() == 1 and bad.count() == 3
    odd = spark.createDataFrame([("{broken",), (None,), ('{"token":"x","a":[{"fact_ids":["f"]}]}',)], "p string")
    got = odd.select(text.redacted(F.col("p")).alias("r"), text.nested_values(F.col("p")).alias("n"), text.forbidden_keys(F.col("p"), ("token",)).alias("k")).collect()
    assert [r.r for r in got] == [text.UNREADABLE, None, '{"a": [{"fact_ids": ["f"]}], "token": "[redacted]"}'] and [r.n for r in got] == [[], [], ["f"]] and [r.k for r in got] == [["*"], [], ["token"]]


def source(spark, folder, dataset, pages):
    (folder / "page.json").write_text(json.dumps({"status": "ok", "source_watermark": "w1", "pages": {dataset: pages}}))
    return lambda cursor: envelope.read_envelopes(spark, str(folder / "page.json"))


def test_from_envelopes_to_reads(spark, tmp_path, parse):
    """Two pages with one bad record go in; a replay adds nothing; reads, rejects, watermark and accepted ids agree."""
    obs = lambda n, **m: dict(GOOD["CN", "macro_observations"], record_id=f"r{n}", vintage_id=f"v{n}", **m)
    read = source(spark, tmp_path, "macro_observations", [{"cursor": None, "next_cursor": "c2", "items": [obs(1), obs(2, odd=1)]}, {"cursor": "c2", "next_cursor": None, "items": [obs(3)]}])
    facts = FactStore(spark, f"file://{tmp_path}/facts")
    pages = PageStore(spark, f"file://{tmp_path}/pages", "macro_observations", "cn", "CN")
    typed = lambda rows: parse("CN", "macro_observations", rows)
    assert ingest_all(read, "macro_observations", typed, facts, pages, "q") == {"pages": 2, "accepted": 2, "rejected": 1}
    for _ in range(2):
        again = ingest_all(read, "macro_observations", typed, facts, pages, "q")
        assert again["pages"] == 0 and facts.table("macro_observations").count() == 2
    assert pages.rejects("code string, issues array<string>").count() == 1 and pages.watermark() == ("w1", None)
    got = pages.accepted().first()
    assert got["pages"] == 2 and len(got.record_ids) == 2
    lit = lambda d: F.lit(d).cast("date")
    assert facts.macro_observations(["S"], lit("2024-01-01"), lit("2024-02-01"), F.lit("2024-02-01").cast("timestamp"), policy="all_vintages").count() == 2


def test_pages_that_are_refused(spark, tmp_path, parse):
    facts, pages = FactStore(spark, f"file://{tmp_path}/facts"), PageStore(spark, f"file://{tmp_path}/pages", "market_observations")
    item = GOOD["CN", "market_observations"]
    typed = lambda rows: parse("CN", "market_observations", rows)
    go = lambda items, **m: ingest_page(source(spark, tmp_path, "market_observations", items)(None), "market_observations", typed, facts, pages, "q", **m)
    with pytest.raises(envelope.SourceError, match="DUPLICATE_PAGE"):
        go({"items": [item, item]})
    with pytest.raises(envelope.SourceError, match="SCHEMA_ERROR"):
        go({"items": [dict(item, odd=1)]})
    assert go({"items": []})["accepted"] == 0
    audits = Audits(spark, f"file://{tmp_path}")
    go({"items": [item]}, audits=audits, run_id="run1")
    with pytest.raises(ValueError, match="HISTORICAL"):
        audits.refuse_history("run1", "p", False, dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1))
    assert sorted(r.kind for r in audits.manifest.read().collect()) == ["historical_pit_refused", "raw_time"]
    two = source(spark, tmp_path, "d", [{"items": [item]}, {"items": []}, {"items": []}, {"items": [item]}])(None)
    assert envelope.on_earlier_pages(two, "d", 3).count() == 1 and envelope.empty_pages(two, "d") == 2


def test_manifest_is_compacted_and_fenced(spark, tmp_path, monkeypatch):
    from tidemark import manifest

    monkeypatch.setattr(manifest, "COMPACT_AFTER", 3)
    log = Manifest(spark, f"file://{tmp_path}/m", "k string, n int")
    for n in range(8):
        assert log.append([("a", n)]) == n + 1
    assert sorted(r.n for r in log.read().collect()) == list(range(8)) and len(log._entries()) <= 4
    with pytest.raises(Conflict):
        log.append([("b", 0)], after=3)


class Clock:
    now = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)

    def __call__(self):
        return Clock.now


@pytest.fixture
def state(spark, tmp_path):
    Clock.now = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    return StateTable(spark, f"file://{tmp_path}/state", Clock())


def test_runs(state):
    """One owner at a time; a failed run or one whose lease has ended is taken over; a finished one is replayed."""
    runs, request = Runs(state), {"dataset": "bars", "ids": {"b", "a"}}
    run_id, held, owned = runs.acquire(request)
    key = request_hash({"ids": {"a", "b"}, "dataset": "bars"})
    assert owned and held["attempt"] == 1 and runs.acquire(request)[2] is False
    assert runs.renew(key, 1) and not runs.renew(key, 2)
    Clock.now += dt.timedelta(minutes=10)
    assert runs.acquire(request)[1]["attempt"] == 2 and not runs.complete(key, 1, {})
    assert runs.fail(key, 2, "TIMEOUT") and runs.result(key) is None
    done = runs.execute(request, lambda run, beat: {"run": run, "beat": beat()})
    assert done == {"run": run_id, "beat": True} and runs.execute(request, lambda *a: 1 / 0) == done
    with pytest.raises(ZeroDivisionError):
        runs.execute({"other": 1}, lambda *a: 1 / 0)
    assert state.get("run", request_hash({"other": 1}))["error"] == "ZeroDivisionError"


def test_tasks_and_worker(state):
    tasks, day = Tasks(state), dt.date(2024, 1, 1)
    first = tasks.begin(day, "t", {"role": "cn"})
    second = tasks.begin(day, "t", {"role": "cn"})
    page = {"accepted": 2, "rejected": 1, "next_cursor": "c", "watermark": "w"}
    assert not tasks.advance(day, "t", first["epoch"], "r1", page) and tasks.advance(day, "t", second["epoch"], "r1", page)
    assert tasks.advance(day, "t", second["epoch"], "r1", dict(page, next_cursor=None)) and not tasks.advance(day, "t", second["epoch"], "r1", page)
    held = state.get("task", "2024-01-01|t")
    assert (held["accepted"], held["run_ids"], held["status"]) == (4, ["r1"], "succeeded")
    with pytest.raises(Immutable):
        tasks.begin(day, "t", {"role": "hk"})
    tries = iter([{"status": "retryable"}, {"status": "succeeded", "run_ids": ["r"]}] * 5)
    worker = Worker(state, [Task("a", lambda d: next(tries)), Task("b", lambda d: {"status": "succeeded"}, required=False)], wait=lambda s: None)
    got = worker.backfill(day, day + dt.timedelta(days=1))
    assert [g["status"] for g in got] == ["degraded"] * 2 and got[0]["tasks"][0]["tries"] == 2 and got[0]["tasks"][1]["error"] == "NO_RUN_EVIDENCE"


def test_deliveries_and_actions(state):
    class Later(RuntimeError):
        retryable = True

    class Unknown(RuntimeError):
        uncertain = True

    sent, errors = [], [Later(), None]

    def send(payload):
        if (e := errors.pop(0)) is not None:
            raise e
        sent.append(payload)

    deliveries = Deliveries(state)
    assert deliveries.deliver("r", "chat", "k", {"a": 1}, send, wait=lambda s: None)["status"] == "succeeded" and sent == [{"a": 1}]
    assert deliveries.deliver("r", "chat", "k", {"a": 1}, send)["status"] == "succeeded" and len(sent) == 1
    with pytest.raises(Immutable):
        deliveries.reserve("r", "chat", "k", {"a": 2})
    errors[:] = [Unknown()]
    assert deliveries.deliver("r2", "chat", "k", {}, send)["status"] == "uncertain" and not deliveries.retry("r2", "chat", "k")
    errors[:] = [None]
    actions = Actions(state)
    assert actions.redeliver("q1", deliveries, "r2", "chat", "k", False, send)["status"] == "rejected"
    assert actions.redeliver("q2", deliveries, "r2", "chat", "k", True, send)["status"] == "succeeded"
    assert actions.redeliver("q2", deliveries, "r2", "chat", "k", True, send)["delivery"] == "succeeded"


def test_query_checks():
    day = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    assert checks.bar_query({"start": day, "end": day + dt.timedelta(1)})["limit"] == 5000
    for bad in ({"start": day, "end": day}, {"start": day, "end": day + dt.timedelta(1), "limit": 0}, {"start": day, "end": day + dt.timedelta(1), "odd": 1}, {"start": day, "end": day + dt.timedelta(1), "instrument_ids": []}):
        with pytest.raises(checks.QueryError):
            checks.bar_query(bad)
    checks.observation_query({"period_from": day, "period_to": day})
    for call, q in ((checks.observation_query, {"period_from": day, "period_to": day - dt.timedelta(1)}), (checks.news_query, {"published_from": day, "published_to": day}), (checks.release_query, {"scheduled_from": day, "scheduled_to": day}), (checks.aware, dt.datetime(2024, 1, 1))):
        with pytest.raises(checks.QueryError):
            call(q)


def test_evidence_and_snapshots(spark):
    fact = lambda i, at=AT, value="1": (i, "cn_market", "t", value, "CNY", at, "s1")
    ref = ("s1", "p", "r", "n", "https://example.org")
    rows = lambda *r: spark.createDataFrame(list(r), evidence.EVIDENCE)
    cutoff, as_of, day = (F.lit(x).cast(t) for x, t in (("2024-01-05 09:00:00", "timestamp"), ("2024-01-05 10:00:00", "timestamp"), ("2024-01-05", "date")))
    good = ("market.cn", "available", True, "", [fact("f2"), fact("f1")], [ref])
    late, invalid = ("market.hk", "available", True, "", [fact("f3", "2024-01-05T09:30:00Z")], [ref]), ("market.us", "revised", True, "", [fact("f4", "noon")], [ref])
    assert {r.input_id: (r.status, len(r.facts)) for r in evidence.cut_off(rows(good, late, invalid), cutoff).collect()} == {"market.cn": ("available", 2), "market.hk": ("late", 0), "market.us": ("invalid", 0)}
    make = lambda *r: evidence.snapshot(rows(*r), day, as_of, cutoff, "v1").first()
    one = make(good, late)
    assert one.fact_ids == ["f1", "f2"] and one.source_ref_ids == ["s1"] and one.snapshot_id == make(late, good).snapshot_id and one.snapshot_id != make(good).snapshot_id
    for bad in ((good, good), (good, ("x", "available", True, "", [fact("f1")], [ref])), (good, ("x", "available", True, "", [], [("s1", "other", "r", "n", None)]))):
        with pytest.raises(evidence.EvidenceError):
            make(*bad)
    regional = spark.createDataFrame([("CN", *good), ("HK", "market.hk", "revised", True, "", [], [ref]), ("US", *invalid)], f"region string, {evidence.EVIDENCE}")
    folded = evidence.calendar_input(regional).first()
    assert folded.status == "revised" and [f.fact_id for f in folded.facts] == ["f1", "f2", "f4"] or sorted(f.fact_id for f in folded.facts) == ["f1", "f2", "f4"]
    broken = regional.withColumn("status", F.when(F.col("region") == "HK", "missing").otherwise(F.col("status")))
    assert evidence.calendar_input(broken).first().status == "missing" and evidence.calendar_input(broken).first().facts == []
    snaps = spark.createDataFrame([("s", ["f1"], [fact("f1"), fact("f2", "x"), fact("f3", AT, "odd")])], f"snapshot_id string, fact_ids array<string>, facts array<{evidence.FACT}>")
    assert {r.fact_id: r.valid for r in evidence.typed_facts(snaps).collect()} == {"f1": True, "f2": False, "f3": False}
    reports = spark.createDataFrame([("r", "s", ["f1", "f9"])], "report_id string, snapshot_id string, fact_ids array<string>")
    assert [r.fact_id for r in evidence.unknown_facts(reports, snaps).collect()] == ["f9"]
    same = spark.createDataFrame([("s", '{"snapshot_id":"s"}'), ("s", '{"snapshot_id":"t"}'), ("s", "{")], "snapshot_id string, payload string")
    assert [r.same for r in evidence.identity_holds(same, "payload", ["snapshot_id"]).collect()] == [True, False, False]


def test_day_policies(spark):
    part = lambda r, s: (r, f"market.{r.lower()}", s, s == "scheduled_session")
    opened, holiday = [part(r, "scheduled_session") for r in ("CN", "HK", "US")], [part("CN", "exchange_holiday"), part("HK", "scheduled_session"), part("US", "scheduled_session")]
    always = ["calendar.global", "news.cn", "news.us"]
    every = [*always, "market.cn", "market.hk", "market.us"]
    day, weekend = dt.date(2024, 1, 5), dt.date(2024, 1, 6)
    rows = [
        (day, "regular", opened, every, []), (day, "regional_holiday", holiday, [x for x in every if x != "market.cn"], ["market.cn"]), (weekend, "weekend", [part(r, "weekend_closed") for r in ("CN", "HK", "US")], always, every[3:]),
        (weekend, "regular", opened, every, []), (day, "regular", opened[:2], every, []), (day, "regional_holiday", holiday, every, []), (day, "regular", opened, always, every[3:]),
    ]
    df = spark.createDataFrame(rows, "day date, day_type string, regions array<struct<region:string,market_input_id:string,status:string,market_input_required:boolean>>, required array<string>, optional array<string>")
    got = evidence.inputs_of(df).collect()
    assert [r.issue for r in got] == [None] * 3 + ["REPORT_DAY_POLICY_INVALID"] * 4 and all(len(r.required) == 6 for r in got[3:])


def test_ids_and_small_rules(spark):
    keys = ["a", "key1", "", "é"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", symbols.instrument_id(F.lit("CN"), F.col("k")).alias("i")).collect()
    assert all(r.i == "ins_" + base64.b32encode(hashlib.sha256(f"CN|{r.k}".encode()).digest()).decode().lower()[:26] for r in got)
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 5, 9)], "day date")
    sessions = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (2, 2, 4)], "day date")
    found = dates.previous_session(days, "day", sessions)
    assert [r.previous_session and r.previous_session.day for r in found.orderBy("day").collect()] == [None, None, 4, 4]
    alias = spark.range(1).select(symbols.us_alias(F.lit("aaa"), F.lit("nyse"), F.lit("XNYS:AAA"), F.lit("2020-01-01").cast("date"), F.lit("2021-01-01").cast("date"), F.lit("2020-01-01").cast("date")).alias("a")).first().a
    assert alias.canonical_symbol == "XNYS:AAA" and alias.issue == "empty_range"
    table = spark.createDataFrame([(1, "<table><tr><td>one<td>two</tr><tr><th>a <table><tr><td>in</table> b</th><td>c</table>")], "id int, html string")
    assert [(r.table_no, r.cells) for r in documents.html_tables(table, "id").collect()] == [(0, ["one", "two"]), (0, ["a b", "c"]), (1, ["in"])]
    pdf = spark.createDataFrame([(1, "Schedule 2024\nConsumer Price Index 11 13 12 10 15 12 11 14 11 10 13 11\nother 1 2 3")], "id int, t string")
    got = documents.pdf_calendar(pdf, "id", "t", F.lit(2024))
    assert got.count() == 12 and got.where("scheduled_date = '2024-02-13' AND name = 'Consumer Price Index'").count() == 1
    releases = documents.calendar_releases(got, "US", "omb", "https://example.org", F.lit(AT).cast("timestamp"))
    assert releases.where("period_end = '2024-01-31'").count() == 1 and documents.last_file_wins(releases.withColumn("f", F.lit(1)).unionByName(releases.withColumn("f", F.lit(2))), "f").select("f").distinct().collect()[0].f == 2
    lines = spark.createDataFrame([("n", "https://Example.org/x"), ("m", None)], "n string, u string").select(text.source_line(F.col("n"), F.col("u")).alias("s")).collect()
    assert [r.s for r in lines] == ["n (example.org)", "m"]
    kinds = spark.createDataFrame([("Read timed out",), ("HTTP 429",), ("bad request",), (None,)], "m string").select(text.error_class(F.col("m")).alias("k")).collect()
    assert [r.k for r in kinds] == ["uncertain", "retry_wait", "failed", "failed"]


def test_vendor_frames_and_pages(spark):
    import pandas as pd

    at = int(dt.datetime(2024, 1, 4, 4, tzinfo=dt.UTC).timestamp() * 1000)
    good, bad = vendors.vendor_frame(spark, pd.DataFrame({"time": [at, at], "date": ["20240104", "20240105"], "close": [1.5, float("nan")]}))
    assert good.first().close == "1.5" and bad.first().close is None
    bars = spark.createDataFrame([("i", dt.date(2024, 1, 4)), ("i", dt.date(2025, 1, 4)), ("i", dt.date(2025, 7, 3))], "instrument_id string, trading_date date")
    bars = bars.select("*", *[F.lit("1").cast("decimal(38,18)").alias(c) for c in ("open", "high", "low", "close", "volume", "turnover")])
    got = vendors.us_session_bars(bars, F.lit(AT).cast("timestamp")).orderBy("trading_date").collect()
    assert [r.issue for r in got] == ["NO_CALENDAR", "CLOSED_DAY", None] and got[2].bar_end == dt.datetime(2025, 7, 3, 17)
    data = [{"link": f"l{k}"} for k in range(7)]
    assert vendors.press_pages(lambda o, n: (data[o : o + 3], 7)) == data
    for read, code in ((lambda o, n: (data[o : o + 3], 7 + o), "SNAPSHOT_CHANGED"), (lambda o, n: (data[:3], 7), "DUPLICATE_PAGE")):
        with pytest.raises(envelope.SourceError, match=code):
            vendors.press_pages(read)
    rows = spark.createDataFrame([("b1", "i", 2), ("b2", "i", 1), ("b3", "h", 1)], "bar_id string, instrument_id string, bar_end int")
    page, following = paging.provider_page(rows, 0, 2, "w")
    assert [r.bar_id for r in page.collect()] == ["b3", "b2"] and following == 2 and paging.provider_page(rows, 2, 2, "w", "w")[1] is None
    for call in (lambda: paging.provider_page(rows, 0, 2, "w", "v"), lambda: paging.provider_page(rows.unionAll(rows), 0, 2, "w"), lambda: paging.snapshot_moment("2024-01-02T00:00:00+00:00", dt.datetime(2024, 1, 1, tzinfo=dt.UTC)), lambda: paging.snapshot_moment("soon", dt.datetime(2024, 1, 1, tzinfo=dt.UTC))):
        with pytest.raises(paging.CursorError):
            call()


def test_provider_side_reads(spark):
    T = lambda h: dt.datetime(2024, 1, 1, h)
    lit = lambda h: F.lit(T(h)).cast("timestamp")
    obs = spark.createDataFrame([("s", dt.date(2024, 1, 1), "o1", 0, T(3)), ("s", dt.date(2024, 1, 1), "o2", 1, T(2)), ("t", dt.date(2024, 1, 1), "o3", 0, T(9))], "series_id string, period_end date, observation_id string, revision_no int, available_at timestamp")
    day = F.lit("2024-01-01").cast("date")
    got = reads.provider_rows(obs, "macro_observations", lit(8), lit(20), day, day, policy="latest_as_of").collect()
    assert [r.observation_id for r in got] == ["o2"]  # by revision, and known at both clocks
    bars = spark.createDataFrame([("b1", "i", "1d", "raw", T(1), T(2), T(3)), ("b2", "i", "1w", "raw", T(1), T(2), T(3))], "bar_id string, instrument_id string, interval string, adjustment string, bar_start timestamp, bar_end timestamp, available_at timestamp")
    assert [r.bar_id for r in reads.provider_rows(bars, "bars", lit(9), lit(9), lit(0), lit(5), ["i"]).collect()] == ["b1"]
    groups = spark.createDataFrame([("a", 1, dt.date(2024, 1, 1), dt.date(2024, 2, 1)), ("a", 2, dt.date(2024, 1, 15), None), ("a", 3, dt.date(2023, 1, 1), dt.date(2024, 1, 1))], "alias string, instrument_id int, valid_from date, valid_to date")
    assert [(r.left_owner, r.right_owner) for r in pit.alias_conflicts(groups, ["alias"]).collect()] == [(1, 2)]
    assert pit.overlap_groups(groups, ["alias"]).select("overlap").distinct().count() == 2


@pytest.mark.parametrize("kind", ["csv", "orc", "json", "parquet"])
def test_file_tables_and_sql_functions(spark, tmp_path, kind):
    rows = spark.createDataFrame([(1, "a,b"), (2, None)], "n int, s string")
    rows.write.format(kind).option("header", "true").save(f"file://{tmp_path}/t")
    assert sorted(map(tuple, extensions.read_table(spark, f"file://{tmp_path}/t", kind, "n int, s string").collect())) == [(1, "a,b"), (2, None)]
    extensions.register_functions(spark)
    assert spark.sql("SELECT tide_excel_day(45292) AS d, tide_full_title('Ａ+5') AS t").first().asDict() == {"d": dt.date(2024, 1, 1), "t": "a plus 5"}
    assert extensions.run_sql(spark, {"x": rows}, "SELECT max(n) AS m FROM {x}").first().m == 2
