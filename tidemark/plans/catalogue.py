"""Registered queries over the reference's operators, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, numbers, symbols, text
from tidemark.operators import context, extensions, merge, paging, pit, quality, report, workflow
from tidemark.operators import queries as reads
from tidemark.plans.facts import cents, line_revisions, moment, news, observations, order_bases, table, validity
from tidemark.streaming.windows import windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SEEN = "2024-01-15 00:00:00"
KNOWN = "1999-06-30 00:00:00"


def query(sql: str):
    def bind(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return bind


OBSERVED = "SELECT event_id AS observation_id, user_id AS series_id, event_type AS period_end, ts AS available_at, CAST(round(value * 100) AS BIGINT) AS value_cents FROM events"
OBSERVATION = ["observation_id", "series_id", "period_end", "available_at", "value_cents"]


@query(f"""SELECT observation_id, series_id, period_end, available_at, value_cents FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, period_end ORDER BY available_at DESC, observation_id DESC) AS r
  FROM ({OBSERVED}) WHERE available_at <= TIMESTAMP '{SEEN}') WHERE r = 1""")
def q_pit_latest_observation(spark, d):
    return pit.revision_policy(observations(spark, d), ["series_id", "period_end"], "latest_as_of", moment(SEEN)).select(*OBSERVATION)


@query(f"""SELECT observation_id, series_id, period_end, available_at, value_cents FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, period_end ORDER BY available_at, observation_id) AS r
  FROM ({OBSERVED}) WHERE available_at <= TIMESTAMP '{SEEN}') WHERE r = 1""")
def q_first_release(spark, d):
    return pit.revision_policy(observations(spark, d), ["series_id", "period_end"], "first_release", moment(SEEN)).select(*OBSERVATION)


@query(f"SELECT * FROM ({OBSERVED}) WHERE available_at <= TIMESTAMP '{SEEN}'")
def q_all_vintages(spark, d):
    return pit.revision_policy(observations(spark, d), ["series_id", "period_end"], "all_vintages", moment(SEEN)).select(*OBSERVATION)


@query(f"""SELECT observation_id, series_id, period_end, available_at, value_cents FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY length(period_end) DESC, available_at DESC, observation_id DESC) AS r
  FROM ({OBSERVED}) WHERE available_at <= TIMESTAMP '{SEEN}') WHERE r = 1""")
def q_revision_order(spark, d):
    rows = observations(spark, d).withColumn("revision_no", F.length("period_end"))
    return pit.revision_policy(rows, ["series_id"], "latest_as_of", moment(SEEN), order="revision").select(*OBSERVATION)


BASES = """base AS (SELECT o_orderkey AS fact_id, o_custkey AS owner_id, o_orderdate AS available_at, o_orderstatus AS source_checksum,
  CAST(round(o_totalprice * 100) AS BIGINT) AS value_cents, o_orderpriority AS run_id FROM orders),
lines AS (SELECT DISTINCT l_orderkey AS fact_id, l_shipdate AS available_at,
  l_returnflag || '|' || l_linestatus || '|' || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 12, '0') || '|' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS source_checksum,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS value_cents, 'line-' || l_linestatus AS run_id FROM lineitem),
versions AS (
  SELECT fact_id, owner_id, available_at, source_checksum, value_cents, run_id, 0 AS version_rank FROM base
  UNION ALL SELECT l.fact_id, b.owner_id, l.available_at, l.source_checksum, l.value_cents, l.run_id, 1 FROM lines l JOIN base b USING (fact_id))"""
VERSION = ["fact_id", "owner_id", "available_at", "source_checksum", "value_cents", "version_rank"]


@query(f"""WITH {BASES} SELECT {", ".join(VERSION)} FROM (
  SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY available_at DESC, version_rank DESC, coalesce(source_checksum, '') DESC) AS r
  FROM versions WHERE available_at <= TIMESTAMP '{KNOWN}') WHERE r = 1""")
def q_base_revision_as_of(spark, d):
    return pit.as_of_latest(order_bases(spark, d), line_revisions(spark, d), "fact_id", ["fact_id", "owner_id"], moment(KNOWN)).select(*VERSION)


@query(f"""WITH {BASES} SELECT {", ".join(VERSION)}, evidence_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY evidence_rank DESC, available_at DESC, version_rank DESC, source_checksum DESC) AS r
  FROM (SELECT *, CASE WHEN run_id IN ('line-F', '1-URGENT') THEN 1 ELSE 0 END AS evidence_rank FROM versions WHERE available_at <= TIMESTAMP '{KNOWN}')) WHERE r = 1""")
def q_evidence_ranked(spark, d):
    rows = pit.as_of_latest(order_bases(spark, d), line_revisions(spark, d), "fact_id", ["fact_id", "owner_id"], moment(KNOWN), runs=("line-F", "1-URGENT"))
    return rows.select(*VERSION, "evidence_rank")


@query(f"""WITH {BASES} SELECT fact_id, owner_id, available_at, checksum, value_cents, version_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY available_at DESC NULLS FIRST, version_rank DESC, checksum DESC NULLS FIRST, source_checksum DESC) AS r
  FROM (SELECT *, CASE WHEN value_cents % 2 = 0 THEN source_checksum END AS checksum FROM versions WHERE available_at <= TIMESTAMP '{KNOWN}')) WHERE r = 1""")
def q_null_rank_release(spark, d):
    """Of several versions without a checksum the greatest source_checksum counts."""
    rows = pit.versions(order_bases(spark, d), line_revisions(spark, d), "fact_id", ["fact_id", "owner_id"], moment(KNOWN))
    rows = rows.withColumn("checksum", F.when(F.col("value_cents") % 2 == 0, F.col("source_checksum")))
    found = pit.current_versions(rows, "fact_id", checksum="checksum", nulls="first", tie="source_checksum")
    return found.select("fact_id", "owner_id", "available_at", "checksum", "value_cents", "version_rank")


@query(f"""SELECT series_id, observation_id, value_cents AS last_cents, available_at FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY available_at DESC, observation_id DESC) AS r2 FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id, period_end ORDER BY available_at DESC, observation_id DESC) AS r
    FROM ({OBSERVED}) WHERE available_at <= TIMESTAMP '{SEEN}') WHERE r = 1) WHERE r2 = 1""")
def q_snapshot_last(spark, d):
    latest = pit.revision_policy(observations(spark, d), ["series_id", "period_end"], "latest_as_of", moment(SEEN))
    last = pit.newest(latest, ["series_id"], [F.col("available_at").desc(), F.col("observation_id").desc()])
    return last.select("series_id", "observation_id", F.col("value_cents").alias("last_cents"), "available_at")


@query("""SELECT event_id AS observation_id, event_type AS metric_code, user_id AS scope_id, ts AS observed_at FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND ts <= TIMESTAMP '2024-01-10' AND event_type IN ('click', 'purchase')
ORDER BY observed_at, metric_code, observation_id LIMIT 5000""")
def q_observations_window(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("observation_id"), F.lit("US").alias("region"), F.col("event_type").alias("metric_code"), F.col("user_id").alias("scope_id"), F.col("ts").alias("observed_at"), F.col("ts").alias("available_at"))
    found = reads.list_market_observations(rows, moment("2024-01-05 00:00:00"), moment("2024-01-12 00:00:00"), moment("2024-01-10 00:00:00"), metrics=["click", "purchase"])
    return found.select("observation_id", "metric_code", "scope_id", "observed_at")


@query("""SELECT c_custkey AS instrument_id, r_name AS region, n_name AS venue_mic, c_mktsegment AS asset_class FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN (SELECT r_name FROM region WHERE r_regionkey <= 2) AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 400 < 300
ORDER BY instrument_id LIMIT 1000""")
def q_instruments_filter(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    day = lambda n: F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int"))
    rows = rows.where("r_regionkey <= 2").select(
        F.col("c_custkey").alias("instrument_id"), F.col("r_name").alias("region"), F.col("n_name").alias("venue_mic"), F.col("c_mktsegment").alias("asset_class"),
        day(F.col("c_custkey") % 400).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
    )
    found = reads.list_instruments(rows, asset_classes=["BUILDING", "MACHINERY"], active_on=F.date_add(F.lit("2020-01-01").cast("date"), 299))
    return found.select("instrument_id", "region", "venue_mic", "asset_class")


VALID = """validity AS (SELECT instrument_id, alias, valid_from, lead(valid_from) OVER (PARTITION BY instrument_id ORDER BY valid_from) AS valid_to
FROM (SELECT o_custkey AS instrument_id, CAST(o_orderdate AS DATE) AS valid_from, min(o_orderpriority) AS alias FROM orders GROUP BY ALL))"""


@query(f"""WITH {VALID} SELECT o_orderkey, instrument_id, alias FROM orders JOIN validity ON o_custkey = instrument_id
AND valid_from <= CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AND (valid_to IS NULL OR CAST(o_orderdate + INTERVAL 30 DAY AS DATE) < valid_to)""")
def q_effective_date_lookup(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.date_add(F.to_date("o_orderdate"), 30).alias("day"))
    found = rows.join(validity(spark, d), F.col("o_custkey") == F.col("instrument_id")).where(pit.effective_on(F.col("day"), F.col("valid_from"), F.col("valid_to")))
    return found.select("o_orderkey", "instrument_id", "alias")


@query(f"""WITH {VALID}, held AS (SELECT alias || '#' || (instrument_id // 10) AS symbol, * FROM validity), asked AS (SELECT DISTINCT symbol, DATE '1998-03-01' AS day FROM held),
met AS (SELECT a.symbol, count(DISTINCT CASE WHEN valid_from <= day AND (valid_to IS NULL OR day < valid_to) THEN instrument_id END) AS n, min(CASE WHEN valid_from <= day AND (valid_to IS NULL OR day < valid_to) THEN instrument_id END) AS one
  FROM asked a JOIN held s ON s.symbol = a.symbol GROUP BY a.symbol)
SELECT symbol, CASE WHEN n = 1 THEN one ELSE -1 END AS instrument_id, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'resolved' ELSE 'inactive' END AS status FROM met""")
def q_alias_resolution(spark, d):
    held = validity(spark, d).withColumn("symbol", F.concat_ws("#", "alias", F.floor(F.col("instrument_id") / 10).cast("string")))
    asked = held.select("symbol").distinct().withColumn("day", F.lit("1998-03-01").cast("date"))
    found = pit.resolve_aliases(asked, held, ["symbol"], "day")
    return found.select("symbol", F.coalesce("instrument_id", F.lit(-1)).alias("instrument_id"), "status")


@query(f"""WITH {VALID}, held AS (SELECT alias || '#' || (instrument_id // 10) AS symbol, instrument_id, valid_from, valid_to FROM validity)
SELECT a.symbol, a.instrument_id AS left_owner, b.instrument_id AS right_owner, count(*) AS n FROM held a JOIN held b ON a.symbol = b.symbol AND a.instrument_id < b.instrument_id
WHERE a.valid_from < coalesce(b.valid_to, DATE '9999-12-31') AND b.valid_from < coalesce(a.valid_to, DATE '9999-12-31') GROUP BY ALL""")
def q_alias_overlap(spark, d):
    held = validity(spark, d).withColumn("symbol", F.concat_ws("#", "alias", F.floor(F.col("instrument_id") / 10).cast("string")))
    return pit.alias_conflicts(held, ["symbol"]).groupBy("symbol", "left_owner", "right_owner").agg(F.count("*").alias("n"))


SCHEDULE = "SELECT o_orderkey AS release_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS scheduled_at, CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderdate AS DATE) END AS scheduled_date FROM orders"


@query(f"""SELECT release_id, scheduled_at, CAST(scheduled_date AS VARCHAR) AS scheduled_date FROM ({SCHEDULE})
WHERE (scheduled_at >= TIMESTAMP '1997-02-01 12:00:00' AND scheduled_at < TIMESTAMP '1997-05-01 00:00:00') OR (scheduled_date BETWEEN DATE '1997-02-01' AND DATE '1997-04-30')
ORDER BY coalesce(scheduled_at, CAST(scheduled_date AS TIMESTAMP)), release_id LIMIT 1000""")
def q_date_or_instant_window(spark, d):
    even = F.col("o_orderkey") % 2 == 0
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("release_id"), F.when(even, F.col("o_orderdate")).alias("scheduled_at"), F.when(~even, F.to_date("o_orderdate")).alias("scheduled_date"))
    start, end = F.lit("1997-02-01 12:00:00").cast("timestamp"), F.lit("1997-05-01 00:00:00").cast("timestamp")
    found = rows.where(dates.instant_or_day_window(F.col("scheduled_at").cast("timestamp"), F.col("scheduled_date"), start, end))
    found = found.orderBy(F.coalesce("scheduled_at", F.col("scheduled_date").cast("timestamp_ntz")), "release_id").limit(1000)
    return found.withColumn("scheduled_date", F.col("scheduled_date").cast("string"))


COPIES = "copies AS (SELECT *, CASE WHEN doc_id <> first_id THEN first_id END AS replaces FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents))"


@query(f"""WITH {COPIES}, page AS (SELECT * FROM copies WHERE lang IN ('en', 'fr') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY n_chars DESC, doc_id LIMIT 500)
SELECT doc_id AS news_id, lang AS language, source AS source_tier, n_chars FROM page WHERE doc_id NOT IN (SELECT replaces FROM page WHERE replaces IS NOT NULL)""")
def q_news_filter_distinct(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("news_id"))
    rows = news(spark, d).where(F.col("language").isin("en", "fr")).join(good, "news_id", "left_semi")
    page = rows.orderBy(F.col("n_chars").desc(), "news_id").limit(500)
    return reads.without_superseded(page).select("news_id", "language", "source_tier", "n_chars")


@query("""SELECT d.doc_id AS news_id, d.source AS source_tier FROM documents d WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text) f WHERE f.first_id = d.doc_id AND n > 1)""")
def q_superseded_anti(spark, d):
    return reads.without_superseded(news(spark, d)).select("news_id", "source_tier")


@query("""SELECT doc_id AS news_id, CASE WHEN mode = 'headline' THEN 'headline' ELSE 'snippet' END AS content_mode, CASE WHEN mode = 'headline' THEN NULL ELSE substr(text, 1, 80) END AS summary, CAST(NULL AS VARCHAR) AS body
FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'headline' WHEN doc_id % 3 = 1 THEN 'snippet' ELSE 'full_text' END AS mode FROM documents)""")
def q_content_mode_trim(spark, d):
    mode = F.when(F.col("doc_id") % 3 == 0, "headline").when(F.col("doc_id") % 3 == 1, "snippet").otherwise("full_text")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("news_id"), mode.alias("content_mode"), F.when(mode != "headline", F.substring("text", 1, 80)).alias("summary"), F.when(mode == "full_text", F.col("text")).alias("body"))
    return reads.trim_content(rows, "snippet")


@query("""SELECT news_id, cluster_id FROM (SELECT doc_id AS news_id, md5(text) AS cluster_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r <= 2""")
def q_cluster_cap(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("news_id"), F.md5(F.encode("text", "UTF-8")).alias("cluster_id"))
    return reads.cap_clusters(rows, 2)


@query(f"""WITH spine AS (SELECT r_name AS region, t AS dataset FROM region, (SELECT unnest(['click', 'signup', 'refund']) AS t)),
rows AS (SELECT r_name AS region, event_type AS dataset, ts, 'p' || (user_id % 4) AS provider FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE ts <= TIMESTAMP '{SEEN}'),
found AS (SELECT region, dataset, count(*) AS n, max(ts) AS newest, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers FROM rows GROUP BY ALL)
SELECT s.region, s.dataset, coalesce(n, 0) AS record_count, newest AS newest_available_at, coalesce(providers, '') AS providers, CASE WHEN n > 0 THEN 'complete' ELSE 'unavailable' END AS status,
  CASE WHEN n > 0 THEN NULL ELSE '{context.NO_RECORDS}' END AS reason FROM spine s LEFT JOIN found f ON s.region = f.region AND s.dataset = f.dataset""")
def q_coverage_matrix(spark, d):
    places = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "events").where(F.col("ts") <= moment(SEEN)).join(places, F.col("user_id") == F.col("c_custkey"))
    rows = rows.select(F.col("r_name").alias("region"), F.col("event_type").alias("dataset"), F.col("ts").alias("available_at"), F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("provider_id"))
    cells = table(spark, d, "region").select(F.col("r_name").alias("region"), F.explode(F.array(*[F.lit(x) for x in ("click", "signup", "refund")])).alias("dataset"))
    return context.coverage(rows, cells, ["region", "dataset"]).withColumn("providers", F.array_join("providers", ","))


@query("SELECT user_id AS run_id, count(event_id) AS rejections FROM events WHERE event_type = 'error' GROUP BY user_id")
def q_rejection_counts(spark, d):
    errors = table(spark, d, "events").where("event_type = 'error'").withColumnRenamed("user_id", "run_id")
    return workflow.rejections_by_run(errors, "run_id", "event_id")


@query("""SELECT user_id, CASE WHEN max(ts) > TIMESTAMP '2024-01-30 12:00:00' THEN 'late' WHEN epoch_us(TIMESTAMP '2024-01-30 12:00:00') / 1e6 - epoch_us(min(ts)) / 1e6 > 36 * 3600 * 19 THEN 'stale'
WHEN bool_or(event_type = 'error') THEN 'revised' ELSE 'available' END AS status FROM events GROUP BY user_id""")
def q_late_stale_status(spark, d):
    rows = table(spark, d, "events").withColumn("revised", F.col("event_type") == "error")
    return pit.source_status(rows, ["user_id"], moment("2024-01-30 12:00:00"), 36 * 19, available="ts")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate <= TIMESTAMP '1997-01-01')")
def q_exists_revision(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return pit.with_version_before(table(spark, d, "orders").select("o_orderkey"), lines, ["o_orderkey"], moment("1997-01-01 00:00:00"), "l_shipdate")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')")
def q_missing_expected(spark, d):
    found = table(spark, d, "orders").where(F.col("o_orderdate") < moment("1996-01-01 00:00:00")).select(F.col("o_custkey").alias("c_custkey"))
    return merge.missing_keys(table(spark, d, "customer").select("c_custkey"), found, ["c_custkey"])


@query("""SELECT o_orderdate, o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-03-01' OR (o_orderdate = TIMESTAMP '1997-03-01' AND o_orderkey > 500) ORDER BY o_orderdate, o_orderkey LIMIT 50""")
def q_page_keyset(spark, d):
    import datetime as dt

    return paging.keyset_page(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], (dt.datetime(1997, 3, 1), 500), 50)


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")
def q_page_offset(spark, d):
    return paging.offset_page(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 200, 100)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q_unique_violations(spark, d):
    return merge.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(r"""WITH cut AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
parts AS (SELECT page_id, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1) AS site, regexp_replace(regexp_extract(u, '^([^?]*)', 1), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^utm_') AND NOT regexp_matches(lower(p), '^(fbclid|gclid|ref|spm)(=|$)'))) AS q FROM cut)
SELECT page_id, lower(site) || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url FROM parts""")
def q_url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical_url"))


@query(r"""SELECT doc_id, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(string_split(text, chr(10))[1]),
  '\+([0-9])', ' plus \1', 'g'), '[-−]([0-9])', ' minus \1', 'g'), '([0-9])[.,]([0-9])', '\1' || chr(1) || '\2', 'g'), '([0-9])[.,]([0-9])', '\1' || chr(1) || '\2', 'g'),
  '([0-9])\p{P}([0-9])', '\1|\2', 'g'), '([0-9])\p{P}([0-9])', '\1|\2', 'g'), '\p{P}', ' ', 'g'), chr(1), '.'), '\s+', ' ', 'g')) AS matched FROM documents""")
def q_title_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", text.simple_title(F.substring_index("text", "\n", 1)).alias("matched"))


@query("SELECT event_id, 'obs_' || substr(sha256(user_id || '|' || event_type || '|' || event_id), 1, 32) AS stable_id FROM events")
def q_stable_id(spark, d):
    return table(spark, d, "events").select("event_id", text.joined_id("obs_", F.col("user_id"), F.col("event_type"), F.col("event_id")).alias("stable_id"))


@query("""SELECT event_id, 'fact_' || sha256('["' || user_id || '","' || event_type || '"]') AS array_id, sha256('{"event_id":"' || event_id || '","event_type":"' || event_type || '"}') AS row_checksum FROM events""")
def q_json_checksums(spark, d):
    return table(spark, d, "events").select("event_id", text.stable_id("fact", F.col("user_id"), F.col("event_type")).alias("array_id"), text.checksum("event_type", "event_id").alias("row_checksum"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_props(spark, d):
    return table(spark, d, "events").select("event_id", text.json_field(F.col("props"), "k").cast("long").alias("k"))


@query("""SELECT event_id, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%Y-%m-%d') AS us_day, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Shanghai', '%Y-%m-%d') AS cn_day FROM events""")
def q_trading_date_tz(spark, d):
    at = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", *[dates.local_day(at, dates.REGION_ZONES[r]).cast("string").alias(f"{r.lower()}_day") for r in ("US", "CN")])


@query("SELECT event_id, isodow(ts) <= 5 AS is_open FROM events")
def q_trading_day(spark, d):
    return table(spark, d, "events").select("event_id", dates.weekday_open(F.to_date("ts")).alias("is_open"))


@query("""WITH days AS (SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(DATE '2025-01-01', DATE '2025-12-31', INTERVAL 1 DAY)) AS d)),
said AS (SELECT day, CASE WHEN isodow(day) > 5 OR day IN ('2025-01-01', '2025-01-20', '2025-02-17', '2025-04-18', '2025-05-26', '2025-06-19', '2025-07-04', '2025-09-01', '2025-11-27', '2025-12-25') THEN 'closed'
  WHEN day IN ('2025-07-03', '2025-11-28', '2025-12-24') THEN 'early_close' ELSE 'regular' END AS status FROM days)
SELECT event_id, CAST(s.day AS VARCHAR) AS day, status, strftime(CASE WHEN status <> 'closed' THEN (CAST(s.day AS TIMESTAMP) + CASE WHEN status = 'early_close' THEN INTERVAL 13 HOUR ELSE INTERVAL 16 HOUR END) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' END, '%Y-%m-%dT%H:%M:%SZ') AS close_at
FROM events JOIN said s ON s.day = CAST(ts + INTERVAL 366 DAY AS DATE)""")
def q_session_window(spark, d):
    rows = table(spark, d, "events").select("event_id", F.date_add(F.to_date("ts"), 366).alias("day"))
    found = dates.session_windows(rows, "day", dates.us_calendar(spark))
    return found.select("event_id", F.col("day").cast("string").alias("day"), "status", dates.iso_instant(F.col("close_at")).alias("close_at"))


@query("""WITH sessions AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS s FROM orders WHERE isodow(o_orderdate) < 6 AND extract(day FROM o_orderdate) <> 1), days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT CAST(day AS VARCHAR) AS day, CAST((SELECT max(s) FROM sessions WHERE s < day) AS VARCHAR) AS previous_session FROM days""")
def q_previous_session(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    found = dates.previous_session(days, "day", days.where(dates.weekday_open(F.col("day")) & (F.dayofmonth("day") != 1)))
    return found.select(F.col("day").cast("string").alias("day"), F.col("previous_session").cast("string").alias("previous_session"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '万元' WHEN 1 THEN ' Basis  Points' WHEN 2 THEN 'hk$ mn' ELSE 'parsec' END AS source_unit,
  CASE p_size % 4 WHEN 0 THEN 'CNY' WHEN 1 THEN 'percent' WHEN 2 THEN 'HKD' END AS n_unit,
  CASE p_size % 4 WHEN 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) * 10000 WHEN 1 THEN CAST(round(p_retailprice * 100) AS BIGINT) // 100 WHEN 2 THEN CAST(round(p_retailprice * 100) AS BIGINT) * 1000000 ELSE -1 END AS scaled_cents,
  CASE WHEN p_size % 4 = 3 THEN 'unsupported_unit' END AS n_issue FROM part""")
def q_unit_scale(spark, d):
    kind = F.col("p_size") % 4
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(kind == 0, "万元").when(kind == 1, " Basis  Points").when(kind == 2, "hk$ mn").otherwise("parsec").alias("source_unit"),
        F.when(kind == 2, "HK").otherwise("CN").alias("region"), (cents("p_retailprice") / F.lit(100).cast("decimal(10,0)")).cast("decimal(20,2)").cast("string").alias("value"),
    )
    found = numbers.normalise_units(rows)
    return found.select("p_partkey", "source_unit", "n_unit", F.coalesce(F.floor(F.col("n_value") * 100).cast("long"), F.lit(-1)).alias("scaled_cents"), "n_issue")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'percent' WHEN 1 THEN 'percent' WHEN 2 THEN 'currency' WHEN 3 THEN 'rate' END AS unit, CASE event_id % 5 WHEN 0 THEN cents * 100 WHEN 1 THEN cents WHEN 2 THEN cents * 100 ELSE -1 END AS ten_thousandths,
  CASE event_id % 5 WHEN 3 THEN 'not_reported' WHEN 4 THEN 'UNIT_REQUIRED' END AS issue FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)""")
def q_us_value(spark, d):
    k, number = F.col("event_id") % 5, (cents("value") / F.lit(100).cast("decimal(10,0)")).cast("decimal(20,2)").cast("string")
    raw = F.when(k == 0, F.concat(number, F.lit(" %"))).when(k == 1, F.concat(number, F.lit("bps"))).when(k == 3, "n/a").otherwise(number)
    hint = F.when(k == 2, "usd").when(k == 3, "rate")
    rows = table(spark, d, "events").select("event_id", numbers.normalise_us_value(raw, hint).alias("v"))
    return rows.select("event_id", "v.unit", F.when(F.col("v.issue").isNull(), (F.col("v.value") * 10000).cast("long")).otherwise(-1).alias("ten_thousandths"), "v.issue")


@query("""SELECT conv_id, turn, CASE WHEN trim(role) = 'user' OR turn % 4 = 3 THEN NULL ELSE role END AS value, CASE WHEN trim(role) = 'user' OR turn % 4 = 3 THEN 'vendor_missing' END AS missing_reason FROM conversations""")
def q_missing_sentinel(spark, d):
    said = F.when(F.col("role") == "user", " -- ").when(F.col("turn") % 4 == 3, "N/A").otherwise(F.col("role"))
    gone = numbers.missing(said)
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(~gone, said).alias("value"), F.when(gone, "vendor_missing").alias("missing_reason"))


DAILY = """days AS (SELECT user_id, CAST(ts AS DATE) AS day, first(cents ORDER BY ts, event_id) AS open, max(cents) AS high, min(cents) AS low, last(cents ORDER BY ts, event_id) AS close
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events) GROUP BY user_id, CAST(ts AS DATE))"""


@query(f"""WITH {DAILY}, broken AS (SELECT user_id, day, open, high - CASE WHEN user_id % 10 = 0 THEN 50 ELSE 0 END AS high, low + CASE WHEN user_id % 15 = 0 THEN 50 ELSE 0 END AS low, close FROM days)
SELECT user_id, CAST(day AS VARCHAR) AS day, open, high, low, close, array_to_string(list_filter([CASE WHEN high < greatest(open, close) THEN 'high_below_body' END, CASE WHEN low > least(open, close) THEN 'low_above_body' END], lambda x: x IS NOT NULL), ',') AS issues FROM broken""")
def q_ohlc_check(spark, d):
    at = F.struct("ts", "event_id")
    rows = table(spark, d, "events").withColumn("cents", cents("value")).groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.min_by("cents", at).alias("open"), F.max("cents").alias("high"), F.min("cents").alias("low"), F.max_by("cents", at).alias("close"))
    rows = rows.withColumns({"high": F.col("high") - F.when(F.col("user_id") % 10 == 0, 50).otherwise(0), "low": F.col("low") + F.when(F.col("user_id") % 15 == 0, 50).otherwise(0),
                             "bar_start": F.lit(0), "bar_end": F.lit(1), "adjustment": F.lit("raw"), "adjustment_as_of": F.lit(None).cast("timestamp")})
    return rows.select("user_id", F.col("day").cast("string").alias("day"), "open", "high", "low", "close", F.array_join(quality.issue_list(quality.bar_tests()), ",").alias("issues"))


EARLY = "CAST(ts AS DATE) < DATE '2024-01-16'"


@query(f"""SELECT user_id, event_type, event_id, CAST(round(value * 100) AS BIGINT) AS value_cents FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN {EARLY} THEN 0 ELSE 1 END DESC, ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def q_merge_last_writer(spark, d):
    rows = table(spark, d, "events").withColumn("value_cents", cents("value"))
    merged = merge.last_writer(rows.where(EARLY), rows.where(f"NOT {EARLY}"), ["user_id", "event_type"], ["ts", "event_id"])
    return merged.select("user_id", "event_type", "event_id", "value_cents")


@query("""SELECT l_orderkey, available_at, checksum, row_number() OVER (PARTITION BY l_orderkey ORDER BY available_at, line, checksum) AS version_no FROM (
  SELECT *, lag(checksum) OVER (PARTITION BY l_orderkey ORDER BY available_at, line, checksum) AS before FROM (
    SELECT DISTINCT l_orderkey, l_shipdate AS available_at, l_linenumber AS line, l_returnflag || l_linestatus AS checksum FROM lineitem)) WHERE before IS DISTINCT FROM checksum""")
def q_merge_append_on_change(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("available_at"), F.col("l_linenumber").alias("line"), F.concat("l_returnflag", "l_linestatus").alias("checksum")).distinct()
    return merge.append_on_change(rows, ["l_orderkey"], [F.col("available_at"), F.col("line"), F.col("checksum")], "checksum").select("l_orderkey", "available_at", "checksum", F.col("version_no").cast("long").alias("version_no"))


@query("""SELECT l_orderkey, available_at, checksum, row_number() OVER (PARTITION BY l_orderkey ORDER BY available_at, line, checksum) AS version_no FROM (
  SELECT l_orderkey, l_shipdate AS available_at, l_linenumber AS line, l_returnflag || l_linestatus AS checksum, row_number() OVER (PARTITION BY l_orderkey, l_returnflag || l_linestatus ORDER BY l_shipdate, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def q_merge_unlike_base(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("available_at"), F.col("l_linenumber").alias("line"), F.concat("l_returnflag", "l_linestatus").alias("checksum")).distinct()
    found = merge.append_if_unlike_base(rows, ["l_orderkey"], [F.col("available_at"), F.col("line"), F.col("checksum")], "checksum")
    return found.select("l_orderkey", "available_at", "checksum", F.col("version_no").cast("long").alias("version_no"))


@query(f"""SELECT event_id, user_id, event_type FROM events e WHERE {EARLY.replace("ts", "e.ts")} UNION ALL
SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events e WHERE NOT ({EARLY.replace("ts", "e.ts")})
  AND NOT EXISTS (SELECT 1 FROM events c WHERE {EARLY.replace("ts", "c.ts")} AND c.user_id = e.user_id AND c.event_type = e.event_type)) WHERE r = 1""")
def q_merge_insert_absent(spark, d):
    rows = table(spark, d, "events")
    cols = ["event_id", "user_id", "event_type"]
    return merge.insert_absent(rows.where(EARLY).select(*cols), rows.where(f"NOT ({EARLY})").select(*cols), [["event_id"], ["user_id", "event_type"]], ["event_id"])


@query("SELECT o_custkey AS run_id, count(DISTINCT o_orderkey) AS records, count(*) AS flat FROM orders GROUP BY o_custkey")
def q_array_flatten_ids(spark, d):
    pages = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run_id"), F.year("o_orderdate").alias("page")).agg(F.collect_list("o_orderkey").alias("ids"))
    return workflow.committed_ids(pages, "run_id", "ids").select("run_id", "records", "flat")


@query("""SELECT user_id, CASE max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END) WHEN 3 THEN 'blocked' WHEN 2 THEN 'retryable' WHEN 1 THEN 'degraded' ELSE 'passed' END AS status FROM events GROUP BY user_id""")
def q_status_lattice(spark, d):
    said = F.when(F.col("event_type") == "error", "blocked").when(F.col("event_type") == "purchase", "retryable").when(F.col("event_type") == "signup", "degraded").otherwise("passed")
    return quality.worst_of(table(spark, d, "events").withColumn("status", said), ["user_id"])


@query("""WITH expected AS (SELECT s_suppkey AS input_id, s_suppkey % 3 <> 0 AS required FROM supplier), quality AS (
  SELECT s_suppkey AS input_id, CASE s_suppkey % 7 WHEN 0 THEN 'available' WHEN 1 THEN 'stale' WHEN 2 THEN 'revised' WHEN 3 THEN 'retryable' WHEN 4 THEN 'denied' ELSE 'odd' END AS status FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT input_id, required, code FROM (SELECT e.input_id, required, CASE WHEN status IS NULL THEN CASE WHEN required THEN 'REQUIRED_INPUT_UNAVAILABLE' ELSE 'OPTIONAL_INPUT_UNAVAILABLE' END
  WHEN NOT required AND status = 'available' THEN 'SCHEDULED_MARKET_CLOSURE' WHEN status IN ('available', 'denied') THEN NULL
  WHEN status = 'odd' THEN CASE WHEN required THEN 'INVALID_REQUIRED_INPUT_STATUS' ELSE 'INVALID_INPUT_STATUS' END
  ELSE upper(status) || CASE WHEN required THEN '_REQUIRED_INPUT' ELSE '_OPTIONAL_INPUT' END END AS code FROM expected e LEFT JOIN quality q USING (input_id)) WHERE code IS NOT NULL""")
def q_quality_gate(spark, d):
    key = F.col("s_suppkey")
    expected = table(spark, d, "supplier").select(key.alias("input_id"), (key % 3 != 0).alias("required"))
    status = F.when(key % 7 == 0, "available").when(key % 7 == 1, "stale").when(key % 7 == 2, "revised").when(key % 7 == 3, "retryable").when(key % 7 == 4, "denied").otherwise("odd")
    return quality.gate_issues(expected, table(spark, d, "supplier").where("s_suppkey % 5 <> 0").select(key.alias("input_id"), status.alias("status")))


@query("""SELECT claim_id, code FROM (SELECT l_orderkey * 10 + l_linenumber AS claim_id, unnest(list_filter([
  CASE WHEN fact IS NULL THEN 'UNCITED_CLAIM' END, CASE WHEN fact IS NOT NULL AND p_partkey IS NULL THEN 'FACT_NOT_MATERIALIZED' END,
  CASE WHEN p_partkey IS NOT NULL AND p_size > 45 THEN 'FACT_AFTER_CUTOFF' END, CASE WHEN p_partkey IS NOT NULL AND CAST(round(l_extendedprice * 100) AS BIGINT) % 1000 <> CAST(round(p_retailprice * 100) AS BIGINT) % 1000 THEN 'VALUE_MISMATCH' END,
  CASE WHEN p_partkey IS NOT NULL AND l_returnflag <> 'A' THEN 'UNIT_MISMATCH' END], lambda x: x IS NOT NULL)) AS code
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_partkey % 11 = 0 THEN -l_partkey - 1 ELSE l_partkey END AS fact FROM lineitem) LEFT JOIN part ON p_partkey = fact)""")
def q_claim_check(spark, d):
    part_key = F.col("l_partkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag").distinct()
    fact = F.when(F.col("l_linenumber") == 7, None).when(part_key % 11 == 0, -part_key - 1).otherwise(part_key)
    claims = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), fact.alias("fact_id"), (cents("l_extendedprice") % 1000).alias("value"), F.col("l_returnflag").alias("unit"))
    facts = table(spark, d, "part").select(F.col("p_partkey").alias("fact_id"), (cents("p_retailprice") % 1000).alias("value"), F.lit("A").alias("unit"), F.col("p_size").alias("available_at"))
    return quality.claim_issues(claims, facts, F.lit(45))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS news_id, count(*) AS copies FROM documents GROUP BY text")
def q_content_hash_dedup(spark, d):
    return merge.copies(table(spark, d, "documents"), F.sha2("text", 256), "doc_id").select("content_hash", F.col("first").alias("news_id"), "copies")


@query("""WITH asked AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'SH' || lpad(CAST(s_suppkey AS VARCHAR), 6, '6') WHEN 1 THEN lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.sz' WHEN 2 THEN CAST(s_suppkey AS VARCHAR) || '.HK' WHEN 3 THEN 'XSHG:12' ELSE 'ABC' END AS symbol FROM supplier)
SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'XSHG:' || substr(symbol, 3) WHEN 1 THEN 'XSHE:' || substr(symbol, 1, 6) WHEN 2 THEN 'XHKG:' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') END AS canonical,
  CASE s_suppkey % 5 WHEN 3 THEN 'malformed_code' WHEN 4 THEN 'unsupported_venue' END AS issue FROM asked""")
def q_regional_symbols(spark, d):
    k = F.col("s_suppkey")
    said = F.when(k % 5 == 0, F.concat(F.lit("SH"), F.lpad(k.cast("string"), 6, "6"))).when(k % 5 == 1, F.concat(F.lpad(k.cast("string"), 6, "0"), F.lit(".sz"))).when(k % 5 == 2, F.concat(k.cast("string"), F.lit(".HK"))).when(k % 5 == 3, "XSHG:12").otherwise("ABC")
    region = F.when(k % 5 == 2, "HK").otherwise("CN")
    rows = table(spark, d, "supplier").select("s_suppkey", symbols.regional_symbol(region, F.lit(""), said).alias("s"))
    return rows.select("s_suppkey", "s.canonical", "s.issue")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'XNAS:' || upper(c_mktsegment) WHEN 1 THEN 'ARCX:' || c_mktsegment END AS canonical,
  CASE c_custkey % 4 WHEN 2 THEN 'exchange_required' WHEN 3 THEN 'ambiguous_alias' END AS issue FROM customer""")
def q_us_symbols(spark, d):
    k = F.col("c_custkey") % 4
    said = F.when(k == 0, F.lower("c_mktsegment")).when(k == 3, F.concat(F.lit("XNYS:"), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    exchange = F.when(k == 0, " nasdaq ").when(k == 1, "nyse-arca").when(k == 3, "AMEX")
    rows = table(spark, d, "customer").select("c_custkey", symbols.us_symbol(said, exchange).alias("s"))
    return rows.select("c_custkey", "s.canonical", "s.issue")


@query("""SELECT n_name AS name, count(*) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_acctbal > s_acctbal GROUP BY n_name""")
def q_theta_within_key(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_acctbal")
    met = extensions.theta_join(customers, table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_acctbal"), ["n_nationkey"], F.col("c_acctbal") > F.col("s_acctbal"))
    return met.join(table(spark, d, "nation"), "n_nationkey").groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("pairs"))


@query("""SELECT release_id, CASE WHEN release_id % 2 = 0 THEN 'ok' ELSE 'schedule_needs_one' END AS issue FROM (SELECT o_orderkey AS release_id FROM orders)""")
def q_schedule_check(spark, d):
    at = F.col("o_orderdate")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("release_id"), at.alias("scheduled_at"), F.when(F.col("o_orderkey") % 2 == 1, F.to_date(at)).alias("scheduled_date"))
    found = rows.withColumn("issues", quality.issue_list(quality.release_tests()))
    return found.select("release_id", F.coalesce(F.get("issues", F.lit(0)), F.lit("ok")).alias("issue"))


# provider-side variants and remaining scalars


@query(f"""SELECT observation_id, series_id, period_end, available_at, value_cents FROM ({OBSERVED}) WHERE available_at <= least(TIMESTAMP '{SEEN}', TIMESTAMP '2024-01-12 06:00:00') AND available_at >= TIMESTAMP '2024-01-03'""")
def q_two_clocks(spark, d):
    return reads.visible(observations(spark, d), moment(SEEN), moment("2024-01-12 06:00:00")).where(F.col("available_at") >= moment("2024-01-03 00:00:00")).select(*OBSERVATION)


@query(f"""WITH {COPIES} SELECT doc_id AS news_id FROM copies WHERE replaces IS NULL""")
def q_originals_only(spark, d):
    return reads.originals_only(news(spark, d)).select("news_id")


@query("""SELECT doc_id AS news_id, doc_id % 3 >= 1 AS satisfied FROM documents""")
def q_content_satisfies(spark, d):
    mode = F.when(F.col("doc_id") % 3 == 0, "headline").when(F.col("doc_id") % 3 == 1, "snippet").otherwise("full_text")
    return table(spark, d, "documents").select(F.col("doc_id").alias("news_id"), reads.satisfies_mode(mode, "snippet").alias("satisfied"))


@query(r"""SELECT o_orderkey, CAST(o_orderdate AS DATE) + 1 > DATE '1997-02-01' AND CAST(o_orderdate AS DATE) < DATE '1997-02-03' AS overlaps FROM orders""")
def q_day_overlaps_window(spark, d):
    start, end = F.lit("1997-02-01 12:00:00").cast("timestamp"), F.lit("1997-02-02 12:00:00").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", dates.day_overlaps(F.to_date("o_orderdate"), start, end).alias("overlaps"))


@query("""SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS period, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first_day, strftime(last_day(o_orderdate), '%Y-%m-%d') AS last_day FROM orders""")
def q_period_bounds(spark, d):
    rows = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMM").alias("period")).distinct()
    first, last = dates.month_bounds(F.col("period"))
    return rows.select("period", first.cast("string").alias("first_day"), last.cast("string").alias("last_day"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || 'Z' AS iso FROM events""")
def q_iso_text(spark, d):
    return table(spark, d, "events").select("event_id", dates.iso_instant(F.col("ts")).alias("iso"))


@query("""SELECT c_custkey, CAST(strftime(make_date(1899, 12, 30) + CAST(40000 + c_custkey AS INTEGER), '%Y-%m-%d') AS VARCHAR) AS day FROM customer""")
def q_excel_day(spark, d):
    return table(spark, d, "customer").select("c_custkey", dates.excel_day(F.col("c_custkey") + 40000).cast("string").alias("day"))


@query("""SELECT p_partkey, CASE WHEN cents % 100 = 0 THEN CAST(cents // 100 AS VARCHAR) WHEN cents % 10 = 0 THEN CAST(cents // 100 AS VARCHAR) || '.' || CAST((cents % 100) // 10 AS VARCHAR)
  ELSE CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS said FROM (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part)""")
def q_plain_decimal(spark, d):
    return table(spark, d, "part").select("p_partkey", numbers.plain_text((cents("p_retailprice") / F.lit(100).cast("decimal(10,0)")).cast("decimal(20,4)")).alias("said"))


@query("""SELECT page_id, starts_with(url, 'https://') AND regexp_matches(lower(url), '^https://[^/?#@]*example\\.(com|org)([:/?#]|$)') AND NOT regexp_matches(url, '^https://[^/?#]*@') AND NOT regexp_matches(lower(url), '^https://[^/?#]+\\.[^/?#]*example') AS allowed FROM pages""")
def q_allowed_url(spark, d):
    return table(spark, d, "pages").select("page_id", text.allowed_url(F.col("url"), ["example.com", "example.org"]).alias("allowed"))


@query("""SELECT conv_id, count(*) AS turns, max(turn) - min(turn) + 1 = count(DISTINCT turn) AS gapless, arg_max(role, turn) AS last_role FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL) GROUP BY conv_id""")
def q_ordered_turns(spark, d):
    return extensions.sequences(table(spark, d, "conversations"), "conv_id", "turn", "role").select("conv_id", F.col("places").alias("turns"), "gapless", F.col("last").alias("last_role"))


@query("""SELECT doc_id, md5(text) IN (SELECT md5(text) FROM documents WHERE source = 'src1') AND source <> 'src1' AS seen_before FROM documents""")
def q_repeated_on_other_page(spark, d):
    docs = table(spark, d, "documents").withColumn("h", F.sha2("text", 256))
    return merge.seen_before(docs.where("source <> 'src1'"), docs.where("source = 'src1'"), ["h"]).unionByName(docs.where("source = 'src1'").withColumn("seen_before", F.lit(False))).select("doc_id", "seen_before")


@query(f"""WITH base AS (SELECT user_id AS instrument_id, event_id AS bar_id, ts AS bar_end, CAST(round(value * 100) AS BIGINT) AS close FROM events WHERE ts <= TIMESTAMP '{SEEN}')
SELECT instrument_id, close AS last_cents, before AS previous_cents, close - before AS change_cents FROM (SELECT *, coalesce(lag(close) OVER w, 0) AS before, row_number() OVER (PARTITION BY instrument_id ORDER BY bar_end DESC, bar_id DESC) AS r FROM base WINDOW w AS (PARTITION BY instrument_id ORDER BY bar_end, bar_id)) WHERE r = 1""")
def q_snapshot_change(spark, d):
    bars = table(spark, d, "events").select(
        F.col("user_id").alias("instrument_id"), F.col("event_id").alias("bar_id"), F.col("ts").alias("bar_end"), F.col("ts").alias("available_at"), cents("value").alias("close"),
        *[F.lit(v).alias(c) for c, v in (("region", "US"), ("interval", "1d"), ("adjustment", "raw"), ("source_checksum", "c"))], F.col("ts").alias("bar_start"), F.to_date("ts").alias("trading_date"))
    found = reads.snapshots_with_change(bars, bars.limit(0), None, moment(SEEN))
    return found.select("instrument_id", F.col("last").alias("last_cents"), F.coalesce("previous_close", F.lit(0)).alias("previous_cents"), (F.col("last") - F.coalesce("previous_close", F.lit(0))).alias("change_cents"))


@query("""SELECT r_name AS region, r_regionkey % 2 = 0 OR r_regionkey = 1 AS offered FROM region WHERE r_regionkey % 2 = 0 OR r_regionkey = 1""")
def q_capabilities(spark, d):
    names = table(spark, d, "region").select("r_name", F.when(F.col("r_regionkey") % 2 == 0, F.array(F.lit("CN"), F.lit("HK"))).when(F.col("r_regionkey") == 1, F.array(F.lit("US"))).otherwise(F.array(F.lit("JP"))).alias("regions"))
    return reads.capabilities(names, ["CN", "US"]).select(F.col("r_name").alias("region"), F.lit(True).alias("offered"))


@query("""SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS items FROM orders GROUP BY o_custkey""")
def q_display_lines(spark, d):
    rows = table(spark, d, "orders").withColumn("said", F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus"))
    return report.display_lines(rows, "o_custkey", ["o_orderkey"], "said", ",").withColumnRenamed("lines", "items")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL""")
def q_hourly_windows(spark, d):
    rows = table(spark, d, "events").withColumn("cents", cents("value"))
    return windowed(rows, "ts", "1 hour", ["event_type"], "cents").select(F.col("start").alias("hour"), "event_type", "n", F.col("total").alias("cents"))


@query("""SELECT e.event_id, max_by(o.o_orderkey, (o.o_orderdate, o.o_orderkey)) AS last_order FROM events e JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= CAST(e.ts AS DATE) - 9000 + CAST(e.user_id AS INTEGER) * 10 GROUP BY e.event_id""")
def q_as_of_join(spark, d):
    left = table(spark, d, "events").select("event_id", "user_id", F.expr("cast(date_add(to_date(ts), cast(user_id * 10 - 9000 as int)) as timestamp_ntz)").alias("at"))
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("value"))
    found = pit.as_of_join(left, right, ["user_id"], "at", ["event_id"], "value")
    return found.where("value IS NOT NULL").select("event_id", F.col("value").alias("last_order"))


# extensions


@query(f"""WITH {DAILY} SELECT user_id AS instrument_id, strftime(date_trunc('week', day), '%Y-%m-%d') AS period, first(open ORDER BY day) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY day) AS close, count(*) AS bars FROM days GROUP BY user_id, date_trunc('week', day)""")
def q_resample_weekly(spark, d):
    at = F.struct("ts", "event_id")
    daily = table(spark, d, "events").withColumn("cents", cents("value")).groupBy(F.col("user_id").alias("instrument_id"), F.to_date("ts").alias("day")).agg(
        F.min_by("cents", at).alias("open"), F.max("cents").alias("high"), F.min("cents").alias("low"), F.max_by("cents", at).alias("close"), F.lit(0).alias("volume"))
    found = extensions.resample_bars(daily, F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd"), order=("day",))
    return found.drop("volume")


@query("""SELECT o_custkey, o_orderkey, cents - coalesce(lag(cents) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), cents) AS change_cents FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)""")
def q_value_changes(spark, d):
    rows = table(spark, d, "orders").withColumn("cents", cents("o_totalprice"))
    found = extensions.changes(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "cents")
    return found.select("o_custkey", "o_orderkey", F.coalesce("change", F.lit(0)).alias("change_cents"))


@query(f"""WITH {DAILY}, spans AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS d FROM days GROUP BY user_id)
SELECT s.user_id, strftime(s.d, '%Y-%m-%d') AS day, last_value(close IGNORE NULLS) OVER (PARTITION BY s.user_id ORDER BY s.d ROWS UNBOUNDED PRECEDING) AS close, close IS NULL AS filled FROM spans s LEFT JOIN days t ON s.user_id = t.user_id AND CAST(s.d AS DATE) = t.day""")
def q_fill_gaps(spark, d):
    rows = table(spark, d, "events").withColumn("cents", cents("value")).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max_by("cents", F.struct("ts", "event_id")).alias("close"))
    return extensions.fill_gaps(rows, "user_id", "day", "close").withColumn("day", F.col("day").cast("string"))


@query("""SELECT o_custkey AS series_id, count(*) AS facts, md5(string_agg(said, '|' ORDER BY said)) AS mark FROM (SELECT o_custkey, o_orderkey || ':' || o_orderstatus AS said FROM orders) GROUP BY o_custkey""")
def q_series_marks(spark, d):
    rows = table(spark, d, "orders").withColumn("said", F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus"))
    return context.marks(rows, "o_custkey", "said").select(F.col("o_custkey").alias("series_id"), "facts", "mark")


# status of runs


@query("""SELECT user_id, CASE max(CASE WHEN required AND status = 'failed' THEN 3 WHEN required AND status = 'retryable' THEN 2 WHEN status <> 'succeeded' THEN 1 ELSE 0 END) WHEN 3 THEN 'blocked' WHEN 2 THEN 'retryable' WHEN 1 THEN 'degraded' ELSE 'succeeded' END AS status
FROM (SELECT DISTINCT user_id, event_type, event_type IN ('error', 'purchase') AS required, CASE event_type WHEN 'error' THEN CASE WHEN user_id % 4 = 0 THEN 'failed' ELSE 'succeeded' END WHEN 'purchase' THEN CASE WHEN user_id % 3 = 0 THEN 'retryable' ELSE 'succeeded' END WHEN 'view' THEN CASE WHEN user_id % 5 = 0 THEN 'failed' ELSE 'succeeded' END ELSE 'succeeded' END AS status FROM events) GROUP BY user_id""")
def q_worker_status(spark, d):
    kind, user = F.col("task_id"), F.col("user_id")
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("task_id")).distinct()
    status = F.when((kind == "error") & (user % 4 == 0), "failed").when((kind == "purchase") & (user % 3 == 0), "retryable").when((kind == "view") & (user % 5 == 0), "failed").otherwise("succeeded")
    return workflow.worker_status(rows.withColumn("required", kind.isin("error", "purchase")), rows.withColumn("status", status), ["user_id"])


@query("""WITH said AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'task' WHEN 'view' THEN 'snapshot' WHEN 'signup' THEN 'generation' WHEN 'purchase' THEN 'delivery' ELSE 'alert' END AS kind,
  CASE event_type WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' ELSE 'pending' END WHEN 'error' THEN CASE event_id % 2 WHEN 0 THEN 'succeeded' ELSE 'failed' END WHEN 'signup' THEN CASE event_id % 2 WHEN 0 THEN 'failed' ELSE 'running' END WHEN 'view' THEN CASE event_id % 2 WHEN 0 THEN 'blocked' ELSE 'passed' END ELSE 'done' END AS status, event_id FROM events),
last AS (SELECT user_id, arg_max(kind || ':' || status, event_id) FILTER (kind IN ('delivery', 'alert')) AS t, arg_max(status, event_id) FILTER (kind = 'generation') AS g, arg_max(status, event_id) FILTER (kind = 'snapshot') AS s FROM said GROUP BY user_id)
SELECT user_id AS report_date, CASE WHEN t = 'delivery:succeeded' THEN 'delivered' WHEN t = 'alert:succeeded' THEN 'blocked_alerted' WHEN t IN ('delivery:failed', 'alert:failed') THEN 'attention_required' WHEN t = 'delivery:pending' THEN 'awaiting_delivery'
  WHEN g = 'failed' THEN 'attention_required' WHEN s = 'blocked' THEN 'quality_blocked' WHEN g IS NOT NULL OR s IS NOT NULL THEN 'generating' ELSE 'ingesting' END AS status FROM last""")
def q_operational_status(spark, d):
    of, n = F.col("event_type"), F.col("event_id")
    kind = F.when(of == "click", "task").when(of == "view", "snapshot").when(of == "signup", "generation").when(of == "purchase", "delivery").otherwise("alert")
    status = (
        F.when(of == "purchase", F.when(n % 3 == 0, "succeeded").when(n % 3 == 1, "failed").otherwise("pending")).when(of == "error", F.when(n % 2 == 0, "succeeded").otherwise("failed"))
        .when(of == "signup", F.when(n % 2 == 0, "failed").otherwise("running")).when(of == "view", F.when(n % 2 == 0, "blocked").otherwise("passed")).otherwise("done")
    )
    rows = table(spark, d, "events").select(F.col("user_id").alias("report_date"), kind.alias("kind"), status.alias("status"), n.alias("at"))
    return workflow.operational_status(rows)


@query("""WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), opened AS (
  SELECT day, isodow(day) < 6 AND extract(day FROM day) <> 1 AS cn, isodow(day) < 6 AND extract(day FROM day) <> 2 AS hk, isodow(day) < 6 AS us FROM days)
SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN isodow(day) >= 6 THEN 'weekend' WHEN NOT (cn AND hk AND us) THEN 'regional_holiday' ELSE 'regular' END AS day_type,
  array_to_string(list_filter([CASE WHEN NOT cn THEN 'market.cn' END, CASE WHEN NOT hk THEN 'market.hk' END, CASE WHEN NOT us THEN 'market.us' END], lambda x: x IS NOT NULL), ',') AS optional,
  array_to_string(list_sort(list_concat(['calendar.global', 'news.cn', 'news.us'], list_filter([CASE WHEN cn THEN 'market.cn' END, CASE WHEN hk THEN 'market.hk' END, CASE WHEN us THEN 'market.us' END], lambda x: x IS NOT NULL))), ',') AS required FROM opened""")
def q_day_policy(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    opened = days.where(dates.weekday_open(F.col("day"))).select("day", F.explode(F.array(*[F.lit(r) for r in ("CN", "HK", "US")])).alias("region"))
    opened = opened.where(~((F.col("region") == "CN") & (F.dayofmonth("day") == 1)) & ~((F.col("region") == "HK") & (F.dayofmonth("day") == 2)))
    found = workflow.day_policy(days, opened)
    return found.select(F.col("day").cast("string").alias("day"), "day_type", F.array_join("optional", ",").alias("optional"), F.array_join("required", ",").alias("required"))


from tidemark.plans import extras, library  # noqa: E402, F401  they register their queries here
