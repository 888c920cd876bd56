"""Registered queries that read and merge through the library's own paths, over tables that stand in for facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, symbols
from tidemark.operators import evidence, extensions, merge, pit
from tidemark.operators import queries as reads
from tidemark.plans.catalogue import BASES, KNOWN, OBSERVED, SEEN, query
from tidemark.plans.facts import cents, line_revisions, moment, order_bases, table
from tidemark.sources import records

BAR_SQL = f"""WITH {BASES}, current AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY available_at DESC, version_rank DESC, coalesce(source_checksum, '') DESC) AS r
  FROM versions WHERE available_at <= TIMESTAMP '{KNOWN}') WHERE r = 1),
bars AS (SELECT fact_id, c.owner_id, o_orderdate AS bar_start, o_orderdate + INTERVAL 1 DAY AS bar_end, value_cents, c.available_at FROM current c JOIN orders ON o_orderkey = fact_id)"""


def bars(spark, d):
    """Orders as daily bars and their lines as revisions."""
    start = F.col("o_orderdate")
    base = order_bases(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("fact_id"), "o_orderdate"), "fact_id").select(
        F.col("fact_id").alias("bar_id"), F.col("owner_id").alias("instrument_id"), F.lit("US").alias("region"), F.lit("1d").alias("interval"), F.lit("raw").alias("adjustment"), start.alias("bar_start"),
        (start + F.expr("INTERVAL 1 DAY")).alias("bar_end"), F.to_date(start).alias("trading_date"), F.col("value_cents").alias("close"), "available_at", "source_checksum")
    revisions = line_revisions(spark, d).select(F.col("fact_id").alias("bar_id"), F.col("value_cents").alias("close"), "available_at", "source_checksum")
    return base, revisions


@query(BAR_SQL + """ SELECT fact_id AS bar_id, owner_id AS instrument_id, bar_start, value_cents AS close FROM bars
WHERE bar_start >= TIMESTAMP '1996-03-01' AND bar_start < TIMESTAMP '1997-09-01' ORDER BY instrument_id, bar_start, bar_id LIMIT 5000""")
def q_list_bars(spark, d):
    base, revisions = bars(spark, d)
    found = reads.list_bars(base, revisions, None, moment("1996-03-01 00:00:00"), moment("1997-09-01 00:00:00"), moment(KNOWN))
    return found.select("bar_id", "instrument_id", "bar_start", "close")


@query(BAR_SQL + """ SELECT owner_id AS instrument_id, value_cents AS last, bar_end FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY bar_end DESC, available_at DESC, fact_id DESC) AS r FROM bars) WHERE r = 1""")
def q_list_snapshots(spark, d):
    base, revisions = bars(spark, d)
    return reads.list_snapshots(base, revisions, None, moment(KNOWN)).select("instrument_id", "last", "bar_end")


@query("""SELECT n_nationkey AS series_id, r_name AS region, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE', 'AMERICA') ORDER BY n_nationkey LIMIT 1000""")
def q_list_macro_series(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("series_id"), F.col("r_name").alias("region"), F.col("n_name").alias("name"))
    return reads.list_macro_series(rows, regions=["ASIA", "EUROPE", "AMERICA"])


@query(f"""SELECT series_id, CAST(period_end AS VARCHAR) AS period_end, observation_id, value_cents FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, period_end ORDER BY available_at DESC, revision_no DESC, observation_id DESC) AS r FROM (
    SELECT observation_id, series_id, CAST(available_at AS DATE) AS period_end, available_at, observation_id % 3 AS revision_no, value_cents FROM ({OBSERVED})) WHERE available_at <= TIMESTAMP '{SEEN}' AND period_end BETWEEN DATE '2024-01-04' AND DATE '2024-01-12')
WHERE r = 1 ORDER BY series_id, period_end, available_at, revision_no LIMIT 5000""")
def q_list_macro_observations(spark, d):
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("observation_id"), F.col("user_id").alias("series_id"), F.to_date("ts").alias("period_end"), F.col("ts").alias("available_at"), (F.col("event_id") % 3).alias("revision_no"), cents("value").alias("value_cents"))
    found = reads.list_macro_observations(rows, None, F.lit("2024-01-04").cast("date"), F.lit("2024-01-12").cast("date"), moment(SEEN))
    return found.select("series_id", F.col("period_end").cast("string").alias("period_end"), "observation_id", "value_cents")


@query(f"""WITH {BASES}, current AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY available_at DESC, version_rank DESC, coalesce(source_checksum, '') DESC) AS r
  FROM versions WHERE available_at <= TIMESTAMP '{KNOWN}') WHERE r = 1)
SELECT fact_id AS release_id, value_cents AS actual, source_checksum FROM current JOIN orders ON o_orderkey = fact_id
WHERE (o_orderkey % 2 = 0 AND o_orderdate >= TIMESTAMP '1996-02-01 12:00:00' AND o_orderdate < TIMESTAMP '1996-12-01') OR (o_orderkey % 2 = 1 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1996-11-30')
ORDER BY o_orderdate, release_id LIMIT 1000""")
def q_list_macro_releases(spark, d):
    even = F.col("o_orderkey") % 2 == 0
    base = order_bases(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("fact_id"), "o_orderkey", "o_orderdate"), "fact_id").select(
        F.col("fact_id").alias("release_id"), F.lit("US").alias("region"), F.lit("s").alias("series_id"), F.when(even, F.col("o_orderdate").cast("timestamp")).alias("scheduled_at"), F.when(~even, F.to_date("o_orderdate")).alias("scheduled_date"),
        F.col("value_cents").alias("actual"), F.col("available_at").cast("timestamp").alias("available_at"), "source_checksum")
    revisions = line_revisions(spark, d).select(F.col("fact_id").alias("release_id"), F.col("value_cents").alias("actual"), F.col("available_at").cast("timestamp").alias("available_at"), "source_checksum")
    at = lambda t: F.lit(t).cast("timestamp")
    found = reads.list_macro_releases(base, revisions, at("1996-02-01 12:00:00"), at("1996-12-01 00:00:00"), at(KNOWN))
    return found.select("release_id", "actual", "source_checksum")


DAY = "TIMESTAMP '2024-01-01'"


@query(f"""WITH firsts AS (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text),
rows AS (SELECT d.doc_id, lang, CASE WHEN d.doc_id <> first_id THEN first_id END AS replaces, {DAY} + INTERVAL 1 HOUR * (d.doc_id % 900) AS t FROM documents d JOIN firsts f ON f.text IS NOT DISTINCT FROM d.text),
page AS (SELECT * FROM rows WHERE lang IN ('en', 'fr') AND t >= TIMESTAMP '2024-01-05' AND t < TIMESTAMP '2024-01-30' AND t <= TIMESTAMP '2024-01-25' ORDER BY t DESC, doc_id LIMIT 500)
SELECT doc_id AS news_id, lang AS language, 'headline' AS content_mode, t AS published_at FROM page WHERE doc_id NOT IN (SELECT replaces FROM page WHERE replaces IS NOT NULL)""")
def q_list_news(spark, d):
    docs = table(spark, d, "documents")
    first = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_id"))
    at = F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 900) * 3600)
    rows = docs.withColumn("own", F.sha2("text", 256)).join(first, F.col("own").eqNullSafe(F.col("h"))).select(
        F.col("doc_id").alias("news_id"), F.array(F.lit("US")).alias("regions"), F.lit("t").alias("title"), F.col("lang").alias("summary"), F.lit(None).cast("string").alias("body"), F.lit("snippet").alias("content_mode"),
        F.col("lang").alias("language"), F.col("source").alias("source_tier"), at.alias("published_at"), F.lit(None).cast("date").alias("published_date"), at.alias("available_at"), F.when(F.col("doc_id") != F.col("first_id"), F.col("first_id")).alias("supersedes_news_id"))
    lit = lambda t: F.lit(t).cast("timestamp")
    found = reads.list_news(rows, lit("2024-01-05"), lit("2024-01-30"), lit("2024-01-25"), regions=["US"], languages=["en", "fr"])
    return found.select("news_id", "language", "content_mode", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


NULL_SUM = "CASE WHEN l_linenumber = 1 THEN NULL ELSE l_returnflag END"


@query(f"""WITH early AS (SELECT l_orderkey AS k, l_shipdate AS t, {NULL_SUM} AS c, l_linenumber AS n FROM lineitem WHERE l_linenumber <= 3),
base AS (SELECT k, min(n) AS n FROM early GROUP BY k), page AS (SELECT l_orderkey AS k, max(l_shipdate) AS t, min(CASE WHEN l_linenumber <= 5 THEN NULL ELSE l_linestatus END) AS c FROM lineitem WHERE l_linenumber > 3 GROUP BY l_orderkey),
held AS (SELECT k, t, c, 0 AS r FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, c NULLS FIRST) AS p FROM early) WHERE p = 1),
latest AS (SELECT k, c FROM held)
SELECT p.k AS bar_id, CASE WHEN l.k IS NULL THEN 'base' ELSE 'revision' END AS place, p.c AS checksum, p.t AS available_at FROM page p LEFT JOIN latest l ON l.k = p.k WHERE l.k IS NULL OR l.c IS DISTINCT FROM p.c""")
def q_merge_versions(spark, d):
    """A page's new bases and revisions; checksums may be missing on either side."""
    line = table(spark, d, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("bar_id"), F.col("l_shipdate").alias("available_at"), F.when(F.col("l_linenumber") != 1, F.col("l_returnflag")).alias("source_checksum"), "l_linenumber", "l_linestatus")
    base = pit.newest(rows.where("l_linenumber <= 3"), ["bar_id"], [F.asc("available_at"), F.asc_nulls_first("source_checksum")]).select("bar_id", "available_at", "source_checksum")
    page = rows.where("l_linenumber > 3").groupBy("bar_id").agg(F.max("available_at").alias("available_at"), F.min(F.when(F.col("l_linenumber") > 5, F.col("l_linestatus"))).alias("source_checksum"))
    fresh, changed = merge.version_changes(base, base.limit(0), page, "bar_id")
    both = fresh.withColumn("place", F.lit("base")).unionByName(changed.withColumn("place", F.lit("revision")))
    return both.select("bar_id", "place", F.col("source_checksum").alias("checksum"), "available_at")


@query("""SELECT observation_id, series_id, CAST(period_end AS VARCHAR) AS period_end, ten_thousandths, quality FROM (
SELECT 'mobs_us_' || substr(sha256('s' || user_id || chr(31) || CAST(CAST(ts AS DATE) AS VARCHAR) || chr(31) || 'v' || event_id || chr(31) || 'us-fixture'), 1, 20) AS observation_id, 's' || user_id AS series_id, CAST(ts AS DATE) AS period_end,
  CASE event_id % 5 WHEN 0 THEN -1 ELSE CAST(round(value * 100) AS BIGINT) * CASE event_id % 5 WHEN 1 THEN 1 ELSE 100 END END AS ten_thousandths, CASE event_id % 5 WHEN 0 THEN 'missing' ELSE 'reported' END AS quality, event_id FROM events) WHERE event_id % 7 <> 0""")
def q_parsed_observations(spark, d):
    """Events written as JSON records of a US page and read back as typed observations; each seventh has a field too many and is set aside."""
    c = F.concat_ws(".", F.floor(cents("value") / 100).cast("string"), F.lpad((cents("value") % 100).cast("string"), 2, "0"))
    five = F.col("event_id") % 5
    iso, day = dates.iso_instant(F.col("ts")), F.to_date("ts").cast("string")
    fields = {
        "record_id": F.concat(F.lit("r"), F.col("event_id")), "source_name": F.lit("n"), "source_url": F.lit("https://example.org/x"), "retrieved_at": iso, "series_id": F.concat(F.lit("s"), F.col("user_id")), "period_start": day, "period_end": day,
        "value": F.when(five == 0, "N/A").when(five == 1, F.concat(c, F.lit(" bp"))).otherwise(F.concat(c, F.lit("%"))), "unit": F.lit("percent"), "transformation": F.lit("level"), "vintage_id": F.concat(F.lit("v"), F.col("event_id")),
        "revision_no": F.lit(0), "value_status": F.when(five == 0, "missing").otherwise("reported"), "available_at": iso, "availability_basis": F.lit("first_seen"), "quality_flags": F.array().cast("array<string>"), "odd": F.when(F.col("event_id") % 7 == 0, "x"),
    }
    page = table(spark, d, "events").select(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("record"), F.lit("c").alias("checksum"))
    good, _ = records.us_records(page, "macro_observations")
    return good.select("observation_id", "series_id", F.col("period_end").cast("string").alias("period_end"), F.coalesce((F.col("value") * 10000).cast("long"), F.lit(-1)).alias("ten_thousandths"), F.col("value_status").alias("quality"))


@query("SELECT c_custkey, 'ins_' || c_custkey % 7 AS key, length(id) AS n FROM (SELECT c_custkey, 'ins_' || repeat('x', 26) AS id FROM customer)")
def q_instrument_ids(spark, d):
    """Ids have one length and one alphabet; tests hold their values against base32."""
    made = symbols.instrument_id(F.lit("CN"), (F.col("c_custkey") % 7).cast("string"))
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit("ins_"), F.col("c_custkey") % 7).alias("key"), F.length(F.when(made.rlike("^ins_[a-z2-7]{26}$"), made)).cast("long").alias("n"))


@query(f"""WITH {BASES}, current AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY available_at DESC, version_rank DESC, coalesce(source_checksum, '') DESC) AS r FROM versions) WHERE r = 1),
last AS (SELECT * FROM (SELECT c.*, CAST(o_orderdate AS DATE) AS day, row_number() OVER (PARTITION BY c.owner_id ORDER BY o_orderdate DESC, c.available_at DESC, fact_id DESC) AS p FROM current c JOIN orders ON o_orderkey = fact_id WHERE o_orderdate < TIMESTAMP '1998-06-01') WHERE p = 1)
SELECT c_custkey AS instrument_id, CASE WHEN l.owner_id IS NULL THEN 'missing' WHEN available_at > TIMESTAMP '1998-06-02' THEN 'late' WHEN day < DATE '1998-01-01' THEN 'stale' WHEN version_rank = 1 THEN 'revised' ELSE 'available' END AS status
FROM customer LEFT JOIN last l ON l.owner_id = c_custkey""")
def q_market_evidence(spark, d):
    base, revisions = bars(spark, d)
    current = pit.current_versions(pit.versions(base, revisions, "bar_id", reads.BAR_KEYS), "bar_id")
    expected = table(spark, d, "customer").select(F.col("c_custkey").alias("instrument_id"))
    found = evidence.instrument_status(expected, current, F.lit("1998-06-01").cast("date"), moment("1998-06-02 00:00:00"), F.lit("1998-01-01").cast("date"))
    return found.select("instrument_id", "status")


@query("""SELECT user_id AS day, CASE WHEN bad IS NOT NULL THEN bad WHEN revised THEN 'revised' ELSE 'available' END AS status FROM (
SELECT user_id, min_by(s, p) FILTER (s NOT IN ('available', 'revised')) AS bad, bool_or(s = 'revised') AS revised FROM (
  SELECT user_id, event_id AS p, CASE event_id % 6 WHEN 0 THEN 'revised' WHEN 1 THEN CASE WHEN user_id % 9 = 0 THEN 'late' ELSE 'available' END ELSE 'available' END AS s FROM events) GROUP BY user_id)""")
def q_calendar_fold(spark, d):
    n = F.col("event_id")
    status = F.when(n % 6 == 0, "revised").when((n % 6 == 1) & (F.col("user_id") % 9 == 0), "late").otherwise("available")
    return evidence.folded(table(spark, d, "events").withColumn("status", status), ["user_id"], "event_id").select(F.col("user_id").alias("day"), "status")


@query("""SELECT coalesce(s, c) AS nation, CASE WHEN s IS NULL THEN 'right_only' WHEN c IS NULL THEN 'left_only' WHEN abs(a - b) <= 20000 THEN 'match' ELSE 'mismatch' END AS status
FROM (SELECT s_nationkey AS s, CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) // count(*) AS BIGINT) AS a FROM supplier GROUP BY 1) FULL JOIN (SELECT c_nationkey AS c, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) // count(*) AS BIGINT) AS b FROM customer GROUP BY 1) ON s = c""")
def q_reconcile(spark, d):
    mean = lambda t, k, v: table(spark, d, t).groupBy(F.col(k).alias("nation")).agg(F.sum(cents(v)).alias("s"), F.count("*").alias("n")).select("nation", F.expr("s div n").alias("value"))
    return extensions.reconcile(mean("supplier", "s_nationkey", "s_acctbal"), mean("customer", "c_nationkey", "c_acctbal"), "nation", "value", 20000).select("nation", "status")
