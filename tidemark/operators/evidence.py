"""Evidence of a report's inputs: what was committed and known by the cutoff, its status, and the snapshot of all of it.

Evidence is a table of inputs: input_id, status, required, reason, facts and sources (arrays of structs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import iso_instant, parse_instant
from tidemark.functions.text import stable_id
from tidemark.operators.pit import has_version_before, newest, source_status

FACT = "struct<fact_id:string,section:string,text:string,value:string,unit:string,available_at:string,source_ref_id:string>"
REFERENCE = "struct<source_ref_id:string,provider_id:string,provider_record_id:string,source_name:string,source_url:string>"
EVIDENCE = f"input_id string, status string, required boolean, reason string, facts array<{FACT}>, sources array<{REFERENCE}>"
USABLE = ("available", "revised")


class EvidenceError(ValueError):
    """Evidence that contradicts itself."""


def source_reference(source: Column) -> Column:
    """A source struct as a reference."""
    key = stable_id("src", source["provider_id"], source["provider_record_id"], source["source_checksum"], length=32)
    return F.struct(key.alias("source_ref_id"), source["provider_id"].alias("provider_id"), source["provider_record_id"].alias("provider_record_id"), source["source_name"].alias("source_name"), source["source_url"].alias("source_url"))


def committed(rows: DataFrame, record_ids: DataFrame, key: str = "source.provider_record_id") -> DataFrame:
    """Rows whose record a run has committed."""
    ids = record_ids.select(F.col(record_ids.columns[0]).alias("_id")).distinct()
    return rows.join(ids, F.col(key) == F.col("_id"), "left_semi")


def bars_before(current: DataFrame, report_date: Column) -> DataFrame:
    """Current versions of bars before a report date, the newest of an instrument first."""
    return current.where(F.col("trading_date") < report_date).orderBy("instrument_id", F.desc("trading_date"), F.desc("available_at"), F.desc("bar_id"))


def late_instruments(current: DataFrame, expected_day: Column, cutoff: Column, as_of: Column) -> DataFrame:
    """Instruments whose bar of the expected day became available after the cutoff, as known at as_of."""
    late = (F.col("trading_date") == expected_day) & (F.col("available_at") > cutoff) & (F.col("available_at") <= as_of)
    return current.where(late).select("instrument_id").distinct()


def unexpected_days(bars: DataFrame, expected_day: Column) -> DataFrame:
    """One row: the sorted distinct days that are not the expected one."""
    return bars.agg(F.array_sort(F.collect_set(F.when(F.col("trading_date") != expected_day, F.col("trading_date")))).alias("days"))


def instrument_status(expected: DataFrame, current: DataFrame, report_date: Column, cutoff: Column, expected_day: Column) -> DataFrame:
    """Status of each expected instrument by its last bar before the report date: missing, late, stale, revised or available."""
    order = [F.col("trading_date").desc(), F.col("available_at").desc(), F.col("bar_id").desc()]
    last = newest(current.where(F.col("trading_date") < report_date), ["instrument_id"], order).select("instrument_id", "bar_id", "trading_date", "available_at", "version_rank")
    met = expected.join(last, "instrument_id", "left")
    status = F.when(F.col("bar_id").isNull(), "missing").when(F.col("available_at") > cutoff, "late").when(F.col("trading_date") < expected_day, "stale").when(F.col("version_rank") == 1, "revised").otherwise("available")
    return met.select("instrument_id", "bar_id", "trading_date", status.alias("status"))


def market_input(input_id: str, expected: DataFrame, current: DataFrame, versions: DataFrame, facts: DataFrame, report_date: Column, cutoff: Column, as_of: Column, expected_day: Column, max_age_hours: int = 36) -> DataFrame:
    """Evidence of a market: all expected instruments, of the expected day, in time.

    expected is a short list; current holds versions known at the cutoff, versions all that are known at as_of.
    """
    spark = expected.sparkSession
    last = newest(current.where(F.col("trading_date") < report_date), ["instrument_id"], [F.desc("trading_date"), F.desc("available_at"), F.desc("bar_id")])
    chosen = expected.join(last, "instrument_id")
    missing = [r[0] for r in expected.join(chosen, "instrument_id", "left_anti").orderBy("instrument_id").collect()]
    none = lambda status, reason: spark.createDataFrame([(input_id, status, True, reason, [], [])], EVIDENCE)
    if missing:
        late = {r[0] for r in late_instruments(versions, expected_day, cutoff, as_of).collect()}
        if set(missing) <= late:
            return none("late", f"available after the cutoff: {', '.join(map(str, missing))}")
        return none("missing", f"missing: {', '.join(map(str, missing))}")
    days = unexpected_days(chosen, expected_day).first().days
    if days:
        return none("stale", f"of other days: {', '.join(map(str, days))}")
    keys = ["bar_id", "source_checksum"]
    revised = has_version_before(chosen.select(*keys), versions.where("version_rank = 1"), keys, cutoff)
    status = source_status(chosen.withColumns({"all": F.lit(1), "revised": F.lit(revised)}), ["all"], cutoff, max_age_hours).first().status
    if status not in USABLE:
        return none(status, "by the time of its bars")
    return facts_of(input_id, status, facts.join(chosen.select("bar_id"), "bar_id", "left_semi"))


def facts_of(input_id: str, status: str, facts: DataFrame) -> DataFrame:
    """Evidence with facts (the fields of FACT, and source); an input's facts are bounded."""
    row = F.struct("fact_id", "section", "text", F.col("value").cast("string").alias("value"), "unit", iso_instant(F.col("available_at")).alias("available_at"), source_reference(F.col("source"))["source_ref_id"].alias("source_ref_id"))
    found = facts.agg(F.array_sort(F.collect_list(row)).alias("facts"), F.array_sort(F.collect_set(source_reference(F.col("source")))).alias("sources"))
    return found.select(F.lit(input_id).alias("input_id"), F.lit(status).alias("status"), F.lit(True).alias("required"), F.lit("").alias("reason"), "facts", "sources")


def has_late_release(releases: DataFrame, window: Column, cutoff: Column, as_of: Column) -> bool:
    """Whether some release of a window became available after the cutoff, as known at as_of; one row is looked for."""
    return not releases.where(window & (F.col("available_at") > cutoff) & (F.col("available_at") <= as_of)).limit(1).isEmpty()


def folded(rows: DataFrame, by: list[str], place: str) -> DataFrame:
    """One status of each group of parts in order: the first that is not usable, else revised if some part is, else available."""
    bad = ~F.col("status").isin(*USABLE)
    found = rows.groupBy(*by).agg(F.min_by(F.when(bad, F.col("status")), F.when(bad, F.col(place))).alias("_bad"), F.bool_or(F.col("status") == "revised").alias("_revised"))
    return found.select(*by, F.coalesce("_bad", F.when(F.col("_revised"), "revised").otherwise("available")).alias("status"))


def calendar_input(regional: DataFrame, input_id: str = "calendar.global", order: tuple[str, ...] = ("CN", "HK", "US")) -> DataFrame:
    """Evidence of all regions' calendars (region beside the columns of evidence) as one; it fails with its first bad region."""
    rows = regional.withColumn("_place", F.array_position(F.array(*[F.lit(r) for r in order]), F.col("region")))
    status = folded(rows.withColumn("_all", F.lit(1)), ["_all"], "_place").select("status")
    bad = ~F.col("status").isin(*USABLE)
    parts = rows.agg(
        F.min_by(F.concat_ws(" calendar: ", "region", "reason"), F.when(bad, F.col("_place"))).alias("_why"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_place", "facts"))), lambda x: x["facts"])).alias("facts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
    )
    met = status.crossJoin(F.broadcast(parts))  # one row each
    good = F.col("status").isin(*USABLE)
    return met.select(F.lit(input_id).alias("input_id"), "status", F.lit(True).alias("required"), F.when(good, "").otherwise(F.col("_why")).alias("reason"), F.when(good, F.col("facts")).otherwise(F.array().cast(f"array<{FACT}>")).alias("facts"), F.when(good, F.col("sources")).otherwise(F.array().cast(f"array<{REFERENCE}>")).alias("sources"))


def cut_off(evidence: DataFrame, cutoff: Column) -> DataFrame:
    """Evidence without facts from after the cutoff: an input with one becomes late, with a fact of no valid time invalid."""
    usable = F.col("status").isin(*USABLE)
    at = F.transform("facts", lambda f: parse_instant(f["available_at"]))
    invalid, late = F.exists(at, lambda t: t.isNull()), F.exists(at, lambda t: t > cutoff)
    status = F.when(~usable, F.col("status")).when(invalid, "invalid").when(late, "late").otherwise(F.col("status"))
    kept = usable & ~invalid & ~late
    reason = F.when(usable & invalid, "a fact has no valid time").when(usable & late, "a fact is from after the cutoff").otherwise(F.col("reason"))
    return evidence.select(
        "input_id", status.alias("status"), "required", reason.alias("reason"),
        F.when(kept, F.col("facts")).otherwise(F.array().cast(f"array<{FACT}>")).alias("facts"), F.when(kept, F.col("sources")).otherwise(F.array().cast(f"array<{REFERENCE}>")).alias("sources"),
    )


def snapshot(evidence: DataFrame, report_date: Column, as_of: Column, cutoff: Column, version: str, policy: DataFrame | None = None) -> DataFrame:
    """One row: the id and fingerprint of all evidence by the cutoff, its facts, sources and input quality.

    Inputs and facts must be there once, and a source reference must always say the same.
    """
    if not evidence.groupBy("input_id").count().where("count > 1").isEmpty():
        raise EvidenceError("an input occurs twice")
    if policy is not None:
        evidence = with_policy(evidence, policy)
    known = cut_off(evidence, cutoff)
    usable = known.where(F.col("status").isin(*USABLE))
    facts = usable.select(F.explode("facts").alias("f")).select("f.*")
    if not facts.where("fact_id IS NULL").isEmpty() or not facts.groupBy("fact_id").count().where("count > 1").isEmpty():
        raise EvidenceError("a fact has no id, or occurs twice")
    sources = usable.select(F.explode("sources").alias("s")).select("s.*").distinct()
    if not sources.where("source_ref_id IS NULL").isEmpty() or not sources.groupBy("source_ref_id").count().where("count > 1").isEmpty():
        raise EvidenceError("a source reference has no id, or says two things")
    one = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    body = one(facts, "facts").crossJoin(F.broadcast(one(sources, "sources"))).crossJoin(F.broadcast(one(known.select("input_id", "status", "required", "reason"), "input_quality")))  # one row each
    told = {"report_date": report_date.cast("string"), "as_of": iso_instant(as_of), "cutoff_at": iso_instant(cutoff), "snapshot_version": F.lit(version)}
    body = body.select(*[c.alias(n) for n, c in told.items()], F.transform("facts", lambda f: f["fact_id"]).alias("fact_ids"), "facts", F.transform("sources", lambda s: s["source_ref_id"]).alias("source_ref_ids"), "sources", "input_quality")
    mark = F.sha2(F.to_json(F.struct(*sorted(body.columns)), {"ignoreNullFields": "false"}), 256)
    return body.withColumn("fingerprint", mark).withColumn("snapshot_id", stable_id("report-input", F.lit(version), F.col("report_date"), F.col("fingerprint")))


def with_policy(evidence: DataFrame, policy: DataFrame) -> DataFrame:
    """Evidence under a day's policy (required, optional): closed markets are optional, and without facts unless they have some."""
    from tidemark.operators.workflow import apply_day_policy

    judged = apply_day_policy(evidence.select("input_id", "status", "required"), policy).withColumnsRenamed({"status": "_status", "required": "_required"})
    none = lambda kind: F.array().cast(f"array<{kind}>")
    met = judged.join(evidence, "input_id", "left")
    kept = F.col("_status").isin(*USABLE)
    return met.select(
        "input_id", F.col("_status").alias("status"), F.col("_required").alias("required"), F.coalesce("reason", F.lit("closed by the calendar")).alias("reason"),
        F.when(kept, F.coalesce("facts", none(FACT))).otherwise(none(FACT)).alias("facts"), F.when(kept, F.coalesce("sources", none(REFERENCE))).otherwise(none(REFERENCE)).alias("sources"),
    )


def policy_holds(day: Column, day_type: Column, regions: Column, required: Column, optional: Column) -> Column:
    """Whether a day's policy agrees with itself: regions is an array of (region, market_input_id, status, market_input_required)."""
    from tidemark.operators.workflow import ALWAYS_REQUIRED, MARKET_INPUTS

    every = F.array(*[F.lit(x) for x in sorted([*ALWAYS_REQUIRED, *MARKET_INPUTS.values()])])
    expected = F.create_map(*[F.lit(x) for kv in MARKET_INPUTS.items() for x in kv])
    open_ = lambda r: r["status"] == "scheduled_session"
    parts = F.forall(regions, lambda r: F.coalesce((r["market_input_id"] == expected[r["region"]]) & r["status"].isin("scheduled_session", "weekend_closed", "exchange_holiday") & (r["market_input_required"] == open_(r)), F.lit(False)))
    whole = (F.size(F.array_distinct(F.transform(regions, lambda r: r["region"]))) == len(MARKET_INPUTS)) & (F.size(regions) == len(MARKET_INPUTS))
    closed = F.array_sort(F.transform(F.filter(regions, lambda r: ~open_(r)), lambda r: r["market_input_id"]))
    inputs = (F.size(F.array_intersect(required, optional)) == 0) & (F.array_sort(F.array_distinct(F.concat(required, optional))) == every)
    weekday = F.weekday(day) < 5
    every_is = lambda *s: F.forall(regions, lambda r: r["status"].isin(*s))
    kind = (
        ((day_type == "regular") & weekday & every_is("scheduled_session")) | ((day_type == "weekend") & ~weekday & every_is("weekend_closed"))
        | ((day_type == "regional_holiday") & weekday & every_is("scheduled_session", "exchange_holiday") & F.exists(regions, lambda r: r["status"] == "exchange_holiday"))
    )
    always = F.size(F.array_except(F.array(*[F.lit(x) for x in ALWAYS_REQUIRED]), required)) == 0
    return F.coalesce(parts & whole & inputs & always & kind & (closed == F.array_sort(optional)), F.lit(False))


def inputs_of(policies: DataFrame) -> DataFrame:
    """day, required, optional and issue of policies (day, day_type, regions, required, optional); a bad policy requires everything."""
    from tidemark.operators.workflow import ALWAYS_REQUIRED, MARKET_INPUTS

    every = F.array(*[F.lit(x) for x in sorted([*ALWAYS_REQUIRED, *MARKET_INPUTS.values()])])
    good = policy_holds(*[F.col(c) for c in ("day", "day_type", "regions", "required", "optional")])
    return policies.select("day", F.when(good, F.array_sort("required")).otherwise(every).alias("required"), F.when(good, F.array_sort("optional")).otherwise(F.array().cast("array<string>")).alias("optional"), F.when(~good, "REPORT_DAY_POLICY_INVALID").alias("issue"))


def typed_facts(snapshots: DataFrame) -> DataFrame:
    """snapshot_id and its facts with typed value and time, and whether each is valid."""
    each = snapshots.select("snapshot_id", F.explode("facts").alias("f")).select("snapshot_id", "f.fact_id", "f.unit", F.col("f.value").alias("said"), F.col("f.value").try_cast("decimal(38,18)").alias("value"), parse_instant(F.col("f.available_at")).alias("available_at"))
    return each.withColumn("valid", (F.col("said").isNull() | F.col("value").isNotNull()) & F.col("available_at").isNotNull())


def identity_holds(rows: DataFrame, payload: str, fields: list[str]) -> DataFrame:
    """rows with `same`: whether the payload (JSON) says the same as the columns of these names."""
    same = F.lit(True)
    for f in fields:
        same = same & F.get_json_object(payload, f"$.{f}").eqNullSafe(F.col(f).cast("string"))
    return rows.withColumn("same", same)


def unknown_facts(reports: DataFrame, snapshots: DataFrame) -> DataFrame:
    """report_id and fact ids of reports (report_id, snapshot_id, fact_ids) that their snapshot lacks."""
    met = reports.join(snapshots.select("snapshot_id", F.col("fact_ids").alias("_known")), "snapshot_id", "left")
    return met.select("report_id", F.explode(F.array_except("fact_ids", F.coalesce("_known", F.array().cast("array<string>")))).alias("fact_id"))
