"""Predicates on facts, quarantine, the quality gate, and checks of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKING = ["missing", "stale", "late", "unavailable", "quarantined", "invalid"]


def issue_list(tests: dict[str, Column]) -> Column:
    """Sorted codes of the tests that are true."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), code) for code, t in tests.items()])))


def bar_tests() -> dict[str, Column]:
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {
        "interval_order": F.col("bar_start") >= F.col("bar_end"),
        "low_above_body": lo > F.least(o, c),
        "high_below_body": h < F.greatest(o, c),
        "adjustment_as_of_missing": (F.col("adjustment") != "raw") & F.col("adjustment_as_of").isNull(),
    }


def release_tests() -> dict[str, Column]:
    return {"schedule_needs_one": F.col("scheduled_at").isNull() == F.col("scheduled_date").isNull()}


def news_tests() -> dict[str, Column]:
    return {
        "body_without_full_text": F.col("body").isNotNull() & (F.col("content_mode") != "full_text"),
        "available_before_published": F.col("available_at") < F.col("published_at"),
        "published_needs_one": F.col("published_at").isNull() == F.col("published_date").isNull(),
    }


def quarantine(df: DataFrame, tests: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their issues. One plan for both: the issues are computed in each."""
    judged = df.withColumn("issues", issue_list(tests))
    return judged.where(F.size("issues") == 0).drop("issues"), judged.where(F.size("issues") > 0)


def status_issue(status: Column, required: Column) -> Column:
    """Issue code of an input's status; 'available' and 'denied' have none."""
    kind = F.when(required, "REQUIRED_INPUT").otherwise("OPTIONAL_INPUT")
    known = status.isin(*BLOCKING, "revised", "retryable")
    return (
        F.when(status.isin("available", "denied"), None)
        .when(known, F.concat_ws("_", F.upper(status), kind))
        .otherwise(F.when(required, "INVALID_REQUIRED_INPUT_STATUS").otherwise("INVALID_INPUT_STATUS"))
    )


def gate_issues(expected: DataFrame, quality: DataFrame) -> DataFrame:
    """Issues of expected inputs (input_id, required) against their quality (input_id, status).

    An input without quality is unavailable; an optional one that is available is a closed market's.
    """
    met = expected.join(quality.withColumn("_seen", F.lit(True)), "input_id", "full_outer")
    needed = F.coalesce(F.col("required"), F.lit(False))
    absent = F.when(needed, "REQUIRED_INPUT_UNAVAILABLE").otherwise("OPTIONAL_INPUT_UNAVAILABLE")
    closed = (F.col("required") == F.lit(False)) & (F.col("status") == "available")
    code = F.when(F.col("_seen").isNull(), absent).when(closed, "SCHEDULED_MARKET_CLOSURE").otherwise(status_issue(F.col("status"), needed))
    return met.select("input_id", needed.alias("required"), code.alias("code")).where("code IS NOT NULL")


def gate_decision(issues: DataFrame) -> DataFrame:
    """One row with the decision: blocked over retryable over degraded over passed."""
    rank = F.when(F.col("required") & ~F.col("code").rlike("^(RETRYABLE|REVISED)_"), 3).when(F.col("required") & F.col("code").startswith("RETRYABLE_"), 2).otherwise(1)
    names = F.array(*[F.lit(x) for x in ("passed", "degraded", "retryable", "blocked")])
    return issues.agg(F.coalesce(F.max(rank), F.lit(0)).alias("rank")).select(F.get(names, F.col("rank")).alias("decision"))


def worse(left: Column, right: Column) -> Column:
    """The worse of two statuses."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(("passed", "degraded", "retryable", "blocked")) for x in (s, i)])
    return F.when(order[left] >= order[right], left).otherwise(right)


def claim_issues(claims: DataFrame, facts: DataFrame, cutoff: Column) -> DataFrame:
    """claim_id and code for each fault of claims (claim_id, fact_id, value, unit) against facts (fact_id, value, unit, available_at)."""
    known = facts.select("fact_id", F.col("value").alias("f_value"), F.col("unit").alias("f_unit"), F.col("available_at").alias("f_at"))
    met = claims.join(known, "fact_id", "left")
    absent = F.col("f_at").isNull()
    codes = issue_list({
        "UNCITED_CLAIM": F.col("fact_id").isNull(),
        "FACT_NOT_MATERIALIZED": F.col("fact_id").isNotNull() & absent,
        "FACT_AFTER_CUTOFF": F.col("f_at") > cutoff,
        "VALUE_MISMATCH": ~absent & ~F.col("value").eqNullSafe(F.col("f_value")),
        "UNIT_MISMATCH": ~absent & ~F.col("unit").eqNullSafe(F.col("f_unit")),
    })
    return met.select("claim_id", F.explode(codes).alias("code"))


def references_resolve(references: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct references that are not known."""
    return references.select(key).distinct().join(known.select(key), key, "left_anti")


def ids_match_facts(ids: Column, facts: Column) -> Column:
    """The listed ids are distinct, and the same as the facts' ids."""
    own = F.transform(facts, lambda f: f["fact_id"])
    return (F.size(ids) > 0) & (F.size(F.array_distinct(ids)) == F.size(ids)) & (F.size(ids) == F.size(own)) & (F.size(F.array_except(ids, own)) == 0) & (F.size(F.array_except(own, ids)) == 0)


def worst_of(rows: DataFrame, by: list[str], status: str = "status", order: tuple[str, ...] = ("passed", "degraded", "retryable", "blocked")) -> DataFrame:
    """The worst status of each group, in an order from good to bad; an unknown status counts as the first."""
    place = F.greatest(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(status)) - 1, F.lit(0))
    return rows.groupBy(*by).agg(F.max(place.cast("int")).alias("_worst")).select(*by, F.get(F.array(*[F.lit(x) for x in order]), F.col("_worst")).alias(status))
