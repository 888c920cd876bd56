"""Status of daily runs: tasks, day policies, the operator's view, and buckets of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Inputs that each report needs, and the market input of each region.
ALWAYS_REQUIRED = ["calendar.global", "news.cn", "news.us"]
MARKET_INPUTS = {"CN": "market.cn", "HK": "market.hk", "US": "market.us"}


def worker_status(tasks: DataFrame, results: DataFrame, by: list[str]) -> DataFrame:
    """Status of each run (by) of tasks (by, task_id, required) from their results (by, task_id, status).

    A required task that failed blocks; one that may be tried again makes the run retryable; anything
    else than success degrades it. A task without a result counts as nothing.
    """
    met = tasks.join(results, [*by, "task_id"], "left")
    rank = F.when(F.col("required") & (F.col("status") == "failed"), 3).when(F.col("required") & (F.col("status") == "retryable"), 2).when(F.col("status") != "succeeded", 1).otherwise(0)
    names = F.array(*[F.lit(x) for x in ("succeeded", "degraded", "retryable", "blocked")])
    return met.groupBy(*by).agg(F.max(rank).alias("_r")).select(*by, F.get(names, F.col("_r")).alias("status"))


def combined_status(worker: Column, quality: Column) -> Column:
    """A run's status and its quality decision as one; a locked run stays locked."""
    either = lambda s: (worker == s) | (quality == s)
    return F.when(worker == "locked", "locked").when(either("blocked"), "blocked").when(either("retryable"), "retryable").when(either("degraded"), "degraded").otherwise("succeeded")


def task_problem(status: Column, rejections: Column, run_ids: Column) -> Column:
    """Evidence status that a task's result forces, or null if there is no problem."""
    return (
        F.when(status.isNull(), "unavailable").when(F.coalesce(rejections, F.lit(0)) > 0, "quarantined")
        .when((status == "succeeded") & (F.coalesce(F.size(run_ids), F.lit(0)) <= 0), "unavailable").when(status == "succeeded", None)
        .when(status == "retryable", "retryable").otherwise("unavailable")
    )


def rejection_counts(reported: DataFrame, rejections: DataFrame, key: str = "run_id") -> DataFrame:
    """The greater of what a run reported and what was kept of its rejects."""
    kept = rejections.groupBy(key).agg(F.count("*").alias("_kept"))
    return reported.join(kept, key, "left").select(key, F.greatest(F.coalesce("reported", F.lit(0)), F.coalesce("_kept", F.lit(0))).cast("long").alias("rejections"))


def day_policy(days: DataFrame, sessions: DataFrame) -> DataFrame:
    """day, day_type, and the required and optional inputs, of days and the sessions (region, day) of the three exchanges."""
    markets = F.array(*[F.struct(F.lit(r).alias("region"), F.lit(i).alias("input_id")) for r, i in MARKET_INPUTS.items()])
    cells = days.select("day").distinct().select("day", F.inline(markets))
    met = cells.join(sessions.select("region", "day", F.lit(True).alias("_open")).distinct(), ["region", "day"], "left")
    is_open = F.coalesce("_open", F.lit(False))
    found = met.groupBy("day").agg(
        F.array_sort(F.collect_list(F.when(is_open, F.col("input_id")))).alias("_need"), F.array_sort(F.collect_list(F.when(~is_open, F.col("input_id")))).alias("optional")
    )
    kind = F.when(F.weekday("day") >= 5, "weekend").when(F.size("optional") > 0, "regional_holiday").otherwise("regular")
    always = F.array(*[F.lit(x) for x in ALWAYS_REQUIRED])
    return found.select("day", kind.alias("day_type"), F.array_sort(F.concat(always, "_need")).alias("required"), "optional")


def apply_day_policy(evidence: DataFrame, policy: DataFrame) -> DataFrame:
    """Evidence (input_id, status, required) under one day's policy row (required, optional).

    Required inputs are required; of closed markets what is available stays as optional, all else is
    unavailable, and absent ones are added.
    """
    need = policy.select(F.explode("required").alias("input_id"), F.lit("need").alias("_kind"))
    free = policy.select(F.explode("optional").alias("input_id"), F.lit("free").alias("_kind"))
    met = evidence.join(need.unionAll(free), "input_id", "full_outer").where("status IS NOT NULL OR _kind = 'free'")
    is_free = F.coalesce(F.col("_kind") == "free", F.lit(False))
    status = F.when(is_free & ~F.coalesce(F.col("status").isin("available", "revised"), F.lit(False)), "unavailable").otherwise(F.col("status"))
    required = F.when(F.col("_kind") == "need", True).when(is_free, False).otherwise(F.col("required"))
    return met.select("input_id", status.alias("status"), required.alias("required"))


def operational_status(events: DataFrame, by: str = "report_date") -> DataFrame:
    """The operator's view of each date from events (by, kind, status, at).

    kind is task, snapshot, generation, report, delivery or alert; the newest delivery or alert
    decides, else the newest report, generation and snapshot, else that there is something at all.
    """
    newest = lambda *kinds: F.max_by(F.struct("kind", "status"), F.when(F.col("kind").isin(*kinds), F.col("at")))
    said = events.groupBy(by).agg(newest("delivery", "alert").alias("t"), newest("report").alias("r"), newest("generation").alias("g"), newest("snapshot").alias("s"), F.max(F.when(F.col("kind").isin("delivery", "alert"), 1)).alias("has_t"), *[F.max(F.when(F.col("kind") == k, 1)).alias(f"has_{k[0]}") for k in ("report", "generation", "snapshot")])
    has = lambda c, kind, *values: F.coalesce((F.col(f"has_{c}") == 1) & (F.col(c)["kind"] == kind) & F.col(c)["status"].isin(*values), F.lit(False))
    status = (
        F.when(has("t", "delivery", "succeeded"), "delivered").when(has("t", "alert", "succeeded"), "blocked_alerted")
        .when(has("t", "delivery", "failed", "uncertain") | has("t", "alert", "failed", "uncertain"), "attention_required").when(has("t", "delivery", "pending", "retry_wait"), "awaiting_delivery")
        .when(has("r", "report", "failed"), "attention_required").when(has("r", "report", "validated"), "awaiting_delivery").when(has("g", "generation", "failed"), "attention_required")
        .when(has("s", "snapshot", "blocked", "retryable"), "quality_blocked")
        .when(F.coalesce("has_r", "has_g", "has_s").isNotNull(), "generating").otherwise("ingesting")
    )
    return said.select(by, status.alias("status"))


def issue_bucket(code: Column) -> Column:
    return F.when(code == "REQUIRED_INPUT_UNAVAILABLE", "missing_required_inputs").when(code.contains("STALE"), "stale_inputs").when(code.contains("LATE"), "late_inputs").when(code.contains("REVISED"), "revised_inputs").otherwise("unavailable_inputs")


def issue_buckets(issues: DataFrame) -> DataFrame:
    """bucket and its sorted distinct entries input:code of issues (input_id, code)."""
    said = issues.select(issue_bucket(F.col("code")).alias("bucket"), F.concat_ws(":", "input_id", "code").alias("entry")).distinct()
    return said.groupBy("bucket").agg(F.array_sort(F.collect_list("entry")).alias("entries"))


def report_status(status: Column, errors: Column, warnings: Column) -> Column:
    """incomplete with an error or if it was; degraded with a warning; else as it was."""
    return F.when((errors > 0) | (status == "incomplete"), "incomplete").when(warnings > 0, "degraded").otherwise(status)


def retry_delays(tries: int, retry_after: int | None = None, cap: int = 30, left: float | None = None) -> list[int]:
    """Seconds before each further try: what the source asked for, else powers of two, up to a cap and while time is left."""
    found: list[int] = []
    for n in range(tries - 1):
        wait = min(cap, retry_after if retry_after is not None else 2**n)
        if left is not None and sum(found) + wait > left:
            break
        found.append(wait)
    return found


def rejections_by_run(rejections: DataFrame, run: str = "run_id", key: str = "id") -> DataFrame:
    return rejections.groupBy(run).agg(F.count(key).alias("rejections"))


def committed_ids(pages: DataFrame, run: str, ids: str) -> DataFrame:
    """Of each run's pages: how many, how many distinct accepted ids, and how many in all."""
    flat = pages.select(run, F.explode_outer(ids).alias("_id"))
    found = flat.groupBy(run).agg(F.count_distinct("_id").alias("records"), F.count("_id").alias("flat"))
    return found.join(pages.groupBy(run).agg(F.count("*").alias("pages")), run)


#: Checks of a worker's readiness, by name; what is not met is listed.
READINESS = ["database", "schema", "providers", "registry", "calendar", "archive", "lease", "scheduler", "secrets", "delivery"]


def unmet(checks: DataFrame) -> DataFrame:
    """One row: whether all checks (name, ok) are met, and the sorted names of those that are not or that nobody made."""
    met = F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("name"))))
    asked = F.array(*[F.lit(x) for x in READINESS])
    return checks.agg(F.array_sort(F.array_except(asked, met)).alias("unmet")).select((F.size("unmet") == 0).alias("ready"), "unmet")
