"""Point-in-time resolution: what was known at a moment, and what was valid on a day.

All filters by knowledge time come before the windows, so they reach the scans of both branches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.symbols import days_overlap


def newest(df: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order, which should end in a unique column."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def versions(base: DataFrame, revisions: DataFrame, key: str, carried: list[str], as_of: Column | None = None) -> DataFrame:
    """Base rows (version_rank 0) and their revisions (1) that were available at as_of.

    A revision takes the columns `carried` from its base row and all else from itself; revisions
    without a base row fall out.
    """
    known = lambda df: df if as_of is None else df.where(F.col("available_at") <= as_of)
    own = [c for c in base.columns if c == key or c not in carried]
    later = known(revisions.select(*own)).join(base.select(key, *[c for c in carried if c != key]), key)
    return known(base).withColumn("version_rank", F.lit(0)).unionByName(later.withColumn("version_rank", F.lit(1)))


def current_versions(found: DataFrame, key: str, checksum: str = "source_checksum", nulls: str = "last", runs: tuple[str, ...] = (), run: str = "run_id", tie: str | None = None) -> DataFrame:
    """The newest version of each key: by available_at, revisions before base, checksum, and the greatest of tie.

    nulls: whether a missing checksum sorts first or last in descending order. With runs, versions
    that came from one of them outrank newer ones.
    """
    last = F.col(checksum).desc_nulls_first() if nulls == "first" else F.coalesce(F.col(checksum), F.lit("")).desc()
    order = [F.col("available_at").desc_nulls_first(), F.col("version_rank").desc(), last]
    if tie:
        order.append(F.col(tie).desc())
    if runs:
        found = found.withColumn("evidence_rank", F.when(F.col(run).isin(*runs), 1).otherwise(0))
        order = [F.col("evidence_rank").desc(), *order]
    return newest(found, [key], order)


def as_of_latest(base: DataFrame, revisions: DataFrame, key: str, carried: list[str], as_of: Column, **options) -> DataFrame:
    return current_versions(versions(base, revisions, key, carried, as_of), key, **options)


def revision_policy(df: DataFrame, key: list[str], policy: str, as_of: Column, order: str = "availability", tie: str = "observation_id") -> DataFrame:
    """Vintages available at as_of: all_vintages, latest_as_of or first_release of each key.

    order: 'availability' sorts by (available_at, revision_no), 'revision' by (revision_no, available_at).
    """
    known = df.where(F.col("available_at") <= as_of)
    if policy == "all_vintages":
        return known
    by = ["available_at", "revision_no"] if order == "availability" else ["revision_no", "available_at"]
    if policy not in ("latest_as_of", "first_release") or order not in ("availability", "revision"):
        raise ValueError(f"unknown policy or order: {policy}, {order}")
    sense = (lambda c: F.col(c).desc_nulls_first()) if policy == "latest_as_of" else (lambda c: F.col(c).asc_nulls_last())
    return newest(known, key, [sense(c) for c in (*by, tie)])


def effective_on(day: Column, valid_from: Column, valid_to: Column) -> Column:
    """valid_from <= day < valid_to; no end means open."""
    return (valid_from <= day) & (valid_to.isNull() | (day < valid_to))


def resolve_aliases(requests: DataFrame, aliases: DataFrame, keys: list[str], day: str, owner: str = "instrument_id") -> DataFrame:
    """Requests with the owner that their alias had on a day, and a status.

    resolved, ambiguous (several owners), inactive (only at other times) or unresolved. Requests must
    be distinct; the equal keys deal out the join, and the range of days is checked within it.
    """
    met = requests.join(aliases.withColumnRenamed(owner, "_owner"), keys, "left")
    active = F.coalesce(effective_on(F.col(day), F.col("valid_from"), F.col("valid_to")), F.lit(False)) & F.col("_owner").isNotNull()
    found = met.groupBy(*requests.columns).agg(
        F.count_distinct(F.when(active, F.col("_owner"))).alias("_n"),
        F.max_by(F.when(active, F.col("_owner")), F.when(active, F.struct("valid_from", "_owner"))).alias("_one"),
        F.count("_owner").alias("_any"),
    )
    status = F.when(F.col("_n") > 1, "ambiguous").when(F.col("_n") == 1, "resolved").when(F.col("_any") > 0, "inactive").otherwise("unresolved")
    return found.select(*requests.columns, F.when(status == "resolved", F.col("_one")).alias(owner), status.alias("status"))


def overlap_groups(aliases: DataFrame, keys: list[str], owner: str = "instrument_id") -> DataFrame:
    """aliases with `overlap`: of one alias, ranges that overlap directly or through others share a number.

    A sort for each alias and the running maximum of ends; a range without an end goes on for ever.
    """
    far = F.lit("9999-12-31").cast("date")
    by = Window.partitionBy(*keys).orderBy("valid_from", F.col(owner), F.coalesce("valid_to", far))
    reach = F.max(F.coalesce("valid_to", far)).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return aliases.withColumn("_new", F.when(F.col("valid_from") < reach, 0).otherwise(1)).withColumn("overlap", F.sum("_new").over(by)).drop("_new")


def alias_conflicts(aliases: DataFrame, keys: list[str], owner: str = "instrument_id") -> DataFrame:
    """Pairs of owners that hold the same alias on overlapping days. Only ranges of one group of overlaps meet."""
    grouped = overlap_groups(aliases, keys, owner)
    side = lambda n: grouped.select(*keys, "overlap", F.col(owner).alias(f"{n}_owner"), F.col("valid_from").alias(f"{n}_from"), F.col("valid_to").alias(f"{n}_to"))
    met = side("left").join(side("right"), [*keys, "overlap"]).drop("overlap")
    clash = days_overlap(F.col("left_from"), F.col("left_to"), F.col("right_from"), F.col("right_to"))
    return met.where((F.col("left_owner") < F.col("right_owner")) & clash)


def source_status(df: DataFrame, by: list[str], cutoff: Column, max_age_hours: int, available: str = "available_at", revised: str = "revised") -> DataFrame:
    """late, stale, revised or available, in that order, for each group."""
    age = F.lit(max_age_hours * 3600)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    rows = df.groupBy(*by).agg(F.max(available).alias("_last"), F.min(available).alias("_first"), F.bool_or(F.col(revised)).alias("_revised"))
    status = F.when(F.col("_last") > cutoff, "late").when(seconds(cutoff) - seconds(F.col("_first")) > age, "stale").when(F.col("_revised"), "revised").otherwise("available")
    return rows.select(*by, status.alias("status"))


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, ids: list[str], value: str) -> DataFrame:
    """left with the last `value` of right (keys, at, value) at or before its moment; an extension.

    Both sides go through one sort by key and time, so the work doesn't grow with the matches. Of
    equal moments the greatest value counts. ids must tell the left rows apart.
    """
    marked = right.groupBy(*keys, at).agg(F.max(value).alias(value)).select(*keys, at, F.lit(0).alias("_side"), value, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in ids])
    asked = left.select(*keys, at, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias(value), *ids)
    by = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = marked.unionByName(asked).withColumn(value, F.last(value, ignorenulls=True).over(by))
    return filled.where("_side = 1").select(*keys, at, *ids, value)


def with_version_before(facts: DataFrame, versions: DataFrame, keys: list[str], cutoff: Column, available: str = "available_at") -> DataFrame:
    """Facts of which some version was available at the cutoff."""
    return facts.join(versions.where(F.col(available) <= cutoff), keys, "left_semi")


def has_version_before(selected: DataFrame, versions: DataFrame, keys: list[str], cutoff: Column, available: str = "available_at") -> bool:
    """Whether any of the selected versions, by their keys, was available at the cutoff; one row is looked for."""
    return not with_version_before(selected, versions, keys, cutoff, available).limit(1).isEmpty()
