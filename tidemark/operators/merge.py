"""Merge policies over whole tables; each returns the new state, to be written beside the old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.pit import newest


def last_writer(current: DataFrame, incoming: DataFrame, key: list[str], tie: list[str]) -> DataFrame:
    """Incoming rows replace current ones of the same key; of several incoming, the first by `tie` descending."""
    rows = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return newest(rows, key, [F.col("_new").desc(), *[F.col(c).desc_nulls_last() for c in tie]]).drop("_new")


def _held(current: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """Distinct keys under other names, and the condition that a row has them; nulls count as equal."""
    held = current.select(*[F.col(c).alias(f"_held_{i}") for i, c in enumerate(keys)]).distinct()
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_held_{i}"))
    return held, same


def absent(current: DataFrame, incoming: DataFrame, keys: list[list[str]], tie: list[str]) -> DataFrame:
    """Incoming rows that share none of the unique keys with current ones or with an earlier incoming row; nulls count as equal."""
    fresh = incoming
    for key in keys:
        held, same = _held(current, key)
        fresh = newest(fresh.join(held, same, "left_anti"), key, [F.col(c).asc_nulls_last() for c in tie])
    return fresh.select(*current.columns)


def insert_absent(current: DataFrame, incoming: DataFrame, keys: list[list[str]], tie: list[str]) -> DataFrame:
    """Current rows and the incoming ones that share none of the unique keys with them or with an earlier incoming row."""
    return current.unionByName(absent(current, incoming, keys, tie))


def append_on_change(arrivals: DataFrame, key: list[str], order: list[Column], checksum: str) -> DataFrame:
    """Versions that differ from the one before them in arrival order, with version_no; A, B, A is three versions."""
    by = Window.partitionBy(*key).orderBy(*order)
    before = F.lag(checksum).over(by)
    changed = arrivals.withColumn("_new", F.row_number().over(by)).withColumn("_change", (F.col("_new") == 1) | ~before.eqNullSafe(F.col(checksum)))
    kept = changed.where("_change").withColumn("version_no", F.row_number().over(by))
    return kept.drop("_new", "_change")


def append_if_unlike_base(arrivals: DataFrame, key: list[str], order: list[Column], checksum: str) -> DataFrame:
    """The first arrival, and each other checksum once; a return to the first is not recorded."""
    first = newest(arrivals, [*key, checksum], order)
    return first.withColumn("version_no", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def version_changes(base: DataFrame, revisions: DataFrame, incoming: DataFrame, key: str, checksum: str = "source_checksum") -> tuple[DataFrame, DataFrame]:
    """New base rows and new revisions of a batch with at most one row for each key.

    No row of the key: a new base. The newest version (by available_at, revisions first, checksum) has the
    same checksum: nothing. Else a new revision. A missing checksum is a value like others.
    """
    said = lambda df, rank: df.select(F.col(key).alias("_key"), "available_at", F.col(checksum).alias("_sum"), F.lit(rank).alias("_rank"))
    known = said(base, 0).unionByName(said(revisions, 1))
    latest = known.groupBy("_key").agg(F.max_by(F.struct("_sum"), F.struct("available_at", "_rank", "_sum")).alias("_latest"))
    met = incoming.join(latest, F.col(key).eqNullSafe(F.col("_key")), "left")
    is_new, same = F.col("_latest").isNull(), F.col("_latest._sum").eqNullSafe(F.col(checksum))
    return met.where(is_new).select(*base.columns), met.where(~is_new & ~same).select(*revisions.columns)


def merge_versions(base: DataFrame, revisions: DataFrame, incoming: DataFrame, key: str, checksum: str = "source_checksum") -> tuple[DataFrame, DataFrame]:
    """The base and revision tables after a batch, by version_changes."""
    fresh, changed = version_changes(base, revisions, incoming, key, checksum)
    return base.unionByName(fresh), revisions.unionByName(changed)


def conflicts(current: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """Incoming rows whose key exists with other content."""
    held = current.select(F.col(key), F.col(content).alias("_held"))
    return incoming.join(held, key).where(~F.col("_held").eqNullSafe(F.col(content))).drop("_held")


def immutable_put(current: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """Insert if absent; the same key with other content raises."""
    if not conflicts(current, incoming, key, content).isEmpty():
        raise ValueError(f"{key} exists with other content")
    return insert_absent(current, incoming, [[key]], [content])


def compare_and_set(current: DataFrame, match: Column, changes: dict[str, Column]) -> tuple[DataFrame, int]:
    """Rows that match get the changes; returns the new state and how many did.

    This only computes the state. Of two writers one must lose when it is written: StateTable does that.
    """
    matched = F.coalesce(match, F.lit(False))
    done = current.withColumns({c: F.when(matched, v).otherwise(F.col(c)) for c, v in changes.items()})
    return done, current.where(matched).count()


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with n."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def missing_keys(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    return expected.join(found.select(*key), key, "left_anti")


def bridge(df: DataFrame, key: str, array: str, name: str) -> DataFrame:
    """A child table of an array column: one row for each distinct value."""
    return df.select(key, F.explode(F.array_distinct(F.col(array))).alias(name))


def release_series(releases: DataFrame, columns: list[str]) -> DataFrame:
    """One series for each that some releases name, of the columns of macro_series; what a release doesn't tell is null."""
    told = {"series_id": F.col("series_id"), "region": F.col("region"), "name": F.col("release_name"), "code": F.col("series_id"), "frequency": F.lit("irregular"), "unit": F.col("unit"), "source": F.col("source")}
    first = newest(releases, ["series_id"], [F.col("available_at").asc_nulls_last(), F.col("release_id").asc_nulls_last()])
    return first.select(*[told.get(c, F.lit(None).cast("string")).alias(c) for c in columns])


def copies(df: DataFrame, content: Column, key: str) -> DataFrame:
    """content_hash, the first key and the number of rows of each content."""
    return df.groupBy(content.alias("content_hash")).agg(F.min(key).alias("first"), F.count("*").alias("copies"))


def seen_before(df: DataFrame, earlier: DataFrame, keys: list[str]) -> DataFrame:
    """df with seen_before: whether an earlier row has its keys; nulls count as equal."""
    held, same = _held(earlier, keys)
    met = df.join(held.withColumn("_hit", F.lit(True)), same, "left")
    return met.withColumn("seen_before", F.coalesce("_hit", F.lit(False))).drop("_hit", *[f"_held_{i}" for i in range(len(keys))])
