"""Extensions that the reference names or leaves open: coarser bars, returns, filled gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resample_bars(bars: DataFrame, period: Column, key: str = "instrument_id", order: tuple[str, ...] = ("bar_start",)) -> DataFrame:
    """One bar for each key and period: first open, highest high, lowest low, last close, total volume.

    All are aggregates with partial sums, so a period's rows meet only as one row per task.
    """
    at = F.struct(*order)
    return bars.groupBy(key, period.alias("period")).agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("bars"),
    )


def changes(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """rows with the value before, and the change, within each key."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("before", before).withColumn("change", F.col(value) - F.col("before"))


def fill_gaps(rows: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """A row for each day from a key's first to its last; missing values are the last known, marked as filled.

    rows must have one row for each key and day.
    """
    spans = rows.groupBy(key).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    days = spans.select(key, F.explode(F.sequence("_a", "_b")).alias(day))
    met = days.join(rows.select(key, day, value), [key, day], "left")
    by = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn("filled", F.col(value).isNull()).withColumn(value, F.last(value, ignorenulls=True).over(by))


def theta_join(left: DataFrame, right: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Pairs of rows of equal keys that meet a condition; the keys deal out the join."""
    return left.join(right, keys).where(condition)


def sequences(rows: DataFrame, key: str, place: str, value: str) -> DataFrame:
    """places, gapless (each place from the first to the last is there) and the last value (the least of several) of each key."""
    each = rows.groupBy(key, place).agg(F.min(value).alias("_v"))
    found = each.groupBy(key).agg(F.count("*").alias("places"), F.min(place).alias("_a"), F.max(place).alias("_b"), F.max_by("_v", place).alias("last"))
    return found.select(key, "places", (F.col("_b") - F.col("_a") + 1 == F.col("places")).alias("gapless"), "last")


def moving_sums(rows: DataFrame, key: str, order: list[str], value: str, width: int) -> DataFrame:
    """rows with moving_sum and moving_count of the last `width` rows of their key, this one included."""
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - width, 0)
    return rows.withColumns({"moving_sum": F.sum(value).over(by), "moving_count": F.count(value).over(by)})


def session_windows(rows: DataFrame, key: str, at: str, gap: str, value: str) -> DataFrame:
    """Sessions of each key: rows no further apart than a gap. start, last, n and total of each."""
    found = rows.groupBy(key, F.session_window(at, gap)).agg(F.min(at).alias("start"), F.max(at).alias("last"), F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.drop("session_window")


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Values at or below which a share of each group's values lies (no values in between are made up)."""
    return rows.groupBy(*by).agg(*[F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{value}`)").cast(rows.schema[value].dataType).alias(n) for n, share in shares.items()])


def reconcile(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: int) -> DataFrame:
    """Two sources' values of each key: match within a tolerance, mismatch, or in one of them only."""
    met = left.select(key, F.col(value).alias("left_value")).join(right.select(key, F.col(value).alias("right_value")), key, "full_outer")
    near = F.abs(F.col("left_value") - F.col("right_value")) <= tolerance
    status = F.when(F.col("left_value").isNull(), "right_only").when(F.col("right_value").isNull(), "left_only").when(near, "match").otherwise("mismatch")
    return met.withColumn("status", status)


def breaker_states(calls: DataFrame, key: str, order: list[str], failed: Column, most: int) -> DataFrame:
    """Each call with `run` (failures in a row up to it) and whether the source's breaker is open after it."""
    by = Window.partitionBy(key).orderBy(*order)
    marked = calls.withColumn("_bad", failed.cast("int")).withColumn("_good", F.sum(1 - F.col("_bad")).over(by))
    run = F.sum("_bad").over(Window.partitionBy(key, "_good").orderBy(*order))
    return marked.withColumn("run", run).withColumn("open", F.col("run") >= most).drop("_bad", "_good")


def run_sql(spark, tables: dict[str, DataFrame], said: str) -> DataFrame:
    """A SQL text over named frames; their names hold for this text only."""
    return spark.sql(said, **tables)


def read_table(spark, path: str, kind: str, schema: str, **options) -> DataFrame:
    """A file table of an explicit schema: parquet, orc, json, csv (a bad row is null) or any other kind that the session knows."""
    return spark.read.format(kind).schema(schema).options(**{"header": "true", "mode": "PERMISSIVE", **options} if kind == "csv" else options).load(path)


def register_functions(spark) -> list[str]:
    """Make the library's scalar rules known to SQL texts, as functions of SQL itself; their names."""
    from tidemark.functions import text

    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tide_excel_day(serial INT) RETURNS DATE RETURN date_add(DATE'1899-12-30', serial)")
    spark.udf.register("tide_full_title", text.full_title)
    return ["tide_excel_day", "tide_full_title"]
