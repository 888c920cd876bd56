"""Coverage, the editor's context as of one moment, and its fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_RECORDS = "no records available in the current repository"


def coverage(records: DataFrame, spine: DataFrame, by: list[str], provider: str = "provider_id", available: str = "available_at") -> DataFrame:
    """A row for each cell of the spine: count, newest, providers, status and reason; empty cells too."""
    found = records.groupBy(*by).agg(F.count("*").alias("record_count"), F.max(available).alias("newest_available_at"), F.array_sort(F.collect_set(provider)).alias("providers"))
    met = spine.join(found, by, "left")
    count = F.coalesce("record_count", F.lit(0)).cast("long")
    return met.select(
        *by, count.alias("record_count"), "newest_available_at", F.coalesce("providers", F.array().cast("array<string>")).alias("providers"),
        F.when(count > 0, "complete").otherwise("unavailable").alias("status"), F.when(count == 0, NO_RECORDS).alias("reason"),
    )


def spine(spark: SparkSession, regions: list[str], datasets: tuple[str, ...] = ("market", "macro", "news")) -> DataFrame:
    return spark.createDataFrame([(r, d) for r in sorted(regions) for d in datasets], "region string, dataset string")


def fingerprint(parts: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """One row: a hash over all rows of all parts that doesn't depend on their order or dealing.

    Each row is hashed on its executor; hashes are summed as decimals, so nothing is collected.
    """
    sums = None
    for name, df in sorted(parts.items()):
        body = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) if not isinstance(df.schema[c].dataType.simpleString(), str) else F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
        digest = F.sha2(F.concat_ws("|", F.lit(name), body), 256)
        piece = lambda k: F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(30,0)"))  # noqa: E731, B023
        one = df.agg(F.count("*").alias("n"), *[piece(k).alias(f"s{k}") for k in range(4)]).withColumn("part", F.lit(name))
        sums = one if sums is None else sums.unionByName(one)
    said = F.concat_ws(":", "part", F.col("n").cast("string"), *[F.coalesce(F.col(f"s{k}").cast("string"), F.lit("")) for k in range(4)])
    return sums.agg(F.array_join(F.array_sort(F.collect_list(said)), ";").alias("body")).select(F.sha2(F.concat(F.col("body"), as_of.cast("string")), 256).alias("fingerprint"))


def marks(rows: DataFrame, by: str, said: str) -> DataFrame:
    """Number of facts of each group, and a hash of their sorted texts; a group's texts are gathered, so groups must be bounded."""
    found = rows.groupBy(by).agg(F.count("*").alias("facts"), F.array_join(F.array_sort(F.collect_list(said)), "|").alias("_body"))
    return found.select(by, "facts", F.md5(F.col("_body").cast("binary")).alias("mark"))
