"""How the driver's tables stand in for fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def cents(column: str) -> Column:
    """Money as whole cents, so sums and comparisons are exact."""
    return F.round(F.col(column) * 100).cast("long")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: a user is a scope, a type is a metric, seen and known at ts."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("observation_id"), F.col("user_id").alias("series_id"), F.col("event_type").alias("period_end"),
        F.col("ts").alias("available_at"), F.lit(0).alias("revision_no"), cents("value").alias("value_cents"),
    )


def order_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as base rows, known on their date."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderdate").alias("available_at"),
        F.col("o_orderstatus").alias("source_checksum"), cents("o_totalprice").alias("value_cents"), F.col("o_orderpriority").alias("run_id"),
    )


def line_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as revisions of their order, known when shipped. Equal lines are one revision."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("fact_id"), F.col("l_shipdate").alias("available_at"),
        F.concat_ws("|", "l_returnflag", "l_linestatus", F.lpad(cents("l_extendedprice").cast("string"), 12, "0"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("source_checksum"),
        cents("l_extendedprice").alias("value_cents"), F.concat_ws("-", F.lit("line"), "l_linestatus").alias("run_id"),
    ).distinct()


def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open ranges of days from orders: each customer's priority holds until the next order day."""
    from pyspark.sql import Window

    days = table(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("valid_from")).agg(F.min("o_orderpriority").alias("alias"))
    following = F.lead("valid_from").over(Window.partitionBy("o_custkey").orderBy("valid_from"))
    return days.select(F.col("o_custkey").alias("instrument_id"), "alias", "valid_from", following.alias("valid_to"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news; an exact copy replaces the first document of its text."""
    docs = table(spark, sf_dir, "documents")
    first = docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_id"))
    rows = docs.withColumn("content_hash", F.sha2("text", 256)).join(first, "content_hash")
    return rows.select(
        F.col("doc_id").alias("news_id"), F.col("lang").alias("language"), F.col("source").alias("source_tier"), "content_hash", F.col("n_chars").alias("n_chars"),
        F.when(F.col("doc_id") != F.col("first_id"), F.col("first_id")).alias("supersedes_news_id"),
        F.substring_index("text", "\n", 1).alias("title"), "text",
    )
