"""Report inputs: facts of bars, news and releases, evidence of a date, and the deterministic report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import instant_or_day_window, iso_instant
from tidemark.functions.numbers import plain_text
from tidemark.functions.text import stable_id
from tidemark.operators.pit import newest

#: Sections of the report, in order.
SECTIONS = ["summary", "cn_market", "hk_market", "us_market", "macro", "news", "calendar", "data_quality"]


def bar_facts(bars: DataFrame) -> DataFrame:
    said = F.concat_ws(" ", "instrument_id", F.col("trading_date").cast("string"), F.concat(F.lit("close "), plain_text(F.col("close"))), "currency")
    return bars.select(stable_id("fact", F.lit("bar"), F.col("bar_id"), F.col("source_checksum")).alias("fact_id"), F.concat(F.lower("region"), F.lit("_market")).alias("section"), said.alias("text"), F.col("close").alias("value"), F.col("currency").alias("unit"), "available_at")


def news_facts(news: DataFrame) -> DataFrame:
    return news.select(stable_id("fact", F.lit("news"), F.col("news_id")).alias("fact_id"), F.lit("news").alias("section"), F.col("title").alias("text"), F.lit(None).cast("decimal(38,18)").alias("value"), F.lit(None).cast("string").alias("unit"), "available_at")


def release_facts(releases: DataFrame) -> DataFrame:
    when = F.coalesce(iso_instant(F.col("scheduled_at")), F.col("scheduled_date").cast("string"))
    return releases.select(stable_id("fact", F.lit("release"), F.col("release_id")).alias("fact_id"), F.lit("calendar").alias("section"), F.concat_ws(" ", when, "release_name").alias("text"), F.col("actual").alias("value"), F.col("unit"), "available_at")


def market_evidence(expected: DataFrame, bars: DataFrame, report_date: Column, cutoff: Column) -> DataFrame:
    """Status of each expected instrument: its last bar before the report date, late, missing or available."""
    before = bars.where(F.col("trading_date") < report_date)
    order = [F.col("trading_date").desc(), F.col("available_at").desc(), F.col("bar_id").desc()]
    last = newest(before, ["instrument_id"], order).select("instrument_id", "bar_id", "trading_date", "available_at", "version_rank")
    met = expected.join(last, "instrument_id", "left")
    status = F.when(F.col("bar_id").isNull(), "missing").when(F.col("available_at") > cutoff, "late").when(F.col("version_rank") == 1, "revised").otherwise("available")
    return met.select("instrument_id", "bar_id", "trading_date", status.alias("status"))


def news_evidence(news: DataFrame, region: str, cutoff: Column, as_of: Column) -> DataFrame:
    """Active and corrected news of the day before the cutoff, available by it."""
    day = F.expr("INTERVAL 1 DAY")
    inside = instant_or_day_window(F.col("published_at"), F.col("published_date"), cutoff - day, cutoff)
    return news.where(F.array_contains("regions", region) & F.col("status").isin("active", "corrected") & (F.col("available_at") <= F.least(cutoff, as_of)) & inside)


def calendar_evidence(releases: DataFrame, cutoff: Column) -> DataFrame:
    """Releases of the week from the cutoff, or one row that says there are none."""
    week = F.expr("INTERVAL 7 DAYS")
    found = releases.where(instant_or_day_window(F.col("scheduled_at"), F.col("scheduled_date"), cutoff, cutoff + week))
    facts = release_facts(found).orderBy("text", "fact_id")
    none = found.agg(F.count("*").alias("n")).where("n = 0").select(
        F.lit("fact_calendar_empty").alias("fact_id"), F.lit("calendar").alias("section"), F.lit("no releases in the window").alias("text"),
        F.lit(0).cast("decimal(38,18)").alias("value"), F.lit("count").alias("unit"), cutoff.alias("available_at"),
    )
    return facts.unionByName(none)


def fallback_report(facts: DataFrame, budget: int = 400) -> DataFrame:
    """A row for each section, in order: status, text within a budget of characters, facts and their count.

    At most the sections' facts are gathered in a row, so callers cap facts before.
    """
    spark = facts.sparkSession
    frame = spark.createDataFrame(list(enumerate(SECTIONS)), "place int, section string")
    grouped = facts.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("fact_id", "text"))).alias("items"))
    met = frame.join(grouped, "section", "left")
    texts = F.array_join(F.transform("items", lambda i: i["text"]), "\n")
    return met.select(
        "place", "section", F.when(F.col("items").isNull(), "unavailable").otherwise("complete").alias("status"),
        F.substring(F.coalesce(texts, F.lit("")), 1, budget).alias("text"),
        F.coalesce(F.array_distinct(F.transform("items", lambda i: i["fact_id"])), F.array().cast("array<string>")).alias("fact_ids"),
        F.coalesce(F.size("items"), F.lit(0)).alias("fact_count"),
    ).orderBy("place")


def over_budget(sections: DataFrame, budget: int) -> DataFrame:
    """Sections whose visible characters exceed a budget."""
    return sections.withColumn("visible", F.length(F.regexp_replace("text", r"\s", ""))).where(F.col("visible") > budget)


def card(report: list[dict]) -> dict:
    """A small card of a collected report: eight sections at most, so it is built in Python."""
    lines = [{"tag": "div", "text": {"tag": "lark_md", "content": f"**{s['section']}**\n{s['text'] or '-'}"}} for s in sorted(report, key=lambda s: s["place"])]
    bad = [s["section"] for s in report if s["status"] != "complete"]
    return {"header": {"title": "daily report", "template": "orange" if bad else "blue"}, "elements": lines}


def capacity_level(used: Column, total: Column) -> Column:
    """ok, warning from 80 %, critical from 90 %, unavailable without a size."""
    share = used / total
    return F.when(total.isNull() | (total <= 0) | used.isNull(), "unavailable").when(share >= 0.9, "critical").when(share >= 0.8, "warning").otherwise("ok")


def display_lines(rows: DataFrame, by: str, order: list[str], said: str, mark: str = "\n") -> DataFrame:
    """The texts of each group in order, as one text; groups must be bounded."""
    items = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(said).alias("_said")))).alias("_items"))
    return items.select(by, F.array_join(F.transform("_items", lambda i: i["_said"]), mark).alias("lines"))
