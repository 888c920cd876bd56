"""Vendor daily bars and official statistics, from JSON texts to fact columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import REGION_ZONES, local_day, month_bounds, session_windows, us_calendar, wall_to_utc
from tidemark.functions.numbers import plain_text, to_decimal
from tidemark.functions.text import joined_id, stable_id

DAILY = "meta struct<symbol:string,interval:string,currency:string>, values array<struct<datetime:string,open:string,high:string,low:string,close:string,volume:string>>"
SESSIONS = {"CN": ("09:30", "15:00"), "HK": ("09:30", "16:00"), "US": ("09:30", "16:00")}


def daily_rows(texts: DataFrame, column: str = "value") -> DataFrame:
    """symbol, currency, trading_date and prices of vendor documents of daily bars."""
    parsed = texts.select(F.from_json(column, DAILY).alias("d"))
    rows = parsed.select("d.meta.symbol", "d.meta.currency", F.explode("d.values").alias("v"))
    money = [to_decimal(F.col(f"v.{c}")).alias(c) for c in ("open", "high", "low", "close", "volume")]
    return rows.select("symbol", "currency", F.col("v.datetime").try_cast("date").alias("trading_date"), *money)


def not_ascending(rows: DataFrame, symbol: str = "symbol", day: str = "trading_date") -> DataFrame:
    """Rows whose day is not after the one before it, in the order that `position` gives."""
    before = F.lag(day).over(Window.partitionBy(symbol).orderBy("position"))
    return rows.withColumn("_before", before).where(F.col(day) <= F.col("_before")).drop("_before")


def positioned(texts: DataFrame, column: str = "value") -> DataFrame:
    """Days in document order, for not_ascending."""
    parsed = texts.select(F.from_json(column, DAILY).alias("d"))
    return parsed.select("d.meta.symbol", F.posexplode("d.values").alias("position", "v")).select("symbol", "position", F.col("v.datetime").try_cast("date").alias("trading_date"))


def regional_bars(rows: DataFrame, region: str, fetched_at: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Bars of a region with fixed session hours; what is missing becomes a flag."""
    zone, (opens, closes) = REGION_ZONES[region], SESSIONS[region]
    flags = F.array_compact(F.array(F.when(F.col("volume").isNull(), "VOLUME_MISSING"), F.when(F.col("turnover").isNull(), "TURNOVER_MISSING")))
    body = F.concat_ws("|", *[F.coalesce(plain_text(F.col(c)), F.lit("")) for c in ("open", "high", "low", "close", "volume", "turnover")])
    return rows.select(
        joined_id("bar_", F.col("instrument_id"), F.col("trading_date"), F.lit("1d"), F.lit("raw")).alias("bar_id"), "instrument_id", F.lit(region).alias("region"), "trading_date",
        wall_to_utc(F.col("trading_date"), opens, zone).alias("bar_start"), wall_to_utc(F.col("trading_date"), closes, zone).alias("bar_end"),
        "open", "high", "low", "close", "volume", "turnover", flags.alias("quality_flags"), fetched_at.alias("available_at"), F.sha2(body, 256).alias("source_checksum"), *keep,
    )


def us_session_bars(rows: DataFrame, fetched_at: Column) -> DataFrame:
    """US bars with the session hours of their day; a day that is closed or beyond the calendar has an issue."""
    met = session_windows(rows, "trading_date", us_calendar(rows.sparkSession))
    bars = regional_bars(met, "US", fetched_at, keep=("status", "open_at", "close_at"))
    issue = F.when(F.col("status").isNull(), "NO_CALENDAR").when(F.col("status") == "closed", "CLOSED_DAY")
    return bars.withColumns({"bar_start": F.col("open_at"), "bar_end": F.col("close_at"), "issue": issue}).drop("status", "open_at", "close_at")


def vendor_frame(spark, frame, epoch: str = "time", day: str = "date") -> tuple[DataFrame, DataFrame]:
    """Rows of a pandas-like frame of daily bars, all fields as texts, and those whose day and epoch don't agree.

    A missing value of any kind becomes null; trading_date is the local day.
    """
    names = list(frame.columns)
    said = [tuple(None if v is None or v != v else str(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    rows = spark.createDataFrame(said, ", ".join(f"`{n}` string" for n in names))
    local, told = epoch_day(F.col(epoch).try_cast("double").cast("long")), F.to_date(F.regexp_replace(F.col(day), "-", ""), "yyyyMMdd")
    judged = rows.withColumn("trading_date", told).withColumn("_same", F.coalesce(local == told, F.lit(False)))
    return judged.where("_same").drop("_same"), judged.where("NOT _same").drop("_same")


def press_pages(read, page: int = 100, limit: int = 100_000) -> list[dict]:
    """Records of all pages that read(offset, page) gives as (records, total); a total that changes or a link that repeats is an error."""
    from tidemark.sources.envelope import SourceError

    records: list[dict] = []
    seen: set[str] = set()
    first = None
    while len(records) < limit:
        got, total = read(len(records), page)
        if first is not None and total != first:
            raise SourceError("SNAPSHOT_CHANGED", f"{first}, then {total}")
        first = total
        for r in got:
            if r.get("link") in seen:
                raise SourceError("DUPLICATE_PAGE", str(r.get("link")))
            seen.add(r.get("link"))
        records += got
        if not got or (total is not None and len(records) >= total):
            return records
    raise SourceError("INVALID_PAGINATION", f"more than {limit} records")


def epoch_day(millis: Column, zone: str = "Asia/Hong_Kong") -> Column:
    return local_day(F.timestamp_millis(millis), zone)


STATISTICS = "header struct<status:struct<name:string>,title:string,count:string>, dataSet array<struct<freq:string,period:string,sv:string,svDesc:string,figure:string>>"


def statistics_rows(texts: DataFrame, column: str = "value") -> DataFrame:
    """Monthly observations of a statistics document; a vintage is the hash of its value."""
    rows = texts.select(F.explode(F.from_json(column, STATISTICS)["dataSet"]).alias("r"))
    first, last = month_bounds(F.col("r.period"))
    monthly = rows.where((F.col("r.freq") == "M") & F.col("r.period").rlike("^[0-9]{6}$"))
    return monthly.select(
        F.col("r.sv").alias("series_id"), F.col("r.svDesc").alias("name"), first.alias("period_start"), last.alias("period_end"),
        to_decimal(F.col("r.figure")).alias("value"), stable_id("vintage", F.col("r.sv"), F.col("r.period"), F.col("r.figure")).alias("vintage_id"),
    )


def series_of(rows: DataFrame) -> DataFrame:
    return rows.select("series_id", "name").dropDuplicates(["series_id"])


def check_registry(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows with an issue: SERIES_UNRESOLVED or SERIES_METADATA_MISMATCH, else null."""
    known = F.broadcast(registry.select("series_id", F.col("name").alias("_name")))
    met = rows.join(known, "series_id", "left")
    issue = F.when(F.col("_name").isNull(), "SERIES_UNRESOLVED").when(~F.col("_name").eqNullSafe(F.col("name")), "SERIES_METADATA_MISMATCH")
    return met.withColumn("issue", issue).drop("_name")


PRESS = "header struct<success:string>, result struct<datasize:int,records:array<struct<title:string,link:string,date:string>>>"


def press_releases(texts: DataFrame, column: str = "value") -> DataFrame:
    """Headlines with a day each, newest first, one for each link."""
    rows = texts.select(F.explode(F.from_json(column, PRESS)["result"]["records"]).alias("r")).select("r.*")
    return rows.dropDuplicates(["link"]).select(stable_id("news", F.col("link")).alias("news_id"), "title", F.col("link").alias("canonical_url"), F.col("date").try_cast("date").alias("published_date")).orderBy(F.col("published_date").desc(), "news_id")
