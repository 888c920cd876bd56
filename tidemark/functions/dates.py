"""Date and time columns: zones, sessions, windows and parsing. The session time zone must be UTC."""

from __future__ import annotations

import datetime as dt
import email.utils

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Zones of regions.
REGION_ZONES = {"CN": "Asia/Shanghai", "HK": "Asia/Hong_Kong", "US": "America/New_York"}
#: Closed and early-closing days of the US equity calendar.
US_CLOSED = [
    "2025-01-01", "2025-01-20", "2025-02-17", "2025-04-18", "2025-05-26", "2025-06-19", "2025-07-04", "2025-09-01", "2025-11-27", "2025-12-25",
    "2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25", "2026-06-19", "2026-07-03", "2026-09-07", "2026-11-26", "2026-12-25",
    "2027-01-01", "2027-01-18", "2027-02-15", "2027-03-26", "2027-05-31", "2027-06-18", "2027-07-05", "2027-09-06", "2027-11-25", "2027-12-24",
]
US_EARLY = ["2025-07-03", "2025-11-28", "2025-12-24", "2026-11-27", "2026-12-24", "2027-11-26"]
US_YEARS = (2025, 2026, 2027)
OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def region_zone(region: Column) -> Column:
    """IANA zone of a region; others give null."""
    return F.create_map(*[F.lit(x) for kv in REGION_ZONES.items() for x in kv])[region]


def parse_instant(text: Column) -> Column:
    """ISO text with an offset to a timestamp; text without one, or malformed, gives null."""
    return F.when(text.rlike(OFFSET), F.try_to_timestamp(text))


def parse_day(text: Column) -> Column:
    return text.try_cast("date")


def iso_instant(instant: Column) -> Column:
    """UTC ISO text with Z; a fraction only if there is one."""
    whole, part = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(instant, "SSSSSS")
    return F.concat(whole, F.when(part != "000000", F.concat(F.lit("."), part)).otherwise(""), F.lit("Z"))


def local_day(instant: Column, zone: Column | str) -> Column:
    """Trading date: the calendar day of an instant in a zone."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def wall_to_utc(day: Column, clock: str, zone: Column | str) -> Column:
    """The instant of a local wall time hh:mm on a day."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", day.cast("string"), F.lit(f"{clock}:00"))), zone)


def in_gap(wall: Column, zone: Column | str) -> Column:
    """True for a wall time that the zone skips: it doesn't come back from UTC."""
    return F.from_utc_timestamp(F.to_utc_timestamp(wall, zone), zone) != wall


def weekday_open(day: Column) -> Column:
    """Monday to Friday."""
    return F.weekday(day) < 5


def trading_days(days: DataFrame, day: str, holidays: DataFrame | None = None) -> DataFrame:
    """Rows on weekdays that are not in `holidays` (column day)."""
    found = days.where(weekday_open(F.col(day)))
    return found if holidays is None else found.join(holidays.select(F.col("day").alias(day)), day, "left_anti")


def utc_now() -> Column:
    """The moment of the query, one for all rows."""
    return F.current_timestamp()


def us_calendar(spark: SparkSession) -> DataFrame:
    """day, status (regular, early_close, closed), open_at and close_at of the known years."""
    first, last = f"{US_YEARS[0]}-01-01", f"{US_YEARS[-1]}-12-31"
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    text = F.col("day").cast("string")
    status = F.when(~weekday_open(F.col("day")) | text.isin(US_CLOSED), "closed").when(text.isin(US_EARLY), "early_close").otherwise("regular")
    zone = REGION_ZONES["US"]
    days = days.withColumn("status", status)
    close = F.when(F.col("status") == "early_close", wall_to_utc(F.col("day"), "13:00", zone)).otherwise(wall_to_utc(F.col("day"), "16:00", zone))
    is_open = F.col("status") != "closed"
    return days.select("day", "status", F.when(is_open, wall_to_utc(F.col("day"), "09:30", zone)).alias("open_at"), F.when(is_open, close).alias("close_at"))


def require_us_year(day: Column) -> Column:
    """The day, or an error for a year that the calendar lacks."""
    return F.when(F.year(day).isin(*US_YEARS), day).otherwise(F.raise_error(F.concat(F.lit("no US calendar for "), F.year(day).cast("string"))).cast("date"))


def session_windows(df: DataFrame, day: str, calendar: DataFrame) -> DataFrame:
    """df with status, open_at and close_at of its day; the calendar is a small dimension."""
    return df.join(calendar.withColumnRenamed("day", day), day, "left")


def previous_session(df: DataFrame, day: str, sessions: DataFrame) -> DataFrame:
    """df with the last session (column day of `sessions`) strictly before its day, as previous_session.

    Distinct sessions are a calendar, at most one for each day. Each stands for the days up to the next
    one, so a day meets its session by an equal join; days after the last session meet the last.
    """
    held = sessions.select(F.col("day").alias("d")).distinct().agg(F.array_sort(F.collect_list("d")).alias("days"), F.max("d").alias("_last"))
    spans = held.select("_last", F.explode(F.transform("days", lambda d, i: F.struct(d.alias("s"), F.coalesce(F.get("days", i + 1), F.date_add(d, 1)).alias("upto")))).alias("x"))
    days = spans.select("_last", F.col("x.s").alias("_s"), F.explode(F.sequence(F.date_add("x.s", 1), F.col("x.upto"))).alias("_day"))
    last = days.agg(F.max("_last").alias("_last"))
    met = df.join(days.drop("_last"), F.col(day) == F.col("_day"), "left").crossJoin(F.broadcast(last))  # one row
    found = F.coalesce(F.col("_s"), F.when(F.col(day) > F.col("_last"), F.col("_last")))
    return met.withColumn("previous_session", found).drop("_s", "_day", "_last")


def instant_or_day_window(instant: Column, day: Column, start: Column, end: Column, zone: str = "UTC") -> Column:
    """In [start, end) by instant, or by day within the window's days in a zone (the end is exclusive)."""
    first = F.to_date(F.from_utc_timestamp(start, zone))
    last = F.to_date(F.from_utc_timestamp(end - F.expr("INTERVAL 1 MICROSECOND"), zone))
    by_instant = F.coalesce((instant >= start) & (instant < end), F.lit(False))
    return by_instant | F.coalesce((day >= first) & (day <= last), F.lit(False))


def day_overlaps(day: Column, start: Column, end: Column, zone: str = "UTC") -> Column:
    """[day, day + 1) in a zone overlaps [start, end)."""
    begin = F.to_utc_timestamp(day.cast("timestamp"), zone)
    return (begin < end) & (F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone) > start)


def excel_day(serial: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int"))


def month_bounds(period: Column) -> tuple[Column, Column]:
    """First and last day of a period yyyyMM."""
    first = F.to_date(period, "yyyyMM")
    return first, F.last_day(first)


def report_day_type(statuses: Column) -> Column:
    """regular, weekend or regional_holiday, of an array of regional session statuses."""
    every = lambda s: F.forall(statuses, lambda x: x == s)
    return F.when(every("scheduled_session"), "regular").when(every("weekend_closed"), "weekend").otherwise("regional_holiday")


def retry_after_seconds(value: str | None, now: dt.datetime) -> int | None:
    """Seconds of a Retry-After header: a number, or an HTTP date."""
    if value is None:
        return None
    if value.strip().isdigit():
        return int(value)
    try:
        at = email.utils.parsedate_to_datetime(value)
    except ValueError:
        return None
    return max(0, int((at - now).total_seconds()))


def local_window(day: Column, zone: Column | str, before_days: int, after_days: int = 0) -> Column:
    """Struct of start and end instants: from a day's local midnight less some days to that more some days."""
    at = lambda n: F.to_utc_timestamp(F.date_add(day, n).cast("timestamp"), zone)
    return F.struct(at(-before_days).alias("start"), at(after_days).alias("end"))


def day_range(first: Column, last: Column) -> Column:
    """All days from first to last, both included; none if they are the wrong way round."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))
