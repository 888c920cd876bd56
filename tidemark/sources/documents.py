"""Tables and links of HTML pages, and rows of XLSX workbooks, with the standard library only."""

from __future__ import annotations

import html.parser
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SHEET_BYTES = 50_000_000


@dataclass
class _Open:
    """A table being read: its number, its rows, and the texts of the cell that is open in it."""

    number: int
    rows: list[list[str]]
    cell: list[str] | None = None

    def end_cell(self) -> None:
        if self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
        self.cell = None


class _Tables(html.parser.HTMLParser):
    """Rows of all tables in the order in which they begin.

    Closing tags of cells and rows may be absent; a table within a cell is a table of its own, and the
    cell goes on after it.
    """

    def __init__(self):
        super().__init__()
        self.found: list[list[list[str]]] = []
        self.open: list[_Open] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.found.append([])
            self.open.append(_Open(len(self.found) - 1, self.found[-1]))
        if not self.open or tag not in ("tr", "td", "th"):
            return
        now = self.open[-1]
        now.end_cell()
        if tag == "tr" or not now.rows:
            now.rows.append([])
        if tag != "tr":
            now.cell = []

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag in ("td", "th", "tr", "table"):
            self.open[-1].end_cell()
            if tag == "table":
                self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].cell is not None:
            self.open[-1].cell.append(data)

    def close(self) -> None:
        super().close()
        for table in self.open:
            table.end_cell()


class _Links(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.links: list[tuple[str, str]] = []
        self.at: tuple[str, list[str]] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a" and (href := dict(attrs).get("href")):
            self.at = href, []

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.at:
            self.links.append((self.at[0], " ".join("".join(self.at[1]).split())))
            self.at = None

    def handle_data(self, data: str) -> None:
        if self.at:
            self.at[1].append(data)


def _each(df: DataFrame, key: str, column: str, schema: str, one) -> DataFrame:
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, *[x.split()[0] for x in schema.split(", ")]]
        for batch in batches:
            yield pd.DataFrame([(k, *r) for k, v in zip(batch[key], batch[column], strict=True) if v is not None for r in one(v)], columns=names)

    return df.select(key, column).mapInPandas(run, f"`{key}` {kind}, {schema}")


def html_tables(df: DataFrame, key: str, column: str = "html") -> DataFrame:
    """table_no, row_no and cells of all tables of the pages."""

    def one(text: str) -> list[tuple]:
        parser = _Tables()
        parser.feed(text)
        parser.close()
        return [(t, r, cells) for t, rows in enumerate(parser.found) for r, cells in enumerate(rows)]

    return _each(df, key, column, "table_no int, row_no int, cells array<string>", one)


def html_links(df: DataFrame, key: str, column: str = "html") -> DataFrame:
    """position, href and label of all links of the pages."""

    def one(text: str) -> list[tuple]:
        parser = _Links()
        parser.feed(text)
        return [(n, href, label) for n, (href, label) in enumerate(parser.links)]

    return _each(df, key, column, "position int, href string, label string", one)


def month_calendar(rows: DataFrame, key: str, year: Column) -> DataFrame:
    """Releases of a table of number, name and twelve month columns; one row for each filled cell.

    A cell holds day/weekday and perhaps hh:mm; a missing time is looked for in the row below. A time
    gives an instant in Shanghai, a day alone a date. The first of equal (name, day) counts.
    """
    below = F.lead("cells").over(Window.partitionBy(key, "table_no").orderBy("row_no"))
    cells = rows.withColumn("_below", below).where(F.size("cells") >= 14)
    months = F.sequence(F.lit(1), F.lit(12))
    cell = cells.select(key, "row_no", F.get("cells", F.lit(1)).alias("name"), "cells", "_below", F.explode(months).alias("month"))
    own = F.get("cells", F.col("month") + 1)
    under = F.when(F.size("_below") < 14, F.get("_below", F.col("month") - 1)).otherwise(F.get("_below", F.col("month") + 1))
    clock = lambda c: F.regexp_extract(c, r"(\d{1,2}:\d{2})", 1)
    time = F.when(clock(own) != "", clock(own)).when(F.coalesce(clock(under), F.lit("")) != "", clock(under))
    day = F.regexp_extract(own, r"^(\d{1,2})/", 1).try_cast("int")
    found = cell.select(key, "row_no", "name", F.try_make_timestamp_ntz(year.cast("int"), F.col("month"), day, F.lit(0), F.lit(0), F.lit(0)).cast("date").alias("day"), time.alias("time")).where("day IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("name", "day").orderBy(key, "row_no"))
    at = F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.col("day").cast("string"), F.col("time"))), "Asia/Shanghai")
    kept = found.withColumn("_n", first).where("_n = 1")
    return kept.select("name", "day", F.when(F.col("time").isNotNull(), at).alias("scheduled_at"), F.when(F.col("time").isNull(), F.col("day")).alias("scheduled_date"))


def headline_list(links: DataFrame, key: str, hosts: list[str]) -> DataFrame:
    """Headlines of allowed links, the first of each canonical address."""
    from tidemark.functions.text import allowed_url, canonical_url

    good = links.where(allowed_url(F.col("href"), hosts)).withColumn("url", canonical_url(F.col("href")))
    first = F.row_number().over(Window.partitionBy("url").orderBy(key, "position"))
    return good.withColumn("_n", first).where("_n = 1").select("url", "label")


def _sheet(raw: bytes) -> list[tuple]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if sum(i.file_size for i in z.infolist()) > MAX_SHEET_BYTES:
            raise ValueError("the workbook is too large")
        tag = lambda e: e.tag.rpartition("}")[2]
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in item.iter() if tag(t) == "t") for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if tag(item) == "si"]
        sheet = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        rows = []
        for row in (e for e in ElementTree.fromstring(z.read(sheet)).iter() if tag(e) == "row"):
            cells: dict[int, str] = {}
            for c in (e for e in row if tag(e) == "c"):
                place = 0
                for letter in re.match("[A-Z]+", c.get("r", "A"))[0]:
                    place = place * 26 + ord(letter) - 64
                said = "".join(t.text or "" for t in c.iter() if tag(t) in ("v", "t"))
                cells[place - 1] = shared[int(said)] if c.get("t") == "s" and said else said
            rows.append((int(row.get("r", len(rows) + 1)), [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]))
        return rows


def xlsx_rows(files: DataFrame) -> DataFrame:
    """row_no and cells of the first sheet of each workbook, of a binaryFile frame."""
    return _each(files, "path", "content", "row_no int, cells array<string>", _sheet)


def sheet_releases(rows: DataFrame, header: list[str]) -> DataFrame:
    """title and day of rows under an exact header; the day is an Excel serial. A bad header or row raises."""
    from tidemark.functions.dates import excel_day

    head = rows.where("row_no = 1").select(F.col("cells") == F.array(*[F.lit(h) for h in header])).collect()
    if not head or not all(r[0] for r in head):
        raise ValueError("the header differs")
    body = rows.where("row_no > 1").select(F.get("cells", F.lit(0)).alias("title"), excel_day(F.get("cells", F.lit(1)).try_cast("double")).alias("day"))
    if not body.where("title IS NULL OR title = '' OR day IS NULL").isEmpty() or not body.groupBy("title", "day").count().where("count > 1").isEmpty():
        raise ValueError("an incomplete or repeated row")
    return body


def clock_schedule(rows: DataFrame, year: Column, zone: str = "America/New_York") -> DataFrame:
    """Releases of table rows whose first cell is like 'January 25 8:30 AM' and whose second is a title; times are local."""
    said = F.get("cells", F.lit(0))
    parts = rows.where(said.rlike(r"^[A-Z][a-z]+ \d{1,2} \d{1,2}:\d{2} [AP]M$")).select(
        F.get("cells", F.lit(1)).alias("title"), F.to_timestamp(F.concat_ws(" ", year.cast("string"), said), "yyyy MMMM d h:mm a").alias("wall")
    )
    return parts.select("title", F.to_utc_timestamp("wall", zone).alias("scheduled_at"))


def year_links(links: DataFrame, pattern: str = r"(20\d\d)") -> DataFrame:
    """year and href of links whose label or address names a year; the first link of a year counts."""
    year = F.regexp_extract(F.concat_ws(" ", "label", "href"), pattern, 1)
    named = links.withColumn("year", year.try_cast("int")).where("year IS NOT NULL")
    return named.groupBy("year").agg(F.min_by("href", "position").alias("href"))


def page_year(text: Column) -> Column:
    """The one year that a page's text names, or null if it names several or none."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(20\d\d)\b"), F.lit(1)))
    return F.when(F.size(found) == 1, found[0].cast("int"))


def symbol_list(text: Column) -> Column:
    """Distinct symbols of a comma-separated text."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.upper(F.trim(x))), lambda x: x != ""))


def last_file_wins(releases: DataFrame, place: str, key: str = "release_id") -> DataFrame:
    """Releases of several yearly files, each once: of one id the row of the file that comes last, in order of schedule and id."""
    by = Window.partitionBy(key).orderBy(F.col(place).desc())
    kept = releases.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
    return kept.orderBy(F.coalesce("scheduled_at", F.col("scheduled_date").cast("timestamp")).asc_nulls_last(), key)


def calendar_releases(rows: DataFrame, region: str, provider: str, url: str, fetched_at: Column) -> DataFrame:
    """Rows of macro_releases from calendar rows (name, scheduled_at, scheduled_date); what a calendar doesn't tell is null.

    A release's period is the month before its day.
    """
    from tidemark import schemas
    from tidemark.functions.dates import iso_instant
    from tidemark.functions.text import joined_id, stable_id

    day = F.coalesce("scheduled_date", F.to_date("scheduled_at"))
    before = F.add_months(F.trunc(day, "month"), -1)
    series = stable_id("series", F.lit(region), F.lit(provider), F.col("name"), length=32)
    when = F.coalesce(iso_instant(F.col("scheduled_at")), F.col("scheduled_date").cast("string"))
    told = {
        "release_id": joined_id("rel_", series, when, before.cast("string"), F.last_day(before).cast("string"), F.col("name")), "region": F.lit(region), "series_id": series, "release_name": F.col("name"),
        "scheduled_at": F.col("scheduled_at"), "scheduled_date": F.col("scheduled_date"), "time_precision": F.when(F.col("scheduled_at").isNotNull(), "instant").otherwise("date"), "available_at": fetched_at,
        "period_start": before, "period_end": F.last_day(before), "status": F.lit("scheduled"), "source_checksum": F.sha2(F.concat_ws("|", "name", when), 256),
    }
    shape = rows.sparkSession.createDataFrame([], schemas.SCHEMAS["macro_releases"]).schema
    none = F.lit(None).cast("string")
    told["source"] = F.struct(F.lit(provider), F.col("name"), F.lit(provider), none, F.lit(url), fetched_at, F.lit(None).cast("timestamp"), told["source_checksum"])
    return rows.select(*[told.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields])


def pdf_calendar(pages: DataFrame, key: str, text: str, year: Column) -> DataFrame:
    """name and twelve days of each line 'indicator d d d ...' of a calendar's plain text, one row for each month.

    The text of a PDF must have been taken out before; twelve days in a row after a name make a line.
    """
    line = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?m)^(\D[^\n]*?(?:[ \t]+\d{1,2}){12})[ \t]*$"), F.lit(1))).alias("line")
    parts = pages.select(key, line).select(key, F.trim(F.regexp_replace("line", r"(?:[ \t]+\d{1,2}){12}$", "")).alias("name"), F.regexp_extract_all("line", F.lit(r"[ \t](\d{1,2})(?=[ \t]|$)"), F.lit(1)).alias("all"))
    days = parts.select(key, "name", F.posexplode(F.slice("all", F.size("all") - 11, 12)).alias("m", "day"))
    at = F.try_make_timestamp_ntz(year.cast("int"), F.col("m") + 1, F.col("day").cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return days.select("name", at.alias("scheduled_date"), F.lit(None).cast("timestamp").alias("scheduled_at")).where("scheduled_date IS NOT NULL")
