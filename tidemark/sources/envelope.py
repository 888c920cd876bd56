"""JSON envelopes of fact pages: guards, strict keys, pages, and rows beside rejects.

An envelope is one file: {status, fetched_at, source_watermark, pages: {dataset: page or [page]}}, a
page is {cursor, next_cursor, items}. Files are read whole and parsed on executors; records stay JSON
texts until their dataset's schema is applied, so that unknown keys can be seen.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Error codes of an envelope and what they mean.
ERRORS = {
    "401": "AUTHENTICATION_FAILED", "auth": "AUTHENTICATION_FAILED", "auth_failure": "AUTHENTICATION_FAILED", "403": "FORBIDDEN", "forbidden": "FORBIDDEN",
    "429": "RATE_LIMITED", "rate_limited": "RATE_LIMITED", "timeout": "TIMEOUT", "schema_drift": "SCHEMA_ERROR", "schema_changed": "SCHEMA_ERROR", "invalid_cursor": "INVALID_CURSOR",
}
RETRYABLE = {"RATE_LIMITED", "TIMEOUT", "UNAVAILABLE"}


class SourceError(RuntimeError):
    """A typed error of a source; retryable says whether another try may help."""

    def __init__(self, code: str, message: str = "", retry_after: int | None = None):
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.retryable, self.retry_after = code, code in RETRYABLE, retry_after


NAMES = ["path", "dataset", "page", "cursor", "next_cursor", "record", "checksum", "watermark", "error"]
#: Keys that say how and when a record was fetched, not what it says.
VOLATILE = {"retrieved_at", "http_headers", "download_path", "batch_id"}


def _canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)


def _checksum(item: object) -> str:
    plain = {k: v for k, v in item.items() if k not in VOLATILE} if isinstance(item, dict) else item
    return hashlib.sha256(_canonical(plain).encode("utf-8", "surrogatepass")).hexdigest()


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else _canonical(value)


def _parse(path: str, text: str) -> list[tuple]:
    """Rows of one file; whatever is not of the form of an envelope is a schema error, never an exception."""
    wrong = [(path, None, None, None, None, None, None, None, "SCHEMA_ERROR")]
    if "<html" in text[:200].lower():
        return wrong
    try:
        payload = json.loads(text)
    except (ValueError, RecursionError):
        return wrong
    if not isinstance(payload, dict):
        return wrong
    if payload.get("status") != "ok":
        error = payload.get("error")
        if not isinstance(error, dict):
            return wrong
        code = ERRORS.get(str(error.get("code", "")).lower(), "UNAVAILABLE")
        after = error.get("retry_after_seconds")
        return [(path, None, None, None, None, None, None, "" if after is None else str(after), code)]
    datasets = payload.get("pages")
    if not isinstance(datasets, dict):
        return wrong
    rows, watermark = [], _text(payload.get("source_watermark"))
    for dataset, pages in datasets.items():
        for number, page in enumerate(pages if isinstance(pages, list) else [pages]):
            items = page.get("items") if isinstance(page, dict) else None
            if not isinstance(items, list):
                return wrong
            head = (path, dataset, number, _text(page.get("cursor")), _text(page.get("next_cursor")))
            # a record that is no object stays as it is, to be set aside when its dataset is read
            rows += [(*head, _canonical(item), _checksum(item), watermark, None) for item in items] or [(*head, None, None, watermark, None)]
    return rows


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """path, dataset, page, cursor, next_cursor, record (JSON), its checksum, watermark and error of all files; an empty page has a null record."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for p, t in zip(batch.path, batch.value, strict=True) for r in _parse(p, t)], columns=NAMES)

    return files.mapInPandas(run, "path string, dataset string, page int, cursor string, next_cursor string, record string, checksum string, watermark string, error string")


def raise_for_errors(envelopes: DataFrame) -> DataFrame:
    """The same rows, or the first file's typed error."""
    bad = envelopes.where("error IS NOT NULL").orderBy("path").limit(1).collect()
    if bad:
        after = bad[0].watermark
        raise SourceError(bad[0].error, bad[0].path, int(after) if after and after.isdigit() else None)
    return envelopes


def page_at(envelopes: DataFrame, dataset: str, cursor: str | None) -> DataFrame:
    """Rows of the page with a cursor; an unknown cursor raises."""
    page = envelopes.where((F.col("dataset") == dataset) & F.col("cursor").eqNullSafe(F.lit(cursor)))
    if page.isEmpty():
        raise SourceError("INVALID_PAGINATION", str(cursor))
    return page


def on_earlier_pages(envelopes: DataFrame, dataset: str, page: int) -> DataFrame:
    """Record ids of a page that an earlier page of its dataset also has."""
    ids = envelopes.where((F.col("dataset") == dataset) & F.col("record").isNotNull()).select("page", F.get_json_object("record", "$.record_id").alias("record_id"))
    return ids.where(F.col("page") == page).select("record_id").join(ids.where(F.col("page") < page).select("record_id"), "record_id", "left_semi").distinct()


def empty_pages(envelopes: DataFrame, dataset: str) -> int:
    """The longest run of neighbouring pages without a record; more than two mean that a source does not go on."""
    pages = envelopes.where(F.col("dataset") == dataset).groupBy("path", "page").agg(F.count("record").alias("n"))
    by = Window.partitionBy("path").orderBy("page")
    marked = pages.withColumn("run", F.sum((F.col("n") > 0).cast("int")).over(by)).where("n = 0")
    return marked.groupBy("path", "run").count().agg(F.max("count")).first()[0] or 0


def repeated_records(envelopes: DataFrame) -> DataFrame:
    """Record ids that occur more than once in a dataset, on one page or several."""
    ids = envelopes.where("record IS NOT NULL").select("dataset", F.get_json_object("record", "$.record_id").alias("record_id"))
    return ids.groupBy("dataset", "record_id").agg(F.count("*").alias("n")).where("n > 1")


def unknown_keys(record: Column, allowed: list[str]) -> Column:
    return F.array_sort(F.array_except(F.json_object_keys(record), F.array(*[F.lit(k) for k in allowed])))


def missing_keys(record: Column, required: list[str]) -> Column:
    return F.array_sort(F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))))


def typed(page: DataFrame, strings: list[str], allowed: list[str] | None = None, arrays: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Records with the required text fields, and rejects with code and sorted field names.

    Typing follows in the dataset's own projection, so bad values can be set aside there.
    """
    ddl = ", ".join([*(f"`{s}` string" for s in strings), *(f"`{a}` array<string>" for a in arrays)])
    absent = missing_keys(F.col("record"), strings)
    extra = unknown_keys(F.col("record"), allowed or [*strings, *arrays])
    judged = page.where("record IS NOT NULL").select("record", absent.alias("absent"), extra.alias("extra"))
    bad = (F.size("absent") > 0) | (F.size("extra") > 0)
    good = judged.where(~bad).select(F.from_json("record", ddl).alias("r")).select("r.*")
    rejects = judged.where(bad).select(F.lit("PROVIDER_RECORD_QUARANTINED").alias("code"), F.array_sort(F.json_object_keys("record")).alias("fields"), "absent", "extra")
    return good, rejects


def trusted_availability(reported: Column, retrieved: Column, evidence: Column, basis: Column) -> Column:
    """Struct of available_at and basis: the reported time counts only with evidence and a published basis."""
    trusted = F.coalesce(evidence.isNotNull() & basis.isin("provider_disseminated", "exchange_published"), F.lit(False))
    return F.struct(F.when(trusted, reported).otherwise(retrieved).alias("available_at"), F.when(trusted, basis).otherwise("first_seen").alias("basis"))
