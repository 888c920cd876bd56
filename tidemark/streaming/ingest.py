"""Page commits: each page of facts is written once, with its audit rows, rejects and watermark.

State is Parquet in a folder that all nodes share. A commit's facts go to a folder named by the page's
fingerprint and count once its manifest entry exists, so a crash before it leaves files that no reader
sees, and a replay after it writes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.manifest import Conflict, Manifest
from tidemark.operators.checks import point_in_time
from tidemark.store import FactStore

PAGES = "fingerprint string, role string, dataset string, region string, watermark string, cursor string, rows long, record_ids array<string>, committed_at timestamp"
AUDITS = "run_id string, provider_id string, kind string, payload string, at timestamp"


def page_fingerprint(page: DataFrame, query: str, watermark: str | None) -> str:
    """Hash of the query, the watermark and all rows, whatever their order."""
    body = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(page.columns)]), {"ignoreNullFields": "false"}))
    sums = page.agg(F.count("*").alias("n"), F.sum(body.cast("decimal(38,0)")).alias("s"), F.bit_xor(body).alias("x"))
    said = F.concat_ws("|", F.lit(query), F.lit(watermark or ""), F.col("n").cast("string"), F.coalesce(F.col("s").cast("string"), F.lit("")), F.coalesce(F.col("x").cast("string"), F.lit("")))
    return sums.select(F.sha2(said, 256)).first()[0]


@dataclass
class PageStore:
    spark: SparkSession
    root: str
    dataset: str
    role: str = "default"
    region: str = "-"

    @cached_property
    def manifest(self) -> Manifest:
        return Manifest(self.spark, f"{self.root}/manifest", PAGES)

    def _own(self) -> DataFrame:
        return self.manifest.read().where((F.col("role") == self.role) & (F.col("dataset") == self.dataset) & (F.col("region") == self.region))

    def _mine(self, r) -> bool:
        return (r.role, r.dataset, r.region) == (self.role, self.dataset, self.region)

    def committed(self, fingerprint: str) -> bool:
        if any(self._mine(r) and r.fingerprint == fingerprint for r in self.manifest.recent()):
            return True
        return self.manifest.older() is not None and not self._own().where(F.col("fingerprint") == fingerprint).isEmpty()

    def commit(self, page: DataFrame, query: str, watermark: str | None = None, cursor: str | None = None, rejects: DataFrame | None = None, record_id: str | None = None, write: Callable[[DataFrame], None] | None = None) -> bool:
        """False if the page was committed before. Rejects are kept in any case, once for each page.

        record_id names a column whose values are noted as accepted. write() gets the stored page and
        merges it elsewhere before the page counts; it must do nothing if called again. A writer that
        loses against another one looks again whether the page is there by now.
        """
        mark = page_fingerprint(page, query, watermark)
        if rejects is not None:
            rejects.write.mode("overwrite").parquet(f"{self.root}/rejects/{self.dataset}/page={mark}")
        while not self.committed(mark):
            after = self.manifest.place()
            path = f"{self.root}/facts/{self.dataset}/page={mark}"
            page.write.mode("overwrite").parquet(path)
            stored = self.spark.read.schema(page.schema).parquet(path)
            if write is not None:
                write(stored)
            ids = [r[0] for r in stored.select(F.col(record_id).cast("string")).distinct().collect()] if record_id else []  # a page is bounded
            entry = (mark, self.role, self.dataset, self.region, watermark, cursor, stored.count(), sorted(x for x in ids if x is not None), dt.datetime.now(dt.UTC).replace(tzinfo=None))
            try:
                self.manifest.append([entry], after)
            except Conflict:
                continue
            return True
        return False

    def watermark(self) -> tuple[str | None, str | None]:
        """Watermark and cursor of the last commit; also where to go on after a cursor has expired."""
        last = [r for r in self.manifest.recent() if self._mine(r)][-1:]
        if not last and self.manifest.older() is not None:
            last = self._own().orderBy(F.col("place").desc()).limit(1).collect()
        return (last[0].watermark, last[0].cursor) if last else (None, None)

    def accepted(self, fingerprints: list[str] | None = None) -> DataFrame:
        """pages, and the distinct record ids that they accepted."""
        own = self._own() if fingerprints is None else self._own().where(F.col("fingerprint").isin(fingerprints))
        return own.agg(F.count("*").alias("pages"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("record_ids")))).alias("record_ids"))

    def facts(self, schema) -> DataFrame:
        """Rows of committed pages only."""
        rows = self.spark.read.schema(f"{_ddl(schema)}, page string").parquet(f"{self.root}/facts/{self.dataset}")
        return rows.join(self._own().select(F.col("fingerprint").alias("page")), "page", "left_semi").drop("page")

    def rejects(self, schema) -> DataFrame:
        try:
            return self.spark.read.schema(f"{_ddl(schema)}, page string").parquet(f"{self.root}/rejects/{self.dataset}")
        except AnalysisException:
            return self.spark.createDataFrame([], f"{_ddl(schema)}, page string")


def _ddl(schema) -> str:
    return schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def ingest_stream(stream: DataFrame, store: PageStore, checkpoint: str, split: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]] | None = None):
    """A streaming query that commits each micro-batch as a page, until the source is used up.

    A page is known by its rows alone, so a batch that comes again, also under a new checkpoint, writes nothing.
    """

    def commit(batch: DataFrame, number: int) -> None:
        good, bad = split(batch) if split else (batch, None)
        store.commit(good, "stream", rejects=bad)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass
class Audits:
    """Append-only audit rows: raw times, refusals, and what else must outlive a failed page."""

    spark: SparkSession
    root: str

    @cached_property
    def manifest(self) -> Manifest:
        return Manifest(self.spark, f"{self.root}/audits", AUDITS)

    def add(self, run_id: str, provider_id: str, kind: str, payload: str) -> None:
        while True:
            try:
                self.manifest.append([(run_id, provider_id, kind, payload, dt.datetime.now(dt.UTC).replace(tzinfo=None))])
                return
            except Conflict:
                continue

    def refuse_history(self, run_id: str, provider_id: str, supported: bool, as_of: dt.datetime, now: dt.datetime) -> None:
        """Refuse a question about the past to a source that only knows the present, and note it."""
        try:
            point_in_time(supported, as_of, now)
        except ValueError as e:
            self.add(run_id, provider_id, "historical_pit_refused", str(e))
            raise


#: Column that tells a dataset's rows apart, for the ids that a page accepts.
RECORD_IDS = {
    "instruments": "instrument_id", "bars": "bar_id", "market_observations": "observation_id", "macro_series": "series_id",
    "macro_observations": "observation_id", "macro_releases": "release_id", "news": "news_id",
}


def ingest_page(envelopes: DataFrame, dataset: str, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], facts: FactStore, pages: PageStore, query: str, cursor: str | None = None, run_id: str = "-", audits: Audits | None = None) -> dict:
    """Take one page of a source through all steps: read, type, set aside, merge, commit.

    parse() gives good rows in the store's columns, and rejects (code, fields, issues, record). A page on
    which no record is good raises; an empty page is fine. A replay writes nothing and says so. An
    expired cursor is met by starting again without one: what is known is merged to nothing.
    """
    from tidemark.sources.envelope import SourceError, page_at, raise_for_errors, repeated_records

    raise_for_errors(envelopes)
    if not repeated_records(envelopes.where(F.col("dataset") == dataset)).isEmpty():
        raise SourceError("DUPLICATE_PAGE", dataset)
    page = page_at(envelopes, dataset, cursor)
    head = page.select("watermark", "next_cursor").limit(1).collect()[0]
    good, bad = parse(page)
    if good.isEmpty() and not bad.isEmpty():
        raise SourceError("SCHEMA_ERROR", f"no record of {dataset} is good")
    if audits is not None and dataset == "market_observations":
        for r in page.where("record IS NOT NULL").select(F.get_json_object("record", "$.record_id").alias("i"), F.get_json_object("record", "$.raw_observed_at").alias("t"), F.get_json_object("record", "$.raw_timezone").alias("z")).where("t IS NOT NULL").collect():
            audits.add(run_id, pages.role, "raw_time", f"{r.i}|{r.t}|{r.z}")  # a page is bounded
    new = pages.commit(good, query, head.watermark, head.next_cursor, rejects=bad, record_id=RECORD_IDS[dataset], write=lambda rows: facts.upsert(dataset, rows))
    return {"committed": new, "next_cursor": head.next_cursor, "watermark": head.watermark, "accepted": good.count(), "rejected": bad.count()}


def ingest_all(read: Callable[[str | None], DataFrame], dataset: str, parse, facts: FactStore, pages: PageStore, query: str, limit: int = 10_000, **options) -> dict:
    """Pages from the last committed cursor until there is none; read(cursor) fetches envelopes, parse is as for ingest_page."""
    from tidemark.sources.envelope import SourceError

    cursor, total = pages.watermark()[1], {"pages": 0, "accepted": 0, "rejected": 0}
    for _ in range(limit):
        try:
            done = ingest_page(read(cursor), dataset, parse, facts, pages, query, cursor, **options)
        except SourceError as e:
            if e.code not in ("INVALID_CURSOR", "INVALID_PAGINATION") or cursor is None:
                raise
            cursor = None  # the cursor has expired
            continue
        total = {"pages": total["pages"] + done["committed"], "accepted": total["accepted"] + done["accepted"], "rejected": total["rejected"] + done["rejected"]}
        cursor = done["next_cursor"]
        if cursor is None:
            return total
    raise SourceError("INVALID_PAGINATION", f"more than {limit} pages")


def advance(state: DataFrame, task: str, owner: str, epoch: int, run_ids: list[str], accepted: int) -> tuple[DataFrame, int]:
    """Task state after a page: only for the owner of the epoch; counters add, run ids stay distinct."""
    from tidemark.operators.merge import compare_and_set

    own = (F.col("task") == task) & (F.col("owner") == owner) & (F.col("epoch") == epoch)
    return compare_and_set(state, own, {"accepted": F.col("accepted") + accepted, "run_ids": F.array_union("run_ids", F.array(*[F.lit(r) for r in run_ids]))})


def lease(state: DataFrame, task: str, owner: str) -> tuple[DataFrame, int]:
    """Take a task over: the epoch goes up, so the owner before can no longer advance it."""
    from tidemark.operators.merge import compare_and_set

    return compare_and_set(state, (F.col("task") == task) & F.col("status").isin("active", "failed"), {"owner": F.lit(owner), "epoch": F.col("epoch") + 1, "status": F.lit("active")})
