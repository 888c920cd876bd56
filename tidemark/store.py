"""A fact store in a folder that all nodes share: tables in buckets of their key, pages that touch few of them.

Tables are Parquet files in buckets of a key's hash; a manifest names the files that count. Insert-only
merges append files to the buckets that a page touches, merges in place rewrite those buckets only, and
a bucket of many small files is rewritten as one. All files of a merge are named in one entry, so a
merge that dies before leaves files that no reader sees, and of two writers at once one gets Conflict.
Reads of given keys go to their buckets only.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.manifest import Manifest
from tidemark.operators import checks, context, merge
from tidemark.operators import queries as reads

#: Tables beside those of schemas.SCHEMAS, with the schema of another.
LIKE = {"bar_revisions": "bars", "release_revisions": "macro_releases"}
#: The column whose hash is a row's bucket; what a merge compares lies in one bucket.
BUCKET_BY = {
    "instruments": "instrument_id", "aliases": "instrument_id", "bars": "instrument_id", "bar_revisions": "instrument_id", "market_observations": "observation_id",
    "macro_series": "series_id", "macro_observations": "series_id", "macro_releases": "release_id", "release_revisions": "release_id", "news": "news_id", "rejections": "run_id",
}
FILES = "name string, bucket int, path string, whole boolean"
BUCKETS = 16
#: Files of one bucket before it is rewritten as one.
COMPACT_FILES = 8


def _live(rows: DataFrame) -> DataFrame:
    """Files that count: of each bucket the last that replaces it, and those after it."""
    last = F.max(F.when(F.col("whole"), F.col("place"))).over(Window.partitionBy("name", "bucket"))
    return rows.withColumn("last", last).where("last IS NULL OR place >= last").drop("last")


@dataclass
class FactStore:
    """The number of buckets holds for the life of a store; its first merge writes it down."""

    spark: SparkSession
    root: str
    buckets: int = BUCKETS

    # tables

    @cached_property
    def manifest(self) -> Manifest:
        return Manifest(self.spark, f"{self.root}/files", FILES, keep=_live)

    def _files(self) -> list:
        """Rows of the files that count; a bounded number for each bucket."""
        older = self.manifest.older()
        last: dict[tuple[str, int], list] = {}
        for r in [*(sorted(older.collect(), key=lambda r: r.place) if older is not None else []), *self.manifest.recent()]:
            held = last.setdefault((r.name, r.bucket), [])
            if r.whole:
                held.clear()
            held.append(r)
        return sorted((r for held in last.values() for r in held), key=lambda r: (r.place, r.name, r.bucket))

    def _read(self, name: str, files: list, buckets: list[int] | None = None) -> DataFrame:
        schema = schemas.SCHEMAS[LIKE.get(name, name)]
        paths = [f"{self.root}/{r.path}" for r in files if r.name == name and (buckets is None or r.bucket in buckets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        return self._read(name, self._files())

    def _count(self, files: list) -> int:
        return next((r.bucket for r in files if r.name == "buckets"), self.buckets)

    def _bucket(self, files: list, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self._count(files))).cast("int")

    def _touched(self, files: list, name: str, rows: DataFrame) -> list[int]:
        """Buckets of some rows; at most as many as there are."""
        return [r[0] for r in rows.select(self._bucket(files, F.col(BUCKET_BY[name]))).distinct().collect()]

    def keyed(self, name: str, keys: list | None) -> DataFrame:
        """The table's buckets that may hold the keys; all without keys."""
        files = self._files()
        if keys is None:
            return self._read(name, files)
        wanted = self.spark.range(1).select(F.array(*[self._bucket(files, F.lit(k)) for k in sorted(keys)])).first()[0] if keys else []
        return self._read(name, files, wanted)

    def _commit(self, files: list, after: int, changes: list[tuple[str, DataFrame, bool]]) -> None:
        """Write (table, rows, whether they replace their buckets) and name all files in one entry."""
        entries = [] if any(r.name == "buckets" for r in files) else [("buckets", self.buckets, "", False)]
        for name, rows, whole in changes:
            made = f"{name}/{uuid.uuid4().hex}"
            rows = rows.withColumn("bucket", self._bucket(files, F.col(BUCKET_BY[name])))
            rows.repartition("bucket").sortWithinPartitions("bucket", BUCKET_BY[name]).write.partitionBy("bucket").parquet(f"{self.root}/{made}")
            found = [r[0] for r in self.spark.read.schema("bucket int").parquet(f"{self.root}/{made}").distinct().collect()]
            entries += [(name, k, f"{made}/bucket={k}", whole) for k in found]
        if entries:
            self.manifest.append(entries, after)
        self._compact()

    def _compact(self) -> None:
        """Rewrite buckets of many files as one file each."""
        after, files = self.manifest.place(), self._files()
        many: dict[str, list[int]] = {}
        counted: dict[tuple[str, int], int] = {}
        for r in files:
            counted[r.name, r.bucket] = counted.get((r.name, r.bucket), 0) + 1
        for (name, bucket), n in counted.items():
            if n > COMPACT_FILES and name in BUCKET_BY:
                many.setdefault(name, []).append(bucket)
        if many:
            self._commit(files, after, [(name, self._read(name, files, buckets), True) for name, buckets in many.items()])

    def _page(self, name: str, incoming: DataFrame) -> tuple[int, list, DataFrame, list[int]]:
        """The last entry, the files that count, the page in the table's columns, and the buckets it touches."""
        after, files = self.manifest.place(), self._files()
        rows = incoming.select(*self._read(name, []).columns)
        return after, files, rows, self._touched(files, name, rows)

    # merges, by dataset

    def upsert_last(self, name: str, incoming: DataFrame) -> None:
        """Instruments, market observations and series: the last writer wins in place."""
        key = {"instruments": "instrument_id", "market_observations": "observation_id", "macro_series": "series_id"}[name]
        tie = ["available_at"] if name == "market_observations" else [key]
        after, files, rows, touched = self._page(name, incoming)
        self._commit(files, after, [(name, merge.last_writer(self._read(name, files, touched), rows, [key], tie), True)])

    def upsert_bars(self, incoming: DataFrame) -> None:
        """A bar's id tells its instrument, so all versions of a bar are in one bucket."""
        after, files, rows, touched = self._page("bars", incoming)
        base, revisions = self._read("bars", files, touched), self._read("bar_revisions", files, touched)
        fresh, changed = merge.version_changes(base, revisions, rows, "bar_id")
        clash = merge.duplicates(base.unionByName(fresh), ["instrument_id", "interval", "bar_start", "adjustment", "source.provider_id"])
        if not clash.isEmpty():
            raise ValueError("another bar_id holds the same bar")
        self._commit(files, after, [("bars", fresh, False), ("bar_revisions", changed, False)])

    def upsert_macro_observations(self, incoming: DataFrame) -> None:
        after, files, rows, touched = self._page("macro_observations", incoming)
        keys = [["observation_id"], ["series_id", "period_end", "vintage_id"]]
        self._commit(files, after, [("macro_observations", merge.absent(self._read("macro_observations", files, touched), rows, keys, ["observation_id"]), False)])

    def upsert_macro_releases(self, incoming: DataFrame) -> None:
        """The first row of a release is its base; other checksums become revisions, each once."""
        after, files, rows, touched = self._page("macro_releases", incoming)
        base, revisions = self._read("macro_releases", files, touched), self._read("release_revisions", files, touched)
        fresh = merge.absent(base, rows, [["release_id"]], ["available_at", "source_checksum"])
        bases = base.unionByName(fresh).select(F.col("release_id").alias("_id"), F.col("source_checksum").alias("_base"))
        unlike = rows.join(bases, F.col("release_id").eqNullSafe(F.col("_id"))).where(~F.col("source_checksum").eqNullSafe(F.col("_base")))
        changed = merge.absent(revisions, unlike.select(*revisions.columns), [["release_id", "source_checksum"]], ["available_at"])
        self._commit(files, after, [("macro_releases", fresh, False), ("release_revisions", changed, False)])

    def insert_news(self, incoming: DataFrame) -> None:
        after, files, rows, touched = self._page("news", incoming)
        self._commit(files, after, [("news", merge.absent(self._read("news", files, touched), rows, [["news_id"]], ["available_at"]), False)])

    def upsert(self, dataset: str, incoming: DataFrame) -> None:
        """The merge of a dataset; releases also bring their series, which come first."""
        if dataset == "macro_releases":
            self.upsert_last("macro_series", merge.release_series(incoming, self._read("macro_series", []).columns))
        merges = {"bars": self.upsert_bars, "macro_observations": self.upsert_macro_observations, "macro_releases": self.upsert_macro_releases, "news": self.insert_news}
        if dataset in merges:
            merges[dataset](incoming)
        else:
            self.upsert_last(dataset, incoming)

    def reject(self, rows: DataFrame) -> None:
        """Append dead letters."""
        after, files, rows, _ = self._page("rejections", rows)
        self._commit(files, after, [("rejections", rows, False)])

    # reads, by route

    def instruments(self, **q) -> DataFrame:
        return reads.list_instruments(self.table("instruments"), **q)

    def bars(self, instruments, start: Column, end: Column, as_of: Column, **q) -> DataFrame:
        keys = None if instruments is None else list(instruments)
        return reads.list_bars(self.keyed("bars", keys), self.keyed("bar_revisions", keys), instruments, start, end, as_of, **q)

    def snapshots(self, instruments, as_of: Column) -> DataFrame:
        keys = None if instruments is None else list(instruments)
        return reads.list_snapshots(self.keyed("bars", keys), self.keyed("bar_revisions", keys), instruments, as_of)

    def market_observations(self, start: Column, end: Column, as_of: Column, **q) -> DataFrame:
        return reads.list_market_observations(self.table("market_observations"), start, end, as_of, **q)

    def macro_series(self, **q) -> DataFrame:
        return reads.list_macro_series(self.table("macro_series"), **q)

    def macro_observations(self, series, first: Column, last: Column, as_of: Column, **q) -> DataFrame:
        return reads.list_macro_observations(self.keyed("macro_observations", None if series is None else list(series)), series, first, last, as_of, **q)

    def macro_releases(self, start: Column, end: Column, as_of: Column, **q) -> DataFrame:
        return reads.list_macro_releases(self.table("macro_releases"), self.table("release_revisions"), start, end, as_of, **q)

    def news(self, start: Column, end: Column, as_of: Column, **q) -> DataFrame:
        return reads.list_news(self.table("news"), start, end, as_of, **q)

    def editor_context(self, regions: list[str], as_of: Column, instruments=(), metrics=(), series=(), topics=None, sessions: int = 5, macro_days: int = 30, upcoming_days: int = 7, news_hours: int = 24, per_cluster: int = 2, max_news: int = 50, mode: str = "snippet") -> dict[str, DataFrame]:
        """All parts of a context at one moment, its coverage and fingerprint. `sessions` counts spans of three days."""
        span = lambda n, unit: F.expr(f"INTERVAL {n} {unit}")
        past, upto = as_of - span(3 * sessions, "DAY"), as_of + span(1, "MICROSECOND")
        parts = {
            "snapshots": self.snapshots(list(instruments), as_of),
            "bars": self.bars(list(instruments), past, upto, as_of),
            "observations": self.market_observations(past, upto, as_of, regions=regions, metrics=list(metrics)),
            "macro": self.macro_observations(list(series), F.to_date(as_of - span(macro_days, "DAY")), F.to_date(as_of), as_of),
            "releases": self.macro_releases(as_of - span(macro_days, "DAY"), as_of + span(upcoming_days, "DAY"), as_of, regions=regions),
        }
        at = F.coalesce("published_at", F.col("published_date").cast("timestamp"))
        page = self.news(as_of - span(news_hours, "HOUR"), upto, as_of, regions=regions, topics=topics, mode=mode, limit=max_news)
        parts["news"] = reads.cap_clusters(page, per_cluster, order=[at.desc_nulls_first(), F.col("news_id").asc()])
        seen = None
        for dataset, names in (("market", ("bars", "observations")), ("macro", ("releases",)), ("news", ("news",))):
            for name in names:
                region = F.explode("regions") if name == "news" else F.col("region")
                rows = parts[name].select(region.alias("region"), F.lit(dataset).alias("dataset"), F.col("source.provider_id").alias("provider_id"), "available_at")
                seen = rows if seen is None else seen.unionByName(rows)
        macro = parts["macro"].select("region", F.lit("macro").alias("dataset"), F.col("source.provider_id").alias("provider_id"), "available_at")
        cover = context.coverage(seen.unionByName(macro), context.spine(self.spark, regions), ["region", "dataset"])
        mark = context.fingerprint({**parts, "coverage": cover}, as_of)
        return {**parts, "coverage": cover.orderBy("region", "dataset"), "fingerprint": mark}


def item_page(df: DataFrame, limit: int, offset: int = 0, as_of: str | None = None) -> dict:
    """A page of at most `limit` rows for a caller outside Spark, and whether there are more; pages by key need no offset (paging.keyset_page)."""
    checks.limited(limit, 5000)
    rows = [r.asDict(recursive=True) for r in df.offset(offset).limit(limit + 1).collect()]
    return {"items": rows[:limit], "has_more": len(rows) > limit, "next_offset": offset + limit if len(rows) > limit else None, "as_of": as_of}
