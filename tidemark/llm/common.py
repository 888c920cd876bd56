"""Helpers that the operators share: column defaults, durable tables, plain word splitting, dealing out keys."""

from __future__ import annotations

import atexit
import contextlib
import math
import os
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed: the white space that separates words, \x20 and \x09 to \x0D.
SPACES = "\t\n\x0b\x0c\r"
#: Rows of one Arrow batch of the tables that `written` makes; texts are long, and workers hold a batch at a time.
BATCH_ROWS = 2_000
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only with a local master a folder of this machine may stand in."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"tidemark-{os.getuid()}")
    return found.rstrip("/")


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_left: set[str] = set()


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a written table in the shared folder and read it back.

    A lost executor costs the reader nothing: the files are in the folder that all executors share.
    They go with `discard`, or at the end of the driver's process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    rows = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, str(min(BATCH_ROWS, int(rows)) if int(rows) > 0 else BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH_KEY, rows)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    _left.add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _left.discard(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables of `written` that no later plan reads."""
    for df in frames:
        if path := _paths.pop(df, None):
            _delete(df.sparkSession, path)


@atexit.register
def _clear() -> None:
    spark = SparkSession.getActiveSession()
    for path in sorted(_left) if spark is not None else []:
        with contextlib.suppress(Exception):  # the session may be gone; then the store's own expiry is left
            _delete(spark, path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def kept_whole(docs: DataFrame, but: str | None = None) -> Column:
    """All columns of docs (but one) as one struct `row`: names of the caller's can't clash with an operator's own."""
    own = [docs[quoted(c)] for c in docs.columns if c != but]
    return (F.struct(*own) if own else F.struct(F.lit(None).cast("int").alias("none"))).alias("row")


def text_bytes(col: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.encode(F.col(col), "UTF-8"), F.lit(b"").cast("binary"))


def evenly_spaced(text: Column) -> Column:
    """The text with each white space a blank; null is empty. Other white space than line ends is rare."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike("[\\x09\\x0B-\\x0D]"), F.translate(text, SPACES, " " * len(SPACES))).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))


def plain_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, as an array; null gives an empty array."""
    return F.array_remove(F.split(evenly_spaced(text), " "), "")


def size_of(docs: DataFrame, text: str) -> int:
    """Bytes of all texts."""
    return docs.select(F.sum(F.octet_length(F.col(quoted(text))))).first()[0] or 0


def task_labels(spark: SparkSession, tasks: int) -> list[int]:
    """Numbers for tasks, such that repartition(tasks, number) gives each task one of them.

    Spark deals rows out by a hash; of some numbers those are taken whose hashes fall evenly.
    """
    number = spark.range(tasks * 40 + 1000).select("id", F.pmod(F.hash("id"), F.lit(tasks)).alias("to"))
    place = F.row_number().over(Window.partitionBy("to").orderBy("id"))
    taken = number.withColumn("k", place).where("k = 1").select("id").collect()
    return sorted(r.id for r in taken)


#: Bytes of packed keys that a task should read, and that a part should hold; the most tasks, and parts dealt out in one step.
TASK_BYTES, PART_BYTES = 24_000_000, 4_000_000
MAX_TASKS, DIRECT_PARTS = 4096, 16_384
DEALT = "task long, part long, kind int, blob binary"
#: Instead of a part: a blob that its task must cut, and one that stands for itself.
CUT, ALONE = -1, -2


@dataclass(frozen=True)
class Deal:
    """How 32-bit hashes are dealt to parts, and parts to tasks.

    The number of tasks is bounded, and so are its labels; beyond it tasks get more parts, one after
    the other. Up to DIRECT_PARTS parts, rows are packed by part before the shuffle. More parts are
    dealt out in two levels: rows are packed by task, and each task cuts what it got by part and
    sorts it, spilling to disk, so packed rows stay large at any size.
    """

    labels: tuple[int, ...]
    per_task: int

    @classmethod
    def of(cls, spark: SparkSession, n_bytes: float) -> Deal:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(1, min(MAX_TASKS, max(least, math.ceil(n_bytes / TASK_BYTES))))
        return cls(tuple(task_labels(spark, tasks)), max(1, math.ceil(n_bytes / (tasks * PART_BYTES))))

    @property
    def parts(self) -> int:
        return len(self.labels) * self.per_task

    @property
    def direct(self) -> bool:
        return self.parts <= DIRECT_PARTS

    def place(self, high: np.ndarray) -> np.ndarray:
        """Parts of hashes below 2**32."""
        return ((high.astype(np.uint64) * np.uint64(self.parts)) >> np.uint64(32)).astype(np.int64)

    def packed(self, place: np.ndarray, kind: int, pack: Callable[[np.ndarray], bytes]) -> list[tuple[int, int, int, bytes]]:
        """Rows of DEALT: pack() gets the numbers of the entries that go into one blob."""
        by = place if self.direct else place // self.per_task
        task = lambda name: self.labels[name // self.per_task if self.direct else name]
        return [(task(name), name if self.direct else CUT, kind, blob) for name, blob in cut_blob(by, pack)]

    def gathered(self, table: DataFrame, cut: Callable[[int, bytes], list[tuple[int, bytes]]]) -> DataFrame:
        """The table of DEALT by task, sorted by part; cut(kind, blob) gives the parts of a blob that was packed by task."""
        dealt = table.repartition(len(self.labels), "task")
        if not self.direct:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for task, part, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("task", "part", "kind", "blob")), strict=True):
                        yield dealt_rows([(task, part, kind, blob)] if part != CUT else [(task, p, kind, b) for p, b in cut(kind, blob)])

            dealt = dealt.mapInArrow(run, DEALT)
        return dealt.sortWithinPartitions("part")


def dealt_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["task", "part", "kind", "blob"])


def cut_blob(place: np.ndarray, pack: Callable[[np.ndarray], bytes]) -> list[tuple[int, bytes]]:
    """The different places, in order, and what pack() makes of the numbers of their entries."""
    order = np.argsort(place, kind="stable")
    place = place[order]
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
    return [(int(place[a]), pack(order[a:b])) for a, b in zip(first.tolist(), np.append(first, len(place))[1:].tolist(), strict=True)]


def alone(deal: Deal, kind: int, entries: np.ndarray, key: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """Rows of DEALT for entries that only pass through, in blobs to tasks by a well-spread key."""
    task = ((key.astype(np.uint64) >> np.uint64(32)) % np.uint64(len(deal.labels))).astype(np.int64)
    return [(deal.labels[t], ALONE, kind, blob) for t, blob in cut_blob(task, lambda order: entries[order].tobytes())]


#: Bytes of a part that are handed over at once.
SECTION_BYTES = 8_000_000


def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, bytes]], bool]]:
    """(kind, blob) of one part after the other, for rows sorted by part, and whether the part ends there.

    A part that is larger than SECTION_BYTES comes in several sections; a blob that stands for itself comes alone.
    """
    now, held, size = None, [], 0
    for batch in batches:
        for part, kind, blob in zip(*(batch.column(c) for c in ("part", "kind", "blob")), strict=True):
            part, blob = part.as_py(), blob.as_py()
            if part != now or part == ALONE:
                if now is not None:
                    yield held, True
                held, size = [], 0
            elif size > SECTION_BYTES:
                yield held, False
                held, size = [], 0
            now = part
            held.append((kind.as_py(), blob))
            size += len(blob)
    if now is not None:
        yield held, True


#: Bits of a sieve, 4 MB, and of one of its rows, 8 KB.
SIEVE_BITS, SIEVE_ROW = 1 << 25, 1 << 16


def sieve(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose key may be in the one column of `wanted`, and rows whose key is not, before a join by key.

    A bit table of fixed size goes to all executors, so that most rows that a join would drop are not
    shuffled. If more keys are wanted than the table can tell apart, more rows pass; none is lost.
    The table passes through the driver, so it is a few rows of bits side by side.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS).cast("long"))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), place(c).bitwiseAND(63).cast("int"))
    part = lambda c: F.shiftright(place(c), SIEVE_ROW.bit_length() - 1).cast("int")
    word = lambda c: F.shiftright(place(c).bitwiseAND(SIEVE_ROW - 1), 6).cast("int")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, np.zeros(0, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([table], pa.list_(pa.int64()))], names=["part", "words"])

        for batch in batches:
            parts, at, bits = (batch.column(c).to_numpy() for c in ("part", "word", "bits"))
            starts = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])[: len(parts)]).tolist()
            for a, b in zip(starts, [*starts[1:], len(parts)], strict=True):
                if parts[a] != now:
                    if now is not None:
                        yield done()
                    now, table = int(parts[a]), np.zeros(SIEVE_ROW // 64, np.int64)
                table[at[a:b]] = bits[a:b]
        if now is not None:
            yield done()

    one = wanted.toDF("w").select(F.col("w").cast(rows.schema[key].dataType).alias("w"))
    held = one.select(part(F.col("w")).alias("part"), word(F.col("w")).alias("word"), bit(F.col("w")).alias("bit")).groupBy("part", "word").agg(F.bit_or("bit").alias("bits"))
    held = written(held.repartition("part").sortWithinPartitions("part").mapInArrow(joined, "part int, words array<long>"), "sieve")
    mine = F.col(f"row.{quoted(key)}")
    met = rows.select(kept_whole(rows)).join(F.broadcast(held), part(mine) == held["part"], "left")
    may = F.coalesce(F.get("words", word(mine)).bitwiseAND(bit(mine)) != 0, F.lit(False))
    return met.where(may).select("row.*"), met.where(~may).select("row.*")
