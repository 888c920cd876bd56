"""Language identification with language-bitmask filters of byte n-grams.

One Bloom filter per language over the same hash places, stored bit-sliced: a place holds one bit
for each language, so the masks of an n-gram's places, joined by AND, give all languages that hold
the n-gram in one go. A language's count of n-grams is corrected for the false positives that the
fill of its filter predicts, and the largest corrected share decides.

Training counts the n-grams of all labelled texts per language, and keeps those that make up at
least a share of their language's, so filters don't fill up with rare foreign passages. The share is
one of SHARES: filters of each are made from a part of the training rows and tried on the rest.

Defined cases: a null or letterless text gives 'und' with score 0; ties go to the first language in
byte order, and so does a text with letters of which no n-gram is held (score 0); without any
labelled text all texts give 'und'; repeated rows give equal rows; an empty table gives an empty
table; other columns are ignored. A filter of more than 64 languages has a mask for each 64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrow import flat, mix, pieces
from tidemark.llm.common import documents, quoted, written

GRAM = 4
PLACES = 1 << 20
HASHES = 3
#: Least shares that are tried; without rows to try them on, the first holds.
SHARES = (0.0, 2e-6, 2e-5, 2e-4)
#: Distinct n-grams of all languages together that a worker counts before it sends them on.
COUNTED = 1_000_000
UNKNOWN = "und"
#: Letters and bytes of other scripts stay, everything else is a space.
KEPT = np.array([b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)], np.uint8)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte n-grams of lower-cased texts as numbers, with a space before and after each text, and the row of each."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    data, starts = flat(pc.binary_join_element_wise(pa.scalar(" "), lowered, pa.scalar(" "), ""))
    if len(data) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    data = KEPT[data]
    code = np.zeros(len(data) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | data[k : len(code) + k]
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    within = (row[: len(code)] == row[GRAM - 1 :]) & ((code & np.uint32(0xFFFF)) != 0x2020) & ((code >> np.uint32(16)) != 0x2020)
    return code[within], row[: len(code)][within]


def places(code: np.ndarray) -> list[np.ndarray]:
    spread = mix(code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return [((spread >> np.uint64(20 * k)) & np.uint64(PLACES - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filters:
    """languages, the masks by place (a column for each 64 languages, bit k for the k-th of them), and each language's rate of false positives."""

    languages: list[str]
    masks: np.ndarray
    wrong: np.ndarray

    @classmethod
    def of(cls, languages: list[str], masks: np.ndarray) -> Filters:
        if len(languages) <= 8:
            masks = masks.astype(np.uint8)
        one = masks.dtype.type(1)
        fill = np.array([((masks[:, k // 64] >> masks.dtype.type(k % 64)) & one).mean() for k in range(len(languages))])
        return cls(languages, masks, fill**HASHES)

    def shares(self, code: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Corrected share of each of n texts' n-grams (rows) that each language (columns) holds."""
        found = np.zeros((n, len(self.languages)))
        if not len(code):
            return found
        first, *others = places(code)
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        total = np.diff(np.append(starts, len(row)))
        number = self.masks.dtype.type
        for word in range(self.masks.shape[1]):
            column = np.ascontiguousarray(self.masks[:, word])
            mask = column[first]
            for p in others:
                mask &= column[p]
            for k in range(64 * word, min(64 * word + 64, len(self.languages))):
                hits = np.add.reduceat(((mask >> number(k % 64)) & number(1)).astype(np.int32), starts)
                found[row[starts], k] = np.clip((hits / total - self.wrong[k]) / (1 - self.wrong[k]), 0, 1)
        return found


def count_grams(known: DataFrame) -> DataFrame:
    """lang, gram, n and tried (of those, how many in rows to try filters on), written, of rows (lang, text, trial)."""

    def rows(name: str, got: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(got), pa.string()), pa.array(got.astype(np.int64)), pa.array(n[:, 0].copy()), pa.array(n[:, 1].copy())], names=["lang", "gram", "n", "tried"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in pieces(batches, "text"):
            code, row = grams(batch.column("text"))
            named = pc.dictionary_encode(batch.column("lang"))
            index, trial = named.indices.to_numpy(), batch.column("trial").to_numpy(zero_copy_only=False)
            for k, name in enumerate(named.dictionary.to_pylist()):
                own = index[row] == k
                got, back = np.unique(code[own], return_inverse=True)
                n = np.column_stack([np.bincount(back, minlength=len(got)), np.bincount(back, trial[row[own]], len(got)).astype(np.int64)])
                if name in held:
                    old, had = held[name]
                    both = np.union1d(old, got)
                    sums = np.zeros((len(both), 2), np.int64)
                    sums[np.searchsorted(both, old)] += had
                    sums[np.searchsorted(both, got)] += n
                    got, n = both, sums
                held[name] = got, n
            if sum(len(got) for got, _ in held.values()) > COUNTED:
                for name, (got, n) in held.items():
                    yield rows(name, got, n)
                held = {}
        for name, (got, n) in held.items():
            yield rows(name, got, n)

    counts = known.mapInArrow(count, "lang string, gram long, n long, tried long").groupBy("lang", "gram")
    return written(counts.agg(F.sum("n").alias("n"), F.sum("tried").alias("tried")), "grams")


def make_masks(counts: DataFrame, languages: list[str], tests: list[Column]) -> list[np.ndarray]:
    """Masks by place for each of the tests, of counts with a language's number; at most PLACES rows for each 64 languages come to the driver."""
    words = max(1, -(-len(languages) // 64))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("number") % 64).cast("int"))
    kept = counts.groupBy("gram", F.floor(F.col("number") / 64).cast("int").alias("word")).agg(*[F.coalesce(F.bit_or(F.when(t, bit)), F.lit(0).cast("long")).alias(f"m{i}") for i, t in enumerate(tests)])
    names = [f"m{i}" for i in range(len(tests))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = places(batch.column("gram").to_numpy().astype(np.uint32))
            rest = [pa.array(np.tile(batch.column(c).to_numpy(), HASHES)) for c in ("word", *names)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), *rest], names=["place", "word", *names])

    table = kept.mapInArrow(place, "place long, word int, " + ", ".join(f"{c} long" for c in names))
    table = table.groupBy("place", "word").agg(*[F.bit_or(c).alias(c) for c in names]).toArrow()
    out = []
    for c in names:
        masks = np.zeros((PLACES, words), np.uint64)
        masks[table.column("place").to_numpy(), table.column("word").to_numpy()] = table.column(c).to_numpy().astype(np.int64).view(np.uint64)
        out.append(masks)
    return out


def fit_filters(docs: DataFrame, lang: str = "lang", text: str = "text", trial: Column | None = None, shares: tuple[float, ...] = SHARES) -> Filters:
    """Filters from all rows with a language.

    trial marks rows on which shares are tried, with filters of the others; the share with most rows
    told right holds (the smallest of equal ones), for filters of all rows.
    """
    trial = F.lit(False) if trial is None else F.coalesce(trial, F.lit(False))
    known = docs.where(docs[quoted(lang)].isNotNull()).select(docs[quoted(lang)].cast("string").alias("lang"), docs[quoted(text)].alias("text"), trial.alias("trial"))
    counts = count_grams(known)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("tried").alias("tried")).orderBy("lang").collect()
    languages = [r.lang for r in totals]
    if not languages:
        return Filters([], np.zeros((PLACES, 1), np.uint8), np.zeros(0))
    numbered = [(r.lang, k, float(r.total), float(r.total - r.tried)) for k, r in enumerate(totals)]
    numbers = docs.sparkSession.createDataFrame(numbered, "lang string, number int, total double, rest double")
    counts = counts.join(F.broadcast(numbers), "lang")
    rest = F.col("n") - F.col("tried")
    share = shares[0]
    if len(shares) > 1 and any(r.tried for r in totals):
        made = make_masks(counts, languages, [(rest > 0) & (rest >= s * F.col("rest")) for s in shares])
        right = told_right(known.where("trial"), [Filters.of(languages, m) for m in made])
        share = shares[int(np.argmax(right))]
    (masks,) = make_masks(counts, languages, [F.col("n") >= share * F.col("total")])
    return Filters.of(languages, masks)


def told_right(rows: DataFrame, made: list[Filters]) -> list[int]:
    """How many rows (lang, text) each of the filters tells right."""
    sent = rows.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            code, row = grams(batch.column("text"))
            said = np.array(batch.column("lang").to_pylist(), dtype=object)
            own = sent.value
            right = [int((np.array(f.languages, dtype=object)[f.shares(code, row, batch.num_rows).argmax(1)] == said).sum()) for f in own]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int32()), pa.array(right, pa.int64())], names=["filter", "n"])

    found = {r.filter: r.n for r in rows.select("lang", "text").mapInArrow(run, "filter int, n long").groupBy("filter").agg(F.sum("n").alias("n")).collect()}
    sent.unpersist()
    return [found.get(k, 0) for k in range(len(made))]


def identify(docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every whole text. The filters have a fixed size and go to executors once."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        names = np.array([*own.languages, UNKNOWN], dtype=object)
        for batch in pieces(batches, "text"):
            texts = batch.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if own.languages:
                shares = own.shares(*grams(texts), len(texts))
                best, score = shares.argmax(1), shares.max(1)
            else:
                best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                lettered = np.zeros(len(texts), bool)
            best[~lettered], score[~lettered] = len(own.languages), 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(docs[quoted(key)].cast("long").alias("doc_id"), docs[quoted(text)].alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(key: str = "doc_id", remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == remainder, F.lit(False))


def op6_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares are tried on a third of the training rows, those of remainder 3."""
    docs = documents(spark, sf_dir)
    filters = fit_filters(docs.where(~held_out()), trial=held_out(remainder=3))
    return identify(docs, filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
