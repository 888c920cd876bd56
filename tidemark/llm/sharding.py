"""Sharding by jump consistent hashing (Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm", 2014).

Native: DataFrame functions only. The 64-bit generator of the paper is kept as two 32-bit
halves in longs, since a plain product would overflow under ANSI rules.

Defined cases: a key of whole numbers hashes as itself, any other by the 64-bit hash of its text; a
null key hashes as 0 and goes to the shard of key 0; a null text has size 16 and CRC 0; equal keys
share a shard and take neighbouring slots, ordered by size and CRC; an empty table gives an empty
table; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import discard, documents, quoted, written
from tidemark.llm.sql import CRC_TABLE, crc32

#: Fixed value: multiplier of the paper's generator, as 16-bit limbs from the lowest.
MULTIPLIER = 2862933555777941757
LIMBS = [(MULTIPLIER >> (16 * i)) & 0xFFFF for i in range(4)]
LOW = 0xFFFFFFFF


def _advance(state: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2**64 on the halves (hi, lo)."""
    hi, lo = state["hi"], state["lo"]
    low, second = lo * LIMBS[0], lo * LIMBS[1]
    bottom = low + F.shiftleft(second.bitwiseAND(0xFFFF), 16) + 1
    upper = (
        F.shiftright(bottom, 32)
        + F.shiftright(second, 16)
        + lo * LIMBS[2]
        + hi * LIMBS[0]
        + F.shiftleft((lo * LIMBS[3] + hi * LIMBS[1]).bitwiseAND(0xFFFF), 16)
    )
    return upper.bitwiseAND(LOW), bottom.bitwiseAND(LOW)


def jump_shards(key: Column, counts: list[int]) -> Column:
    """Struct of shards s0, s1, ... of a long key, one for each shard count in counts.

    One walk serves all counts: the jumps don't depend on the count, which only says where to stop.
    A walk makes at most max(counts) jumps, since each lands beyond the last.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.shiftright(key, 32).bitwiseAND(LOW).alias("hi"),
        key.bitwiseAND(LOW).alias("lo"),
        *[F.lit(0).cast("int").alias(f"s{i}") for i in range(len(counts))],
    )

    def jump(state: Column, _: Column) -> Column:
        hi, lo = _advance(state)
        landed = F.floor((state["at"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(
            landed.cast("long").alias("at"),
            hi.alias("hi"),
            lo.alias("lo"),
            *[F.when(landed < n, landed.cast("int")).otherwise(state[f"s{i}"]).alias(f"s{i}") for i, n in enumerate(counts)],
        )
        return F.when(state["at"] >= max(counts), state).otherwise(moved)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(max(counts))), start, jump)
    return F.transform(F.array(walked), lambda s: F.struct(*[s[f"s{i}"].alias(f"s{i}") for i in range(len(counts))]))[0]


def shard_table(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's shard among `shards`, its gapless slot there, and its shard if one more is appended.

    The text is read once, for size and CRC. Rows are dealt out by sampled ranges of (shard, key,
    size, CRC, place in the table), so no key, shard or spread of keys makes a task larger than others,
    and sorted within. A row's slot is its place in its range, after the rows that earlier ranges have
    of its shard; these counts are as many as ranges and shards together.
    """
    raw = F.encode(docs[quoted(text)], "UTF-8")
    whole = isinstance(docs.schema[key].dataType, T.IntegralType)
    rows = docs.select(
        docs[quoted(key)].alias("doc_id"),
        (F.coalesce(F.length(raw), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        jump_shards(docs[quoted(key)] if whole else F.when(docs[quoted(key)].isNotNull(), F.xxhash64(docs[quoted(key)].cast("string"))), [shards, shards + 1]).alias("to"),
    ).select("doc_id", "size", "text_crc32", F.col("to.s0").alias("shard"), F.col("to.s1").alias("grown_shard"), F.monotonically_increasing_id().alias("place"))
    rows = written(rows, "shards")
    order = [F.col("shard"), F.asc_nulls_first("doc_id"), F.col("size"), F.col("text_crc32"), F.col("place")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("place")
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "ranges")  # range and place in it hold from here on
    discard(rows)
    ranged = ranged.withColumn("range", F.shiftright("at", 33))
    counts = ranged.groupBy("shard", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ranged.join(F.broadcast(starts), ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("at") - F.col("first")).cast("long").alias("slot"), "grown_shard",
    )


def op9_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(documents(spark, sf_dir), shards=40)


SQL = f"""WITH RECURSIVE {CRC_TABLE},
walk AS (
  SELECT doc_id, CAST(coalesce(doc_id, 0) AS HUGEINT) + CASE WHEN doc_id < 0 THEN 18446744073709551616 ELSE 0 END AS k, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS s0, CAST(0 AS BIGINT) AS s1
  FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, k, pos, CASE WHEN pos < 40 THEN pos ELSE s0 END, CASE WHEN pos < 41 THEN pos ELSE s1 END FROM (
    SELECT doc_id, k, CAST(floor((pos + 1) * (2147483648.0::DOUBLE / CAST(k // 8589934592 + 1 AS DOUBLE))) AS BIGINT) AS pos, s0, s1 FROM (
      SELECT doc_id, (k * {MULTIPLIER} + 1) % 18446744073709551616 AS k, pos, s0, s1 FROM walk WHERE pos < 41))),
landed AS (SELECT doc_id, max(s0) AS s0, max(s1) AS s1 FROM walk GROUP BY doc_id),
placed AS (
  SELECT d.doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 16 AS BIGINT) AS size, CAST(coalesce({crc32("text")}, 0) AS BIGINT) AS text_crc32, s0, s1
  FROM crc_table, documents d JOIN landed l ON l.doc_id IS NOT DISTINCT FROM d.doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(s0 AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY s0 ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(s1 AS INTEGER) AS grown_shard FROM placed"""
