"""Quality rules: countable base rules, then a hashed n-gram log-likelihood ratio.

Native: DataFrame functions only, no shuffle of texts. A document's score is the mean over its words
of log(p_target / p_raw), with multinomials over hashed n-grams, from trusted labelled documents and
from all documents (Xie et al., "Data Selection for Language Models via Importance Resampling",
2023). Two families of n-grams are summed: the words themselves, in WORD_BUCKETS, and their last three
characters, in END_BUCKETS; so a word that was never seen still has a likely or unlikely ending. The target is smoothed towards the raw share by SMOOTHING words: a bucket that no trusted
document has fallen into weighs more the more trusted words there are, and texts that are like all
others score about 0 whatever the size of the target. Weights are whole millionths, so sums don't
depend on the order of addition.

Defined cases: a null or empty text has no words and fails the base rules; with no trusted
document all weights are 0 and the base rules decide alone; repeated rows are judged one by one and
counted one by one; null labels are not trusted; an empty table gives an empty table. The caller's
columns are kept, but for those that are named like a result; in the stage all are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, evenly_spaced, kept_whole, plain_words, quoted
from tidemark.llm.sql import CRC_TABLE, crc32

#: Primes, so that all bits of a word's CRC-32 count.
WORD_BUCKETS, END_BUCKETS = 16_381, 4_093
BUCKETS = WORD_BUCKETS + END_BUCKETS
#: Words by which the target is smoothed towards the raw share.
SMOOTHING = 10_000
#: At most so many trusted documents, those with the smallest md5 of their id, fit the target.
TRUSTED_DOCS = 20_000
#: Least mean weight of a kept document, in millionths of a nat.
THRESHOLD = -1_000_000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _based(rows: DataFrame) -> DataFrame:
    """rows (row, text) with the base columns beside them. Windows are compared by 64-bit hashes; only texts with some window twice are sorted."""
    t = F.coalesce("text", F.lit(""))
    out = rows.withColumn("spaced", evenly_spaced(F.col("text")))
    out = out.withColumn("words", F.array_remove(F.split("spaced", " "), "")).withColumn("n_words", F.size("words").cast("long"))
    out = out.withColumn("word_chars", F.length(F.replace(F.col("spaced"), F.lit(" "), F.lit(""))).cast("long"))
    symbols = F.when(t.rlike(f"[{SYMBOLS}]"), F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).otherwise(0)
    out = out.withColumn("n_symbols", symbols.cast("long"))
    out = out.withColumn("lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    out = out.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))
    starts = F.when(F.size("hashes") >= WINDOW, F.sequence(F.lit(0), F.size("hashes") - WINDOW)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("wins", F.transform(starts, lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)])))
    repeats = F.size(F.array_distinct("wins")) < F.size("wins")
    out = out.withColumn("ordered", F.when(repeats, F.sort_array(F.transform("wins", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    alike = lambda e, k: (F.get("ordered", k)["h"] == e["h"])
    twice = F.filter("ordered", lambda e, k: F.coalesce(alike(e, k - 1), F.lit(False)) | F.coalesce(alike(e, k + 1), F.lit(False)))
    out = out.withColumn("places", F.sort_array(F.transform(twice, lambda e: e["i"])))
    gaps = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))).cast("long"))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return out.withColumn("base_failed", failed).drop("spaced", "lines", "hashes", "wins", "ordered", "places")


def _rows(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(kept_whole(docs), docs[quoted(text)].alias("text"))


def _spread(judged: DataFrame, docs: DataFrame, named: list[str]) -> DataFrame:
    """The caller's columns, but for those of these names, and the named columns."""
    own = [F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns if c.lower() not in named]
    return judged.select(*own, *named)


def base_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    return _spread(_based(_rows(docs, text)), docs, MEASURES)


def word_bucket(word: Column) -> Column:
    return (F.crc32(word.cast("binary")) % WORD_BUCKETS).cast("int")


def end_bucket(word: Column) -> Column:
    """Bucket of a word's last three characters; these come after the words' own."""
    return (F.crc32(F.substring(word, -3, 3).cast("binary")) % END_BUCKETS + WORD_BUCKETS).cast("int")


def fit_weights(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", trusted_docs: int = TRUSTED_DOCS) -> list[int]:
    """Weights of all buckets in millionths: log of target over raw share.

    Every document counts for the raw share, and the trusted ones for the target. Map-side sums leave
    BUCKETS rows a task to shuffle. BUCKETS numbers come to the driver.
    """
    trusted = (
        labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("id")).distinct()
        .orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(trusted_docs)
        .withColumn("trusted", F.lit(1))
    )
    rows = docs.select(docs[quoted(key)].alias("key"), docs[quoted(text)].alias("text"))
    words = rows.join(F.broadcast(trusted), F.col("key") == F.col("id"), "left").select("trusted", F.explode(plain_words(F.col("text"))).alias("w"))
    grams = words.select("trusted", F.explode(F.array(word_bucket(F.col("w")), end_bucket(F.col("w")))).alias("b"))
    found = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("trusted").alias("target")).collect()
    words = [r for r in found if r.b < WORD_BUCKETS]
    raws, targets = sum(r.raw for r in words), sum(r.target for r in words)
    weights = [0] * BUCKETS
    for r in found if targets else []:
        share = r.raw / raws
        weights[r.b] = round(math.log((r.target + SMOOTHING * share) / (targets + SMOOTHING) / share) * 1e6)
    return weights


def _judged(docs: DataFrame, labels: DataFrame, key: str, text: str, threshold: int) -> DataFrame:
    weights = F.split(F.lit(",".join(map(str, fit_weights(docs, labels, key, text)))), ",").cast("array<long>")  # folded to one literal
    out = _based(_rows(docs, text))
    out = out.withColumn("total", F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.get(weights, word_bucket(w)) + F.get(weights, end_bucket(w))))
    out = out.withColumn("score", F.when(F.col("n_words") > 0, F.col("total") / F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("total") >= F.col("n_words") * threshold)).drop("words", "total")


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """docs with the base columns, score (mean weight of a word in millionths) and kept."""
    return _spread(_judged(docs, labels, key, text, threshold), docs, [*MEASURES, "score", "kept"])


COLUMNS = ["doc_id", *MEASURES, "kept"]


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with the columns of documents.

    The filter is tied to a row number, so that it isn't moved below the columns it needs, which
    would then be computed again for each of their uses.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = _judged(docs, labels, "doc_id", "text", THRESHOLD)
    return judged.withColumn("keep", F.col("kept") & (F.monotonically_increasing_id() >= 0)).where("keep").select("row.*")


#: Grams and weights for DuckDB, for `docs` a table name.
def _sql_parts(docs: str) -> str:
    blank = "regexp_replace(coalesce(text, ''), '[\\x09-\\x0D]', ' ', 'g')"
    return f"""
base0 AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t,
         list_filter(string_split({blank}, ' '), lambda x: x <> '') AS w
  FROM {docs}),
wins AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS c
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM base0)),
covered AS (
  SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (
    SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM wins WHERE c > 1) GROUP BY rid),
based AS (
  SELECT b.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM base0) b
  LEFT JOIN covered c ON c.rid = b.rid),
failing AS (
  SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM based),
{CRC_TABLE},
told AS (SELECT rid, doc_id, unnest(w) AS word FROM base0),
codes AS (SELECT said, {crc32("said")} AS c FROM (SELECT DISTINCT word AS said FROM told UNION SELECT DISTINCT right(word, 3) FROM told), crc_table),
grams AS (
  SELECT rid, doc_id, c % {WORD_BUCKETS} AS b FROM told JOIN codes ON said = word
  UNION ALL SELECT rid, doc_id, {WORD_BUCKETS} + c % {END_BUCKETS} FROM told JOIN codes ON said = right(word, 3)),
trusted AS (
  SELECT DISTINCT doc_id AS tid FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0
  ORDER BY md5(CAST(tid AS VARCHAR)), tid LIMIT {TRUSTED_DOCS}),
counted AS (SELECT b, count(*) AS raw, count(tid) AS target FROM grams LEFT JOIN trusted ON doc_id = tid GROUP BY b),
totals AS (SELECT sum(raw) AS raws, sum(target) AS targets FROM counted WHERE b < {WORD_BUCKETS}),
weights AS (
  SELECT b, CASE WHEN targets = 0 THEN 0 ELSE CAST(round_even(ln((target + {SMOOTHING} * (raw / raws)) / (targets + {SMOOTHING}) / (raw / raws)) * 1e6, 0) AS BIGINT) END AS weight FROM counted, totals),
summed AS (SELECT rid, sum(weight) AS s FROM grams JOIN weights USING (b) GROUP BY rid),
judged AS (
  SELECT f.*, NOT base_failed AND coalesce(s, 0) >= n_words * ({THRESHOLD}) AS kept FROM failing f LEFT JOIN summed s ON s.rid = f.rid)"""


SQL = f"WITH {_sql_parts('documents')} SELECT {', '.join(COLUMNS)} FROM judged"
