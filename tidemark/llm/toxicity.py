"""Toxicity by classifier chains.

Categories are predicted one after the other by linear models over hashed words and word beginnings;
each model also gets the probabilities of the categories before it. In training those are
out-of-fold predictions, so a later model meets earlier ones as uncertain as they will be.

A feature's value is the share of a document's words, up to one in RATE, that fall into its bucket, so
length alone changes nothing; whole words also count as present, once or SEEN times, so a few of them
show in a long text. Values are whole parts of SCALE, so sums don't depend on their order.

The models are fitted on a bounded, documented sample of labelled rows. Its texts stay where they are:
features are chosen by sums over the sample, and only values of chosen features, at most FEATURES a
category, go to the tasks that fit, one task for each fold. Every whole text is scored.

Defined cases: a null or empty text has no features and gets the models' base rates; null labels
count as 0; of several rows of a labelled id one is learnt from; all repeated rows are scored, alike;
an empty table gives an empty table; without labelled rows all probabilities are 0; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.arrow import flat, pieces, word_hashes, words
from tidemark.llm.common import discard, documents, quoted, written

BUCKETS = 1 << 20
BEGINNINGS = (4, 5, 6, 7, 8)
RATE = 60
SEEN = 2
SCALE = 1 << 20
#: Labelled rows that fit the models: at most so many that are toxic, and as many others, by the md5 of their id.
SAMPLE_PER_CLASS = 2000
FEATURES = 192
FOLDS = 5
PENALTY = 0.1
THRESHOLD = 0.5
#: Letters stay, other ASCII separates words.
SPACE = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and word beginnings, their rows, and words by row."""
    data, starts = flat(pc.utf8_lower(pc.fill_null(texts, "")))
    begin, end, row = words(data, starts, SPACE)
    (one,) = word_hashes(data, begin, end, b"word")
    found, rows = [one], [row]
    for n in BEGINNINGS:
        long = end - begin >= n
        found += word_hashes(data, begin[long], begin[long] + n, b"beginning")
        rows.append(row[long])
    half = BUCKETS // 2
    bucket = (np.concatenate([*found, one]) % np.uint64(half)).astype(np.int64)
    bucket[len(bucket) - len(row) :] += half  # the upper half is for words as present
    return bucket, np.concatenate([*rows, row]), np.bincount(row, minlength=len(texts))


def values(bucket: np.ndarray, row: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket) with their values in parts of SCALE."""
    pair, count = np.unique(row * BUCKETS + bucket, return_counts=True)
    row, bucket = pair // BUCKETS, pair % BUCKETS
    value = np.where(bucket < BUCKETS // 2, RATE * count / n_words[row], count / SEEN)
    return bucket, row, np.rint(SCALE * np.minimum(1.0, value)).astype(np.int64)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last is the base) of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], PENALTY)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def chosen_features(found: DataFrame, told: DataFrame, categories: list[str], sizes: dict) -> np.ndarray:
    """Buckets whose mean value differs most between the sides of a category, at most FEATURES for each; few numbers come to the driver."""
    value = F.col("value")
    sums = [F.sum(v * w).alias(n) for k in categories for v, w, n in ((value, F.col(quoted(k)), f"s_{k}"), (value * value, F.col(quoted(k)), f"q_{k}"))]
    stats = found.join(F.broadcast(told), "at").groupBy("bucket").agg(F.sum("value").alias("s"), F.sum(value * value).alias("q"), *sums)
    stats = written(stats, "stats")
    chosen: set[int] = set()
    for k in categories:
        side = []
        for s, q, m in ((F.col(quoted(f"s_{k}")), F.col(quoted(f"q_{k}")), sizes[k]), (F.col("s") - F.col(quoted(f"s_{k}")), F.col("q") - F.col(quoted(f"q_{k}")), sizes[""] - sizes[k])):
            mean = s / (SCALE * max(1, m))
            side.append((mean, (q / (float(SCALE) ** 2 * max(1, m)) - mean * mean + 1e-4) / max(1, m)))
        score = F.abs((side[0][0] - side[1][0]) / F.sqrt(side[0][1] + side[1][1]))
        chosen |= {r.bucket for r in stats.select("bucket", score.alias("score")).orderBy(F.desc("score"), "bucket").limit(FEATURES).collect()}
    discard(stats)
    return np.array(sorted(chosen), np.int64)


def fit_folds(matrix: DataFrame, places: np.ndarray, y: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Out-of-fold predictions of a category and the weights of the model of all rows; each fold is a task's work.

    matrix: (at, bucket, value) of chosen features. It is copied to FOLDS + 1 groups of bounded size.
    """
    n = len(y)
    fold = np.arange(n) % FOLDS

    def fitted(k: int, at: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        x = np.zeros((n, len(places)))
        held = value > 0
        x[at[held], np.searchsorted(places, bucket[held])] = value[held] / SCALE
        x = np.column_stack([x, earlier])
        if k < FOLDS:
            place = np.flatnonzero(fold == k)
            out = probability(x[place], logistic(x[fold != k], y[fold != k]))
        else:
            out = logistic(x, y)
            place = np.arange(len(out))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(out), k == FOLDS)), pa.array(place), pa.array(out)], names=["whole", "place", "out"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy() for c in ("fold", "at", "bucket", "value")])
            for k in np.unique(rows[:, 0]).tolist():
                held.setdefault(k, []).append(rows[rows[:, 0] == k, 1:])
        for k, parts in sorted(held.items()):
            yield fitted(k, *np.concatenate(parts).T)

    copies = matrix.select(F.explode(F.sequence(F.lit(0), F.lit(FOLDS))).alias("fold"), "at", "bucket", "value")
    # a row of value 0 for each fold, so that each is fitted even if no feature was chosen or found
    spark = matrix.sparkSession
    copies = copies.unionAll(spark.range(FOLDS + 1).select(F.col("id").cast("int").alias("fold"), F.lit(0).cast("long"), F.lit(int(places[0]) if len(places) else 0).cast("long"), F.lit(0).cast("long")))
    found = copies.repartition(FOLDS + 1, "fold").mapInArrow(run, "whole boolean, place long, out double").collect()
    out, weights = np.zeros(n), np.zeros(len(places) + earlier.shape[1] + 1)
    for r in found:
        (weights if r.whole else out)[r.place] = r.out
    return out, weights


def fit_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], first: str = "toxic", sample: int = SAMPLE_PER_CLASS, key: str = "doc_id", text: str = "text") -> dict | None:
    """Models of the chain over categories (columns over labels), in their order.

    The sample is stratified by the category `first`. Its ids are few and go to all executors.
    """
    names = list(categories)
    told = labels.where(F.col("doc_id").isNotNull()).select("doc_id", *[F.coalesce(c, F.lit(False)).cast("long").alias(k) for k, c in categories.items()])
    told = told.groupBy(F.col("doc_id").alias("id")).agg(*[F.max(quoted(k)).alias(k) for k in names])
    rates = told.agg(F.count("*").alias("n"), *[F.avg(quoted(k)).alias(k) for k in names]).first()
    if not rates["n"]:
        return None
    order = [F.md5(F.col("id").cast("string").cast("binary")), F.col("id")]
    side = lambda v: told.where(F.col(quoted(first)) == v).orderBy(*order).limit(sample)
    taken = side(1).unionAll(side(0))
    rows = docs.select(docs[quoted(key)].alias("doc_id"), docs[quoted(text)].alias("text")).join(F.broadcast(taken), F.col("doc_id") == F.col("id"))
    rows = rows.groupBy("id", *map(quoted, names)).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = written(rows.withColumn("at", F.row_number().over(Window.orderBy(*order)).cast("long") - 1), "sample")  # a bounded number of rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            bucket, row, value = values(*features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("at").to_numpy()[row]), pa.array(bucket), pa.array(value)], names=["at", "bucket", "value"])

    spark = docs.sparkSession
    told = rows.select("at", *map(quoted, names))
    y = {r["at"]: [r[k] for k in names] for r in told.collect()}
    if not y:
        return None
    y = np.array([y[k] for k in range(len(y))], float)
    dealt = rows.select("at", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = written(dealt.mapInArrow(run, "at long, bucket long, value long"), "features")
    places = chosen_features(found, told, names, {"": len(y), **{k: int(y[:, i].sum()) for i, k in enumerate(names)}})
    matrix = written(found.where(F.col("bucket").isin(places.tolist())), "matrix")
    models, earlier = [], np.zeros((len(y), 0))
    logit = lambda p: np.log(p / (1 - p))
    for i, k in enumerate(names):
        out, w = fit_folds(matrix, places, y[:, i], earlier)
        w[-1] += logit(np.clip(rates[k], 1e-3, 1 - 1e-3)) - logit(np.clip(y[:, i].mean(), 1e-3, 1 - 1e-3))  # to the rate outside the sample
        models.append(w.tolist())
        earlier = np.column_stack([earlier, out])
    discard(rows, found, matrix)
    return {"places": places.tolist(), "models": models}


def score_toxicity(docs: DataFrame, model: dict | None, categories: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and p_<category> for each category of the chain, of every whole text."""
    schema = "doc_id long, " + ", ".join(f"`p_{k}` double" for k in categories)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model:
            places = np.array(model["places"])
            weights = [np.array(w) for w in model["models"]]
            number = np.full(BUCKETS, -1, np.int32)
            number[places] = np.arange(len(places))
        for batch in pieces(batches, "text"):
            found = np.zeros((batch.num_rows, len(categories)))
            if model:
                bucket, row, n_words = features(batch.column("text"))
                held = number[bucket] >= 0
                b, r, v = values(bucket[held], row[held], n_words)
                for k, w in enumerate(weights):
                    own, chained = w[: len(places)], w[len(places) : -1]
                    total = np.bincount(r, own[number[b]] * v / SCALE, batch.num_rows) + w[-1] + found[:, :k] @ chained
                    found[:, k] = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c) for c in found.T.copy()]], names=["doc_id", *[f"p_{k}" for k in categories]])

    rows = docs.select(docs[quoted(key)].cast("long").alias("doc_id"), docs[quoted(text)].alias("text"))
    return rows.mapInArrow(run, schema)


#: The labels table tells two things, quality and toxicity; the chain goes from the one to the other to both at once.
CATEGORIES = {
    "low_quality": "quality = 0",
    "toxic": "toxic = 1",
    "toxic_and_low_quality": "toxic = 1 AND quality = 0",
}


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels, {k: F.expr(c) for k, c in CATEGORIES.items()})
    scored = score_toxicity(docs, model, list(CATEGORIES))
    return scored.select("doc_id", *[F.round(f"p_{k}", 6).alias(f"p_{k}") for k in CATEGORIES], (F.col("p_toxic") >= THRESHOLD).alias("toxic"))
