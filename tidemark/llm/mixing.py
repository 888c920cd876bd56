"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells (source, language, topic) are raked in turn to the three target
marginals; a cell never gets more than it holds, so the others take up what it can't give. A
document's probability is its cell's raked share, and a hash of its id decides, the same on every
run. Where cells hold too little, targets can't be met; `marginals` tells for each value what was
wanted and what is reached.

A topic is given by the caller as a column. Without one, documents are told apart by their form (table,
licensed, brief, long, prose); this is no topic model.

Targets: shares by value, or a power of the observed shares (1 keeps them, 0 makes values equal).

Defined cases: a null source or language is a value of its own; a null or empty text has no tokens,
counts as one token, and is of topic 'brief'; repeated rows share their id's fate; an empty table
gives an empty table; a value without a target share gets none; other columns are ignored, and kept by
the stage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, evenly_spaced, kept_whole, plain_words, quoted, written

DIMENSIONS = ("source", "lang", "topic")
#: Power of the observed shares, by dimension.
POWERS = {"source": 0.5, "lang": 0.8, "topic": 0.8}
SWEEPS = 10
#: Share of all tokens that the sample should hold.
BUDGET = 0.6
SEED = 17
#: So many cells are raked on the driver; more are raked as a table.
DRIVER_CELLS = 50_000
NONE = "(none)"


def topic(text: Column, tokens: Column) -> Column:
    """A topic by form, where the table brings none: table, licensed, brief, long or prose."""
    bars = F.length(text) - F.length(F.translate(text, "|", ""))
    return (
        F.when(bars >= 10, "table")
        .when(F.coalesce(text.rlike("[Ll]icen[cs]e"), F.lit(False)), "licensed")
        .when(tokens < 100, "brief").when(tokens >= 1000, "long").otherwise("prose")
    )


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; words are only cut out of texts with two white spaces in a row."""
    said = evenly_spaced(text)
    trimmed = F.trim(said)
    apart = F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1
    return F.when(trimmed == "", 0).when(trimmed.contains("  "), F.size(plain_words(text))).otherwise(apart)


def with_measures(docs: DataFrame, text: str = "text", given: Column | None = None) -> DataFrame:
    """row (all columns of docs), source, lang, topic and tokens."""
    out = docs.select(
        kept_whole(docs), docs[quoted(text)].alias("text"), *[F.coalesce(docs[c].cast("string"), F.lit(NONE)).alias(c) for c in ("source", "lang")],
        *([] if given is None else [F.coalesce(given.cast("string"), F.lit(NONE)).alias("topic")]),
    )
    out = out.withColumn("tokens", F.greatest(word_count(F.col("text")), F.lit(1)).cast("long"))
    return out if given is not None else out.withColumn("topic", topic(F.col("text"), F.col("tokens")))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", given: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic and tokens of each document, written: texts are read once for them."""
    return written(with_measures(docs, text, given).select(F.col(f"row.{quoted(key)}").alias("doc_id"), *DIMENSIONS, "tokens"), "measured")


def _target(totals: dict[str, float], given: dict[str, float] | float) -> dict[str, float]:
    shares = {v: n**given for v, n in totals.items()} if isinstance(given, int | float) else {v: given.get(v, 0.0) for v in totals}
    whole = sum(shares.values()) or 1.0
    return {v: s / whole for v, s in shares.items()}


def rake_cells(cells: list[tuple], targets: dict, sweeps: int = SWEEPS, budget: float = BUDGET) -> np.ndarray:
    """Raked tokens of cells (source, lang, topic, tokens), in their order."""
    held = np.array([c[3] for c in cells], float)
    wanted = held.sum() * budget
    codes, goals = [], []
    for d, name in enumerate(DIMENSIONS):
        values, code = np.unique([c[d] for c in cells], return_inverse=True)
        sums = np.bincount(code, held)
        share = _target(dict(zip(values.tolist(), (sums / held.sum()).tolist(), strict=True)), targets[name])
        codes.append(code)
        goals.append(np.array([share[v] for v in values.tolist()]) * wanted)
    x = held * budget
    for _ in range(sweeps):
        for code, goal in zip(codes, goals, strict=True):
            sums = np.bincount(code, x)
            x = np.minimum(x * np.divide(goal, sums, out=np.zeros_like(goal), where=sums > 0)[code], held)
    return x


def rake_table(cells: DataFrame, targets: dict, sweeps: int = SWEEPS, budget: float = BUDGET) -> DataFrame:
    """The same for a table of any number of cells: a sum and a join for each dimension and sweep.

    Sums have partial sums before their shuffle; each sweep is written, so lost executors cost little.
    """
    whole = cells.agg(F.sum("tokens")).first()[0]
    goals = {}
    for name in DIMENSIONS:
        totals = cells.groupBy(name).agg(F.sum("tokens").alias("t"))
        given = targets[name]
        if isinstance(given, int | float):
            share = F.pow(F.col("t") / F.lit(float(whole)), F.lit(float(given)))
        else:
            share = F.coalesce(*[F.when(F.col(name) == v, F.lit(float(s))) for v, s in given.items()], F.lit(0.0))
        shares = totals.select(F.col(name), share.alias("s"))
        norm = shares.agg(F.sum("s")).first()[0] or 1.0
        goals[name] = written(shares.select(name, (F.col("s") / F.lit(norm) * whole * budget).alias("goal")), "goals")
    x = cells.withColumn("x", F.col("tokens") * F.lit(budget))
    for _ in range(sweeps):
        for name in DIMENSIONS:
            factor = x.groupBy(name).agg(F.sum("x").alias("sum")).join(goals[name], name).select(
                name, F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(0.0).alias("factor")
            )
            x = x.join(factor, name).select(*cells.columns, F.least(F.col("x") * F.col("factor"), F.col("tokens").cast("double")).alias("x"))
        x = written(x, "raked")
    return x


def chance(key: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 from 52 bits of the md5 of seed and id."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(F.encode(said, "UTF-8")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def fit_rates(rows: DataFrame, targets: dict | None = None, budget: float = BUDGET, sweeps: int = SWEEPS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """source, lang, topic and rate of each cell of measured rows.

    At most driver_cells rates go to all executors, so that rows need not be shuffled for them.
    """
    targets = POWERS | (targets or {})
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    few = cells.orderBy(*DIMENSIONS).limit(driver_cells + 1).collect()
    if len(few) > driver_cells:
        raked = rake_table(written(cells, "cells"), targets, sweeps, budget)
        return raked.select(*DIMENSIONS, (F.col("x") / F.col("tokens")).alias("rate"))
    listed = [tuple(r) for r in few]
    raked = rake_cells(listed, targets, sweeps, budget) if listed else []
    table = [(*c[:3], float(x / c[3])) for c, x in zip(listed, raked, strict=True)]
    return F.broadcast(rows.sparkSession.createDataFrame(table, "source string, lang string, topic string, rate double"))


def marginals(rows: DataFrame, rates: DataFrame, targets: dict | None = None, budget: float = BUDGET) -> DataFrame:
    """dimension, value, held, wanted and reached tokens of each value, of measured rows under the rates of their cells."""
    targets = POWERS | (targets or {})
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")).join(rates, list(DIMENSIONS))
    out = None
    for name in DIMENSIONS:
        sums = cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("held"), F.sum(F.col("tokens") * F.col("rate")).alias("reached"))
        whole = sums.agg(F.sum("held").alias("whole"))
        given = targets[name]
        if isinstance(given, int | float):
            share = F.pow(F.col("held") / F.col("whole"), F.lit(float(given)))
        else:
            share = F.coalesce(*[F.when(F.col("value") == v, F.lit(float(s))) for v, s in given.items()], F.lit(0.0))
        shares = sums.crossJoin(F.broadcast(whole)).withColumn("share", share)  # one row
        norm = shares.agg(F.sum("share").alias("norm"))
        one = shares.crossJoin(F.broadcast(norm)).select(F.lit(name).alias("dimension"), "value", F.col("held").cast("long").alias("held"), (F.col("share") / F.col("norm") * F.col("whole") * budget).alias("wanted"), "reached")
        out = one if out is None else out.unionAll(one)
    return out


def mix_sources(docs: DataFrame, targets: dict | None = None, budget: float = BUDGET, key: str = "doc_id", text: str = "text", given: Column | None = None, **options) -> DataFrame:
    """doc_id, source, lang, topic, tokens, rate and sampled, for each document; `given` is its topic.

    The narrow table of measures is written, its cells are summed and raked.
    """
    rows = measured(docs, key, text, given)
    rates = fit_rates(rows, targets, budget, **options)
    drawn = (chance(F.col("doc_id")) < F.col("rate")).alias("sampled")
    return rows.join(rates, list(DIMENSIONS)).select("doc_id", *DIMENSIONS, "tokens", "rate", drawn)


def op2_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", *DIMENSIONS, "tokens", F.round(F.col("rate") * 1e6).cast("long").alias("rate_ppm"), "sampled")


def op2_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source, language and topic holds, should give and gives, in whole tokens."""
    rows = measured(documents(spark, sf_dir))
    whole = lambda c: F.round(c).cast("long").alias(c)
    return marginals(rows, fit_rates(rows)).select("dimension", "value", "held", whole("wanted"), whole("reached"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents. Whole rows meet the rates of their cells, so texts are read twice but not shuffled."""
    rates = fit_rates(measured(docs))
    met = with_measures(docs).drop("text").join(rates, list(DIMENSIONS))
    return met.where(chance(F.col("row.doc_id")) < F.col("rate")).select("row.*")


def _sql_parts(docs: str) -> str:
    """Measures, raked cells and drawn rows for DuckDB, for `docs` a table name."""
    powers = ", ".join(f"pow(sum(tokens) OVER (PARTITION BY {d}) / sum(tokens) OVER (), {POWERS[d]}) AS s_{d}" for d in DIMENSIONS)
    first = ", ".join(f"row_number() OVER (PARTITION BY {d} ORDER BY source, lang, topic) AS f_{d}" for d in DIMENSIONS)
    goals = ", ".join(f"s_{d} / sum(CASE WHEN f_{d} = 1 THEN s_{d} ELSE 0 END) OVER () * sum(tokens) OVER () * {BUDGET} AS g_{d}" for d in DIMENSIONS)
    steps, last = [], "x0"
    for n in range(SWEEPS):
        for d in DIMENSIONS:
            now = f"x{n}_{d}"
            steps.append(f"{now} AS (SELECT * REPLACE (CASE WHEN sx > 0 THEN least(x * g_{d} / sx, CAST(tokens AS DOUBLE)) ELSE 0 END AS x) FROM (SELECT * EXCLUDE (sx), sum(x) OVER (PARTITION BY {d}) AS sx FROM {last}))")
            last = now
    return f"""
told AS (
  SELECT *, coalesce(CAST(source AS VARCHAR), '{NONE}') AS c_source, coalesce(CAST(lang AS VARCHAR), '{NONE}') AS c_lang,
         greatest(len(list_filter(string_split(regexp_replace(coalesce(text, ''), '[\x09-\x0D]', ' ', 'g'), ' '), lambda x: x <> '')), 1) AS c_tokens
  FROM {docs}),
measured AS (
  SELECT *, CASE WHEN length(text) - length(replace(text, '|', '')) >= 10 THEN 'table' WHEN regexp_matches(text, '[Ll]icen[cs]e') THEN 'licensed'
                 WHEN c_tokens < 100 THEN 'brief' WHEN c_tokens >= 1000 THEN 'long' ELSE 'prose' END AS c_topic FROM told),
cells AS (SELECT c_source AS source, c_lang AS lang, c_topic AS topic, CAST(sum(c_tokens) AS DOUBLE) AS tokens FROM measured GROUP BY ALL),
shares AS (SELECT *, {powers}, {first} FROM cells),
x0 AS (SELECT *, {goals}, tokens * {BUDGET} AS x, CAST(0 AS DOUBLE) AS sx FROM shares),
{", ".join(steps)},
drawn AS (
  SELECT m.*, x / tokens AS rate,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / {float(1 << 52)} < x / tokens AS sampled
  FROM measured m JOIN {last} r ON c_source = r.source AND c_lang = r.lang AND c_topic = r.topic)"""


SQL = f"""WITH {_sql_parts("documents")}
SELECT doc_id, c_source AS source, c_lang AS lang, c_topic AS topic, CAST(c_tokens AS BIGINT) AS tokens, CAST(round(rate * 1e6) AS BIGINT) AS rate_ppm, sampled FROM drawn"""

MARGINALS_SQL = f"""WITH {_sql_parts("documents")},
said AS (SELECT c_source, c_lang, c_topic, c_tokens, rate, unnest([struct_pack(dimension := 'source', value := c_source), struct_pack(dimension := 'lang', value := c_lang), struct_pack(dimension := 'topic', value := c_topic)]) AS v FROM drawn),
sums AS (SELECT v.dimension AS dimension, v.value AS value, sum(c_tokens) AS held, sum(c_tokens * rate) AS reached FROM said GROUP BY ALL),
value_shares AS (SELECT *, sum(held) OVER (PARTITION BY dimension) AS whole, pow(held / sum(held) OVER (PARTITION BY dimension), CASE dimension {" ".join(f"WHEN '{d}' THEN {p}" for d, p in POWERS.items())} END) AS share FROM sums)
SELECT dimension, value, CAST(held AS BIGINT) AS held, CAST(round(share / sum(share) OVER (PARTITION BY dimension) * whole * {BUDGET}) AS BIGINT) AS wanted, CAST(round(reached) AS BIGINT) AS reached FROM value_shares"""
