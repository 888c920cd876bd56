"""The read queries over fact tables (columns as in tidemark.schemas), as known at a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import instant_or_day_window
from tidemark.operators.pit import as_of_latest, effective_on, newest, revision_policy

MODES = ("headline", "snippet", "full_text")
BAR_KEYS = ["bar_id", "instrument_id", "region", "interval", "adjustment", "bar_start", "bar_end", "trading_date"]
RELEASE_KEYS = ["release_id", "region", "series_id", "scheduled_at", "scheduled_date"]


def _among(df: DataFrame, column: str, values) -> DataFrame:
    return df if values is None else df.where(F.col(column).isin(sorted(values)))


def list_instruments(instruments: DataFrame, regions=None, venues=None, asset_classes=None, active_on: Column | None = None, modified_since: Column | None = None, limit: int = 1000) -> DataFrame:
    rows = _among(_among(_among(instruments, "region", regions), "venue_mic", venues), "asset_class", asset_classes)
    if active_on is not None:
        rows = rows.where(effective_on(active_on, F.col("valid_from"), F.col("valid_to")))
    if modified_since is not None:
        rows = rows.where(F.col("updated_at") >= modified_since)
    return rows.orderBy("instrument_id").limit(limit)


def current_bars(bars: DataFrame, revisions: DataFrame, as_of: Column, **options) -> DataFrame:
    return as_of_latest(bars, revisions, "bar_id", BAR_KEYS, as_of, **options)


def list_bars(bars: DataFrame, revisions: DataFrame, instruments, start: Column, end: Column, as_of: Column, interval: str = "1d", adjustment: str = "raw", limit: int = 5000) -> DataFrame:
    """Filters on columns that all versions of a bar share go before the window, where they reach the scan."""
    inside = (F.col("interval") == interval) & (F.col("adjustment") == adjustment) & (F.col("bar_start") >= start) & (F.col("bar_start") < end)
    base = _among(bars, "instrument_id", instruments).where(inside)
    return current_bars(base, revisions, as_of).orderBy("instrument_id", "bar_start", "bar_id").limit(limit)


def list_snapshots(bars: DataFrame, revisions: DataFrame, instruments, as_of: Column) -> DataFrame:
    """The last raw daily close of each instrument; changes against the day before are left null."""
    base = _among(bars, "instrument_id", instruments).where((F.col("interval") == "1d") & (F.col("adjustment") == "raw"))
    order = [F.col("bar_end").desc(), F.col("available_at").desc(), F.col("bar_id").desc()]
    last = newest(current_bars(base, revisions, as_of), ["instrument_id"], order)
    gone = [F.lit(None).cast("decimal(38,18)").alias(c) for c in ("previous_close", "change", "change_pct", "volume")]
    return last.select("instrument_id", F.col("close").alias("last"), *gone, "bar_end", "available_at").orderBy("instrument_id")


def snapshots_with_change(bars: DataFrame, revisions: DataFrame, instruments, as_of: Column) -> DataFrame:
    """An extension: snapshots whose change columns are filled from the close before."""
    base = _among(bars, "instrument_id", instruments).where((F.col("interval") == "1d") & (F.col("adjustment") == "raw"))
    by = Window.partitionBy("instrument_id").orderBy("bar_end", "bar_id")
    rows = current_bars(base, revisions, as_of).withColumn("previous_close", F.lag("close").over(by))
    last = newest(rows, ["instrument_id"], [F.col("bar_end").desc(), F.col("bar_id").desc()])
    change = F.col("close") - F.col("previous_close")
    return last.select("instrument_id", F.col("close").alias("last"), "previous_close", change.alias("change"), (change.cast("double") / F.col("previous_close").cast("double") * 100).alias("change_pct"))


def list_market_observations(rows: DataFrame, start: Column, end: Column, as_of: Column, regions=None, metrics=None, scopes=None, limit: int = 5000) -> DataFrame:
    found = _among(_among(_among(rows, "region", regions), "metric_code", metrics), "scope_id", scopes)
    found = found.where((F.col("observed_at") >= start) & (F.col("observed_at") < end) & (F.col("available_at") <= as_of))
    return found.orderBy("observed_at", "metric_code", "observation_id").limit(limit)


def list_macro_series(series: DataFrame, regions=None, ids=None, limit: int = 1000) -> DataFrame:
    return _among(_among(series, "region", regions), "series_id", ids).orderBy("series_id").limit(limit)


def list_macro_observations(rows: DataFrame, series, first: Column, last: Column, as_of: Column, policy: str = "latest_as_of", order: str = "availability", by: str = "period_end", limit: int = 5000) -> DataFrame:
    found = _among(rows, "series_id", series).where((F.col(by) >= first) & (F.col(by) <= last))
    found = revision_policy(found, ["series_id", "period_end"], policy, as_of, order)
    return found.orderBy("series_id", "period_end", "available_at", "revision_no").limit(limit)


def list_macro_releases(base: DataFrame, revisions: DataFrame, start: Column, end: Column, as_of: Column, regions=None, limit: int = 1000) -> DataFrame:
    """The window and the order go by the base row's schedule, also for a rescheduled release."""
    inside = instant_or_day_window(F.col("scheduled_at"), F.col("scheduled_date"), start, end)
    found = as_of_latest(_among(base, "region", regions).where(inside), revisions, "release_id", RELEASE_KEYS, as_of)
    return found.orderBy(F.coalesce("scheduled_at", F.col("scheduled_date").cast("timestamp")).asc_nulls_last(), "release_id").limit(limit)


def satisfies_mode(actual: Column, wanted: str) -> Column:
    """headline < snippet < full_text."""
    return F.array_position(F.array(*[F.lit(m) for m in MODES]), actual) >= MODES.index(wanted) + 1


def trim_content(news: DataFrame, mode: str) -> DataFrame:
    """Summary and body beyond the requested mode become null, and the mode says so."""
    none = F.lit(None).cast("string")
    if mode == "headline":
        return news.withColumns({"summary": none, "body": none, "content_mode": F.lit("headline")})
    if mode == "snippet":
        return news.withColumns({"body": none, "content_mode": F.when(F.col("content_mode") == "full_text", "snippet").otherwise(F.col("content_mode"))})
    return news


def without_superseded(page: DataFrame, key: str = "news_id", replaces: str = "supersedes_news_id") -> DataFrame:
    """Rows that no row of the same page replaces."""
    gone = page.where(F.col(replaces).isNotNull()).select(F.col(replaces).alias(key))
    return page.join(gone, key, "left_anti")


def list_news(news: DataFrame, start: Column, end: Column, as_of: Column, regions=None, entities=None, topics=None, languages=None, tiers=None, mode: str = "headline", include_superseded: bool = False, limit: int = 500) -> DataFrame:
    """Filters, order and limit; then superseded rows of the page go, and content is trimmed.

    So a page may hold fewer rows than its limit though more exist.
    """
    found = news.where((F.col("available_at") <= as_of) & instant_or_day_window(F.col("published_at"), F.col("published_date"), start, end))
    texts = lambda values: F.array(*[F.lit(v) for v in sorted(values)])
    if regions is not None:
        found = found.where(F.arrays_overlap("regions", texts(regions)))
    if topics:
        found = found.where(F.arrays_overlap("topics", texts(topics)))
    if entities:
        found = found.where(F.arrays_overlap(F.transform("entities", lambda e: e["entity_id"]), texts(entities)))
    found = _among(_among(found, "language", languages), "source_tier", tiers)
    at = F.coalesce("published_at", F.col("published_date").cast("timestamp"))
    page = found.orderBy(at.desc_nulls_first(), F.col("news_id").asc()).limit(limit)
    if not include_superseded:
        page = without_superseded(page)
    return trim_content(page, mode).orderBy(at.desc_nulls_first(), F.col("news_id").asc())


def cap_clusters(news: DataFrame, k: int, cluster: str = "cluster_id", key: str = "news_id", order: list[Column] | None = None) -> DataFrame:
    """The first k rows of each cluster; a row without a cluster is one of its own."""
    return newest(news.withColumn("_cluster", F.coalesce(F.col(cluster).cast("string"), F.col(key).cast("string"))), ["_cluster"], order or [F.col(key).asc()], k).drop("_cluster")


def capabilities(providers: DataFrame, regions: list[str]) -> DataFrame:
    return providers.where(F.arrays_overlap("regions", F.array(*[F.lit(r) for r in regions])))


def visible(rows: DataFrame, as_of: Column, context_as_of: Column, available: str = "available_at") -> DataFrame:
    """Rows known at both clocks: the query's and the caller's."""
    return rows.where(F.col(available) <= F.least(as_of, context_as_of))


def originals_only(news: DataFrame, replaces: str = "supersedes_news_id") -> DataFrame:
    """A provider's view: corrections fall out and originals stay, the reverse of without_superseded."""
    return news.where(F.col(replaces).isNull())


#: Orders of a US provider's pages, by dataset.
PROVIDER_ORDER = {
    "instruments": ["canonical_symbol", "valid_from", "instrument_id"], "bars": ["bar_end", "instrument_id", "bar_id"], "market_observations": ["observed_at", "observation_id"],
    "macro_observations": ["period_end", "series_id", "available_at"], "macro_releases": ["scheduled_at", "release_id"], "macro_series": ["series_id"], "news": ["published_at", "news_id"],
}


def provider_rows(rows: DataFrame, dataset: str, as_of: Column, context_as_of: Column, start: Column | None = None, end: Column | None = None, keys=None, policy: str | None = None, entities=None, topics=None) -> DataFrame:
    """A US provider's rows of a dataset: both clocks, its window, its filters, its revision choice and its order.

    Bars must be daily and raw; releases and news have instants only; news comes newest first, without full text.
    """
    known = visible(rows, as_of, context_as_of) if "available_at" in rows.columns else rows.where(F.col("source.retrieved_at") <= F.least(as_of, context_as_of))
    window = {"bars": "bar_start", "market_observations": "observed_at", "macro_observations": "period_end", "macro_releases": "scheduled_at", "news": "published_at"}.get(dataset)
    if dataset == "bars":
        known = known.where((F.col("interval") == "1d") & (F.col("adjustment") == "raw"))
    if window and start is not None:
        last = F.col(window) <= end if dataset == "macro_observations" else F.col(window) < end
        known = known.where((F.col(window) >= start) & last)
    key = {"bars": "instrument_id", "instruments": "instrument_id", "market_observations": "metric_code", "news": None}.get(dataset, "series_id")
    known = known if key is None else _among(known, key, keys)
    texts = lambda values: F.array(*[F.lit(v) for v in sorted(values)])
    if entities:
        known = known.where(F.arrays_overlap(F.transform("entities", lambda e: e["entity_id"]), texts(entities)))
    if topics:
        known = known.where(F.arrays_overlap("topics", texts(topics)))
    if policy:
        known = revision_policy(known, ["series_id", "period_end"], policy, as_of, "revision")
    if dataset == "news":
        return trim_content(known, "snippet").orderBy(*[F.col(c).desc() for c in PROVIDER_ORDER["news"]])
    return known.orderBy(*PROVIDER_ORDER[dataset])
