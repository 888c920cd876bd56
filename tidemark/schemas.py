"""Explicit schemas of the fact datasets; nothing is inferred."""

from __future__ import annotations

SOURCE = "source struct<provider_id:string,provider_record_id:string,source_name:string,source_symbol:string,source_url:string,retrieved_at:timestamp,provider_updated_at:timestamp,source_checksum:string>"
RIGHTS = "rights struct<storage_allowed:boolean,internal_analysis_allowed:boolean,external_llm_allowed:boolean,embedding_allowed:boolean,redistribution_allowed:boolean,content_expires_at:timestamp>"


def _ddl(*parts: str) -> str:
    return ", ".join(parts)


SCHEMAS: dict[str, str] = {
    "instruments": _ddl("instrument_id string, region string, venue_mic string, local_symbol string, canonical_symbol string, name string, name_en string, asset_class string, currency string, timezone string, status string, listed_on date, delisted_on date, lot_size decimal(38,18), valid_from date, valid_to date, updated_at timestamp", SOURCE),
    "aliases": _ddl("instrument_id string, provider_id string, source_symbol string, venue_mic string, canonical_symbol string, valid_from date, valid_to date"),
    "bars": _ddl("bar_id string, instrument_id string, region string, interval string, adjustment string, bar_start timestamp, bar_end timestamp, trading_date date, open decimal(38,18), high decimal(38,18), low decimal(38,18), close decimal(38,18), volume decimal(38,18), turnover decimal(38,18), vwap decimal(38,18), currency string, adjustment_as_of timestamp, available_at timestamp, availability_basis string, quality_flags array<string>, source_checksum string", SOURCE),
    "market_observations": _ddl("observation_id string, region string, scope_type string, scope_id string, metric_code string, value decimal(38,18), unit string, currency string, period_start timestamp, period_end timestamp, observed_at timestamp, available_at timestamp, availability_basis string, dimensions map<string,string>, quality_flags array<string>", SOURCE),
    "macro_series": _ddl("series_id string, region string, authority string, code string, name string, description string, frequency string, unit string, transformation string, seasonal_adjustment string", SOURCE),
    "macro_observations": _ddl("observation_id string, series_id string, region string, period_start date, period_end date, value decimal(38,18), unit string, transformation string, released_at timestamp, available_at timestamp, availability_basis string, vintage_id string, revision_no int, value_status string, supersedes_observation_id string, quality_flags array<string>", SOURCE),
    "macro_releases": _ddl("release_id string, region string, series_id string, release_name string, scheduled_at timestamp, scheduled_date date, time_precision string, released_at timestamp, available_at timestamp, period_start date, period_end date, actual decimal(38,18), consensus decimal(38,18), previous decimal(38,18), unit string, status string, source_checksum string", SOURCE),
    "news": _ddl("news_id string, regions array<string>, title string, summary string, body string, content_mode string, language string, source_name string, source_tier string, canonical_url string, published_at timestamp, published_date date, time_precision string, first_seen_at timestamp, available_at timestamp, availability_basis string, cluster_id string, supersedes_news_id string, status string, content_hash string, entities array<struct<entity_type:string,entity_id:string,mention:string,confidence:decimal(38,18)>>, topics array<string>, quality_flags array<string>", RIGHTS, SOURCE),
    "rejections": _ddl("run_id string, provider_id string, dataset string, code string, details string, rejected_at timestamp"),
}


def empty(spark, dataset: str):
    """A dataset without rows: every query over it returns none."""
    return spark.createDataFrame([], SCHEMAS[dataset])
