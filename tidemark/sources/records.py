"""Typed records of the seven datasets, from the JSON records of envelopes to the store's columns.

Each dataset is a list of fields with a kind; kinds say how a text is read and what is wrong with it. A
record with unknown, absent or unreadable fields, or against a rule of its dataset, is set aside with its
issues; all others become rows that a FactStore takes. Values are normalised with the functions for
units, symbols, titles and times, all of them column expressions but for titles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import dates, numbers, symbols, text
from tidemark.operators.quality import issue_list
from tidemark.sources.envelope import trusted_availability

ENUMS = {
    "asset_class": ("equity", "etf", "index", "future", "fx", "rate", "commodity"),
    "instrument_status": ("active", "suspended", "delisted", "unknown"),
    "interval": ("1d", "1w", "1mo"),
    "adjustment": ("raw", "split_adjusted", "total_return"),
    "availability_basis": ("provider_disseminated", "first_seen", "exchange_published", "inferred"),
    "scope_type": ("instrument", "market", "exchange", "sector"),
    "frequency": ("daily", "weekly", "monthly", "quarterly", "annual", "irregular"),
    "transformation": ("level", "mom", "qoq", "yoy", "annualized", "index"),
    "seasonal_adjustment": ("adjusted", "not_adjusted", "unknown"),
    "source_tier": ("official", "licensed_media", "research", "social", "other"),
    "content_mode": ("headline", "snippet", "full_text"),
    "time_precision": ("instant", "date"),
}
#: Topics of filing forms.
FORM_TOPICS = {"10-K": ("filing", "annual_report"), "10-Q": ("filing", "quarterly_report"), "8-K": ("filing", "corporate_action")}
ENTITIES = "array<struct<entity_type:string,entity_id:string,mention:string,confidence:string>>"
RIGHTS = ("storage_allowed", "internal_analysis_allowed", "external_llm_allowed", "embedding_allowed", "redistribution_allowed")
RIGHTS_TYPE = f"struct<{','.join(f'{r}:boolean' for r in RIGHTS)},content_expires_at:string>"
#: How a kind of field is kept in JSON, where it isn't a text.
TYPES = {"texts": "array<string>", "map": "map<string,string>", "entities": ENTITIES, "rights": RIGHTS_TYPE, "whole": "int"}


@dataclass(frozen=True)
class Field:
    """A field's kind: text, instant, day, decimal, whole, texts, map, entities, rights, or the name of an enumeration."""

    name: str
    kind: str = "text"
    required: bool = True


def _fields(said: str) -> list[Field]:
    """Fields from 'name', 'name:kind' and 'name:kind?' (need not be there)."""
    out = []
    for part in said.split():
        name, _, kind = part.rstrip("?").partition(":")
        out.append(Field(name, kind or "text", not part.endswith("?")))
    return out


SOURCE = "record_id source_url retrieved_at:instant provider_updated_at:instant?"
KNOWN = "available_at:instant availability_basis:availability_basis quality_flags:texts"
BAR = f"interval:interval bar_start:instant bar_end:instant trading_date:day open high low close volume? turnover? currency adjustment:adjustment {KNOWN}"
OBSERVED = f"scope_type:scope_type scope_id metric_code value? unit currency? period_start:instant period_end:instant observed_at:instant dimensions:map {KNOWN}"
VINTAGE = f"series_id period_start:day period_end:day value? unit transformation released_at:instant? vintage_id revision_no:whole value_status supersedes_observation_id? {KNOWN}"
NEWS = f"summary? language source_tier:source_tier first_seen_at:instant entities:entities? rights:rights {KNOWN}"
REGIONAL = {
    "instruments": _fields(f"symbol mic name name_en? asset_class:asset_class currency timezone status:instrument_status listed_on:day? delisted_on:day? lot_size:decimal? valid_from:day valid_to:day? {SOURCE}"),
    "bars": _fields(f"symbol mic vwap? adjustment_as_of:instant? {BAR} {SOURCE}"),
    "market_observations": _fields(f"{OBSERVED} raw_observed_at? raw_timezone? {SOURCE}"),
    "macro_observations": _fields(f"{VINTAGE} {SOURCE}"),
    "macro_releases": _fields(f"series_id release_name scheduled_at:instant? scheduled_date:day? time_precision:time_precision? released_at:instant? available_at:instant period_start:day period_end:day actual? consensus? previous? unit status {SOURCE}"),
    "news": _fields(f"title body? content_mode:content_mode source_name canonical_url? published_at:instant? published_date:day? time_precision:time_precision? topics:texts {NEWS} {SOURCE}"),
}
IDENTITY = "symbol exchange issuer_key? first_canonical_symbol first_valid_from:day valid_from:day"
US = {
    "instruments": _fields(f"{IDENTITY} valid_to:day? name asset_class:asset_class currency timezone status:instrument_status listed_on:day? delisted_on:day? lot_size:decimal? source_name {SOURCE}"),
    "bars": _fields(f"{IDENTITY} {BAR} source_name {SOURCE}"),
    "market_observations": _fields(f"{OBSERVED} source_name {SOURCE}"),
    "macro_series": _fields(f"series_id authority code name description? frequency:frequency unit transformation:transformation seasonal_adjustment:seasonal_adjustment source_name {SOURCE}"),
    "macro_observations": _fields(f"{VINTAGE} source_name {SOURCE}"),
    "macro_releases": _fields(f"series_id release_name scheduled_at:instant released_at:instant? available_at:instant period_start:day period_end:day actual? consensus? previous? unit status source_name {SOURCE}"),
    "news": _fields(f"source_name canonical_url title? published_at:instant? topics:texts? accession_number? form? company_name? filing_date:day? acceptance_datetime:instant? {NEWS} {SOURCE}"),
}


def read_records(page: DataFrame, fields: list[Field]) -> DataFrame:
    """record, checksum, issues, and r: a struct of the typed fields; `given` says which were there."""
    ddl = ", ".join(f"`{f.name}` {TYPES.get(f.kind, 'string')}" for f in fields)
    # the record is parsed twice: as its dataset's struct, and as a map of texts that tells what was there
    parsed = page.where("record IS NOT NULL").select("record", "checksum", F.from_json("record", ddl).alias("j"), F.coalesce(F.from_json("record", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("m"))
    parsed = parsed.withColumn("given", F.map_keys("m"))
    names = [f.name for f in fields]
    tests: dict[str, Column] = {"UNKNOWN_FIELD": F.size(F.array_except("given", F.array(*map(F.lit, names)))) > 0}
    typed = []
    for f in fields:
        said = F.col(f"j.{f.name}")
        value = {"instant": dates.parse_instant, "day": dates.parse_day, "decimal": numbers.to_decimal}.get(f.kind, lambda c: c)(said)
        if f.required:
            tests[f"MISSING:{f.name}"] = F.col("m")[f.name].isNull()
        # what was there but is not of its kind
        tests[f"INVALID:{f.name}"] = value.isNull() & F.col("m")[f.name].isNotNull()
        if f.kind in ENUMS:
            tests[f"INVALID:{f.name}"] = said.isNotNull() & ~said.isin(*ENUMS[f.kind])
        typed.append(value.alias(f.name))
    return parsed.select("record", "checksum", "given", issue_list(tests).alias("issues"), F.struct(*typed).alias("r"))


def _split(rows: DataFrame, dataset: str, columns: dict[str, Column], tests: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows in the dataset's columns, and rejects with code, fields, issues and the redacted record.

    The verdict is tied to a row number, so that filters on it stay above the parsed record; below, it would
    be parsed again for each field that a test looks at.
    """
    judged = rows.withColumn("issues", F.array_sort(F.array_distinct(F.concat("issues", issue_list(tests)))))
    judged = judged.withColumn("good", (F.size("issues") == 0) & (F.monotonically_increasing_id() >= 0))
    shape = rows.sparkSession.createDataFrame([], schemas.SCHEMAS[dataset]).schema
    good = judged.where("good").select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields])
    bad = judged.where("NOT good").select(F.lit("PROVIDER_RECORD_QUARANTINED").alias("code"), F.array_sort("given").alias("fields"), "issues", text.redacted(F.col("record")).alias("record"))
    return good, bad


def _source(provider: str, record_id: Column, name: Column, symbol: Column | None = None) -> Column:
    r = lambda c: F.col(f"r.{c}")
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(provider).alias("provider_id"), record_id.alias("provider_record_id"), name.alias("source_name"), (none if symbol is None else symbol).alias("source_symbol"),
        r("source_url").alias("source_url"), r("retrieved_at").alias("retrieved_at"), r("provider_updated_at").alias("provider_updated_at"), F.col("checksum").alias("source_checksum"),
    )


def _entities() -> Column:
    return F.coalesce(F.transform("r.entities", lambda e: F.struct(e["entity_type"].alias("entity_type"), e["entity_id"].alias("entity_id"), e["mention"].alias("mention"), numbers.to_decimal(e["confidence"]).alias("confidence"))), F.array().cast("array<struct<entity_type:string,entity_id:string,mention:string,confidence:decimal(38,18)>>"))


def _rights() -> Column:
    return F.struct(*[F.col(f"r.rights.{x}").alias(x) for x in RIGHTS], dates.parse_instant(F.col("r.rights.content_expires_at")).alias("content_expires_at"))


def _news_tests() -> dict[str, Column]:
    share = lambda e: numbers.to_decimal(e["confidence"])
    bad = F.exists("r.entities", lambda e: e["entity_type"].isNull() | e["entity_id"].isNull() | share(e).isNull() | (share(e) < 0) | (share(e) > 1))
    return {"INVALID:entities": bad, "INVALID:rights": F.array_contains(F.array(*[F.col(f"r.rights.{x}").isNull() for x in RIGHTS]), True)}


def _scaled(rows: DataFrame, region: str, unit: str) -> DataFrame:
    """rows with unit, its currency and scale, by the table of unit aliases."""
    table = F.broadcast(numbers.unit_table(rows.sparkSession))  # a fixed, small table
    key = numbers.unit_key(F.col(f"r.{unit}"))
    return rows.join(table, (key == F.col("u_alias")) & ((F.col("u_region") == "") | (F.col("u_region") == region)), "left")


def _value(name: str, optional: bool = True) -> tuple[Column, Column]:
    """A field's value in its normal unit, and whether it can't be read."""
    said = F.col(f"r.{name}")
    gone, number = numbers.missing(said), numbers.to_decimal(said)
    scaled = (number.cast("decimal(38,9)") * F.col("u_scale")).try_cast("decimal(38,18)")
    bad = (~gone & scaled.isNull()) if optional else scaled.isNull()
    return F.when(~gone, scaled), bad


def regional_records(page: DataFrame, dataset: str, region: str, provider: str, registry: DataFrame | None = None, source_name: str = "-") -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects of a CN or HK page (record, checksum).

    registry has venue_mic, local_symbol and instrument_key of known instruments; a symbol that it lacks is set aside.
    """
    rows = read_records(page, REGIONAL[dataset])
    r = lambda c: F.col(f"r.{c}")
    tests: dict[str, Column] = {}
    own = {"region": F.lit(region), "available_at": r("available_at"), "source_checksum": F.col("checksum")}
    plain = lambda *names: {n: r(n) for n in names}
    record_id = r("record_id")
    if dataset in ("instruments", "bars"):
        rows = rows.withColumn("s", symbols.regional_symbol(F.lit(region), r("mic"), r("symbol")))
        known = registry.select(F.col("venue_mic").alias("k_venue"), F.col("local_symbol").alias("k_code"), "instrument_key")
        rows = rows.join(known, (F.col("s.venue") == F.col("k_venue")) & (F.col("s.code") == F.col("k_code")), "left")
        tests |= {"INVALID:symbol": F.col("s.issue").isNotNull(), "INSTRUMENT_UNREGISTERED": F.col("instrument_key").isNull()}
        instrument = symbols.instrument_id(F.lit(region), F.col("instrument_key"))
    if dataset == "instruments":
        record_id = F.concat_ws(":", F.lit(provider), F.col("s.canonical"), r("valid_from").cast("string"))
        tests["INVALID:currency"] = ~r("currency").rlike("^[A-Z]{3}$")
        columns = own | plain("name", "name_en", "asset_class", "currency", "status", "listed_on", "delisted_on", "lot_size", "valid_from", "valid_to") | {
            "instrument_id": instrument, "canonical_symbol": F.col("s.canonical"), "venue_mic": F.col("s.venue"), "local_symbol": F.col("s.code"), "timezone": F.lit(dates.REGION_ZONES[region]), "updated_at": r("retrieved_at"),
        }
        return _split(rows, dataset, columns | {"source": _source(provider, record_id, F.lit(source_name), r("symbol"))}, tests)
    if dataset == "bars":
        rows = _scaled(rows, region, "currency")
        record_id = F.concat_ws(":", F.lit(provider), F.col("s.canonical"), r("trading_date").cast("string"), r("interval"), r("adjustment"), F.to_date("r.available_at").cast("string"))
        prices = {n: _value(n, optional=False) for n in ("open", "high", "low", "close")}
        counts = {n: numbers.to_decimal(r(n)) for n in ("volume", "turnover", "vwap")}
        o, h, lo, c = (prices[n][0] for n in ("open", "high", "low", "close"))
        tests |= {f"INVALID:{n}": bad for n, (_, bad) in prices.items()} | {f"INVALID:{n}": r(n).isNotNull() & v.isNull() for n, v in counts.items()}
        tests |= {"UNKNOWN_UNIT": F.col("u_unit").isNull(), "NOT_A_TRADING_DAY": ~dates.weekday_open(r("trading_date")), "interval_order": r("bar_start") >= r("bar_end"), "low_above_body": lo > F.least(o, c), "high_below_body": h < F.greatest(o, c), "adjustment_as_of_missing": (r("adjustment") != "raw") & r("adjustment_as_of").isNull()}
        bar_id = text.joined_id("bar_", instrument, r("interval"), dates.iso_instant(r("bar_start")), dates.iso_instant(r("bar_end")), r("adjustment"), F.lit(provider), record_id)
        columns = own | plain("interval", "adjustment", "bar_start", "bar_end", "trading_date", "currency", "adjustment_as_of", "availability_basis", "quality_flags") | {n: v for n, (v, _) in prices.items()} | counts | {"bar_id": bar_id, "instrument_id": instrument}
        return _split(rows, dataset, columns | {"source": _source(provider, record_id, F.lit(source_name), r("symbol"))}, tests)
    if dataset == "news":
        return _regional_news(rows, region, provider)
    rows = _scaled(rows, region, "unit")
    tests["UNKNOWN_UNIT"] = F.col("u_unit").isNull()
    source = {"source": _source(provider, record_id, F.lit(source_name)), "unit": F.col("u_unit")}
    if dataset == "market_observations":
        value, bad = _value("value")
        columns = own | plain("scope_type", "scope_id", "metric_code", "period_start", "period_end", "observed_at", "availability_basis", "dimensions", "quality_flags") | {
            "observation_id": text.joined_id("mobs_", F.lit(provider), r("record_id")), "value": value, "currency": F.coalesce(r("currency"), F.col("u_currency")),
        }
        return _split(rows, dataset, columns | source, tests | {"INVALID:value": bad})
    if dataset == "macro_observations":
        value, bad = _value("value")
        day = lambda c: r(c).cast("string")
        columns = own | plain("series_id", "period_start", "period_end", "transformation", "released_at", "availability_basis", "vintage_id", "revision_no", "value_status", "supersedes_observation_id", "quality_flags") | {
            "observation_id": text.joined_id("obs_", r("series_id"), day("period_start"), day("period_end"), r("vintage_id"), r("revision_no"), r("record_id")), "value": value,
        }
        return _split(rows, dataset, columns | source, tests | {"INVALID:value": bad})
    values = {n: _value(n) for n in ("actual", "consensus", "previous")}
    precision, wrong = _precision("scheduled_at", "scheduled_date")
    when = F.coalesce(dates.iso_instant(r("scheduled_at")), r("scheduled_date").cast("string"))
    columns = own | plain("series_id", "release_name", "scheduled_at", "scheduled_date", "released_at", "period_start", "period_end", "status") | {n: v for n, (v, _) in values.items()} | {
        "release_id": text.joined_id("rel_", r("series_id"), when, r("period_start").cast("string"), r("period_end").cast("string"), r("release_name")), "time_precision": precision,
    }
    return _split(rows, dataset, columns | source, tests | {f"INVALID:{n}": bad for n, (_, bad) in values.items()} | {"schedule_needs_one": wrong})


def _precision(instant: str, day: str) -> tuple[Column, Column]:
    """The precision of a time, told or seen, and whether not just that one time is there."""
    at, on, told = F.col(f"r.{instant}"), F.col(f"r.{day}"), F.col("r.time_precision")
    precision = F.coalesce(told, F.when(at.isNotNull(), "instant").otherwise("date"))
    return precision, (at.isNull() == on.isNull()) | ((precision == "instant") & at.isNull()) | ((precision == "date") & on.isNull())


def _regional_news(rows: DataFrame, region: str, provider: str) -> tuple[DataFrame, DataFrame]:
    """A body stays only with full text that may be stored; without it a full text counts as a snippet."""
    r = lambda c: F.col(f"r.{c}")
    precision, wrong = _precision("published_at", "published_date")
    allowed = (r("content_mode") == "full_text") & F.coalesce(F.col("r.rights.storage_allowed"), F.lit(False))
    body = F.when(allowed, r("body"))
    dropped = r("body").isNotNull() & ~allowed
    flags = F.when(dropped, F.concat(r("quality_flags"), F.array(F.lit("body_omitted_by_rights")))).otherwise(r("quality_flags"))
    mode = F.when((r("content_mode") == "full_text") & body.isNull(), "snippet").otherwise(r("content_mode"))
    url = text.canonical_url(r("canonical_url"))
    rows = rows.withColumn("matched", text.full_title(r("title"))).withColumns({"body": body, "url": url})
    said = F.to_json(F.struct(F.col("body").alias("body"), r("summary").alias("summary"), r("title").alias("title")), {"ignoreNullFields": "false"})
    rows = rows.withColumn("hash", F.sha2(said, 256))
    when = F.coalesce(dates.iso_instant(r("published_at")), r("published_date").cast("string"))
    at = F.coalesce(r("published_at"), r("published_date").cast("timestamp"))
    ids = F.array_sort(F.transform(_entities(), lambda e: e["entity_id"]))
    columns = {
        "news_id": text.joined_id("news_", F.lit(provider), r("record_id"), F.coalesce(F.col("url"), F.col("matched")), when), "cluster_id": text.cluster_id(r("title"), ids, at, F.col("url"), F.col("hash")),
        "regions": F.array(F.lit(region)), "body": F.col("body"), "content_mode": mode, "canonical_url": F.col("url"), "time_precision": precision, "content_hash": F.col("hash"), "status": F.lit("active"),
        "entities": _entities(), "quality_flags": flags, "rights": _rights(), "source": _source(provider, r("record_id"), r("source_name")),
    } | {n: r(n) for n in ("title", "summary", "language", "source_name", "source_tier", "published_at", "published_date", "first_seen_at", "available_at", "availability_basis", "topics")}
    return _split(rows, "news", columns, {"published_needs_one": wrong, "available_before_published": r("available_at") < r("published_at"), "INVALID:title": F.trim(r("title")) == ""} | _news_tests())


def us_records(page: DataFrame, dataset: str, provider: str = "us-fixture") -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects of a US page (record, checksum); reported times count only with evidence."""
    rows = read_records(page, US[dataset])
    r = lambda c: F.col(f"r.{c}")
    day, at = (lambda c: r(c).cast("string")), (lambda c: dates.iso_instant(r(c)))
    plain = lambda *names: {n: r(n) for n in names}
    own_id = lambda name, *parts: text.joined_id(f"{name}_", *parts, mark="\x1f", length=20)
    named = lambda *parts: F.concat_ws(":", F.lit(provider), *parts)
    own, tests = {"region": F.lit("US"), "source_checksum": F.col("checksum")}, {}
    source = lambda record_id, symbol=None: {"source": _source(provider, record_id, r("source_name"), symbol)}

    def timed(rows: DataFrame, *evidence: str) -> DataFrame:
        return rows.withColumn("timed", trusted_availability(r("available_at"), r("retrieved_at"), F.coalesce(*map(r, evidence)), r("availability_basis")))

    times = {"available_at": F.col("timed.available_at"), "availability_basis": F.col("timed.basis")}

    if dataset in ("instruments", "bars"):
        rows = rows.withColumn("s", symbols.us_symbol(r("symbol"), r("exchange")))
        tests |= {"INVALID:symbol": F.col("s.issue").isNotNull(), "INVALID:first_canonical_symbol": symbols.canonical_symbol(r("first_canonical_symbol")).isNull()}
        instrument = symbols.us_instrument_id(r("first_canonical_symbol"), r("first_valid_from"))
    if dataset == "instruments":
        tests["range_order"] = r("valid_to") <= r("valid_from")
        columns = own | plain("name", "asset_class", "currency", "timezone", "status", "listed_on", "delisted_on", "lot_size", "valid_from", "valid_to") | {
            "instrument_id": instrument, "canonical_symbol": F.col("s.canonical"), "venue_mic": F.col("s.venue"), "local_symbol": F.col("s.code"), "updated_at": r("retrieved_at"),
        }
        return _split(rows, dataset, columns | source(named(r("symbol"), day("valid_from")), r("symbol")), tests)
    if dataset == "bars":
        rows = timed(rows, "provider_updated_at").withColumns({f"v_{n}": numbers.normalise_us_value(r(n), r("currency")) for n in ("open", "high", "low", "close")})
        prices = {n: F.col(f"v_{n}") for n in ("open", "high", "low", "close")}
        counts = {n: numbers.to_decimal(r(n)) for n in ("volume", "turnover")}
        o, h, lo, c = (prices[n]["value"] for n in ("open", "high", "low", "close"))
        tests |= {f"INVALID:{n}": v["value"].isNull() for n, v in prices.items()} | {f"INVALID:{n}": r(n).isNotNull() & v.isNull() for n, v in counts.items()}
        tests |= {"TRADING_DATE_MISMATCH": dates.local_day(r("bar_start"), dates.REGION_ZONES["US"]) != r("trading_date"), "interval_order": r("bar_start") >= r("bar_end"), "low_above_body": lo > F.least(o, c), "high_below_body": h < F.greatest(o, c)}
        columns = own | plain("interval", "adjustment", "bar_start", "bar_end", "trading_date", "currency", "quality_flags") | {n: v["value"] for n, v in prices.items()} | counts | times | {
            "bar_id": own_id("bar_us", instrument, r("interval"), at("bar_start"), r("adjustment"), F.lit(provider)), "instrument_id": instrument,
        }
        return _split(rows, dataset, columns | source(named(r("symbol"), r("interval"), at("bar_start"), r("adjustment")), r("symbol")), tests)
    if dataset == "news":
        return _us_news(rows, provider, own_id, named)
    numeric = {"market_observations": ["value"], "macro_observations": ["value"], "macro_releases": ["actual", "consensus", "previous"]}.get(dataset, [])
    rows = rows.withColumns({**{f"v_{n}": numbers.normalise_us_value(F.coalesce(r(n), F.lit("--")), r("unit")) for n in numeric}, "v_unit": numbers.normalise_us_value(F.lit("--"), r("unit"))})
    value, unit = (lambda name: F.col(f"v_{name}")), F.col("v_unit")
    tests["UNKNOWN_UNIT"] = unit["unit"].isNull()
    bad = lambda name: ~F.coalesce(value(name)["issue"], F.lit("")).isin("", "not_reported")
    if dataset == "macro_series":
        columns = own | plain("series_id", "authority", "code", "name", "description", "frequency", "transformation", "seasonal_adjustment") | {"unit": unit["unit"]}
        return _split(rows, dataset, columns | source(named(F.concat_ws("-", r("authority"), r("code")))), tests)
    if dataset == "market_observations":
        rows = timed(rows, "provider_updated_at")
        columns = own | plain("scope_type", "scope_id", "metric_code", "period_start", "period_end", "observed_at", "dimensions", "quality_flags") | times | {
            "observation_id": own_id("obs_us", F.lit("US"), r("scope_type"), r("scope_id"), r("metric_code"), at("observed_at"), F.lit(provider)),
            "value": value("value")["value"], "unit": unit["unit"], "currency": F.coalesce(r("currency"), value("value")["currency"]),
        }
        return _split(rows, dataset, columns | source(named(r("metric_code"), at("observed_at"))), tests | {"INVALID:value": bad("value")})
    if dataset == "macro_observations":
        rows = timed(rows, "provider_updated_at", "released_at")
        columns = own | plain("series_id", "period_start", "period_end", "transformation", "released_at", "vintage_id", "revision_no", "value_status", "supersedes_observation_id", "quality_flags") | times | {
            "observation_id": own_id("mobs_us", r("series_id"), day("period_end"), r("vintage_id"), F.lit(provider)), "value": value("value")["value"], "unit": unit["unit"],
        }
        return _split(rows, dataset, columns | source(named(r("series_id"), day("period_end"), r("vintage_id"))), tests | {"INVALID:value": bad("value")})
    evidence = F.coalesce(r("provider_updated_at"), r("released_at"))
    columns = own | plain("series_id", "release_name", "scheduled_at", "released_at", "period_start", "period_end", "status") | {n: value(n)["value"] for n in ("actual", "consensus", "previous")} | {
        "release_id": own_id("mrel_us", r("series_id"), at("scheduled_at"), day("period_end"), F.lit(provider)), "time_precision": F.lit("instant"), "unit": unit["unit"],
        "available_at": F.when(evidence.isNotNull(), r("available_at")).otherwise(r("retrieved_at")),
    }
    return _split(rows, dataset, columns | source(named(r("series_id"), at("scheduled_at"), day("period_end"))), tests | {f"INVALID:{n}": bad(n) for n in ("actual", "consensus", "previous")})


def _us_news(rows: DataFrame, provider: str, own_id, named) -> tuple[DataFrame, DataFrame]:
    """Daily rows bring title and topics; filings build both from their form, and a day alone never becomes an instant."""
    r = lambda c: F.col(f"r.{c}")
    filed = r("accession_number").isNotNull()
    form = F.upper(r("form"))
    topics = F.create_map(*[x for k, v in FORM_TOPICS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[form]
    accepted = r("acceptance_datetime")
    number = F.lower(F.replace(r("accession_number"), F.lit("-"), F.lit("")))
    title = F.when(filed, F.concat_ws(" ", F.lit("SEC filing:"), form, r("company_name"))).otherwise(r("title"))
    flags = F.concat(
        r("quality_flags"), F.when(filed & accepted.isNull(), F.array(F.lit("PUBLISHED_AT_FALLBACK_TO_FIRST_SEEN"))).otherwise(F.array().cast("array<string>")),
        F.when(filed & topics.isNull(), F.array(F.lit("SEC_FORM_UNMAPPED"))).otherwise(F.array().cast("array<string>")),
    )
    rows = rows.withColumns({"title": title, "url": text.canonical_url(r("canonical_url")), "published": F.when(filed, F.coalesce(accepted, r("retrieved_at"))).otherwise(r("published_at"))})
    rows = rows.withColumn("matched", text.full_title(F.col("title")))
    said = F.to_json(F.struct(r("summary").alias("summary"), F.col("matched").alias("title"), F.col("url").alias("url")), {"ignoreNullFields": "false"})
    rows = rows.withColumn("hash", F.sha2(said, 256))
    archive = lambda c: F.lower(r(c)).startswith("https://www.sec.gov/archives/edgar/data/") & F.lower(r(c)).contains(number)
    ids = F.array_sort(F.transform(_entities(), lambda e: e["entity_id"]))
    columns = {
        "news_id": F.when(filed, F.concat(F.lit("news_us_sec_"), number)).otherwise(own_id("news_us", named(r("record_id")))), "regions": F.array(F.lit("US")), "title": F.col("title"),
        "content_mode": F.when(r("summary").isNotNull(), "snippet").otherwise("headline"), "canonical_url": F.col("url"), "published_at": F.col("published"), "time_precision": F.lit("instant"),
        "first_seen_at": F.when(filed & accepted.isNull(), r("retrieved_at")).otherwise(r("first_seen_at")), "available_at": F.when(filed, F.coalesce(accepted, r("retrieved_at"))).otherwise(r("available_at")),
        "availability_basis": F.when(filed & accepted.isNotNull(), "provider_disseminated").when(filed, "first_seen").otherwise(r("availability_basis")),
        "topics": F.when(filed, F.coalesce(topics, F.array(F.lit("filing")))).otherwise(r("topics")), "content_hash": F.col("hash"), "status": F.lit("active"), "quality_flags": flags,
        "cluster_id": text.cluster_id(F.col("title"), ids, F.col("published"), F.col("url"), F.col("hash")), "entities": _entities(), "rights": _rights(),
        "source": _source(provider, F.when(filed, r("accession_number")).otherwise(named(r("record_id"))), r("source_name")),
    } | {n: r(n) for n in ("summary", "language", "source_name", "source_tier")}
    absent = lambda *names: F.array_contains(F.array(*[r(n).isNull() for n in names]), True)
    tests = {
        "INCOMPLETE": (filed & absent("form", "company_name", "filing_date")) | (~filed & absent("title", "published_at", "topics")),
        "INVALID:source_url": filed & ~(archive("source_url") & archive("canonical_url")),
    }
    return _split(rows, "news", columns, tests | _news_tests())


def macro_series_of(observations: DataFrame, code: str, name: str) -> DataFrame:
    """The one synthetic series that a regional source of observations stands for, known when they were fetched."""
    first = observations.groupBy("region").agg(F.min_by("source", "available_at").alias("source"), F.min("available_at").alias("available_at"), F.min("unit").alias("unit"))
    return first.select(F.lit(code).alias("series_id"), "region", F.lit(code).alias("code"), F.lit(name).alias("name"), F.lit("irregular").alias("frequency"), "unit", "source", "available_at")
