"""Checks of a query before any plan is made."""

from __future__ import annotations

import datetime as dt


class QueryError(ValueError):
    """A query that is not asked right; code says how."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


def before(start, end, name: str = "range") -> None:
    """start < end; for bars, releases and news."""
    if start is None or end is None or not start < end:
        raise QueryError("INVALID_RANGE", f"{name}: {start} is not before {end}")


def not_after(first, last, name: str = "period") -> None:
    """first <= last; for the periods of observations."""
    if first is None or last is None or first > last:
        raise QueryError("INVALID_RANGE", f"{name}: {first} is after {last}")


def limited(limit: int, most: int, least: int = 1) -> None:
    if not least <= limit <= most:
        raise QueryError("INVALID_LIMIT", f"{limit} is not from {least} to {most}")


def listed(values: list | None, most: int, name: str = "ids") -> None:
    """A list of at least one and at most so many values."""
    if values is not None and not 1 <= len(values) <= most:
        raise QueryError("INVALID_LIST", f"{name}: {len(values)} values")


def known(given: dict, fields: set[str]) -> None:
    """No fields but the known ones."""
    if extra := sorted(set(given) - fields):
        raise QueryError("UNKNOWN_FIELD", ", ".join(extra))


def aware(moment: dt.datetime) -> None:
    if moment.tzinfo is None:
        raise QueryError("NAIVE_TIME", str(moment))


def point_in_time(supported: bool, as_of: dt.datetime, now: dt.datetime, tolerance: dt.timedelta = dt.timedelta(0)) -> None:
    """A source that only knows the present refuses questions about the past."""
    if not supported and as_of < now - tolerance:
        raise QueryError("UNSUPPORTED_HISTORICAL_PIT", f"as of {as_of}")


def bar_query(given: dict) -> dict:
    """A bar query with its defaults, checked."""
    known(given, {"instrument_ids", "start", "end", "interval", "adjustment", "as_of", "limit"})
    q = {"interval": "1d", "adjustment": "raw", "limit": 5000} | given
    listed(q.get("instrument_ids"), 500, "instrument_ids")
    before(q.get("start"), q.get("end"))
    limited(q["limit"], 5000)
    return q


def observation_query(given: dict) -> dict:
    known(given, {"series_ids", "period_from", "period_to", "revision_policy", "as_of", "limit"})
    q = {"revision_policy": "latest_as_of", "limit": 5000} | given
    listed(q.get("series_ids"), 200, "series_ids")
    not_after(q.get("period_from"), q.get("period_to"))
    limited(q["limit"], 5000)
    return q


def release_query(given: dict) -> dict:
    known(given, {"regions", "scheduled_from", "scheduled_to", "as_of", "limit"})
    q = {"limit": 1000} | given
    before(q.get("scheduled_from"), q.get("scheduled_to"))
    limited(q["limit"], 1000)
    return q


def news_query(given: dict) -> dict:
    known(given, {"regions", "published_from", "published_to", "entity_ids", "topics", "languages", "source_tiers", "content_mode", "include_superseded", "as_of", "limit"})
    q = {"content_mode": "headline", "include_superseded": False, "limit": 500} | given
    before(q.get("published_from"), q.get("published_to"))
    limited(q["limit"], 500)
    return q
