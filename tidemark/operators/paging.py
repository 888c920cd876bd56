"""Pages of a sorted snapshot, and cursors that can't be forged."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CursorError(ValueError):
    """A cursor that is malformed, forged, or of another query or snapshot."""


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The rows after a key in ascending order of `keys`; the key need not exist. Filters reach the scan."""
    if after is not None:
        later: Column = F.lit(False)
        for k in reversed(range(len(keys))):
            column, value = F.col(keys[k]), F.lit(after[k])
            later = (column > value) | ((column == value) & later) if k < len(keys) - 1 else column > value
        df = df.where(later)
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys]).limit(limit)


def offset_page(df: DataFrame, keys: list[str], offset: int, limit: int, expected_before: tuple | None = None) -> DataFrame:
    """Rows offset to offset + limit; with expected_before, the row before the page must have that key.

    The row before the page comes with the page, so the sort runs once; then a page is collected, and is
    a small table. Far pages are dear: keyset_page reads only what it gives.
    """
    ordered = df.orderBy(*[F.col(k).asc_nulls_last() for k in keys])
    if expected_before is None or offset == 0:
        return ordered.offset(offset).limit(limit)
    rows = ordered.offset(offset - 1).limit(limit + 1).collect()
    if not rows or tuple(rows[0][k] for k in keys) != tuple(expected_before):
        raise CursorError("SNAPSHOT_CHANGED")
    return df.sparkSession.createDataFrame(rows[1:], df.schema)


def same_snapshot(expected: str | None, found: str) -> None:
    """Pages of one query must be of one snapshot."""
    if expected is not None and expected != found:
        raise CursorError("SNAPSHOT_CHANGED")


def snapshot_moment(expected: str | None, found: dt.datetime) -> None:
    """A cursor's snapshot is a moment with a zone that is not after the page's own."""
    if expected is None:
        return
    try:
        at = dt.datetime.fromisoformat(expected)
    except ValueError as e:
        raise CursorError("INVALID_CURSOR") from e
    if at.tzinfo is None or at > found:
        raise CursorError("INVALID_CURSOR")


def provider_page(bars: DataFrame, offset: int, limit: int, watermark: str, expected: str | None = None, max_offset: int = 100_000) -> tuple[DataFrame, int | None]:
    """A page of several instruments' bars in one order (bar_end, instrument_id, bar_id), and where the next begins.

    Bars must be unique, and pages of one watermark.
    """
    same_snapshot(expected, watermark)
    if not 0 <= offset <= max_offset:
        raise CursorError("INVALID_CURSOR")
    if not bars.groupBy("bar_id").count().where("count > 1").isEmpty():
        raise CursorError("DUPLICATE_PAGE")
    page = bars.orderBy("bar_end", "instrument_id", "bar_id").offset(offset).limit(limit + 1).collect()
    rows = bars.sparkSession.createDataFrame(page[:limit], bars.schema)
    return rows, offset + limit if len(page) > limit else None


def fingerprint(query: dict, as_of: str, version: str) -> str:
    """Hash of a query without its cursor; sets count as sorted lists."""

    def plain(v: object) -> object:
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items() if k != "cursor"}
        if isinstance(v, set | frozenset):
            return sorted(map(plain, v), key=str)
        return [plain(x) for x in v] if isinstance(v, list | tuple) else v

    return hashlib.sha256(json.dumps([plain(query), as_of, version], sort_keys=True, default=str).encode()).hexdigest()


def encode_cursor(secret: bytes, dataset: str, mark: str, position: dict) -> str:
    body = base64.urlsafe_b64encode(json.dumps([dataset, mark, position], sort_keys=True).encode())
    return f"{body.decode()}.{hmac.new(secret, body, hashlib.sha256).hexdigest()}"


def decode_cursor(secret: bytes, cursor: str, dataset: str, mark: str, max_offset: int = 100_000) -> dict:
    body, _, seal = cursor.partition(".")
    if not hmac.compare_digest(seal, hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()):
        raise CursorError("INVALID_CURSOR")
    of, made, position = json.loads(base64.urlsafe_b64decode(body))
    if (of, made) != (dataset, mark) or not 0 <= position.get("offset", 0) <= max_offset:
        raise CursorError("INVALID_CURSOR")
    return position
