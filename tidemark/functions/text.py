"""Texts, hashes, identifiers, URLs and nested payloads."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query keys that only track.
TRACKING = ["fbclid", "gclid", "ref", "spm"]


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, tracking keys and fragment dropped, the query's parts sorted; the path stays.

    Parts of the query keep the encoding they came with.
    """
    said = F.regexp_replace(F.trim(url), "#.*$", "")
    head, query = F.regexp_extract(said, r"^([^?]*)", 1), F.regexp_extract(said, r"\?(.*)$", 1)
    site, path = F.regexp_extract(head, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1), F.regexp_replace(head, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    key = lambda p: F.lower(F.regexp_extract(p, "^([^=]*)", 1))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~key(p).startswith("utm_") & ~key(p).isin(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(F.lower(site), path, tail)


def allowed_url(url: Column, hosts: list[str]) -> Column:
    """https, a host of the list, and no user in it."""
    authority = F.regexp_extract(url, r"^https://([^/?#]*)", 1)
    return (authority != "") & ~authority.contains("@") & F.lower(F.regexp_replace(authority, r":\d+$", "")).isin(hosts)


def simple_title(title: Column) -> Column:
    """Title for matching, with column functions: lower case, signs before digits as words, punctuation as spaces.

    Punctuation between digits stays a boundary: '.' for a point or comma, else '|'.
    """
    text = F.lower(title)
    text = F.regexp_replace(text, r"\+([0-9])", " plus $1")
    text = F.regexp_replace(text, "[-−]([0-9])", " minus $1")
    text = F.regexp_replace(text, "([0-9])[.,](?=[0-9])", "$1\u0001")
    text = F.regexp_replace(text, r"([0-9])\p{P}(?=[0-9])", "$1|")
    text = F.regexp_replace(text, r"\p{P}", " ")
    text = F.regexp_replace(F.translate(text, "\u0001", "."), r"\s+", " ")
    return F.trim(text)


@F.pandas_udf(T.StringType())
def full_title(titles: pd.Series) -> pd.Series:
    """As simple_title, over compatibility forms and with full case folding, which Spark lacks.

    Traditional characters are not turned into simplified ones: no table for that is at hand.
    """

    def one(title: str | None) -> str | None:
        if title is None:
            return None
        text = unicodedata.normalize("NFKC", title).casefold()
        text = re.sub("[-−](?=[0-9])", " minus ", re.sub(r"\+(?=[0-9])", " plus ", text))
        parts = re.split(r"(\W)", text)
        marks = [unicodedata.category(p).startswith("P") if len(p) == 1 else False for p in parts]
        out = []
        for k, (part, mark) in enumerate(zip(parts, marks, strict=True)):
            if not mark:
                out.append(part)
            elif k and parts[k - 1][-1:].isdecimal() and parts[k + 1][:1].isdecimal():
                out.append("." if part in ".," else "|")
            else:
                out.append(" ")
        text = " ".join("".join(out).replace("_", " ").split())
        return re.sub("(?<=[㐀-鿿0-9]) (?=[㐀-鿿0-9])", "", text)

    return titles.map(one)


def stable_id(namespace: str, *parts: Column, length: int = 64) -> Column:
    """Namespace and the SHA-256 of a JSON array of the parts as texts."""
    body = F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit(f"{namespace}_"), F.substring(F.sha2(body, 256), 1, length))


def joined_id(namespace: str, *parts: Column, mark: str = "|", length: int = 32) -> Column:
    """Namespace and the first hexadecimal digits of the SHA-256 of parts joined by a mark."""
    return F.concat(F.lit(namespace), F.substring(F.sha2(F.concat_ws(mark, *[p.cast("string") for p in parts]), 256), 1, length))


def checksum(*columns: str) -> Column:
    """SHA-256 of a JSON object of the columns in order of name, nulls kept, decimals as texts."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def cluster_id(title: Column, entity_ids: Column, published_at: Column, url: Column, content_hash: Column) -> Column:
    """Hash of the matching title, sorted entities and UTC day; an empty title adds URL and content."""
    matched = full_title(title)
    said = F.struct(matched.alias("title"), F.array_sort(entity_ids).alias("entity_ids"), F.to_date(published_at).cast("string").alias("day"), F.when(matched == "", url).alias("url"), F.when(matched == "", content_hash).alias("hash"))
    return F.concat(F.lit("cluster_"), F.sha2(F.to_json(said), 256))


def _walk(value: object, visit) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            visit(k, v)
            _walk(v, visit)
    elif isinstance(value, list):
        for v in value:
            _walk(v, visit)


def _loaded(text: str | None) -> tuple[object, bool]:
    """A JSON text's value, and whether it can be read."""
    try:
        return json.loads(text or "null"), True
    except (ValueError, RecursionError):
        return None, False


#: What stands for a payload that can't be read: nothing of it is shown.
UNREADABLE = '{"unreadable":true}'


def redacted(payload: Column, secret_keys: tuple[str, ...] = ("token", "secret", "password", "api_key", "authorization")) -> Column:
    """A JSON payload with the values of secret keys replaced, at any depth; one that can't be read becomes UNREADABLE."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def clean(v: object) -> object:
            if isinstance(v, dict):
                return {k: "[redacted]" if any(s in k.lower() for s in secret_keys) else clean(x) for k, x in v.items()}
            return [clean(x) for x in v] if isinstance(v, list) else v

        def one(text: str | None) -> str | None:
            value, good = _loaded(text)
            return None if text is None else json.dumps(clean(value), ensure_ascii=False, sort_keys=True) if good else UNREADABLE

        return texts.map(one)

    return run(payload)


def nested_values(payload: Column, keys: tuple[str, ...] = ("fact_ids", "source_ref_ids")) -> Column:
    """Sorted distinct texts under the given keys of a JSON payload, at any depth; none of one that can't be read."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            found: set[str] = set()
            _walk(_loaded(text)[0], lambda k, v: found.update(x for x in (v if isinstance(v, list) else [v]) if isinstance(x, str)) if k in keys else None)
            return sorted(found)

        return texts.map(one)

    return run(payload)


def forbidden_keys(payload: Column, keys: tuple[str, ...]) -> Column:
    """Sorted keys of a JSON payload, at any depth, that are among the forbidden; a payload that can't be read is all forbidden."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            value, good = _loaded(text)
            found: set[str] = set() if good else {"*"}
            _walk(value, lambda k, _: found.add(k) if k.lower() in keys else None)
            return sorted(found)

        return texts.map(one)

    return run(payload)


def error_class(message: Column) -> Column:
    """What became of a sending, by its error's text: uncertain if it may have arrived, retryable, else failed."""
    said = F.lower(F.coalesce(message, F.lit("")))
    return F.when(said.rlike("timeout|timed out|connection reset|broken pipe"), "uncertain").when(said.rlike("rate limit|429|unavailable|50[0234]"), "retry_wait").otherwise("failed")


def source_line(name: Column, url: Column) -> Column:
    """How a source is shown: its name, and its host if it has an address."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z]+://([^/?#]*)", 1)
    return F.concat(F.trim(name), F.when(host != "", F.concat(F.lit(" ("), F.lower(host), F.lit(")"))).otherwise(""))


def json_field(payload: Column, *path: str) -> Column:
    """A field of a JSON payload, as text; absent fields and payloads that can't be read give null."""
    return F.get_json_object(payload, "$." + ".".join(path))
