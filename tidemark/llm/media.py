"""Media columns: ISO media containers, written, walked box by box, and read back.

A payload of 8-bit samples becomes an uncompressed RGB video track of 8 by 8 pictures (192 bytes
each). The reader walks nested boxes, decodes the sample tables (times, sizes, chunks, sync
samples) and gives codec, duration and the byte ranges of key pictures; it never decodes a payload.

Fragmented files (moof boxes) and files of several tracks are read too.

Defined cases: a null or empty text gives one picture of spaces; a container without a track, with
broken boxes, absent or cut tables, counts that don't agree, or ranges beyond its end raises ValueError
in parse_container, and gives a row of nulls with the reason in `error` in probe_media. Every count is
checked against the file's size before anything is allocated for it. Repeated rows give equal rows; an
empty table gives an empty table; other columns are ignored. A box of size 0 reaches to the end,
64-bit sizes and chunk offsets are read, unknown boxes are passed over. A track without a table of
sync samples has only key samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrow import pieces
from tidemark.llm.common import documents, quoted

SIDE, SAMPLE, RATE, PER_CHUNK = 8, 192, 25, 64
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex"}
#: Boxes within boxes beyond this are broken.
DEPTH = 16
#: Pictures from one key picture to the next in the registered query.
KEY_EVERY = 12
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(raw: bytes) -> bytes:
    """Spaces up to a positive multiple of a picture."""
    return raw + b" " * (-len(raw) % SAMPLE if raw else SAMPLE)


def write_container(payload: bytes, key_every: int = 1) -> bytes:
    """A QuickTime-branded file with one video track; payload's length must be a positive multiple of SAMPLE."""
    n, odd = divmod(len(payload), SAMPLE)
    if odd or not n:
        raise ValueError("the payload must be a positive multiple of a picture")
    chunks, rest = divmod(n, PER_CHUNK)
    runs = [(1, PER_CHUNK)] * (chunks > 0) + [(chunks + 1, rest)] * (rest > 0)
    total = chunks + (rest > 0)
    entry = struct.pack(">6xH16xHHIIIH32sHh", 1, SIDE, SIDE, 0x480000, 0x480000, 0, 1, b"", 24, -1)

    def movie(first: int, wide: bool) -> bytes:
        places = first + SAMPLE * PER_CHUNK * np.arange(total, dtype=np.int64)
        tables = [
            full(b"stsd", struct.pack(">I", 1), box(b"raw ", entry)),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", a, b, 1) for a, b in runs]),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", total), places.astype(">u8" if wide else ">u4").tobytes()),
        ]
        if key_every > 1:
            keys = np.arange(1, n + 1, key_every)
            tables.append(full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()))
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">4IHH", 0, 0, RATE, n, 0x55C4, 0)),
            full(b"hdlr", struct.pack(">4s4s12x", b"mhlr", b"vide"), b"\0"),
            box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), box(b"stbl", *tables)),
        )
        header = struct.pack(">5IiIHhII", 0, 0, 1, 0, n, 0, 0, 0, 0, 0, 0)
        track = box(b"trak", full(b"tkhd", header, MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7), media)
        start = full(b"mvhd", struct.pack(">4IIH10x", 0, 0, RATE, n, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", start, track)

    kind = box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  ")
    wide = len(payload) > 0xFFFF0000
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")
    size = len(movie(0, wide))
    return kind + movie(len(kind) + size + len(head), wide) + head + payload


def write_fragments(payload: bytes, per_fragment: int = PER_CHUNK, key_every: int = 1) -> bytes:
    """The same pictures as a fragmented file: an empty movie, then a moof and a mdat for each `per_fragment` pictures."""
    plain = write_container(payload, key_every)
    n = len(payload) // SAMPLE
    tables = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"raw ", struct.pack(">6xH16xHHIIIH32sHh", 1, SIDE, SIDE, 0x480000, 0x480000, 0, 1, b"", 24, -1))), full(b"stts", bytes(4)), full(b"stsc", bytes(4)), full(b"stsz", bytes(8)), full(b"stco", bytes(4)))
    media = box(b"mdia", full(b"mdhd", struct.pack(">4IHH", 0, 0, RATE, 0, 0x55C4, 0)), full(b"hdlr", struct.pack(">4s4s12x", b"mhlr", b"vide"), b"\0"), box(b"minf", tables))
    track = box(b"trak", full(b"tkhd", struct.pack(">5I", 0, 0, 1, 0, 0), bytes(60), flags=7), media)
    out = plain[: struct.unpack_from(">I", plain)[0]] + box(b"moov", track, box(b"mvex", full(b"trex", struct.pack(">5I", 1, 1, 1, SAMPLE, 0x10000))))
    for first in range(0, n, per_fragment):
        count = min(per_fragment, n - first)
        flags = [0 if (first + k) % key_every == 0 else 0x10000 for k in range(count)]

        def moof(offset: int) -> bytes:
            run = full(b"trun", struct.pack(">Ii", count, offset), struct.pack(f">{count}I", *flags), flags=0x401)  # noqa: B023
            return box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 1), flags=0x20000), run))

        out += moof(len(moof(0)) + 8) + box(b"mdat", payload[first * SAMPLE : (first + count) * SAMPLE])
    return out


def walk(raw: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Boxes of raw[start:end]: kind, and where the content begins and ends."""
    while start < end:
        if end - start < 8:
            raise ValueError("a box is cut short")
        size, kind = struct.unpack_from(">I4s", raw, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box is cut short")
            size, head = struct.unpack_from(">Q", raw, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} reaches beyond its parent")
        yield kind, start + head, start + size
        start += size


def _tables(raw: memoryview, start: int, end: int, into: dict, depth: int = 0) -> dict:
    """Places of all leaf boxes below, by kind; the first of a kind counts."""
    if depth > DEPTH:
        raise ValueError("boxes are nested too deeply")
    for kind, a, b in walk(raw, start, end):
        if kind in NESTED:
            _tables(raw, a, b, into, depth + 1)
        else:
            into.setdefault(kind, (a, b))
    return into


def _fields(raw: memoryview, place: tuple[int, int], skip: int, form: str) -> tuple:
    """Numbers behind `skip` bytes of a box."""
    a, b = place
    if b - a < skip + struct.calcsize(form):
        raise ValueError("a box is cut short")
    return struct.unpack_from(form, raw, a + skip)


def _numbers(raw: memoryview, place: tuple[int, int], skip: int, width: int, dtype: str = ">u4") -> np.ndarray:
    """A counted table behind `skip` bytes: its count, then rows of `width` numbers."""
    a, b = place
    (n,) = _fields(raw, place, skip, ">I")
    if a + skip + 4 + n * width * np.dtype(dtype).itemsize > b:
        raise ValueError("a table is cut short")
    return np.frombuffer(raw, dtype, n * width, a + skip + 4).reshape(n, width).astype(np.int64)


def _within(raw: memoryview, starts: np.ndarray, sizes: np.ndarray) -> None:
    if len(starts) and ((starts < 0) | (sizes < 0) | (starts > len(raw)) | (sizes > len(raw) - np.minimum(starts, len(raw)))).any():
        raise ValueError("a sample lies beyond the end")


def _listed(raw: memoryview, at: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Starts, sizes and key flags of the samples of a track's tables, and how long they last."""
    if missing := [k.decode() for k in (b"stts", b"stsc", b"stsz") if k not in at]:
        raise ValueError(f"no {', '.join(missing)}")
    each, n = _fields(raw, at[b"stsz"], 4, ">II")
    if each * n > len(raw):
        raise ValueError("samples are larger than the file")
    sizes = np.full(n, each, np.int64) if each else _numbers(raw, at[b"stsz"], 8, 1)[:, 0]
    times = _numbers(raw, at[b"stts"], 4, 2).tolist()
    if sum(k for k, _ in times) != n:
        raise ValueError("times and samples differ")
    if n and not (b"co64" in at or b"stco" in at):
        raise ValueError("no chunk offsets")
    places = _numbers(raw, at[b"co64"], 4, 1, ">u8") if b"co64" in at else _numbers(raw, at[b"stco"], 4, 1) if b"stco" in at else np.zeros((0, 1), np.int64)
    runs = _numbers(raw, at[b"stsc"], 4, 3)
    chunks = np.diff(np.append(runs[:, 0], len(places) + 1))
    if (chunks < 0).any() or (len(runs) and runs[0, 0] != 1) or sum(a * b for a, b in zip(runs[:, 1].tolist(), chunks.tolist(), strict=True)) != n:
        raise ValueError("chunks and samples differ")
    per_chunk = np.repeat(runs[:, 1], chunks)
    chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)
    before = np.cumsum(sizes) - sizes
    lead = np.append(0, np.cumsum(per_chunk))[:-1]
    starts = places[chunk, 0] + before - before[lead[chunk]] if n else np.zeros(0, np.int64)
    _within(raw, starts, sizes)
    keys = np.ones(n, bool)
    if b"stss" in at:
        numbers = _numbers(raw, at[b"stss"], 4, 1)[:, 0]
        if len(numbers) and not 1 <= numbers.min() <= numbers.max() <= n:
            raise ValueError("a sync sample does not exist")
        keys[:] = False
        keys[numbers - 1] = True
    return starts, sizes, keys, sum(k * d for k, d in times)


def _fragments(raw: memoryview, moofs: list[tuple[int, int, int]], defaults: dict[int, tuple]) -> dict[int, list[tuple]]:
    """(start, size, is key, duration) of the samples of all fragments, by track."""
    found: dict[int, list[tuple]] = {}
    for box_start, a, b in moofs:
        reached = box_start
        for kind, x, y in walk(raw, a, b):
            if kind != b"traf":
                continue
            inner = list(walk(raw, x, y))
            head = next(((p, q) for k, p, q in inner if k == b"tfhd"), None)
            if head is None:
                raise ValueError("no tfhd")
            flags, track = _fields(raw, head, 0, ">II")
            flags &= 0xFFFFFF
            at, base = 8, box_start if flags & 0x20000 else reached
            if flags & 1:
                (base,) = _fields(raw, head, at, ">Q")
                at += 8
            at += 4 * bool(flags & 2)
            told = list(defaults.get(track, (0, 0, 0)))  # duration, size and flags
            for k, bit in enumerate((8, 0x10, 0x20)):
                if flags & bit:
                    (told[k],) = _fields(raw, head, at, ">I")
                    at += 4
            place = base
            for k, p, q in inner:
                if k != b"trun":
                    continue
                flags, n = _fields(raw, (p, q), 0, ">II")
                at = 8
                if flags & 1:
                    place, at = base + _fields(raw, (p, q), at, ">i")[0], at + 4
                first, at = (_fields(raw, (p, q), at, ">I")[0], at + 4) if flags & 4 else (None, at)
                bits = [bool(flags & bit) for bit in (0x100, 0x200, 0x400, 0x800)]
                if n * 4 * sum(bits) > q - p - at or (not bits[1] and n * told[1] > len(raw)):
                    raise ValueError("a table is cut short")
                if n + sum(map(len, found.values())) > len(raw):
                    raise ValueError("more samples than bytes")
                rows = np.frombuffer(raw, ">u4", n * sum(bits), p + at).reshape(n, sum(bits)).tolist()
                for row in range(n):
                    values = iter(rows[row])
                    duration, size, said = (next(values) if bit else d for bit, d in zip(bits[:3], told, strict=True))
                    if row == 0 and first is not None:
                        said = first
                    found.setdefault(track, []).append((place, size, not said & 0x10000, duration))
                    place += size
            reached = place
    return found


def parse_container(media: bytes) -> dict:
    """The first track as parse_tracks gives it."""
    return parse_tracks(media)[0]


def parse_tracks(media: bytes) -> list[dict]:
    """codec, handler, size, timescale, duration and the samples' places and key flags of each track."""
    raw = memoryview(media)
    tracks: list[tuple[int, int]] = []
    defaults: dict[int, tuple] = {}
    moofs = []
    for kind, a, b in walk(raw, 0, len(raw)):
        if kind == b"moov":
            for inner, x, y in walk(raw, a, b):
                if inner == b"trak":
                    tracks.append((x, y))
                elif inner == b"mvex":
                    for k, p, q in walk(raw, x, y):
                        if k == b"trex":
                            track, _, *rest = _fields(raw, (p, q), 4, ">5I")
                            defaults[track] = tuple(rest)
        elif kind == b"moof":
            moofs.append((a - 8, a, b))
    if not tracks:
        raise ValueError("no track")
    later = _fragments(raw, moofs, defaults)
    found = []
    for x, y in tracks:
        at = _tables(raw, x, y, {})
        if missing := [k.decode() for k in (b"tkhd", b"mdhd", b"stsd") if k not in at]:
            raise ValueError(f"no {', '.join(missing)}")
        (track,) = _fields(raw, at[b"tkhd"], 20 if _fields(raw, at[b"tkhd"], 0, ">B")[0] == 1 else 12, ">I")
        long = _fields(raw, at[b"mdhd"], 0, ">B")[0] == 1
        scale, duration = _fields(raw, at[b"mdhd"], 20 if long else 12, ">IQ" if long else ">II")
        handler = bytes(raw[at[b"hdlr"][0] + 8 : at[b"hdlr"][0] + 12]).decode("latin1") if b"hdlr" in at else ""
        entries = list(walk(raw, at[b"stsd"][0] + 8, at[b"stsd"][1]))
        if not entries:
            raise ValueError("no sample entry")
        codec, c, d = entries[0]
        width, height = _fields(raw, (c, d), 24, ">HH") if handler == "vide" else (0, 0)
        starts, sizes, keys, lasts = _listed(raw, at)
        if later.get(track):
            more = np.array([(p, n, k) for p, n, k, _ in later[track]], np.int64)
            _within(raw, more[:, 0], more[:, 1])
            starts, sizes, keys = np.append(starts, more[:, 0]), np.append(sizes, more[:, 1]), np.append(keys, more[:, 2] == 1)
            lasts += sum(t for *_, t in later[track])
            duration = duration or lasts
        if lasts != duration:
            raise ValueError("times and duration differ")
        found.append({"codec": codec.decode("latin1"), "handler": handler, "width": width, "height": height, "timescale": scale, "duration": duration, "starts": starts, "sizes": sizes, "keys": keys})
    return found


def key_ranges(found: dict) -> list[tuple[int, int]]:
    """Start and length of key samples; neighbours are one range."""
    starts, sizes = found["starts"][found["keys"]], found["sizes"][found["keys"]]
    if not len(starts):
        return []
    new = np.append(True, starts[1:] != starts[:-1] + sizes[:-1])
    at = np.flatnonzero(new)
    return list(zip(starts[at].tolist(), np.add.reduceat(sizes, at).tolist(), strict=True))


def read_samples(media: bytes, found: dict) -> bytes:
    """The stored bytes of all samples, in order."""
    whole = dict(found, keys=np.ones(len(found["sizes"]), bool))
    return b"".join(media[a : a + n] for a, n in key_ranges(whole))


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text", key_every: int = 1) -> DataFrame:
    """doc_id, n_bytes and the container of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "raw"):
            raws = [x or b"" for x in batch.column("raw").to_pylist()]
            stored = pa.array([write_container(padded(x), key_every) for x in raws], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, raws), pa.int64()), stored], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(docs[quoted(key)].cast("long").alias("doc_id"), F.encode(docs[quoted(text)], "UTF-8").alias("raw"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


TRACK = "codec string, handler string, width int, height int, timescale long, duration long, samples long, key_ranges array<struct<start:long,length:long>>"
PROBED = (
    "codec string, width int, height int, timescale long, duration long, samples long, "
    "key_ranges array<struct<start:long,length:long>>, payload_bytes long, payload_sha256 string, tail_crc32 long, error string"
)


def probe_media(stored: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """What the container's boxes say, and digests of the first track's stored samples, for a column `media`; `tracks` tells all tracks."""
    kinds = dict(stored.dtypes)
    tracks = ",".join(x.replace(" ", ":", 1) for x in TRACK.split(", "))
    schema = "".join(f"{quoted(c)} {kinds[c]}, " for c in keep) + "media_bytes long, media_sha256 string, " + PROBED + f", tracks array<struct<{tracks}>>"

    def told(track: dict) -> dict:
        own = {k: track[k] for k in ("codec", "handler", "width", "height", "timescale", "duration")}
        return own | {"samples": len(track["sizes"]), "key_ranges": [{"start": a, "length": n} for a, n in key_ranges(track)]}

    def one(media: bytes | None) -> dict:
        try:
            if media is None:
                raise ValueError("no container")
            found = parse_tracks(media)
            if max(t[k] for t in found for k in ("timescale", "duration")) >= 1 << 63:
                raise ValueError("a time is too large")
            payload = read_samples(media, found[0])
            tracks = [told(t) for t in found]
        except (ValueError, struct.error, IndexError, KeyError, OverflowError, MemoryError) as e:
            return {"error": str(e) or type(e).__name__}
        said = {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:])}
        return tracks[0] | said | {"tracks": tracks}

    ranges = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    short = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    typed = lambda ddl: [(n, short.get(t, ranges)) for n, t in (x.split(" ", 1) for x in ddl.split(", "))]
    types = [*typed(PROBED), ("tracks", pa.list_(pa.struct(typed(TRACK))))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media"):
            raws = batch.column("media").to_pylist()
            rows = [one(x) for x in raws]
            own = [
                pa.array([None if x is None else len(x) for x in raws], pa.int64()),
                pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in raws], pa.string()),
            ]
            read = [pa.array([r.get(n) for r in rows], t) for n, t in types]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *own, *read], names=[*keep, "media_bytes", "media_sha256", *(n for n, _ in types)])

    return stored.select(*map(quoted, keep), "media").mapInArrow(run, schema)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = probe_media(store_media(documents(spark, sf_dir), key_every=KEY_EVERY))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("codec="), F.rtrim("codec")),
        F.concat(F.lit("size="), "width", F.lit("x"), "height"),
        F.concat(F.lit("time="), "duration", F.lit("/"), "timescale"),
        F.concat(F.lit("samples="), "samples"),
        F.concat(F.lit("keys="), F.concat_ws(",", F.transform("key_ranges", lambda r: F.concat(r["start"], F.lit("+"), r["length"])))),
    )
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
