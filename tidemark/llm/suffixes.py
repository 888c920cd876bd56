"""Suffix-array dedup with a logarithmic index family.

Each byte covered by a LENGTH-byte string that also starts anywhere else is removed. The index holds
sparse suffix arrays: of each window of LENGTH bytes the suffix at its anchor is kept, the place of
the least hash among the window's ANCHOR-byte strings. Equal windows have equal anchors at equal
places, so no match is missed, and about one suffix in 80 bytes is indexed.

A batch of documents gets a suffix array: its suffixes in the order of their first ANCHOR bytes, dealt
out by the hash of these. It is merge-scanned against each level of the index for suffixes that agree
in so many bytes, and becomes a level; levels of like size are merged, so a suffix is moved a
logarithmic number of times (`SuffixIndex`). The registered query adds its whole table as one batch
to an index that is not kept.

A suffix comes with its context: all windows that have it as anchor, known by a 128-bit BLAKE2b digest.
If a whole context is found elsewhere, its bytes go. Different contexts of one anchor are compared by
their bytes: they are put in the order of what follows the anchor and of what precedes it, and the
common prefixes of neighbours in both orders tell which windows agree.

No task holds a large group. Equal contexts within one batch are settled on the spot and sent on once. An
anchor of more than LOCAL_HOT contexts in a batch, or HOT in a part, is hot: its contexts' windows are
dealt out one by one, by their own digests. LOCAL_HOT, HOT and STEP choose a way, never a result.

Defined cases: a null text is empty; a text under LENGTH bytes holds no window and stays whole; strings
are judged on the input; equal rows are each other's copies; an empty table gives an empty table; other
columns are ignored. Rows are told apart by two 64-bit hashes of doc_id and text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrow import flat, mix, pieces
from tidemark.llm.common import DEALT, Deal, alone, cut_blob, dealt_rows, documents, quoted, sections, sieve, size_of, text_bytes, written

LENGTH, ANCHOR = 200, 40
PLACES = LENGTH - ANCHOR + 1
#: Suffixes of one batch that a worker settles, about.
BATCH_SUFFIXES = 100_000
#: Contexts of one anchor in a worker's batch, and in a part, from which the anchor is hot.
LOCAL_HOT, HOT = 512, 20_000
#: Contexts that are compared at once, about.
STEP = 2_000
#: Bytes of packed suffixes for each byte of text, about.
SUFFIX_SHARE = 1.1
#: Entries of a suffix array: the first bytes, digest of the context, row, where the context starts in it, anchor's place and further windows in it.
ENTRY = np.dtype([
    ("anchor", f"S{ANCHOR}"), ("d0", "u8"), ("d1", "u8"), ("r0", "i8"), ("r1", "i8"), ("start", "i8"), ("lead", "u1"), ("more", "u1"), ("settled", "u1"), ("pad", "u1", 5),
])
WINDOW = np.dtype([("d0", "u8"), ("d1", "u8"), ("r0", "i8"), ("r1", "i8"), ("start", "i8"), ("partial", "u1"), ("settled", "u1"), ("old", "u1"), ("pad", "u1", 5)])
#: Kinds of blobs: entries of a batch, spans, contexts of hot anchors, hot anchors, entries of a level, contexts, windows, hot anchors of levels.
NEW, SPAN, LOCAL, MARK, LEVEL, CONTEXT, WIN, OLD_MARK = range(8)
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def place_hashes(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the ANCHOR bytes from each place on, from hashes of 1, 2, 4, ... bytes. It only chooses anchors."""
    held, width, eight = BYTE_CODES[data], 1, None
    while width < 32:
        held = held[:-width] * np.uint32(2654435761 + 2 * width) + held[width:]
        width *= 2
        eight = held if width == 8 else eight
    n = len(data) - ANCHOR + 1
    held = held[:n] * np.uint32(2246822519) + eight[32 : 32 + n]
    held ^= held >> np.uint32(15)
    held *= np.uint32(739982445)
    held ^= held >> np.uint32(12)
    return held


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours: running minima from both ends of blocks of that size."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    full = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    full[: len(values)] = values
    table = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2b digests of spans, as two numbers each."""
    hashed = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(hashed, "<u8").reshape(-1, 2)


def suffixes(data: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Anchored suffixes of documents that lie end to end, as ENTRY; rows has two numbers for each document."""
    n = np.diff(bounds)
    count = np.maximum(n - LENGTH + 1, 0)
    if not count.sum():
        return np.zeros(0, ENTRY)
    hashes = place_hashes(data)
    order = (hashes.astype(np.uint64) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    least = least_in_window(order, PLACES)
    owner = np.repeat(np.arange(len(n)), count)
    window = np.arange(len(owner)) + (bounds[:-1] - (np.cumsum(count) - count))[owner]
    anchor = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])))
    last = np.append(new[1:], len(owner)) - 1
    start, end, anchor, doc = window[new], window[last] + LENGTH, anchor[new], owner[new]
    out = np.zeros(len(new), ENTRY)
    out["anchor"] = data[anchor[:, None] + np.arange(ANCHOR)].reshape(-1).view(f"S{ANCHOR}")
    digest = digests(data.tobytes(), start, end)
    out["d0"], out["d1"] = digest[:, 0], digest[:, 1]
    out["r0"], out["r1"] = rows[doc, 0], rows[doc, 1]
    out["start"], out["lead"], out["more"] = start - bounds[doc], anchor - start, end - LENGTH - start
    return out


def anchor_keys(anchors: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each anchor's bytes, to deal them out by."""
    words = np.ascontiguousarray(anchors).view(np.uint8).reshape(-1, ANCHOR).copy().view("<u8")
    key = np.full(len(words), np.uint64(ANCHOR))
    for column in words.T:
        key = mix(key ^ column)
    return key


def in_order(entries: np.ndarray) -> np.ndarray:
    """Entries by their first bytes, then by context."""
    return entries[np.lexsort((entries["d1"], entries["d0"], entries["anchor"]))]


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each entry differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def joined(start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of the same document made one; sorted by document and start."""
    order = np.lexsort((start, doc))
    start, end, doc = start[order], end[order], doc[order]
    if not len(start):
        return start, end, doc
    base = np.cumsum(changes(doc)) - 1
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + base * wide)
    at = np.flatnonzero(np.append(True, start[1:] + base[1:] * wide > reach[:-1]))
    stop = np.append(at[1:], len(start)) - 1
    return start[at], reach[stop] - base[stop] * wide, doc[at]


def span_rows(entries: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """(r0, r1, start, stop) of entries, overlapping ones of a row made one."""
    if not len(entries):
        return np.zeros((0, 4), np.int64)
    order = np.lexsort((entries["r1"], entries["r0"]))
    entries, stop = entries[order], stop[order]
    first = changes(entries["r0"], entries["r1"])
    a, b, doc = joined(entries["start"], stop, np.cumsum(first) - 1)
    at = np.flatnonzero(first)[doc]
    return np.column_stack([entries["r0"][at], entries["r1"][at], a, b])


def ends(entries: np.ndarray) -> np.ndarray:
    return entries["start"] + entries["more"] + LENGTH


def settled(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal contexts one, marked as settled, in order; and the spans of all contexts that occur twice."""
    entries = in_order(entries)
    first = changes(entries["d0"], entries["d1"])
    size = np.diff(np.append(np.flatnonzero(first), len(entries)))
    again = np.repeat(size, size) > 1
    spans = span_rows(entries[again], ends(entries[again]))
    kept = entries[first].copy()
    kept["settled"] |= size > 1
    return kept, spans


def suffix_table(docs: DataFrame, deal: Deal) -> DataFrame:
    """Packed suffixes by part, and spans settled within a batch, of docs (r0, r1, raw)."""

    def packed(found: np.ndarray) -> pa.RecordBatch:
        kept, spans = settled(found)
        new = changes(kept["anchor"])
        size = np.diff(np.append(np.flatnonzero(new), len(kept)))
        hot = np.repeat(size, size) > LOCAL_HOT
        marks, warm, local = kept["anchor"][hot & new], kept[~hot], kept[hot]
        high = np.uint64(32)
        rows = deal.packed(deal.place(anchor_keys(warm["anchor"]) >> high), NEW, lambda order: warm[order].tobytes())
        rows += deal.packed(deal.place(anchor_keys(marks) >> high), MARK, lambda order: marks[order].tobytes())
        rows += alone(deal, LOCAL, local, local["d0"]) + alone(deal, SPAN, spans, mix(spans[:, 0].copy().view(np.uint64)))
        return dealt_rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in pieces(batches, "raw"):
            data, bounds = flat(batch.column("raw"))
            held.append(suffixes(data, bounds, np.column_stack([batch.column("r0").to_numpy(), batch.column("r1").to_numpy()])))
            n += len(held[-1])
            if n >= BATCH_SUFFIXES:
                yield packed(np.concatenate(held))
                held, n = [], 0
        if n:
            yield packed(np.concatenate(held))

    return docs.select("r0", "r1", "raw").mapInArrow(run, DEALT)


def entry_cut(deal: Deal):
    def cut(kind: int, blob: bytes) -> list[tuple[int, bytes]]:
        marks = kind in (MARK, OLD_MARK)
        entries = np.frombuffer(blob, f"S{ANCHOR}" if marks else ENTRY)
        anchors = entries if marks else entries["anchor"]
        return cut_blob(deal.place(anchor_keys(anchors) >> np.uint64(32)), lambda order: entries[order].tobytes())

    return cut


FOUND = "wanted boolean, r0 long, r1 long, start long, stop long, key long, lead int, partial boolean, hot boolean, task long, part long, kind int, blob binary"
FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def found_spans(spans: np.ndarray) -> pa.RecordBatch:
    n = len(spans)
    columns = [pa.array(np.zeros(n, bool)), *[pa.array(spans[:, k].copy()) for k in range(4)]]
    rest = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())]
    return pa.RecordBatch.from_arrays([*columns, *rest], names=FOUND_NAMES)


def found_contexts(entries: np.ndarray, partial: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    n = len(entries)
    columns = [np.ones(n, bool), entries["r0"], entries["r1"], entries["start"], ends(entries).astype(np.int64), anchor_keys(entries["anchor"]).view(np.int64), entries["lead"].astype(np.int32), partial, hot]
    rest = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary())]
    return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in columns], *rest], names=FOUND_NAMES)


def scan(batch: np.ndarray, levels: list[np.ndarray], marks: np.ndarray, old_marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge-scan of a batch's suffix array against levels, all in order.

    Spans of whole contexts that occur again, contexts that must be compared, whether each is not found
    whole, and whether its anchor is hot. Of anchors that were hot before, the levels hold all windows.
    """
    own = np.setdiff1d(np.union1d(batch["anchor"], marks), old_marks)
    marks = np.union1d(marks, old_marks)
    met = [batch]
    for level in levels:
        at = np.searchsorted(own, level["anchor"])
        met.append(level[own[np.minimum(at, len(own) - 1)] == level["anchor"]] if len(own) else level[:0])
    met = in_order(np.concatenate(met))
    new_key, new = changes(met["anchor"]), changes(met["anchor"], met["d0"], met["d1"])
    size = np.diff(np.append(np.flatnonzero(new), len(met)))
    twin = np.repeat(size, size) > 1
    gone = met[twin & (met["settled"] == 0)]
    group = np.cumsum(new_key) - 1
    contexts = np.bincount(group, new, int(new_key.sum())).astype(np.int64)
    hot = (contexts > HOT) | np.isin(met["anchor"][new_key], marks)
    wanted = new & ((contexts[group] > 1) | hot[group])
    whole = np.maximum.reduceat(twin | (met["settled"] == 1), np.flatnonzero(new)) if len(met) else np.zeros(0, bool)
    return span_rows(gone, ends(gone)), met[wanted], ~np.repeat(whole, size)[wanted], hot[group][wanted]


def match_suffixes(table: DataFrame, deal: Deal, keep: bool) -> DataFrame:
    """FOUND: spans to remove, contexts to be compared, and (if keep) the batch's suffix array and hot anchors by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, marks, old, levels = [], [], [], {}
        none = np.zeros(0, f"S{ANCHOR}")
        for blobs, last in sections(batches):
            for kind, blob in blobs:
                if kind == SPAN:
                    yield found_spans(np.frombuffer(blob, np.int64).reshape(-1, 4))
                elif kind == LOCAL:
                    entries = np.frombuffer(blob, ENTRY)
                    yield found_contexts(entries, entries["settled"] == 0, np.ones(len(entries), bool))
                elif kind in (MARK, OLD_MARK):
                    (marks if kind == MARK else old).append(np.frombuffer(blob, f"S{ANCHOR}"))
                elif kind == NEW:
                    held.append(np.frombuffer(blob, ENTRY))
                else:
                    levels.setdefault(kind, []).append(np.frombuffer(blob, ENTRY))
            if held:  # what is hot by now goes on at once, so a part's memory is bounded
                entries, spans = settled(np.concatenate(held))
                yield found_spans(spans)
                new = changes(entries["anchor"])
                size = np.diff(np.append(np.flatnonzero(new), len(entries)))
                hot = np.repeat(size, size) > HOT
                if hot.any():
                    yield found_contexts(entries[hot], entries["settled"][hot] == 0, np.ones(int(hot.sum()), bool))
                    marks.append(entries["anchor"][hot & new])
                held = [entries[~hot]]
                marks = [np.unique(np.concatenate(marks))] if marks else []
            if not last:
                continue
            if held or marks:
                batch = held[0] if held else np.zeros(0, ENTRY)
                mark = np.unique(np.concatenate([none, *marks]))
                spans, wanted, partial, hot = scan(batch, [in_order(np.concatenate(x)) for x in levels.values()], mark, np.unique(np.concatenate([none, *old])))
                yield found_spans(spans)
                yield found_contexts(wanted, partial, hot)
                if keep:
                    anchors = batch["anchor"] if len(batch) else mark
                    part = int(deal.place(anchor_keys(anchors[:1]) >> np.uint64(32))[0])
                    mark = np.union1d(mark, wanted["anchor"][hot])
                    yield kept_blobs(deal, part, [(LEVEL, batch.tobytes()), (MARK, mark.tobytes())])
            held, marks, old, levels = [], [], [], {}

    return deal.gathered(table, entry_cut(deal)).mapInArrow(run, FOUND)


def kept_blobs(deal: Deal, part: int, blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """Rows of FOUND for blobs of a level."""
    n = len(blobs)
    rest = [pa.nulls(n, t) for t in (*[pa.int64()] * 5, pa.int32(), pa.bool_(), pa.bool_())]
    own = [pa.array([deal.labels[part // deal.per_task]] * n, pa.int64()), pa.array([part] * n, pa.int64()), pa.array([k for k, _ in blobs], pa.int32()), pa.array([b for _, b in blobs], pa.binary())]
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.bool_()), *rest, *own], names=FOUND_NAMES)


HEAD = 7


def context_table(wanted: DataFrame, texts: DataFrame, deal: Deal) -> DataFrame:
    """Packed contexts by part of their anchor, (key, r0, r1, start, size, lead, partial) and their bytes; and windows of hot anchors by their own digests."""
    each = F.struct("start", "stop", "key", "lead", "partial", "hot")
    lists = wanted.groupBy("r0", "r1").agg(F.collect_set(each).alias("list"))
    likely, _ = sieve(texts.select("r0", "r1", "raw"), "r0", wanted.select("r0"))
    rows = likely.join(lists, ["r0", "r1"]).select("r0", "r1", "raw", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "raw"):
            data, bounds = flat(batch.column("raw"))
            own = np.column_stack([batch.column("r0").to_numpy(), batch.column("r1").to_numpy()])
            _, once = np.unique(own, axis=0, return_index=True)  # of equal rows' contexts that were settled one is enough
            lists = batch.column("list")
            flatly = lists.flatten()
            doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            start, stop, key, lead = (flatly.field(c).to_numpy().astype(np.int64) for c in ("start", "stop", "key", "lead"))
            partial, hot = (flatly.field(c).to_numpy(zero_copy_only=False) for c in ("partial", "hot"))
            cold = np.isin(doc, once) & ~hot
            head = np.column_stack([key, own[doc], start, stop - start, lead, partial])
            begin = bounds[doc] + start
            yield dealt_rows(packed_contexts(deal, head[cold], data, begin[cold]) + packed_windows(deal, head[hot], data, begin[hot]))

    return rows.mapInArrow(run, DEALT)


def packed_contexts(deal: Deal, head: np.ndarray, data: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    size = head[:, 4]
    pack = lambda o: np.int64(len(o)).tobytes() + head[o].tobytes() + spread(data, begin[o], size[o]).tobytes()
    return deal.packed(deal.place(np.ascontiguousarray(head[:, 0]).view(np.uint64) >> np.uint64(32)), CONTEXT, pack)


def packed_windows(deal: Deal, head: np.ndarray, data: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """All windows of contexts, equal ones once, and the spans of those that occur twice here."""
    if not len(head):
        return []
    count = head[:, 4] - LENGTH + 1
    of = np.repeat(np.arange(len(head)), count)
    offset = np.arange(len(of)) - (np.cumsum(count) - count)[of]
    out = np.zeros(len(of), WINDOW)
    digest = digests(data.tobytes(), begin[of] + offset, begin[of] + offset + LENGTH)
    out["d0"], out["d1"], out["r0"], out["r1"] = digest[:, 0], digest[:, 1], head[of, 1], head[of, 2]
    out["start"], out["partial"] = head[of, 3] + offset, head[of, 6]
    out, spans = settled_windows(out)
    rows = deal.packed(deal.place(out["d0"] >> np.uint64(32)), WIN, lambda o: out[o].tobytes())
    return rows + alone(deal, SPAN, spans, mix(spans[:, 0].copy().view(np.uint64)))


def settled_windows(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal windows one, marked as settled, in order of digests; and the spans of those that occur twice and are not settled."""
    windows = windows[np.lexsort((windows["d1"], windows["d0"]))]
    first = changes(windows["d0"], windows["d1"])
    size = np.diff(np.append(np.flatnonzero(first), len(windows)))
    again = np.repeat(size, size) > 1
    hit = windows[again & (windows["partial"] == 1) & (windows["settled"] == 0)]
    kept = windows[first].copy()
    kept["settled"] |= size > 1
    if len(kept):
        kept["old"] = np.minimum.reduceat(windows["old"], np.flatnonzero(first))
    return kept, span_rows(hit, hit["start"] + LENGTH)


def spread(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all spans, end to end."""
    first = np.cumsum(size) - size
    return data[np.repeat(begin - first, size) + np.arange(int(size.sum()))]


def context_cut(deal: Deal):
    def cut(kind: int, blob: bytes) -> list[tuple[int, bytes]]:
        if kind == WIN:
            out = np.frombuffer(blob, WINDOW)
            return cut_blob(deal.place(out["d0"] >> np.uint64(32)), lambda o: out[o].tobytes())
        head, data = unpacked(blob)
        begin = np.cumsum(head[:, 4]) - head[:, 4]
        pack = lambda o: np.int64(len(o)).tobytes() + head[o].tobytes() + spread(data, begin[o], head[o, 4]).tobytes()
        return cut_blob(deal.place(np.ascontiguousarray(head[:, 0]).view(np.uint64) >> np.uint64(32)), pack)

    return cut


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    return np.frombuffer(blob, np.int64, HEAD * n, 8).reshape(n, HEAD), np.frombuffer(blob, np.uint8, offset=8 + 8 * HEAD * n)


def prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row of bytes in their order, and the common prefix of each row in order with the one before it."""
    width = rows.shape[1]
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    differ = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), width) if len(differ) else np.zeros(0, np.int64)
    return rank, np.append(0, common)


def compare(head: np.ndarray, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Spans (r0, r1, start, stop) of the windows of partly found contexts that some other context here also has.

    Equal windows have their anchor at the same place l, so two windows agree if what precedes their
    anchors agrees in l bytes, and what starts there in the LENGTH - l others. Both follow from
    common prefixes in one order each: contexts between which no prefix is shorter are one class.
    """
    size, lead = head[:, 4], head[:, 5]
    more, n = size - LENGTH, len(head)
    right, left = np.arange(LENGTH), np.arange(PLACES - 1)
    inside = right < (size - lead)[:, None]
    ahead = np.where(inside, data[np.where(inside, (begin + lead)[:, None] + right, 0)], 0).astype(np.uint8)
    inside = left < lead[:, None]
    behind = np.where(inside, data[np.where(inside, (begin + lead - 1)[:, None] - left, 0)], 0).astype(np.uint8)
    (rank_r, common_r), (rank_l, common_l) = prefixes(ahead), prefixes(behind)
    rows, starts = [], []
    for at in range(PLACES):
        own = np.flatnonzero((lead - more <= at) & (at <= lead))
        if len(own) < 2:
            continue
        code = np.cumsum(common_r < LENGTH - at)[rank_r[own]] * (n + 1) + np.cumsum(common_l < at)[rank_l[own]]
        order = np.argsort(code, kind="stable")
        same = code[order[1:]] == code[order[:-1]]
        hit = own[order[np.append(same, False) | np.append(False, same)]]
        hit = hit[head[hit, 6] == 1]
        rows.append(hit)
        starts.append(head[hit, 3] + lead[hit] - at)
    if not rows:
        return np.zeros((0, 4), np.int64)
    rows, starts = np.concatenate(rows), np.concatenate(starts)
    entries = np.zeros(len(rows), [("r0", "i8"), ("r1", "i8"), ("start", "i8")])
    entries["r0"], entries["r1"], entries["start"] = head[rows, 1], head[rows, 2], starts
    return span_rows(entries, starts + LENGTH)


def steps(key: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `most` neighbouring entries that don't divide a key."""
    last = np.append(np.flatnonzero(changes(key))[1:], len(key)) if len(key) else np.zeros(0, np.int64)
    a = 0
    while a < len(key):
        b = int(last[min(np.searchsorted(last, a + most), len(last) - 1)])
        yield a, b
        a = b


SPANS = "r0 long, r1 long, start long, stop long, task long, part long, kind int, blob binary"


def match_contexts(table: DataFrame, deal: Deal, keep: bool) -> DataFrame:
    """Spans of windows that are found elsewhere, and (if keep) the hot anchors' windows by part."""

    def spans(rows: np.ndarray) -> pa.RecordBatch:
        n = len(rows)
        rest = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary())]
        return pa.RecordBatch.from_arrays([*[pa.array(rows[:, k].copy()) for k in range(4)], *rest], names=[x.split()[0] for x in SPANS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, held = [], []
        for blobs, last in sections(batches):
            for kind, blob in blobs:
                if kind == SPAN:
                    yield spans(np.frombuffer(blob, np.int64).reshape(-1, 4))
                elif kind == WIN:
                    held.append(np.frombuffer(blob, WINDOW))
                else:
                    contexts.append(unpacked(blob))
            if held:
                windows, found = settled_windows(np.concatenate(held))
                held = [windows]
                yield spans(found)
            if not last:
                continue
            if contexts:
                head, data = (np.concatenate(x) for x in zip(*contexts, strict=True))
                begin = np.cumsum(head[:, 4]) - head[:, 4]
                order = np.argsort(head[:, 0], kind="stable")
                head, begin = head[order], begin[order]
                for a, b in steps(head[:, 0], STEP):
                    yield spans(compare(head[a:b], data, begin[a:b]))
            if keep and held and (fresh := held[0][held[0]["old"] == 0]).size:
                fresh["old"] = 1
                part = int(deal.place(fresh["d0"][:1] >> np.uint64(32))[0])
                own = [pa.array([v], t) for v, t in ((deal.labels[part // deal.per_task], pa.int64()), (part, pa.int64()), (WIN, pa.int32()), (fresh.tobytes(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, *own], names=[x.split()[0] for x in SPANS.split(", ")])
            contexts, held = [], []

    return deal.gathered(table, context_cut(deal)).mapInArrow(run, SPANS)


def repeated_spans(batch: DataFrame, texts: DataFrame, deal: Deal, levels: DataFrame | None = None, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(r0, r1, start, stop) of spans to remove in a batch (r0, r1, raw) and in what the levels hold; spans may overlap.

    texts are the rows of the batch and of all levels. Beside them, the blobs of the new level, if keep.
    """
    table = suffix_table(batch, deal)
    if levels is not None:
        table = table.unionAll(levels.where(F.col("kind") != WIN))
    found = written(match_suffixes(table, deal, keep), "suffixes")
    table = context_table(found.where("wanted"), texts, deal)
    if levels is not None:
        table = table.unionAll(levels.where(F.col("kind") == WIN))
    second = written(match_contexts(table, deal, keep), "windows")
    span = ["r0", "r1", "start", "stop"]
    spans = found.where("NOT wanted").select(*span).unionAll(second.where("blob IS NULL").select(*span)).distinct()
    blobs = found.where("blob IS NOT NULL").select(*DEALT_NAMES).unionAll(second.where("blob IS NOT NULL").select(*DEALT_NAMES))
    return spans, blobs


DEALT_NAMES = [x.split()[0] for x in DEALT.split(", ")]


def named_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, raw, and two hashes of both that name the row."""
    rows = docs.select(F.col(quoted(key)).cast("long").alias("doc_id"), text_bytes(quoted(text)).alias("raw"))
    return rows.withColumns({"r0": F.xxhash64("doc_id", "raw"), "r1": F.xxhash64(F.lit(7), "raw", "doc_id")})


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (start and stop of each maximal removed run) and kept (the remaining bytes)."""
    rows = named_texts(docs, key, text)
    long = rows.where(F.length("raw") >= LENGTH).select("r0", "r1", "raw")
    deal = Deal.of(docs.sparkSession, size_of(docs, text) * SUFFIX_SHARE)
    spans = written(repeated_spans(long, long, deal)[0], "spans")
    lists = spans.groupBy(F.col("r0").alias("s0"), F.col("r1").alias("s1")).agg(F.collect_list(F.struct("start", "stop")).alias("list"))
    likely, clean = sieve(rows, "r0", spans.select("r0"))
    met = likely.join(lists, (likely["r0"] == lists["s0"]) & (likely["r1"] == lists["s1"]), "left").select("doc_id", "raw", "list")
    met = met.unionAll(clean.select("doc_id", "raw", F.lit(None).cast("array<struct<start:bigint,stop:bigint>>")))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "raw"):
            lists = batch.column("list")
            flatly = lists.flatten()
            doc = np.repeat(np.arange(batch.num_rows), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            a, b, d = joined(flatly.field("start").to_numpy(), flatly.field("stop").to_numpy(), doc)
            at = np.searchsorted(d, np.arange(batch.num_rows + 1))
            raws, kept, spans = batch.column("raw").to_pylist(), [], []
            for k, raw in enumerate(raws):
                own = list(zip(a[at[k] : at[k + 1]].tolist(), b[at[k] : at[k + 1]].tolist(), strict=True))
                spans.append([{"start": x, "stop": y} for x, y in own])
                edges = [0, *(e for s in own for e in s), len(raw)]
                kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in raws], pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return met.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


VERSIONS = "version long, levels array<string>, sizes array<long>, texts array<string>, labels array<long>, per_task int"


@dataclass
class SuffixIndex:
    """A kept family of suffix arrays in a shared folder; one writer at a time.

    Levels are named by an append-only table of versions, so a batch that dies leaves files that no reader
    sees. `expected_bytes` is about how much text the index will hold: it fixes the number of parts.
    """

    spark: SparkSession
    root: str
    expected_bytes: float = 1e9

    def version(self) -> dict:
        try:
            rows = self.spark.read.schema(VERSIONS).parquet(f"{self.root}/versions").orderBy(F.desc("version")).limit(1).collect()
        except AnalysisException:
            rows = []
        if rows:
            return rows[0].asDict()
        deal = Deal.of(self.spark, self.expected_bytes * SUFFIX_SHARE)
        return {"version": 0, "levels": [], "sizes": [], "texts": [], "labels": list(deal.labels), "per_task": deal.per_task}

    def _put(self, blobs: DataFrame, name: str) -> int:
        blobs.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self._level(name).agg(F.sum(F.length("blob"))).first()[0] or 0

    def _level(self, name: str) -> DataFrame:
        return self.spark.read.schema(DEALT).parquet(f"{self.root}/{name}")

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, start and stop of spans that are now found elsewhere, in the batch and in older documents; spans may overlap."""
        now = self.version()
        deal, made = Deal(tuple(now["labels"]), now["per_task"]), uuid.uuid4().hex
        rows = named_texts(docs, key, text).where(F.length("raw") >= LENGTH)
        rows.write.option("compression", "zstd").parquet(f"{self.root}/texts-{made}")
        now["texts"].append(f"texts-{made}")
        texts = self.spark.read.schema(rows.schema).parquet(*[f"{self.root}/{t}" for t in now["texts"]])
        batch = self.spark.read.schema(rows.schema).parquet(f"{self.root}/texts-{made}")
        levels = None
        for n, name in enumerate(now["levels"]):  # each level keeps a kind of its own, so that it stays in order
            one = self._level(name).withColumn("kind", F.when(F.col("kind") == LEVEL, 100 + n).when(F.col("kind") == MARK, OLD_MARK).otherwise(F.col("kind")).cast("int"))
            levels = one if levels is None else levels.unionAll(one)
        spans, blobs = repeated_spans(batch, texts.select("r0", "r1", "raw"), deal, levels, keep=True)
        spans = written(spans, "spans")
        now["levels"].append(f"level-{made}")
        now["sizes"].append(self._put(blobs, f"level-{made}"))
        while len(now["sizes"]) > 1 and now["sizes"][-2] < 2 * now["sizes"][-1]:
            both, name = [now["levels"].pop(), now["levels"].pop()], f"level-{uuid.uuid4().hex}"
            now["sizes"] = [*now["sizes"][:-2], self._put(merged(self._level(both[0]).unionAll(self._level(both[1])), deal), name)]
            now["levels"].append(name)
        now["version"] += 1
        self.spark.createDataFrame([now], VERSIONS).coalesce(1).write.mode("append").parquet(f"{self.root}/versions")
        return spans.join(texts.select("doc_id", "r0", "r1").distinct(), ["r0", "r1"]).select("doc_id", "start", "stop")


def merged(blobs: DataFrame, deal: Deal) -> DataFrame:
    """Two levels as one: suffix arrays of a part merged in order, equal contexts and windows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        task = part = None

        def done() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                raw = b"".join(parts)
                if kind == LEVEL:
                    raw = settled(np.frombuffer(raw, ENTRY))[0].tobytes()
                elif kind == WIN:
                    raw = settled_windows(np.frombuffer(raw, WINDOW))[0].tobytes()
                else:
                    raw = np.unique(np.frombuffer(raw, f"S{ANCHOR}")).tobytes()
                yield dealt_rows([(task, part, kind, raw)])

        for batch in batches:
            for t, p, kind, blob in zip(*(batch.column(c).to_pylist() for c in DEALT_NAMES), strict=True):
                if p != part:
                    yield from done()
                    held = {}
                task, part = t, p
                held.setdefault(kind, []).append(blob)
        yield from done()

    return blobs.repartition(len(deal.labels), "task").sortWithinPartitions("part").mapInArrow(run, DEALT)


def op1_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS raw FROM documents),
places AS (SELECT rid, raw, unnest(range(0, octet_length(raw) - {LENGTH - 1})) AS i FROM d WHERE octet_length(raw) >= {LENGTH}),
wins AS (SELECT rid, i, md5(raw[i + 1 : i + {LENGTH}]) AS m FROM places),
repeated AS (SELECT m FROM wins GROUP BY m HAVING count(*) > 1),
hits AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM wins SEMI JOIN repeated USING (m)),
runs AS (SELECT rid, i, sum(CASE WHEN before IS NULL OR i > before + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM hits),
spans AS (SELECT rid, min(i) AS a, max(i) + {LENGTH} AS b FROM runs GROUP BY rid, run),
edges AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS kept_from FROM spans),
kept AS (
  SELECT e.rid, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last_b, string_agg(hex(raw[kept_from + 1 : a]), '' ORDER BY a) AS lead
  FROM edges e JOIN d USING (rid) GROUP BY e.rid)
SELECT doc_id, CAST(octet_length(raw) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN k.rid IS NULL THEN sha256(raw) ELSE sha256(unhex(lead || CASE WHEN last_b < octet_length(raw) THEN hex(raw[last_b + 1 : octet_length(raw)]) ELSE '' END)) END AS kept_sha256
FROM d LEFT JOIN kept k USING (rid)"""
