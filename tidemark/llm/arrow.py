"""Arrow batches as flat byte arrays, cut into pieces of bounded size, and hashes of words.

A worker holds one piece at a time: arrays of words are a sixth of its bytes, arrays of bytes are
short-lived, and nothing is kept from one piece to the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one step handles at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 18
#: Words of more bytes are hashed by BLAKE2b.
LONG_WORD = 64


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each row starts (one entry more than rows); null is empty."""
    column = pc.cast(column, pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with at most `limit` bytes of that column, or one row."""
    limit = limit or PIECE_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_other(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values in another way (the finaliser of MurmurHash3)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Masks that keep the first 0 to 8 bytes of a little-endian number.
FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; beyond the end are zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: bytes = b"", lanes: int = 1) -> list[np.ndarray]:
    """One or two independent 64-bit hashes of each span [begin, end) of bytes, keyed by seed.

    Spans are taken in eight bytes a round, so a round's work is by words and not by bytes; spans
    of more than LONG_WORD bytes go through BLAKE2b.
    """
    keys = np.frombuffer(hashlib.blake2b(seed, digest_size=16).digest(), "<u8")
    size = end - begin
    spread = [mix, mix_other][:lanes]
    out = [f(size.astype(np.uint64) ^ k) for f, k in zip(spread, keys, strict=False)]
    view = eights(data)
    left, at = np.flatnonzero((size > 0) & (size <= LONG_WORD)), 0
    while len(left):
        part = view[begin[left] + at] & FIRST_BYTES[np.minimum(size[left] - at, 8)]
        for f, h in zip(spread, out, strict=True):
            h[left] = f(h[left] ^ part)
        at += 8
        left = left[size[left] > at]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[begin[k] : end[k]], key=seed[:64], digest_size=16).digest()
        for lane, h in enumerate(out):
            h[k] = int.from_bytes(digest[8 * lane : 8 * lane + 8], "little")
    return out


def words(data: np.ndarray, starts: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all maximal runs of bytes outside `space` (a truth value for each byte), and their rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(starts, begin, side="right") - 1
