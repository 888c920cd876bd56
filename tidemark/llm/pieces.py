"""SentencePiece encoding with original byte spans, and decoding.

The normaliser of the model is rebuilt from its compiled character map: at each place the longest
prefix in the double-array trie is replaced, and for every normalised byte the original byte it came
from is kept. The library finds the pieces; their lengths add up to the normalised text, so each
piece's bounds carry over to the original bytes.

Defined cases: a null text encodes as the empty text (begin and end ids only); other columns are
ignored; repeated rows give repeated results; an empty table gives an empty table. A model without
byte fallback may give unknown pieces; their surfaces are then read from the library's own result. If
the pieces don't cover the normalised text, the bounds are null; ids and text are the library's in any
case. The pieces of a model without a map (as the default one) differ from the text by spaces only.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrow import pieces
from tidemark.llm.common import documents, quoted

#: The sign for a space, the sign for malformed input, numbers of the model format's fields and piece kinds.
SPACE_SIGN = "▁".encode()
PIECES, NORMALIZER, CHARSMAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE = 1, 3, 2, 3, 4, 5
UNKNOWN, CONTROL, BYTE = 2, 3, 6


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, raw[at : at + n]
            at += n


class CharacterMap:
    """A compiled character map: a double-array trie over source bytes, and the texts it points to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of raw[at:], and what replaces it."""
        if not self.units:
            return None
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node, found = step(self.units[0]), None
        for n in range(at, len(raw)):
            node ^= raw[n]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != raw[n]:
                break
            node ^= step(unit)
            if unit >> 8 & 1:
                found = n + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


def character_length(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Normalizer:
    """Normalised bytes of a text, and for each of them (and the end) the original byte it stands for."""

    def __init__(self, spec: dict):
        self.map = CharacterMap(spec.get(CHARSMAP, b""))
        self.dummy, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (DUMMY_PREFIX, EXTRA_SPACES, ESCAPE))
        self.space = SPACE_SIGN if self.escape else b" "

    def __call__(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        return self.mapped(raw) if self.map.units or self.trim else self.plain(raw)

    def plain(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map only spaces change."""
        if not raw:
            return b"", np.zeros(1, np.int32)
        data = np.frombuffer(raw, np.uint8)
        widths = np.ones(len(data), np.int32)
        widths[data == 0x20] = len(self.space)
        source = np.repeat(np.arange(len(data), dtype=np.int32), widths)
        out = raw.replace(b" ", self.space)
        if self.dummy:
            out, source = self.space + out, np.concatenate([np.zeros(len(self.space), np.int32), source])
        return out, np.append(source, np.int32(len(raw)))

    def mapped(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        taken, at = [], 0
        while at < len(raw):
            n, text = self.map.longest(raw, at) or (0, b"")
            if not n:
                n = character_length(raw[at])
                text = raw[at : at + n]
            taken.append((text, at, at + n))
            at += n
        end = len(raw)
        if self.trim:
            while taken and not taken[0][0].strip(b" "):
                taken.pop(0)
            while taken and not taken[-1][0].strip(b" "):
                end = taken.pop()[1]
        out, source = bytearray(), []
        if not taken:
            return b"", np.array([end], np.int32)
        if self.dummy:
            out += self.space
            source += [taken[0][1]] * len(self.space)
        after_space = self.trim
        for text, start, _ in taken:
            if after_space:
                text = text.lstrip(b" ")
            for byte in text:
                new = self.space if byte == 0x20 else bytes([byte])
                if self.trim and byte == 0x20 and out.endswith(self.space) and after_space:
                    continue
                out += new
                source += [start] * len(new)
                after_space = self.trim and byte == 0x20
        while self.trim and out.endswith(self.space) and len(out) > len(self.space):
            del out[-len(self.space) :]
            end = source[-1]
            del source[-len(self.space) :]
        return bytes(out), np.array([*source, end], np.int32)


class Codec:
    """One model: ids with bounds on the original bytes, and decoding."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        entries = list(fields(raw))
        spec = next((dict(fields(v)) for k, v in entries if k == NORMALIZER), {})
        self.normalizer = Normalizer(spec)
        listed = [dict(fields(v)) for k, v in entries if k == PIECES]
        kinds = np.array([p.get(3, 1) for p in listed], np.int8)
        self.widths = np.array([{CONTROL: 0, BYTE: 1}.get(k, len(p.get(1, b""))) for p, k in zip(listed, kinds, strict=True)], np.int32)
        self.unknown = kinds == UNKNOWN

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, "<u4") for x in self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)]

    def bounds(self, text: str, ids: np.ndarray) -> np.ndarray | None:
        """Original byte where each piece starts, and the end: piece i spans bounds[i] to bounds[i + 1]; None if pieces don't cover the normalised text."""
        normal, source = self.normalizer(text.encode())
        widths = self.widths[ids]
        if self.unknown[ids].any():
            found = [len(p.surface.encode().replace(b" ", self.normalizer.space)) for p in self.library.encode(text, out_type="immutable_proto").pieces if self.unknown[p.id]]
            if len(found) != int(self.unknown[ids].sum()):
                return None
            widths[self.unknown[ids]] = found
        places = np.concatenate([[0], np.cumsum(widths)])
        return source[places] if places[-1] == len(normal) else None

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.library.decode([x.tolist() for x in ids], num_threads=1)


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(f.read())


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), bounds (the same, one more than ids) and the decoded text.

    The model file must be at the same path on every executor. Texts are handled in pieces of
    bounded size, whole text by whole text.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in pieces(batches, "text"):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids = own.encode(texts)
            bounds = [own.bounds(t, x) for t, x in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                    pa.array([None if x is None else x.astype("<u4").tobytes() for x in bounds], pa.binary()),
                    pa.array(own.decode(ids), pa.string()),
                ],
                names=["doc_id", "ids", "bounds", "decoded"],
            )

    rows = docs.select(docs[quoted(key)].cast("long").alias("doc_id"), docs[quoted(text)].alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, bounds binary, decoded string")


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir))


def piece_digests(docs: DataFrame) -> DataFrame:
    return encode_documents(docs).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
        F.sha2("bounds", 256).alias("bounds_sha256"),
    )


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: each document's ids, the original byte bounds of its pieces, and what they decode to."""
    return encode_documents(docs).withColumn("n_tokens", (F.length("ids") / 4).cast("long"))
