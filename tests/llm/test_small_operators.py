"""Sharding, mixing, quality, media, pieces, language, toxicity and personal data."""

import collections
import datetime
import hashlib
import itertools
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, media, mixing, pieces, pii, quality, sharding, toxicity
from tidemark.llm.common import plain_words, shared_dir

DATA = "/root/testdata/sf0.001"


# sharding


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards_follow_the_published_function(spark):
    keys = [0, 1, -1, 7, 2**62, -(2**63), 2**63 - 1, *range(100, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for r in df.select("k", sharding.jump_shards(F.col("k"), [1, 7, 40, 41]).alias("s")).collect():
        assert list(r.s) == [jump(r.k, n) for n in (1, 7, 40, 41)]


def test_shards_agree_with_sql(spark, agrees):
    agrees(sharding.op9_jump_shards(spark, DATA), sharding.SQL)


def test_shard_table(spark, frame, odd, none):
    texts = {i * 2**40 + i: None if i % 7 == 0 else f"é{i}" for i in range(700)} | {7: "seven"}
    rows = [*texts.items(), *[(7, "seven")] * 300]  # sparse keys, and one that holds a third of the rows
    got = sharding.shard_table(frame(rows), shards=10).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.grown_shard in (r["shard"], 10)
        by[r["shard"]].append((r.doc_id, r.slot))
    assert all([s for _, s in sorted(rows)] == list(range(len(rows))) for rows in by.values())
    assert sharding.shard_table(odd).count() == 10 and sharding.shard_table(none).count() == 0
    named = spark.createDataFrame([(f"k{i % 50}", "t") for i in range(200)], "name string, text string")
    got = sharding.shard_table(named, shards=4, key="name").collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(r["shard"])
    assert len(got) == 200 and all(len(s) == 1 for s in by.values()) and len(set.union(*by.values())) == 4


# mixing


def test_mixture_agrees_with_sql_and_both_ways_agree(spark, agrees):
    agrees(mixing.op2_raked_mixture(spark, DATA), mixing.SQL)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    one, two = ({r.doc_id: (r.rate, r.sampled) for r in mixing.mix_sources(docs, driver_cells=n).collect()} for n in (50_000, 3))
    assert one.keys() == two.keys() and all(abs(one[k][0] - two[k][0]) < 1e-9 and one[k][1] == two[k][1] for k in one)


def test_raked_marginals():
    cells = [(s, lang, "t", 100.0 * (1 + i)) for i, (s, lang) in enumerate(itertools.product("abc", ["en", "fr"]))]
    x = mixing.rake_cells(cells, {"source": 0, "lang": {"en": 0.75, "fr": 0.25}, "topic": 1}, sweeps=200, budget=0.2)
    total = lambda d, v: sum(n for c, n in zip(cells, x, strict=True) if c[d] == v)
    assert np.allclose([total(0, s) / x.sum() for s in "abc"], 1 / 3, atol=1e-6)
    assert abs(total(1, "en") / x.sum() - 0.75) < 1e-6 and abs(x.sum() - 0.2 * 2100) < 1e-3
    assert (mixing.rake_cells(cells, {"source": 0, "lang": 0, "topic": 0}, budget=5.0) <= [c[3] for c in cells]).all()


def test_marginals(spark, frame, agrees):
    agrees(mixing.op2_marginals(spark, DATA), mixing.MARGINALS_SQL)
    docs = frame([(i, "a b c d", "en", "s" if i % 4 else "t") for i in range(40)]).withColumn("subject", F.when(F.col("doc_id") < 10, "x"))
    rows = mixing.measured(docs, given=F.col("subject"))
    targets = {"source": {"s": 0.5, "t": 0.5}, "lang": 1, "topic": 1}
    got = {(r.dimension, r.value): r for r in mixing.marginals(rows, mixing.fit_rates(rows, targets, 0.5), targets, 0.5).collect()}
    assert got["topic", "x"].held == 40 and got["topic", "(none)"].held == 120
    assert abs(got["source", "t"].wanted - 40) < 1e-9 and abs(got["source", "t"].reached - 40) < 0.2  # nearly all of t
    short = {(r.dimension, r.value): r for r in mixing.marginals(rows, mixing.fit_rates(rows, targets, 0.9), targets, 0.9).collect()}["source", "t"]
    assert short.reached <= short.held < short.wanted


def test_words_are_counted(spark):
    texts = [None, "", " ", "a", " a  b\n\tc ", "a b c", "a\u00a0b c", "\n\n", "x" * 9 + " y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_mixture_of_odd_rows(spark, frame, odd, none):
    rows = frame([(1, "a b", None, None), (2, None, "en", "s"), (2, None, "en", "s"), (None, "x", "en", None)])
    got = mixing.mix_sources(rows).collect()
    assert len(got) == 4 and {r.source for r in got} == {"(none)", "s"} and mixing.mix_sources(none).count() == 0
    assert mixing.mix_sources(odd).count() == 10
    assert mixing.mixing_stage(spark, odd, "").columns == odd.columns


# quality


def plain_base(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = collections.defaultdict(list)
    for k in range(len(words) - 4):
        at[tuple(words[k : k + 5])].append(k)
    covered = {k + d for ks in at.values() if len(ks) > 1 for k in ks for d in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_base_columns(frame, prose, odd, none):
    again = prose(12, 1)
    rows = [(i, prose(i, i)) for i in range(0, 60, 4)]
    rows += [(100, f"{again} {again}"), (101, f"{again}\n{again}\n \n\n{again}"), (102, "a b a b a b a b a b a b"), (103, "#a *b $c|d <e> & % é x \x0b y"), (104, prose(60, 9) + " " + prose(6, 2) + " x " + prose(6, 2))]
    got = {r.doc_id: r for r in quality.base_columns(frame(rows)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(t), i
    assert quality.base_columns(odd).count() == 10 and quality.base_columns(none).count() == 0
    for r in quality.base_columns(odd).where("doc_id IS NOT NULL").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(r.text)


def test_quality_agrees_with_sql(spark, agrees):
    agrees(quality.op5_quality_rules(spark, DATA), quality.SQL)


def test_quality_without_trusted_rows(spark, frame, odd, none):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.kept == (not r.base_failed) for r in quality.quality_rules(odd.drop("kept"), labels).collect())
    assert quality.quality_rules(none, labels).count() == 0
    plan = quality.quality_rules(odd, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_like_texts_score_nought_whatever_is_trusted(spark, frame, prose):
    docs = frame([(i, prose(200, i)) for i in range(8)])
    for trusted in ([1], [1, 2, 3], range(8)):
        labels = spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int")
        got = quality.quality_rules(docs, labels).collect()
        assert all(abs(r.score) < 150_000 and r.kept for r in got)


def test_words_count(spark, frame, prose):
    """Lists of other ordinary lower-case words score lower than texts of the trusted words."""
    other = lambda i: prose(200, i).translate(str.maketrans("aeiouthn", "xqzjkwvb"))
    docs = frame([(i, prose(200, i)) for i in range(40)] + [(100 + i, other(i)) for i in range(10)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    weights = {r.doc_id: r.score for r in quality.quality_rules(docs, labels).collect()}
    assert max(weights[100 + i] for i in range(10)) < min(weights[i] for i in range(40))


def test_quality_tells_junk(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality.quality_rules(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in got}
    assert share[1] > 0.97 and share[0] < 0.05


# media


@pytest.mark.parametrize("n", [1, 63, 64, 65, 200])
@pytest.mark.parametrize("every", [1, 7])
def test_container_round_trip(n, every):
    payload = np.random.default_rng(n).integers(0, 256, n * media.SAMPLE, dtype=np.uint8).tobytes()
    stored = media.write_container(payload, every)
    found = media.parse_container(stored)
    assert media.read_samples(stored, found) == payload
    assert (found["codec"], found["duration"], found["timescale"], len(found["sizes"])) == ("raw ", n, 25, n)
    keys = media.key_ranges(found)
    assert sum(x for _, x in keys) == media.SAMPLE * len(range(0, n, every))
    assert all(stored[a : a + 192] == payload[k * 192 :][:192] for (a, _), k in zip(keys, range(0, n, every), strict=False))


@pytest.mark.parametrize("n", [1, 63, 200])
def test_fragments_and_several_tracks(n):
    payload = np.random.default_rng(n).integers(0, 256, n * media.SAMPLE, dtype=np.uint8).tobytes()
    plain, stored = media.write_container(payload, 7), media.write_fragments(payload, 30, 7)
    one, two = media.parse_container(plain), media.parse_container(stored)
    assert media.read_samples(stored, two) == payload and two["duration"] == n
    assert one["keys"].tolist() == two["keys"].tolist() and len(media.key_ranges(one)) == len(media.key_ranges(two)) or n == 1
    moov = plain.index(b"moov") - 4
    size = struct.unpack_from(">I", plain, moov)[0]
    track = plain[plain.index(b"trak") - 4 : moov + size]
    twice = plain[:moov] + struct.pack(">I4s", size + len(track), b"moov") + plain[moov + 8 : moov + size] + track + plain[moov + size :]
    with pytest.raises(ValueError):
        media.parse_tracks(twice[: -len(track)])
    assert len(media.parse_tracks(twice)) == 2


def test_variants_and_broken_containers():
    stored = media.write_container(b"x" * 192 * 3)
    place = stored.index(b"mdat")
    open_end = stored[: place - 4] + struct.pack(">I", 0) + stored[place:]
    assert media.read_samples(open_end, media.parse_container(open_end)) == b"x" * 576
    extra = media.box(b"free", b"1234") + b""
    assert media.parse_container(stored + extra)["duration"] == 3
    for bad in (b"", b"abc", stored[:-1], stored[: place - 4], *(stored.replace(k, b"xxxx") for k in (b"stsz", b"trak", b"stco", b"stsc", b"stts", b"tkhd", b"mdhd", b"stsd"))):
        with pytest.raises(ValueError):
            media.parse_container(bad)


def test_altered_containers_give_rows_with_errors(spark):
    """Cut and altered files, counts of all sizes among them, give a row each and never more memory than the file asks for."""
    r = np.random.default_rng(7)
    files = []
    for source in (media.write_container(b"x" * 192 * 20, 3), media.write_fragments(b"x" * 192 * 20, 6, 3)):
        counts = [source.index(k) + d for k in (b"stsz", b"stsc", b"stts", b"mdhd", b"tkhd") for d in (8, 12, 16)]
        for k in range(300):
            raw = bytearray(source)
            if k < len(counts):
                raw[counts[k] : counts[k] + 4] = b"\xff\xff\xff\xff"
            for _ in range(r.integers(0, 4)):
                raw[r.integers(0, min(len(raw), 900))] = r.integers(0, 256)
            files.append((len(files), raw[: r.integers(0, len(raw))] if k % 5 == 0 else raw))
    got = media.probe_media(spark.createDataFrame(files, "doc_id long, media binary"), keep=("doc_id",)).collect()
    assert len(got) == len(files) and sum(g.error is not None for g in got) > 200
    assert all((g.error is None) == (g.payload_sha256 is not None) == (g.tracks is not None) for g in got)


def test_media_columns(spark, odd, none):
    got = media.probe_media(media.store_media(odd)).collect()
    assert len(got) == 10 and media.probe_media(media.store_media(none)).count() == 0
    texts = {(r.doc_id): r.text or "" for r in odd.collect()}
    for r in got:
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    broken = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "doc_id long, media binary")
    assert all(r.error and r.codec is None for r in media.probe_media(broken, keep=("doc_id",)).collect())


# pieces


def trie(entries):
    """A double-array trie and the texts it points to, built plainly: byte by byte, first free place."""
    texts, at = b"", {}
    for k, v in entries.items():
        at[k] = len(texts)
        texts += v + b"\0"
    units, used = {}, {0}
    nodes = [(b"", 0)]
    while nodes:
        prefix, place = nodes.pop(0)
        nexts = sorted({k[len(prefix)] for k in entries if k.startswith(prefix) and len(k) > len(prefix)})
        labels = nexts + ([0] if prefix in entries else [])
        base = next(b for b in range(1, 1 << 20) if all((place ^ b ^ c) not in used for c in labels) and (place ^ b) not in used or not labels)
        own = prefix[-1] if prefix else 0
        units[place] = base << 10 | (1 << 8 if prefix in entries else 0) | own
        used.add(place ^ base)
        for c in nexts:
            used.add(place ^ base ^ c)
            nodes.append((prefix + bytes([c]), place ^ base ^ c))
        if prefix in entries:
            units[place ^ base] = 0x80000000 | at[prefix]
    array = np.zeros(max(units) + 300, "<u4")
    for p, u in units.items():
        array[p] = u
    return struct.pack("<I", array.nbytes) + array.tobytes() + texts


def test_longest_prefix_normalisation():
    blob = trie({b"a": b"A", b"ab": b"xyz", b"\xef\xbc\xa1": b"A", b"\xe3\x80\x80": b" ", b"q": b""})
    spec = {pieces.CHARSMAP: blob, pieces.DUMMY_PREFIX: 1, pieces.EXTRA_SPACES: 0, pieces.ESCAPE: 0}
    out, source = pieces.Normalizer(spec)("abaqｂ　Ａ".encode())
    assert out == b" xyzA\xef\xbd\x82 A" and source.tolist() == [0, 0, 0, 0, 2, 4, 4, 4, 7, 10, 13]
    spec |= {pieces.EXTRA_SPACES: 1, pieces.ESCAPE: 1}
    out, source = pieces.Normalizer(spec)(b"  c  d ")
    assert out == "▁c▁d".encode() and source.tolist() == [2, 2, 2, 2, 3, 3, 3, 5, 6]
    assert pieces.Normalizer(spec)(b"   ")[0] == b""


def test_codec_equals_the_library(spark, odd, none):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = pieces.encode_documents(odd).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(got) == 10 and pieces.encode_documents(none).count() == 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == own.encode(texts[r.doc_id], add_bos=True, add_eos=True) and r.decoded == own.decode(ids)
        raw, bounds = texts[r.doc_id].encode(), np.frombuffer(r.bounds, "<u4").astype(int)
        assert len(bounds) == len(ids) + 1 and bounds[0] == 0 and bounds[-1] == len(raw) and (np.diff(bounds) >= 0).all()
        said = [own.id_to_piece(i) for i in ids]
        for p, a, b in zip(said, bounds[:-1], bounds[1:], strict=True):
            if not p.startswith("<") and "▁" not in texts[r.doc_id]:
                assert raw[a:b].decode().replace(" ", "▁") in (p, p[1:])


def with_map(raw, spec):
    """A model's bytes with another normaliser spec."""
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    held = lambda k, v: varint(k << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(k << 3) + varint(v)
    normal = b"".join(held(k, v) for k, v in spec.items())
    return b"".join(held(k, normal if k == pieces.NORMALIZER else v) for k, v in pieces.fields(raw))


@pytest.mark.parametrize(("dummy", "trim"), [(1, 0), (1, 1), (0, 1)])
def test_bounds_through_a_character_map(dummy, trim):
    """The public model under the library's own compiled map: same normal text as the library's, and bounds that fit the pieces."""
    import sentencepiece

    known = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    blob = next(dict(pieces.fields(v))[pieces.CHARSMAP] for k, v in pieces.fields(known) if k == pieces.NORMALIZER)
    with open(pieces.default_model(), "rb") as f:
        raw = f.read()
    own = pieces.Codec(with_map(raw, {pieces.CHARSMAP: blob, pieces.DUMMY_PREFIX: dummy, pieces.EXTRA_SPACES: trim, pieces.ESCAPE: 1}))
    for text in ("Ａｂｃ　ﬁne ①② ㌔", "plain words", "  two  spaces ", "", "é\u0301 ½ ﷺ x", "tab\tand\nline", "日本語 ﾊﾟ"):
        normal, source = own.normalizer(text.encode())
        assert normal.decode() == own.library.normalize(text), text
        (ids,) = own.encode([text])
        bounds = own.bounds(text, ids)
        assert len(source) == len(normal) + 1 and len(bounds) == len(ids) + 1 and (np.diff(bounds) >= 0).all() and bounds[-1] <= len(text.encode())


# language


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op6_language_filters(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98 and all(0 <= r.score <= 1 for r in got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)


def test_language_odd_rows(frame, odd, none):
    filters = langid.fit_filters(frame([(1, "the house and the tree " * 20, "en", "s"), (2, "der baum und das haus " * 20, "de", "s"), (3, "x", None, "s"), (4, None, "fr", "s")]))
    got = {r.doc_id: r for r in langid.identify(frame([(1, None), (2, "12 34!"), (3, "The TREE"), (4, "das haus"), (5, "ÿ")]), filters).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4)] == ["und", "und", "en", "de"] and got[1].score == 0
    assert got[5].lang_pred in filters.languages and langid.identify(odd, filters).count() == 10 and langid.identify(none, filters).count() == 0
    empty = langid.fit_filters(none)
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


def test_many_languages(frame, prose):
    """More than 64, told apart by words of their own, with shares tried on some rows."""
    words = lambda k: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}" for w in ("ora", "ibe", "umo") for _ in range(4))
    rows = [(100 * k + j, words(k), f"l{k:02d}", "s") for k in range(70) for j in range(3)]
    filters = langid.fit_filters(frame(rows), trial=F.col("doc_id") % 100 == 2)
    assert len(filters.languages) == 70 and filters.masks.shape[1] == 2
    got = langid.identify(frame([(k, words(k)) for k in range(70)]), filters).collect()
    assert all(r.lang_pred == f"l{r.doc_id:02d}" and r.score > 0.9 for r in got)


def test_false_positives_are_corrected():
    masks = np.ones((langid.PLACES, 1), np.uint8)  # language 0 holds everything by chance
    code, _ = langid.grams(pa.array(["some words here"]))
    for p in langid.places(code):
        masks[p, 0] |= 2
    filters = langid.Filters(["a", "b"], masks, np.array([1 - 1e-9, 1e-6]))
    shares = filters.shares(*langid.grams(pa.array(["some words here", "xyzzy plugh"])), 2)
    assert shares[0, 1] > 0.99 and shares[1, 1] < 0.1


# toxicity


def test_chain_learns_and_odd_rows(spark, frame, prose, odd, none):
    rows = [(i, prose(60, i) + (" idiot scum" if i % 4 == 0 else "")) for i in range(240)]
    labels = spark.createDataFrame([(i, i % 3 > 0, i % 4 == 0) for i, _ in rows], "doc_id long, quality boolean, toxic boolean")
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    chain = {k: F.expr(c) for k, c in toxicity.CATEGORIES.items()}
    model = toxicity.fit_toxicity(frame(rows), labels, chain)
    assert [len(m) - len(model["places"]) for m in model["models"]] == [1, 2, 3]  # base, and one more for each category before
    fresh = [(1000 + i, prose(80, 5000 + i) + (" Idiot, scum!" if i % 2 else "")) for i in range(40)]
    got = {r.doc_id: r.p_toxic > 0.5 for r in toxicity.score_toxicity(frame(fresh), model, list(chain)).collect()}
    assert sum(got[1000 + i] == bool(i % 2) for i in range(40)) >= 38
    assert toxicity.score_toxicity(odd, model, list(chain)).count() == 10 and toxicity.score_toxicity(none, model, list(chain)).count() == 0
    assert toxicity.fit_toxicity(frame(rows), labels.where("false"), chain) is None
    assert {r.p_toxic for r in toxicity.score_toxicity(odd, None, list(chain)).collect()} == {0.0}


# personal data


def test_permutations():
    for size in (1, 2, 10, 97, 1000, 4096):
        p = pii.Permutation(b"key", "t", size)
        image = [p.forward(v) for v in range(size)]
        assert sorted(image) == list(range(size)) and [p.backward(v) for v in image] == list(range(size))
    assert [pii.Permutation(b"a", "t", 1000).forward(v) for v in range(50)] != [pii.Permutation(b"b", "t", 1000).forward(v) for v in range(50)]


@pytest.mark.parametrize("kind", ["phone", "date", "email"])
def test_equal_values_stay_linked_in_all_forms(kind):
    """Whatever the form a value is written in, its pseudonym is one value, not the value itself, and comes back."""
    r = random.Random(4)
    one, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", back=True)
    for _ in range(300):
        if kind == "phone":
            a, b, c = (f"{r.randrange(10 ** n):0{n}d}" for n in (3, 3, 4))
            forms, plain = [f"+1{a}{b}{c}", f"+1 {a} {b} {c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}"], lambda s: re.sub(r"\D", "", s)[-10:]
        elif kind == "date":
            day = datetime.date.fromordinal(r.randrange(pii.FIRST_DAY, pii.LAST_DAY + 1))
            forms = [day.strftime(f) for f in ("%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%d/%m/%Y")]
            plain = lambda s: s.replace("/", "-") if s[4] in "-/" else "-".join(re.split("[./]", s)[::-1])
            if day.day > 12:
                us = day.strftime("%m/%d/%Y")
                fresh = one.replace(us)[0]
                assert f"{fresh[6:]}-{fresh[:2]}-{fresh[3:5]}" == one.replace(forms[0])[0] and back.replace(fresh)[0] == us
        else:
            name = "".join(r.choice("abcdefgh0123") for _ in range(r.choice([1, 1, 2, 6])))
            forms, plain = [f"{name}@mail.example.com", f"{name.upper()}@mail.example.com"], str.lower
            assert one.replace(forms[0])[0].split("@")[0] != name and "example" not in one.replace(forms[0])[0]
        fresh = [one.replace(f)[0] for f in forms]
        assert len({plain(x) for x in fresh}) == 1 and all(x != f and back.replace(x)[0] == f for x, f in zip(fresh, forms, strict=True))
    assert one.replace("john@a.com")[0].split("@")[0] != one.replace("john@b.com")[0].split("@")[0]


def test_permutations_against_a_plain_cipher():
    """Feistel rounds written out again: halves of a mixed radix, rounds by keyed BLAKE2b, walked on while outside."""
    def plain(key, tweak, size, value):
        high = next(h for h in range(1, size + 2) if h * h >= size)
        low = -(-size // high)
        secret = hashlib.blake2b(f"{tweak}|{size}".encode(), key=key, digest_size=32).digest()
        f = lambda n, x: int.from_bytes(hashlib.blake2b(bytes([n]) + x.to_bytes(24, "big"), key=secret, digest_size=24).digest(), "big")
        while True:
            left, right = value // low, value % low
            for n in range(10):
                if n % 2:
                    right = (right + f(n, left)) % low
                else:
                    left = (left + f(n, right)) % high
            value = left * low + right
            if value < size:
                return value

    for size in (2, 10, 100, 677, 5000):
        own = pii.Permutation(b"key", "t", size)
        assert all(own.forward(v) == plain(b"key", "t", size, v) for v in range(0, size, 1 + size // 50))


VALUES = [
    "+1 (017) 555-7713", "4111 1111 1111 1111", "4111111111111111", "3782-822463-10005", "10.0.0.1", "2024-02-29", "31.12.1999", "Bob.Smith9@mail.example.com",
    "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "password=b7db7aa4a5fcc78305", "078-05-1120", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "555-123-4567",
]


def test_pseudonyms_keep_format_and_come_back():
    one, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", back=True)
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s)))
    for value in VALUES:
        text = f"xx {value} yy"
        out, found = one.replace(text)
        assert len(found) == 1 and value not in out and back.replace(out)[0] == text, value
        if "token" not in value and "password" not in value and value != "10.0.0.1":
            assert shape(out) == shape(text)
        assert one.replace(out)[1]  # a pseudonym is valid in its format
    a, b = (one.replace(v)[0] for v in VALUES[1:3])
    assert a.replace(" ", "") == b  # equal values stay linked


@pytest.mark.parametrize("clean", ["4111111111111112", "999.1.1.1", "1.2.3.4.5", "CC BY-NC 4.0.", "2024-02-30", "000-12-1234", "DE88 3704 0044 0532 0130 00", "XX89 3704 0044 0532 0130 00", "a@b", "@", "20240229", "version 3.1.2", "1234567"])
def test_clean_text_stays(clean):
    assert pii.Pseudonyms(b"k").replace(f"x {clean} y") == (f"x {clean} y", [])


@pytest.mark.parametrize(("text", "kind", "value"), [
    ("in 2024 4111 1111 1111 1111", "card", "4111 1111 1111 1111"),
    ("BE68 5390 0754 7034 USD 50", "iban", "BE68 5390 0754 7034"),
    ("BE68539007547034 USD 50", "iban", "BE68539007547034"),
    ("ES91 2100 0418 4502 0005 1332 BIC", "iban", "ES91 2100 0418 4502 0005 1332"),
    ("DE88 3704 DE89 3704 0044 0532 0130 00", "iban", "DE89 3704 0044 0532 0130 00"),
    ("+49 30 1234 5678 2024 2025", "phone", "+49 30 1234 5678"),
])
def test_values_inside_a_failed_match_are_found(text, kind, value):
    one, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", back=True)
    a = text.index(value)
    out, found = one.replace(text)
    assert found == [(kind, a, a + len(value))] and value not in out
    assert out[:a] == text[:a] and out[a + len(value) :] == text[a + len(value) :]
    assert back.known(kind, out[a : a + len(value)]) == value


def test_long_failed_runs_are_scanned_in_linear_time():
    for run in ("1234 " * 40_000, "AB12 " * 40_000, "+1 " * 60_000, "1." * 100_000, "%" * 200_000, "+1 23 " * 30_000):
        start = time.perf_counter()
        pii.Pseudonyms(b"k").replace(run)
        assert time.perf_counter() - start < 20


def test_pii_odd_rows(spark, frame, odd, none):
    rows = odd.unionByName(frame([(50, "mail a.b@c.org and 10.1.2.3"), (51, "10.1.2.3!")]))
    got = {r.doc_id: r for r in pii.pseudonymise(rows, b"k").collect()}
    assert pii.pseudonymise(rows, b"k").columns == [*rows.columns, "n_private", "private"]
    assert got[1].text is None and got[2].text == "" and got[50].n_private == 2 and got[5].text == "x" * 300_000
    assert got[51].text[:-1] == got[50].text.split(" and ")[1]
    assert pii.pseudonymise(none, b"k").count() == 0 and pii.pii_stage(spark, rows, "").columns == rows.columns


# common


def test_words_and_folders(spark, odd):
    texts = [None, "", " a\tb\x0bc\x0cd\re\n", "é x y"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(plain_words(F.col("t"))).collect()
    assert [list(r[0]) for r in got] == [[], [], ["a", "b", "c", "d", "e"], ["é x", "y"]]
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_tasks_are_dealt_evenly(spark):
    from tidemark.llm.common import task_labels

    labels = task_labels(spark, 13)
    assert len(set(labels)) == 13
    df = spark.createDataFrame([(x,) for x in labels], "task long").repartition(13, "task").groupBy(F.spark_partition_id()).count()
    assert [r["count"] for r in df.collect()] == [1] * 13


def test_sections_end_where_parts_end():
    from tidemark.llm import common

    rows = [(0, common.ALONE, 9, b"a"), (0, common.ALONE, 9, b"b"), (0, 1, 0, b"x" * 5), (0, 1, 0, b"y" * common.SECTION_BYTES), (0, 1, 0, b"z"), (0, 4, 1, b"w")]
    got = [([k for k, _ in blobs], last) for blobs, last in common.sections(iter([common.dealt_rows(rows[:3]), common.dealt_rows(rows[3:])]))]
    assert got == [([9], True), ([9], True), ([0, 0], False), ([0], True), ([1], True)]


def test_a_shared_folder_is_asked_for(spark):
    """Without a folder, only a local master may use this machine's."""
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert shared_dir(Session).startswith("file://")


CLASHING = "_w _e _l _h _s _p _g _sum _keep kept score _lang _source _topic _tokens rate topic tokens _at _bit at bit bits row g tid m_g first private n_private n_words words total spaced sid check node component"


def test_stages_keep_clashing_columns(spark, prose):
    """Every stage that returns documents keeps the caller's columns and their values, whatever they are called."""
    import corpus_pipeline

    names = CLASHING.split()
    rows = [(i, f"{prose(60, i)} a{i}@b{i}.org", "en", "s", 5, *[f"{c}{i}" for c in names]) for i in range(30)]
    rows += [(100 + i, *rows[i][1:]) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns, name
        kept = got.collect()
        assert kept and all(r[c] == f"{c}{r.doc_id % 100}" for r in kept for c in names), name


def test_sieve_passes_what_is_wanted(spark):
    from tidemark.llm.common import sieve

    rows = spark.range(5000).withColumn("text", F.lit("x"))
    likely, rest = sieve(rows, "id", spark.range(0, 5000, 50))
    some, other = {r.id for r in likely.collect()}, {r.id for r in rest.collect()}
    assert set(range(0, 5000, 50)) <= some and some | other == set(range(5000)) and not some & other and len(some) < 120
    likely, rest = sieve(rows, "id", spark.range(0))
    assert likely.count() == 0 and rest.count() == 5000


def test_sieve_sends_few_rows_through_the_driver(spark, monkeypatch):
    """The whole bit table, wherever its keys fall, is at most SIEVE_BITS / SIEVE_ROW rows."""
    from tidemark.llm import common

    tables, plain = [], common.written
    monkeypatch.setattr(common, "written", lambda df, label: tables.append(plain(df, label)) or tables[-1])
    likely, rest = common.sieve(spark.range(100_000), "id", spark.range(0, 100_000, 4))
    assert tables[0].count() <= common.SIEVE_BITS // common.SIEVE_ROW
    assert likely.where("id % 4 = 0").count() == 25_000 and rest.where("id % 4 = 0").count() == 0 and likely.count() + rest.count() == 100_000
