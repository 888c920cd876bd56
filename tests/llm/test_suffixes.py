import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffixes


def brute(rows, length=200):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, raw in raws:
        for s in range(len(raw) - length + 1):
            w = hash(raw[s : s + length])
            seen[w] = seen.get(w, 0) + 1
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if seen[hash(raw[s : s + length])] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df):
    from pyspark.sql import functions as F

    found = suffixes.remove_repeats(df).select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h"))
    return sorted((tuple(r) for r in found.collect()), key=str)


def corpus(prose):
    r = random.Random(3)
    passages = [prose(60, 1000 + k) for k in range(4)]
    rows = []
    for i in range(120):
        text = prose(r.randrange(5, 150), i)
        if i % 3 == 0:
            words = text.split()
            words.insert(r.randrange(len(words)), passages[r.randrange(4)][r.randrange(30) :])
            text = " ".join(words)
        if i % 10 == 0:
            text = text + "\n" + text[: r.randrange(50, 400)] + text
        rows.append((i, text))
    rows += [(200 + k, rows[k][1]) for k in range(0, 60, 7)] + [(300 + k, rows[k][1][3:-9] + " é") for k in range(0, 60, 11)]
    return rows + [(400, "ab" * 500), (401, "abc" * 300), (402, "z" * 199), (403, "z" * 200), (404, "z" * 201), (405, None), (406, "")]


@pytest.mark.parametrize("way", ["plain", "small", "hot", "locally hot", "two levels"])
def test_same_bytes_as_brute_force(frame, prose, monkeypatch, way):
    """Once as it runs; with small batches; with nearly all anchors hot in their part, or in their batch; with parts cut by tasks."""
    from tidemark.llm import common

    if way == "small":
        monkeypatch.setattr(suffixes, "BATCH_SUFFIXES", 50)
        monkeypatch.setattr(suffixes, "STEP", 3)
        monkeypatch.setattr(common, "SECTION_BYTES", 1000)
    elif way == "hot":
        monkeypatch.setattr(suffixes, "BATCH_SUFFIXES", 200)
        monkeypatch.setattr(suffixes, "HOT", 2)
        monkeypatch.setattr(common, "SECTION_BYTES", 5000)
    elif way == "locally hot":
        monkeypatch.setattr(suffixes, "BATCH_SUFFIXES", 300)
        monkeypatch.setattr(suffixes, "LOCAL_HOT", 1)
    elif way == "two levels":
        monkeypatch.setattr(common, "DIRECT_PARTS", 2)
        monkeypatch.setattr(common, "PART_BYTES", 20_000)
        monkeypatch.setattr(common, "MAX_TASKS", 3)
    rows = corpus(prose)
    assert run(frame(rows)) == brute(rows)


def test_odd_rows(odd, none):
    got = {(r[0], r[1]): r[2:4] for r in run(odd)}
    assert len(run(odd)) == 10 and run(none) == []
    assert got[(5, 300_000)] == (300_000, 1) and got[(1, 0)] == (0, 0) and got[(4, 3)] == (0, 0)


def test_equal_windows_have_equal_anchors(prose):
    raws = [prose(200, k).encode() for k in range(3)]
    raws.append(b"12345" + raws[0][7:])
    data, bounds = np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])
    found = suffixes.suffixes(data, bounds, np.column_stack([np.arange(4), np.zeros(4, int)]))
    anchors = {}
    for e in found:
        raw, a = raws[e["r0"]], int(e["start"]) + int(e["lead"])
        assert raw[a : a + suffixes.ANCHOR] == e["anchor"]
        for k in range(int(e["more"]) + 1):
            s = int(e["start"]) + k
            anchors.setdefault(raw[s : s + 200], set()).add((bytes(e["anchor"]), int(e["lead"]) - k))
    assert sum(map(len, raws)) - 4 * 199 == sum(int(e["more"]) + 1 for e in found)
    assert all(len(a) == 1 for a in anchors.values())


def test_contexts_are_compared_byte_by_byte():
    """Random contexts around one anchor, also with zero bytes, against all windows cut out."""
    r = random.Random(6)
    anchor = bytes(r.randrange(256) for _ in range(40))
    contexts = []
    for k in range(60):
        lead = r.randrange(161)
        more = r.randrange(min(lead, 160) + 1)
        left, right = bytes(r.choice([0, 0, 97]) for _ in range(3)), bytes(r.choice([0, 0, 97]) for _ in range(3))
        raw = (left * 60)[-lead:] if lead else b""
        raw += anchor + (right * 60)[: 200 + more - lead - 40]
        contexts.append((k, lead, more, raw))
    head = np.array([(5, k, 0, 1000 * k, len(raw), lead, k % 3 > 0) for k, lead, _, raw in contexts], np.int64)
    data = np.frombuffer(b"".join(c[3] for c in contexts), np.uint8)
    got = suffixes.compare(head, data, np.cumsum(head[:, 4]) - head[:, 4])
    seen = {}
    for k, lead, more, raw in contexts:
        for s in range(more + 1):
            seen.setdefault((raw[s : s + 200], lead - s), []).append((k, s))
    expected = set()
    for places in seen.values():
        if len(places) > 1:
            expected |= {(k, 1000 * k + s + d) for k, s in places if k % 3 for d in range(200)}
    assert {(int(r0), p) for r0, _, a, b in got for p in range(a, b)} == expected and expected


def test_the_index_meets_later_batches(spark, frame, prose, tmp_path, monkeypatch):
    """Five batches, one after the other: together the same spans as brute force over all, and levels that shrink geometrically."""
    monkeypatch.setattr(suffixes, "HOT", 6)
    monkeypatch.setattr(suffixes, "LOCAL_HOT", 4)
    rows = corpus(prose)
    index = suffixes.SuffixIndex(spark, f"file://{tmp_path}", expected_bytes=1e5)
    gone: dict = {}
    for n in range(5):
        for r in index.add(frame(rows[n::5])).collect():
            gone.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
        sizes = index.version()["sizes"]
        assert all(a >= 2 * b for a, b in zip(sizes[:-1], sizes[1:], strict=True))
    assert {i: len(x) for i, x in gone.items()} == {i: n for i, _, n, _, _ in brute(rows) if n}
    assert index.version()["version"] == 5 and len(index.version()["levels"]) < 5


def test_query_agrees_with_sql(spark, agrees):
    agrees(suffixes.op1_suffix_family(spark, "/root/testdata/sf0.001"), suffixes.SQL)
