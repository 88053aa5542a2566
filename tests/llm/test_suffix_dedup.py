import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyweave.llm import suffix_dedup as sd


def brute(rows, length=sd.LENGTH):
    first, out = {}, []
    texts = [(sd.NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            first[w] = min(i, first.get(w, i))
    for i, b in texts:
        covered = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < i:
                covered[j : j + length] = True
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        rest = bytes(np.frombuffer(b, np.uint8)[~covered]) if b else b""
        out.append((None if i == sd.NO_ID else i, len(b), int(covered.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("settings_", [{}, {"block_bytes": 20_000}, {"block_bytes": 15_000, "hot_blocks": 2}])
def test_against_brute_force(docs, settings_):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sd.remove_repeats(docs, with_text=True, **settings_).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    for r in got:
        assert r["kept"] is None or hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]


def test_odd_rows(spark, empty):
    long = "".join(random.Random(1).choices("abcdef ", k=200))
    rows = [(1, long), (1, long), (None, long), (None, long[10:120]), (2, long[:49]), (3, long[:50]), (4, "x" * 300), (5, "x" * 60), (6, None), (7, ""), (8, "é" * 40 + long[50:130])]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumnRenamed("id", "doc_id")
    got = sd.remove_repeats(df, block_bytes=300).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    assert sd.remove_repeats(empty).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=sd.LENGTH, max_size=sd.LENGTH + 6).map(lambda b: bytes(x % 2 for x in b[:3]) + b"s" * (len(b) - 3)), min_size=1, max_size=30), st.integers(1, 20))
def test_index_family(strings, batch):
    ids = np.sort(np.array([i // 2 for i in range(len(strings))], np.int64))
    got = sd.smaller_windows(strings, ids, batch_windows=batch)
    windows = [(i, s[j : j + sd.LENGTH]) for i, s in zip(ids, strings) for j in range(len(s) - sd.LENGTH + 1)]
    least = {}
    for i, w in windows:
        least[w] = min(i, least.get(w, i))
    assert got.tolist() == [bool(least[w] < i) for i, w in windows]


def test_levels_are_logarithmic():
    family = sd.SuffixArrayFamily()
    rng = random.Random(3)
    for i in range(37):
        family.add([bytes(rng.choices(b"abc", k=80))], np.array([i]))
    assert [level[0] for level in family.levels] == [5, 2, 0]


def test_levels_are_suffix_arrays():
    """Each level holds the distinct windows of its batches in the order of their bytes."""
    rng = random.Random(5)
    batches = [[bytes(rng.choices(b"ab\x00\xff", k=rng.randrange(sd.LENGTH, 120))) for _ in range(4)] + [b"\x00" * 70] for _ in range(6)]
    family = sd.SuffixArrayFamily()
    for i, strings in enumerate(batches):
        family.add(strings, np.full(len(strings), i))
    (top, low), held = family.levels, lambda xs: sorted({s[j : j + sd.LENGTH] for strings in xs for s in strings for j in range(len(s) - sd.LENGTH + 1)})
    for level, own in ((top, batches[:4]), (low, batches[4:])):
        assert [bytes(w).ljust(sd.LENGTH, b"\x00") for w in level[1]] == held(own)


def test_shared_minimizers():
    rng = np.random.default_rng(1)
    each = [np.unique(rng.integers(0, 60, 25).astype(np.uint32)) for _ in range(7)]
    import pyarrow as pa

    table = pa.table({"bucket": pa.array([3] * 7, pa.int32()), "block": pa.array(range(10, 17), pa.int32()), "keys": [k.tobytes() for k in each]})
    count = {}
    for k in each:
        for x in k.tolist():
            count[x] = count.get(x, 0) + 1
    got = {r["block"]: (np.frombuffer(r["shared"], np.uint32).tolist(), np.frombuffer(r["hot"], np.uint32).tolist()) for r in sd._shared_minimizers(table, 4).to_pylist()}
    assert got == {10 + i: ([x for x in k.tolist() if count[x] > 1], [x for x in k.tolist() if count[x] >= 4]) for i, k in enumerate(each)}
