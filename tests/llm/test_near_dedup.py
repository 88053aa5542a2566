import random

import pytest

import corpus_pipeline
from keyweave.llm import near_dedup

from .conftest import changed, prose


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def plain(text, n=5):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows):
    """The smallest id of each id's component over the pairs at 0.8 or more."""
    sets = {i: plain(t or "") for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    pairs = 0
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if jaccard(sets[a], sets[b]) >= 0.8:
                pairs += 1
                x, y = sorted((label[a], label[b]))
                label = {i: x if c == y else c for i, c in label.items()}
    return label, pairs


def near_pairs(n=80, words=300):
    """Pairs at and around the threshold, and a chain."""
    rng = random.Random(3)
    texts = []
    for i in range(n):
        text = prose(rng, words)
        texts += [text, changed(rng, text, (0.01, 0.02, 0.022, 0.03)[i % 4])]
    for _ in range(8):
        texts.append(changed(rng, texts[-1], 0.01))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block_rows", [512, 3])
def test_against_brute_force(spark, block_rows):
    rows = near_pairs()
    want, pairs = brute(rows)
    assert pairs > 50
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.classes(df, block_rows=block_rows).collect()} == want


def test_the_stage_reaches_every_pair_at_the_threshold(spark):
    rows = near_pairs(40)
    want, _ = brute(rows)
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert {r["doc_id"] for r in got.collect()} == set(want.values())


def test_odd_texts(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.classes(docs).collect()} == brute(rows)[0]
    assert near_dedup.deduplicate(empty).columns == empty.columns and near_dedup.deduplicate(empty).count() == 0


@pytest.mark.parametrize("point_rows", [1 << 14, 20])
def test_candidates_are_the_pairs_within_the_radius(spark, point_rows):
    """By fingerprints and sizes, against all pairs; over one block or many, and over neighbouring sizes."""
    rng = random.Random(5)
    points = []
    for i in range(60):
        fp = [rng.getrandbits(64) for _ in range(near_dedup.WORDS)]
        for k, flips in enumerate((0, 60, near_dedup.RADIUS, near_dedup.RADIUS + 1)):
            bits = rng.sample(range(64 * near_dedup.WORDS), flips)
            points.append((4 * i + k, rng.choice((80, 100, 125)) if k else 100, [w ^ sum(1 << b % 64 for b in bits if b // 64 == at) for at, w in enumerate(fp)]))
    want = {}
    for i, n, f in points:
        for j, m, g in points:
            if i < j and 5 * min(n, m) >= 4 * max(n, m) and sum((x ^ y).bit_count() for x, y in zip(f, g)) <= near_dedup.RADIUS:
                want.setdefault(i, set()).add(j)
    label = list(range(len(points)))
    for i in sorted(want):
        for j in want[i]:
            x, y = sorted((label[i], label[j]))
            label = [x if c == y else c for c in label]
    signed = [(i, n, *(w - (1 << 64) if w >> 63 else w for w in f)) for i, n, f in points]
    df = spark.createDataFrame(signed, "key bigint, n bigint, " + ", ".join(f"f{w} bigint" for w in range(near_dedup.WORDS)))
    edges = near_dedup.candidates(df, point_rows=point_rows)
    got = {r["node"]: r["component"] for r in near_dedup.components(edges).collect()}
    assert [got.get(i, i) for i in range(len(points))] == label and len(set(label)) > 60


def test_fingerprints_of_similar_sets_lie_within_the_radius():
    """Sets of every size at a similarity of 0.8, the smallest of four and five shingles."""
    import numpy as np

    rng = np.random.default_rng(6)
    far = 0
    for n in (4, 8, 12, 16, 40, 400):
        for a, b in ((n // 4, 0), (n // 8, n // 8)):
            for _ in range(40):
                common, one, two = np.split(rng.integers(0, 1 << 63, n + a + b, np.uint64), [n, n + a])
                x, y = near_dedup.fingerprint(np.append(common, one)), near_dedup.fingerprint(np.append(common, two))
                hamming = np.bitwise_count(x ^ y).sum()
                assert np.bitwise_count(near_dedup.unary(x) ^ near_dedup.unary(y)).sum() <= hamming <= near_dedup.RADIUS
                other = near_dedup.fingerprint(rng.integers(0, 1 << 63, n, np.uint64))
                far += np.bitwise_count(x ^ other).sum() > near_dedup.RADIUS
    assert far == 12 * 40
