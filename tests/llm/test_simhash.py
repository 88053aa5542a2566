import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keyweave.llm import simhash
from keyweave.llm.components import components


def plain_fingerprint(text, n=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=4):
    label = {i: i for i in fps}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in ids}


def test_fingerprints_and_classes_against_brute_force(docs):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = {i: plain_fingerprint(t) for i, t in texts.items()}
    got = {r["doc_id"]: r for r in simhash.classes(docs).collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == want
    found = brute_components(want)
    assert {i: r["component_id"] for i, r in got.items()} == found
    assert len(set(found.values())) < len(found) - 10
    assert {r["doc_id"] for r in simhash.deduplicate(docs).collect()} == {i for i, c in found.items() if i == c}


@pytest.mark.parametrize("cell_rows, agree", [(4096, 2), (7, 2), (4096, 3), (50, 5)])
def test_links_of_a_large_cluster_stay_linear(spark, cell_rows, agree):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(1 << 62))
    fps = {centre}
    while len(fps) < 400:
        fps.add(centre ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    fps |= {int(x) for x in rng.integers(0, 2**63, 200)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    points = spark.createDataFrame([(f, f) for f in signed], "rep bigint, fp bigint")
    edges = simhash.links(points, cell_rows=cell_rows, agree=agree)
    assert edges.count() < len(simhash.cell_masks(agree=agree)) * 600
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    want = brute_components({f: f % 2**64 for f in signed})
    linked = {i for i, c in want.items() if sum(x == c for x in want.values()) > 1}
    by_want, by_got = {}, {}
    for i in linked:
        by_want.setdefault(want[i], set()).add(i)
        by_got.setdefault(got[i], set()).add(i)
    assert set(got) == linked and sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


@pytest.mark.parametrize("agree", [2, 3, 4])
def test_selectivity_is_as_computed(agree):
    """Of unrelated fingerprints, the share of pairs that share a cell; and pairs within the radius always do."""
    rng = np.random.default_rng(agree)
    fps = rng.integers(0, 1 << 63, 6_000, np.uint64) * np.uint64(2) + rng.integers(0, 2, 6_000).astype(np.uint64)
    unary = lambda x: ((x & (x >> np.uint64(1)) & np.uint64(simhash._LOW)) << np.uint64(1)) | ((x | (x >> np.uint64(1))) & np.uint64(simhash._LOW))
    code, met = unary(fps), 0
    for mask in simhash.cell_masks(agree=agree):
        _, counts = np.unique(code & np.uint64(mask % 2**64), return_counts=True)
        met += int((counts * (counts - 1) // 2).sum())
    assert met / (6_000 * 5_999 / 2) == pytest.approx(simhash.selectivity(simhash.RADIUS, agree), rel=0.35)
    near = fps.copy()
    for _ in range(simhash.RADIUS):
        near ^= np.uint64(1) << rng.integers(0, 64, 6_000).astype(np.uint64)
    shared = np.zeros(6_000, bool)
    for mask in simhash.cell_masks(agree=agree):
        shared |= (unary(near) & np.uint64(mask % 2**64)) == (code & np.uint64(mask % 2**64))
    assert shared.all()


def test_sharper_cells_for_more_points():
    chosen = [simhash.agreeing_groups(10**n) for n in range(3, 13)]
    assert chosen == sorted(chosen) and chosen[0] == 2 and chosen[-1] > 4
    compared = [10**n * simhash.selectivity(simhash.RADIUS, k) for n, k in zip(range(3, 13), chosen)]
    assert compared[-1] < 10**12 / 10**5  # partners of a point, of 10^12


def test_popcount_distance_is_a_lower_bound(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-(2**63), 2**63 - 1, (200, 2))]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = df.select("a", "b", F.bit_count(simhash.unary(F.col("a")).bitwiseXOR(simhash.unary(F.col("b")))).alias("d")).collect()
    for r in got:
        a, b = r["a"] % 2**64, r["b"] % 2**64
        pop = [abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2)]
        assert r["d"] == sum(pop) <= (a ^ b).bit_count()


def test_components_against_union_find(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 80)]
    label = {}

    def root(i):
        label.setdefault(i, i)
        while label[i] != i:
            i = label[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            label[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: root(i) for i in label}


def test_odd_rows(spark, empty):
    rows = [(None, "a b c d e f", 1), (5, "A b  c d e f", 2), (5, "a b c d e f", 3), (9, None, 4), (None, "", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = sorted((r["doc_id"] or 0, r["fingerprint"] == "0" * 16, r["component_id"]) for r in simhash.classes(df).collect())
    assert got == [(0, False, 5), (0, True, 9), (5, False, 5), (5, False, 5), (9, True, 9)]
    assert [r["fp"] for r in simhash.deduplicate(df).orderBy("fp").collect()] == [2, 3, 4]
    assert simhash.classes(empty).count() == 0 and simhash.deduplicate(empty).columns == empty.columns
