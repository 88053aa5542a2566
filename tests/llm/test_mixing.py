import random

import pytest
from pyspark.sql import functions as F

from keyweave.llm import mixing


def water_fill(sizes, weights, share, epochs):
    """By rounds: clamp, reshare, until nothing is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: epochs * sizes[s] for s in names}
    target, open_, left = {}, list(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > cap[s]]
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = cap[s]
        left -= sum(cap[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return target


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(6)
    names = ["hot"] * 40 + ["a", "B", "z", "é", "𝔘", "", None, "tiny"]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 300])) if i % 50 else None, rng.choice(names)) for i in range(3000)] + [(9999, "one two", "single"), (10_000, None, "nothing")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"target": F.lit("x"), "bucket": F.lit(1), "size": F.lit(2), "u": F.lit(3)}).repartition(6)


@pytest.mark.parametrize("share, epochs, bucket_rows", [(1.5, 2, 4096), (0.4, 1, 50), (3.0, 2, 50), (1.0, 4, 7)])
def test_targets_and_taken(sources, share, epochs, bucket_rows):
    rows = mixing.plan(sources, weights=(3, 1, 2), budget_share=share, max_epochs=epochs, bucket_rows=bucket_rows).collect()
    assert len(rows) == sources.count()
    sizes = {}
    for r in rows:
        assert r["_mx_size"] == len((r["text"] or "").split())
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["_mx_size"]
    want = water_fill(sizes, (3, 1, 2), share, epochs)
    taken = {}
    for r in rows:
        assert r["_mx_target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9) and r["_mx_source_size"] == sizes[r["source"]]
        assert 0 <= r["_mx_times"] <= epochs
        taken[r["source"]] = taken.get(r["source"], 0) + r["_mx_size"] * r["_mx_times"]
        assert r["source"] != "nothing" or r["_mx_times"] == 0
    for s, t in want.items():
        # half the smallest document left out, which matters where a bucket holds few
        assert abs(taken[s] - t) <= max(2, 0.005 * t + 1, 150 if bucket_rows < 50 else 0), s


def test_reruns_agree_and_the_seed_matters(sources):
    pick = lambda **k: {r["doc_id"]: r["_mx_times"] for r in mixing.plan(k.pop("df", sources), **k).collect()}
    first = pick()
    assert first == pick(df=sources.repartition(2)) and first != pick(seed=1)


def test_mix_repeats_rows(sources):
    times = {r["doc_id"]: r["_mx_times"] for r in mixing.plan(sources).collect()}
    mixed = mixing.mix(sources)
    assert mixed.columns == sources.columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: t for i, t in times.items() if t}


def test_odd_rows(spark, empty):
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).columns == empty.columns
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "a b", "s"), (None, None, None)], "doc_id bigint, text string, source string")
    rows = mixing.plan(df).collect()
    assert len(rows) == 4 and len({r["_mx_times"] for r in rows if r["doc_id"] == 1}) == 1


def test_nearer_end_of_the_quota(spark):
    """Few coarse documents: the quota is met from the nearer side."""
    rows = [(i, "w " * n, "s") for i, n in enumerate([1000, 900, 800, 700])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for seed in range(8):
        taken = sum(r["_mx_size"] * r["_mx_times"] for r in mixing.plan(df, budget_share=0.5, seed=seed).collect())
        assert abs(taken - 1700) <= 350


def test_empty_documents_and_caps(spark):
    """Sources without words aren't taken; where whole epochs reach the cap, nothing goes beyond it."""
    rows = [(1, "", "none"), (2, None, "none"), (3, "", "some"), (4, "a b", "some"), (5, "", "full")] + [(10 + i, "", "full") for i in range(5)] + [(20, "x", "full")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    planned = mixing.plan(df, budget_share=5, max_epochs=2, bucket_rows=1).collect()
    assert max(r["_mx_times"] for r in planned) == 2 and {r["_mx_times"] for r in planned if r["source"] == "none"} == {0}
    assert mixing.mix(df).where("source = 'none'").count() == 0


def test_many_sources(spark):
    df = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 700).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 13).cast("int")).alias("text"))
    sizes = {}
    for r in df.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    want = water_fill(sizes, (3, 1, 2), 1.5, 2)
    for r in mixing.plan(df).collect():
        assert r["_mx_target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9)


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (2, "c", "s")], "doc_id bigint, text string, source string")
    more = df.withColumns({n: F.lit("own") for n in ("_mx_size", "_mx_u", "_mx_source", "at", "_copy_", "_MX_times")})
    planned = mixing.plan(more)
    assert planned.columns == [*more.columns, *[mixing.prefix_of(more.columns) + c for c in mixing.ADDED]] and len(set(planned.columns)) == len(planned.columns)
    assert mixing.mix(more).columns == more.columns and {r["_mx_size"] for r in mixing.mix(more).collect()} == {"own"}
