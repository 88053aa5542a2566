import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyweave.llm.exact_dedup import PatriciaTrie, deduplicate, groups


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=8), st.integers(0, 50)), max_size=60), st.sampled_from([min, max]), st.integers(1, 4000))
def test_trie_against_dict(rows, prefer, budget):
    trie, want = PatriciaTrie(prefer, budget), {}
    for string, id_ in rows:
        trie.insert(string, id_, 1)
        owner, copies = want.get(string, (id_, 0))
        want[string] = (prefer(owner, id_), copies + 1)
    assert sorted((s, *x) for s, x in trie.items()) == sorted((s, *x) for s, x in want.items())


def test_trie_spills_long_shared_prefixes():
    rng = random.Random(2)
    rows = [(b"p" * 5000 + bytes(rng.choices(b"ab", k=k % 40)), k) for k in range(500)]
    trie, want = PatriciaTrie(min, 20_000), {}
    for string, id_ in rows:
        trie.insert(string, id_, 1)
        want.setdefault(string, id_)
    assert trie.spilled and {s: x[0] for s, x in trie.items()} == want


@pytest.mark.parametrize("keep, choose, trie_bytes", [("largest", max, 1 << 20), ("smallest", min, 3000)])
def test_groups_against_brute_force(spark, docs, keep, choose, trie_bytes):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    by = {}
    for i, t in rows:
        by.setdefault(t, []).append(i)
    want = sorted((i, choose(by[t]), len(by[t]), i == choose(by[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    got = groups(docs, keep, trie_bytes=trie_bytes)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sorted(r["doc_id"] for r in deduplicate(docs, keep).collect()) == sorted(w[0] for w in want if w[3])


def test_odd_rows(spark, empty):
    rows = [(1, "a", "s"), (1, "a", "s"), (None, "a", "t"), (None, None, "u"), (3, "", "u")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, owner string").withColumn("digest", F.lit(1))
    got = sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in groups(df, "largest").collect())
    assert got == [(0, 1, 3, False), (0, 3, 2, False), (1, 1, 3, True), (1, 1, 3, True), (3, 3, 2, True)]
    assert [tuple(r) for r in deduplicate(df, "largest").orderBy("doc_id").collect()] == [(1, "a", "s", 1), (3, "", "u", 1)]
    assert [r["keep_id"] for r in groups(df, "smallest").where("text_sha256 = sha2('a', 256)").collect()] == [None] * 3
    assert groups(empty).count() == 0 and deduplicate(empty).columns == empty.columns


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id bigint, text string").withColumns({n: F.lit(n) for n in ("_size", "_sha", "_SHA_OF", "_keep", "digest")})
    got = deduplicate(df, "largest")
    assert got.columns == df.columns and sorted((r["doc_id"], r["_size"], r["_keep"]) for r in got.collect()) == [(2, "_size", "_keep"), (3, "_size", "_keep")]
