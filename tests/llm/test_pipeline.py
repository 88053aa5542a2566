import math
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece

import __spark_entry__
import corpus_pipeline
from keyweave.llm import exact_dedup, quality_rules
from keyweave.llm.queries import MODEL_FILE, oracle_sql, queries

from .test_mixing import water_fill
from .test_near_dedup import brute

SF = "/root/testdata/sf0.001"


def plain_votes(text):
    """The rules' votes, from plain counts."""
    space = " \t\n\x0b\x0c\r"
    words = [w for w in re.split("[ \\t\\n\\x0b\\x0c\\r]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(space)]
    n, chars, symbols = len(words), sum(map(len, words)), set("#*$%&|<>")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    ended = sum(x.rstrip(space)[-1] in ".!?:;\"')]”。！？" for x in lines)
    caps = sum(len(w.encode()) > 1 and w.encode().isupper() for w in words)
    vote = lambda value, bad, good: 0 if value is None else -1 if bad(value) else 1 if good(value) else 0
    per = lambda x, of: x / of if of else None
    marked = per(sum(not w.encode().isalpha() and bool(symbols & set(w)) for w in words), n)
    share = per(sum(c in symbols for c in text), chars)
    both = None if marked is None else (marked, share)
    votes = (
        vote(both, lambda v: v[0] > 0.1 or v[1] > 0.05, lambda v: v[0] < 0.05 and v[1] < 0.03),
        vote(per(len(covered), n), lambda v: v > 0.35, lambda v: v < 0.2),
        vote(per(chars, n), lambda v: v < 2.5 or v > 14, lambda v: 3 < v < 10),
        vote(per(caps, n), lambda v: v > 0.3, lambda v: v < 0.15),
        vote(per(text.count("!"), n), lambda v: v > 0.15, lambda v: v < 0.05),
        vote(per(len(lines) - len(set(lines)), len(lines)), lambda v: v > 0.5, lambda v: v < 0.2 and len(lines) >= 3),
        vote(per(ended, len(lines)), lambda v: v < 0.2 and len(lines) >= 3, lambda v: v > 0.6),
    )
    return votes, n < 50 or 100 * len(covered) > 50 * n


def good_documents(rows):
    """Ids that pass the base rules and are more probably good than bad; the estimate itself has a test of its own."""
    votes = {i: plain_votes(t or "") for i, t in rows}
    patterns, inverse, counted = np.unique(np.array([v for v, _ in votes.values()]), axis=0, return_inverse=True, return_counts=True)
    good = quality_rules.estimate(patterns, counted.astype(float))["posterior"][inverse.ravel()] >= 0.5
    return {i for (i, (_, failed)), g in zip(votes.items(), good) if g and not failed}


def test_stages_against_brute_force(spark):
    """Every stage over all that the one before has kept, against plain Python over whole texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF).cache()
        rows, got = [(r["doc_id"], r["text"]) for r in before.collect()], after.collect()
        assert got
        if k < 4:
            assert after.columns == columns, name
        if k == 0:
            assert {r["doc_id"] for r in got} == good_documents(rows) and len(got) < len(rows)
        if k == 1:
            kept = {}
            for i, t in rows:
                kept[t] = max(i, kept.get(t, -1))
            assert sorted(r["doc_id"] for r in got) == sorted(kept.values())
        if k == 2:
            label, pairs = brute(rows)
            assert sorted(r["doc_id"] for r in got) == sorted(set(label.values())) and pairs
        if k == 3:
            words = {r["doc_id"]: len((r["text"] or "").split()) for r in before.collect()}
            of, sizes = {r["doc_id"]: r["source"] for r in before.collect()}, Counter()
            for i, n in words.items():
                sizes[of[i]] += n
            want, times, taken = water_fill(sizes, (3, 1, 2), 1.5, 2), Counter(r["doc_id"] for r in got), Counter()
            for i, n in words.items():
                taken[of[i]] += n * times[i]
                assert times[i] in (whole := math.floor(want[of[i]] / sizes[of[i]] + 1e-9), whole + 1) and times[i] <= 2
            for s, t in want.items():
                # going over by the smallest document left out was nearer than staying short, or the other way round
                whole, own = math.floor(t / sizes[s] + 1e-9), [(n, times[i]) for i, n in words.items() if of[i] == s]
                if taken[s] > t + 1:
                    assert max(n for n, m in own if m > whole) >= 2 * (taken[s] - t) - 1, s
                else:
                    assert t - taken[s] <= max(0.005 * t, min((n for n, m in own if m == whole), default=0) / 2) + 1, s
        if k == 4:
            texts = dict(rows)
            assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
            assert [r["doc_id"] for r in got if r["ids"] != library.encode(texts[r["doc_id"]] or "") or r["n_tokens"] != len(r["ids"])] == []
        before = after


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and "ids" in got.columns


def test_registered():
    every = __spark_entry__.queries()
    assert "pipeline" in every and set(queries()) <= set(every) and set(oracle_sql()) <= set(queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", ["op3_simhash_near_dedup", "op10_suffix_array_dedup", "op9_sentencepiece", "op4_license_scans"])
def test_queries_over_whole_tables(spark, name):
    assert queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_exact_dedup_keeps_the_largest(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    groups = exact_dedup.groups(docs, "largest")
    assert groups.where("kept").count() == docs.select("text").distinct().count()
