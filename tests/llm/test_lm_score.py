import collections
import math
import zlib

import pytest
from pyspark.sql import functions as F

from keyweave.llm import lm_score
from keyweave.llm.queries import MODEL_FILE
from keyweave.llm.vocabulary import Marginals, Vocabulary, best_paths, marginals


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(MODEL_FILE)


def spellings(word, vocabulary):
    """All segmentations, as lists of ids."""
    if not word:
        return [[]]
    out = []
    for n in range(1, len(word) + 1):
        heads = []
        if word[:n] in vocabulary.pieces:
            heads.append([vocabulary.pieces[word[:n]]])
        elif n == 1:
            heads.append([vocabulary.byte_ids[b] for b in word[0].encode()])
        for head in heads:
            out += [head + rest for rest in spellings(word[n:], vocabulary)]
    return out


WORDS = [" the", " there", " thereou", " ab", " aß漢", "", " ", "x", " zzzzqq"]


def test_marginals_sum_over_all_segmentations(vocabulary):
    log_p = [math.log((i % 97 + 1) / 1e5) for i in range(len(vocabulary.scores))]
    for word, got in marginals(sorted(WORDS), vocabulary, log_p):
        want = math.log(sum(math.exp(sum(log_p[i] for i in ids)) for ids in spellings(word, vocabulary)))
        assert got == pytest.approx(want, rel=1e-9)


def test_expected_counts_over_all_segmentations(vocabulary, monkeypatch):
    log_p = [math.log((i % 97 + 1) / 1e5) for i in range(len(vocabulary.scores))]
    want = collections.Counter()
    for k, word in enumerate(sorted(WORDS)):
        paths = [(ids, math.exp(sum(log_p[i] for i in ids))) for ids in spellings(word, vocabulary)]
        whole = sum(p for _, p in paths)
        for ids, p in paths:
            for i in ids:
                want[i] += (k + 1) * p / whole
    for kept in (200, 3):  # with arcs kept, and found again
        monkeypatch.setattr(Marginals, "KEPT", kept)
        uses = [0.0] * len(log_p)
        Marginals(vocabulary, log_p).expect(sorted(WORDS), range(1, len(WORDS) + 1), uses)
        assert {i: u for i, u in enumerate(uses) if u} == pytest.approx({i: u for i, u in want.items() if u}, rel=1e-9)


def plain_expected(word, vocabulary, log_p, longest):
    """piece -> expected uses, from a forward and a backward table over all substrings."""
    n = len(word)
    arcs = [(s, e, [vocabulary.pieces[word[s:e]]]) for e in range(1, n + 1) for s in range(max(0, e - longest), e) if word[s:e] in vocabulary.pieces]
    arcs += [(e - 1, e, [vocabulary.byte_ids[b] for b in word[e - 1].encode()]) for e in range(1, n + 1) if word[e - 1] not in vocabulary.pieces]
    arcs = [(s, e, ids, sum(log_p[i] for i in ids)) for s, e, ids in arcs]
    into, out = collections.defaultdict(list), collections.defaultdict(list)
    for s, e, ids, p in arcs:
        into[e].append((s, p))
        out[s].append((e, p))
    add = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
    ahead, back = [0.0] * (n + 1), [0.0] * (n + 1)
    for e in range(1, n + 1):
        ahead[e] = add([ahead[s] + p for s, p in into[e]])
    for s in range(n - 1, -1, -1):
        back[s] = add([back[e] + p for e, p in out[s]])
    uses = collections.Counter()
    for s, e, ids, p in arcs:
        for i in ids:
            uses[i] += math.exp(ahead[s] + p + back[e] - ahead[n])
    return uses


def test_best_paths_are_best(vocabulary):
    known = [w for w in WORDS if all(c in vocabulary.pieces for c in w)]
    for word, ids in best_paths(sorted(known), vocabulary, by_merges=False):
        total = lambda p: sum(vocabulary.scores[i] for i in p)
        assert total(ids) == max(map(total, spellings(word, vocabulary)))
        assert b"".join(vocabulary.spelling[i] for i in ids).decode() == word


def test_scores_against_a_plain_version(spark, docs, vocabulary):
    rows = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    held = {i for i in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    count = collections.Counter(w for i, words in rows.items() if i not in held for w in words)
    ends = len(rows) - len(held)
    n, v = sum(count.values()) + ends, len(count) + 1
    base = lambda c: math.log10((c + 1) / (n + v + 1))
    longest = max(map(len, vocabulary.pieces))
    log_p, log_end = [-math.log(2 + i) for i in range(len(vocabulary.scores))], 0.0
    for _ in range(lm_score.ROUNDS):
        uses = collections.Counter()
        for word, c in count.items():
            for i, u in plain_expected(" " + word.decode(), vocabulary, log_p, longest).items():
                uses[i] += c * u
        log_p, log_end = lm_score.log_probabilities(uses, len(log_p), ends)
    every = {w for words in rows.values() for w in words}
    lattice = {w[1:].encode(): p / math.log(10) for w, p in marginals(sorted(" " + w.decode() for w in every), vocabulary, log_p)}
    got = lm_score.score(docs, MODEL_FILE, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, block_bytes=30_000).collect()
    assert len(got) == len(rows)
    for r in got:
        words = rows[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (r["doc_id"] in held, len(words) + 1, n)
        assert r["n_known"] == sum(w in count for w in words) + 1
        assert r["base_score"] == pytest.approx(sum(base(count[w]) for w in words) + base(ends), rel=1e-9)
        assert r["score"] == pytest.approx(sum(lattice[w] for w in words) + log_end / math.log(10), rel=1e-9)


def test_better_than_uniform_pieces_on_held_out_documents(spark, docs, vocabulary):
    got = lm_score.score(docs, MODEL_FILE, F.col("doc_id") % 3 == 0).where("held_out").collect()
    flat = [-math.log(len(vocabulary.scores) + 1)] * len(vocabulary.scores)
    words = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    score = sum(r["score"] for r in got)
    used = collections.Counter(" " + w.decode() for r in got for w in words[r["doc_id"]])
    uniform = sum(p * used[w] for w, p in marginals(sorted(used), vocabulary, flat)) / math.log(10)
    assert score > 0.8 * uniform


def test_odd_rows(spark, empty):
    assert lm_score.score(empty, MODEL_FILE, F.lit(False)).count() == 0
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "y")], "doc_id bigint, text string, word string")
    got = lm_score.score(df, MODEL_FILE, F.lit(None).cast("boolean")).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == [(0, 1, 1, 7), (1, 3, 3, 7), (1, 3, 3, 7)]
    none = lm_score.score(df, MODEL_FILE, F.lit(True)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in none)
