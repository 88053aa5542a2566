import numpy as np
from pyspark.sql import functions as F

from keyweave.llm import quality_rules as qr
from tests.llm.conftest import corpus, prose


def plain_counts(text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else set()
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts():
    for _, text in corpus():
        if text and len(text) < 15_000:
            assert qr.counts(text)[:5] == plain_counts(text), text[:80]
    assert qr.counts("a b c a b c")[4] == 6 and qr.counts("a a a a")[4] == 4 and qr.counts("")[:5] == (0, 0, 0, 0, 0)
    assert qr.counts("x y\n\n x y\nx y\n \n")[3] == 1 and qr.counts("# $<|>")[2] == 5
    assert qr.counts("ab " * 3000)[:5] == (3000, 6000, 0, 0, 3000)


def labelled():
    import random

    rng = random.Random(11)
    good = [prose(rng, rng.randrange(60, 400)) + "." for _ in range(300)]
    junk = []
    for i in range(60):
        words = prose(rng, 150).split()
        if i % 3 == 0:
            junk.append(" ".join(w + rng.choice(("###", "***", "%%%", "&&&")) for w in words))
        elif i % 3 == 1:
            junk.append("!! ".join(w.upper() for w in words))
        else:
            junk.append(" ".join(words[:3] * 50))
    return [(i, t, 1) for i, t in enumerate(good)] + [(1000 + i, t, 0) for i, t in enumerate(junk)]


def test_junk_goes_and_clean_documents_stay(spark):
    df = spark.createDataFrame(labelled(), "doc_id bigint, text string, quality int").repartition(4)
    got = df.join(qr.judge(df), "doc_id")
    right = got.where((F.col("quality") == 1) == F.col("kept")).count()
    assert right >= 0.98 * got.count()
    assert got.where("quality = 1 and not kept").count() <= 3
    kept = qr.keep(df)
    assert kept.columns == df.columns and kept.where("quality = 0").count() <= 1 and kept.where("quality = 1").count() >= 297


def test_em_recovers_planted_rates():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.85
    rates = {True: np.array([0.002, 0.004, 0.001, 0.003]), False: np.array([0.5, 0.6, 0.4, 0.55])}
    votes = np.where(rng.random((20_000, 4)) < np.where(good[:, None], rates[True], rates[False]), -1, 1)
    votes[rng.random(votes.shape) < 0.1] = 0
    patterns, inverse, counted = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    fitted = qr.estimate(patterns, counted.astype(float))
    assert abs(fitted["prior"] - 0.85) < 0.04
    assert np.abs(fitted["table"][0] - rates[False]).max() < 0.06
    said = fitted["posterior"][inverse.ravel()] >= 0.5
    assert (said == good).mean() > 0.95


def test_odd_rows(spark, docs, empty):
    got = qr.judge(docs)
    assert got.count() == docs.count() and got.where("kept is null").count() == 0
    assert got.where("n_words = 0 and not (p_good between 0 and 1)").count() == 0
    assert qr.judge(empty).count() == 0 and qr.keep(empty).columns == empty.columns
    df = spark.createDataFrame([(None, "a", 1), (1, None, 2), (1, None, 3)], "doc_id bigint, text string, n_words int")
    assert qr.judge(df).count() == 3 and qr.keep(df).count() == 0


def test_padded_lines_are_ended():
    at = qr.COUNTS.index("n_ended_lines")
    assert [qr.counts(x)[at] for x in ("One line.", "One line." + " " * 20, "one line" + " " * 20, "One.\t\t\t\t\t\t\t\t\t\nTwo!" + " " * 8 + "\r\nthree")] == [1, 1, 0, 2]


def test_columns_of_any_name(spark):
    df = spark.createDataFrame(labelled(), "doc_id bigint, text string, quality int").withColumns({"_kw_text": F.lit("x"), "_text": F.lit(1), "_kw_vote_symbols": F.lit(2), "vote_caps": F.lit(3)})
    kept = qr.keep(df)
    assert kept.columns == df.columns and kept.count() == qr.keep(df.select("doc_id", "text")).count()
    assert [tuple(r) for r in kept.select("_kw_text", "_text", "_kw_vote_symbols").distinct().collect()] == [("x", 1, 2)]
