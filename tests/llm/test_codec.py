from functools import cache

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyweave.llm import sentencepiece_codec as codec
from keyweave.llm.queries import MODEL_FILE
from keyweave.llm.vocabulary import Vocabulary, best_paths, merge


def test_round_trip(docs):
    back = codec.decode(codec.encode(docs, MODEL_FILE), MODEL_FILE).collect()
    assert len(back) == docs.count()
    assert [r["doc_id"] for r in back if r["decoded"] != (r["text"] or "")] == []
    assert all(len(r["ids"]) == 0 for r in back if not r["text"])


def test_chunks_and_cache_don_t_matter(docs, monkeypatch):
    want = {r["doc_id"]: r["ids"] for r in codec.encode(docs, MODEL_FILE).collect()}
    monkeypatch.setattr(codec, "CHUNK_CHARS", 500)
    monkeypatch.setattr(codec, "REMEMBERED", 20)
    assert {r["doc_id"]: r["ids"] for r in codec.encode(docs, MODEL_FILE).collect()} == want


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The library on the same file, told to read it as a unigram model."""
    data = open(MODEL_FILE, "rb").read()
    at = data.rindex(b"tok_v0\x18\x02") + 7
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(data[:at] + b"\x01" + data[at + 1 :])
    return sentencepiece.SentencePieceProcessor(model_file=str(path))


def test_ids_are_the_models_own(docs):
    """The library's encoding of whole texts, but for texts with the character that it takes for a space."""
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    rows = [r for r in codec.encode(docs, MODEL_FILE).collect() if "\u2581" not in (r["text"] or "")]
    assert len(rows) > 90 and [r["doc_id"] for r in rows if r["ids"] != library.encode(r["text"] or "")] == []


def test_ids_over_a_whole_table(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [r["doc_id"] for r in codec.encode(table, MODEL_FILE).collect() if r["ids"] != library.encode(r["text"] or "")] == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeinrst hlo.é漢 "), min_size=1, max_size=24), min_size=1, max_size=20))
def test_merging_forward(texts):
    """Merging outright, and the library, on texts of few characters, whose pieces overlap a lot."""
    library, vocabulary = _library()
    assert vocabulary.by_merges
    for word, ids in best_paths(sorted({" " + t for t in texts}), vocabulary):
        assert ids == library.encode(word[1:])
        if set(word) <= set(vocabulary.pieces):
            assert [vocabulary.spelling[i].decode() for i in ids] == merge(word, vocabulary)


@cache
def _library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE), Vocabulary.load(MODEL_FILE)


def test_unigram_paths_against_the_library(docs, unigram):
    """The same file read as a unigram model: sums as high as the library's, which stops short of the best for a few words."""
    vocabulary = Vocabulary.load(MODEL_FILE)
    words = sorted({" " + w for r in docs.collect() for w in (r["text"] or "").split() if w.isascii() and w.isprintable() and len(w) < 60})
    total = lambda ids: sum(vocabulary.scores[i] for i in ids)
    same = 0
    for word, ids in best_paths(words, vocabulary, by_merges=False):
        theirs = unigram.encode(word[1:])
        assert total(ids) >= total(theirs) and b"".join(vocabulary.spelling[i] for i in ids).decode() == word
        same += ids == theirs
    assert same >= 0.98 * len(words)


def test_a_very_long_word():
    _, vocabulary = _library()
    word = " " + "abcdefghij" * 100_000
    ((_, ids),) = best_paths([word], vocabulary)
    assert b"".join(vocabulary.spelling[i] for i in ids).decode() == word


def test_odd_rows(spark, empty):
    assert codec.encode(empty, MODEL_FILE).count() == 0
    df = spark.createDataFrame([(None, "  two  spaces ", 1), (1, "\n\n", 2), (1, None, 3)], "doc_id bigint, text string, score int")
    back = codec.decode(codec.encode(df, MODEL_FILE), MODEL_FILE).orderBy("score").collect()
    assert [r["decoded"] for r in back] == ["  two  spaces ", "\n\n", ""]
    with pytest.raises(ValueError):
        codec.encode(df.withColumn("ids", F.lit(1)), MODEL_FILE)
    with pytest.raises(ValueError):
        codec.decode(codec.encode(df, MODEL_FILE).withColumn("decoded", F.lit(1)), MODEL_FILE)
    assert codec.decode(spark.createDataFrame([(None,)], "ids array<int>"), MODEL_FILE).first()["decoded"] is None
