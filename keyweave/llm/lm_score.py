"""Language-model scores from a subword lattice.

Words (after lower-casing A-Z) get a space in front and are spelt with the pieces of an existing
vocabulary. The probability of a word is the sum over all its segmentations of the product of their
piece probabilities, by a forward recursion in log space; a text is its words and one end mark, so its
probability is their product. The vocabulary is taken as it is. Its scores weight the segmentations
where they are log probabilities; those of a vocabulary of merges are ranks, which only start the
estimate. Piece probabilities are then re-estimated from the words of all training documents by expectation-
maximisation: all segmentations of a word count with their probability under the weights so far,
times the word's frequency (forward and backward over the lattice), ROUNDS times in all.

Both this score and the base score (words with add-one smoothing) are sums over words, so each
distinct word is scored once. Documents are dealt into blocks; a block sends its distinct words to the
word table and gets their scores back, which keeps the shuffle to (block, distinct word) rows, and no
task holds more than a block. No table of the vocabulary of the corpus is broadcast or collected.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import checkpointed, pieces, text_bytes, text_or_empty
from keyweave.llm.vocabulary import Marginals, Vocabulary

#: Text in a block, and distinct words that a counting task holds before it hands them on.
BLOCK_BYTES, COUNTED = 8 << 20, 400_000
#: Added to the count of every piece.
SMOOTHING = 0.1
#: Passes over the distinct training words.
ROUNDS = 2


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes.lower() changes A-Z only


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), count over training documents (0 for words of held-out ones only); of docs (text, held_out)."""
    schema = pa.schema([("word", pa.binary()), ("count", pa.int64())])

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, held_out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held_out:
                    for word in _words(text):
                        seen.setdefault(word, 0)
                else:
                    seen.update(_words(text))
                if len(seen) > COUNTED:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)

    return docs.select("text", "held_out").mapInArrow(run, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))


def _spelt(word: bytes) -> str:
    return " " + word.decode("utf-8", "replace")


def piece_counts(words: DataFrame, vocabulary, weights: list[float]) -> dict[int, float]:
    """How often each piece is expected in the segmentations of the training words under weights; one number for each piece of the vocabulary reaches the driver."""
    schema = pa.schema([("piece", pa.int32()), ("uses", pa.float64())])
    shared = words.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Marginals(Vocabulary(*vocabulary.value), shared.value)
        uses = [0.0] * len(shared.value)
        for batch in batches:
            lattice.expect(map(_spelt, batch.column("word").to_pylist()), batch.column("count").to_pylist(), uses)
        used = [i for i, n in enumerate(uses) if n]
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array([uses[i] for i in used], pa.float64())], schema=schema)

    counted = words.where("count > 0").mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
    return {r["piece"]: r["uses"] for r in counted.collect()}


def log_probabilities(uses: dict[int, float], size: int, ends: int) -> tuple[list[float], float]:
    """Natural log probability of each piece, and of the end mark, which share one distribution."""
    total = sum(uses.values()) + ends + SMOOTHING * (size + 1)
    return [math.log((uses.get(i, 0) + SMOOTHING) / total) for i in range(size)], math.log((ends + SMOOTHING) / total)


def score(docs: DataFrame, model_file: str, held_out, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    held_out is a Column; its rows are scored but not learnt from, null counts as false. A null text
    has no words, only the end mark. Repeated rows and ids give a row each. An empty table gives no
    rows; without training documents every word is unknown.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(model_file).parts())  # a vocabulary file, however large docs is
    size = len(vocabulary.value[1])
    held = F.coalesce(held_out, F.lit(False))
    each = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held_out"), text_or_empty(text_col).alias("text"))

    words = checkpointed(word_counts(each).sortWithinPartitions("word"))  # neighbours share prefixes
    totals = words.agg(F.sum("count"), F.count_if(F.col("count") > 0)).first()
    ends = each.select("held_out").where("not held_out").count()
    train_tokens, distinct = (totals[0] or 0) + ends, (totals[1] or 0) + (ends > 0)
    first = Vocabulary(*vocabulary.value)
    log_p, log_end = ([-math.log(2 + i) for i in range(size)] if first.by_merges else list(first.scores)), 0.0  # pieces of merges come in order of rank
    for _ in range(ROUNDS):
        log_p, log_end = log_probabilities(piece_counts(words, vocabulary, log_p), size, ends)
    shared = spark.sparkContext.broadcast(log_p)
    denominator = train_tokens + distinct + 1

    def score_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Marginals(Vocabulary(*vocabulary.value), shared.value)
        for batch in batches:
            found = [p for _, p in total(map(_spelt, batch.column("word").to_pylist()))]
            yield pa.record_batch([batch.column("word"), batch.column("count"), pa.array(found, pa.float64())], names=["word", "count", "log_p"])

    table = words.mapInArrow(score_words, "word binary, count long, log_p double")

    blocks = pieces(text_bytes(each), block_bytes)
    dealt = each.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))

    def distinct_words(block: pa.Table) -> pa.Table:
        seen: set[bytes] = set()
        for text in block["text"].to_pylist():
            seen.update(_words(text))
        return pa.table({"block": pa.array([block["block"][0].as_py()] * len(seen), pa.int32()), "word": pa.array(list(seen), pa.binary())})

    asked = dealt.groupBy("block").applyInArrow(distinct_words, "block int, word binary")
    answered = asked.join(table, "word").select("block", "word", "count", "log_p")

    ln10, end_base = math.log(10), math.log10((ends + 1) / denominator)

    def score_block(block: pa.Table, answers: pa.Table) -> pa.Table:
        at = {w: i for i, w in enumerate(answers["word"].to_pylist())}
        counts = answers["count"].to_numpy()
        known, base, lattice = counts > 0, np.log10((counts + 1) / denominator), answers["log_p"].to_numpy() / ln10
        rows = []
        for text in block["text"].to_pylist():
            tokens = _words(text)
            i = np.fromiter(map(at.__getitem__, tokens), np.int64, len(tokens))
            rows.append((len(tokens) + 1, int(known[i].sum()) + (ends > 0), float(base[i].sum()) + end_base, float(lattice[i].sum()) + log_end / ln10))
        columns = list(zip(*rows)) or [[]] * 4
        return pa.table({
            "id": block["id"],
            "held_out": block["held_out"],
            "n_tokens": pa.array(columns[0], pa.int64()),
            "n_known": pa.array(columns[1], pa.int64()),
            "train_tokens": pa.array([train_tokens] * len(rows), pa.int64()),
            "base_score": pa.array(columns[2], pa.float64()),
            "score": pa.array(columns[3], pa.float64()),
        })

    scored = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score_block, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)
