"""SentencePiece encoding and decoding with an existing vocabulary, by shared-prefix Viterbi.

A text gets a space in front and falls into marked words: the spaces before a word, and the word.
No piece of the vocabulary crosses the boundary before a space (checked at the start), so the best
segmentation of a text is that of its words. Each task sorts the distinct marked words of a chunk of
texts that it has not met before into a trie, walks it depth first, and reuses the forward scores
of shared prefixes. Nothing is shuffled, memory is bounded by the chunk and the word cache.

The ids are those of the model itself: of a unigram model the segmentation with the highest sum of
scores, of a model of merges the one that merging gives (see vocabulary.Viterbi). One exception: a
literal U+2581, which the library can't tell from a space, is spelt in bytes, so that every text
decodes to itself.

A word is held with ten bytes or so for each of its characters, however long it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from keyweave.llm.vocabulary import Viterbi, Vocabulary

#: Characters of texts and ids worked on at once, and words whose ids a task remembers.
CHUNK_CHARS, CHUNK_IDS, REMEMBERED = 1 << 20, 1 << 20, 250_000
_MARKED = re.compile(r" *[^ \n]+| +|\n")


#: What a worker process keeps for its next task: one model's trie, the pairs of pieces it has tried, and up to REMEMBERED words with their ids.
_HELD: dict[str, tuple[Viterbi, dict[str, bytes]]] = {}


def _held(name: str, parts: tuple) -> tuple[Viterbi, dict[str, bytes]]:
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Viterbi(Vocabulary(*parts)), {}
    return _HELD[name]


def _encode(batches: Iterable[pa.RecordBatch], held: tuple[Viterbi, dict[str, bytes]], at: int) -> Iterator[pa.RecordBatch]:
    best, known = held
    for batch in batches:
        first = 0
        while first < batch.num_rows:
            texts: list[str] = []
            chars = 0
            while first + len(texts) < batch.num_rows and (not texts or chars < CHUNK_CHARS):
                texts.append(batch.column(at)[first + len(texts)].as_py() or "")
                chars += len(texts[-1])
            marked = [_MARKED.findall(" " + t) if t else [] for t in texts]
            if len(known) > REMEMBERED:
                known.clear()
            new = {w for words in marked for w in words if w not in known}
            for word, ids in best(sorted(new)):
                known[word] = np.array(ids, np.int32).tobytes()
            packed = [b"".join(map(known.__getitem__, words)) for words in marked]
            offsets = np.zeros(len(texts) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns, ids], names=[*batch.schema.names, "_ids"])
            first += len(texts)


def encode(docs: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs and a column of ids (array<int>); a null or empty text has none. A column of that name in docs is an error."""
    if ids_col in docs.columns:
        raise ValueError(f"docs has a column {ids_col}")
    vocabulary = Vocabulary.load(model_file)
    if vocabulary.crossing():
        raise ValueError("pieces cross word boundaries")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.parts())  # a vocabulary file, however large docs is
    name = hashlib.sha256(repr((vocabulary.pieces, vocabulary.scores)).encode()).hexdigest()
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(lambda b: _named(_encode(b, _held(name, shared.value), at), schema.names), schema)


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """encoded and a column with the text that its ids stand for; null ids give a null text."""
    if text_col in encoded.columns:
        raise ValueError(f"encoded has a column {text_col}")
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file).spelling)
    at = encoded.columns.index(ids_col)
    schema = T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = pa.array(shared.value, pa.binary())
        for batch in batches:
            lists, first = batch.column(at), 0
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            while first < batch.num_rows:
                done = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, done + CHUNK_IDS)))
                part = lists.slice(first, last - first)
                # the spellings of all ids of the part, side by side
                taken = spelling.take(part.flatten())
                starts = np.concatenate([[0], ends[first:last] - done])
                texts = []
                for a, b, valid in zip(starts[:-1].tolist(), starts[1:].tolist(), part.is_valid().to_pylist()):
                    data = _joined(taken, a, b) if b > a else b""
                    texts.append((data[1:] if data[:1] == b" " else data).decode("utf-8", "replace") if valid else None)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "_text"])
                first = last

    return encoded.mapInArrow(lambda b: _named(run(b), schema.names), schema)


def _joined(strings: pa.BinaryArray, first: int, last: int) -> bytes:
    """The bytes of strings[first:last], which stand side by side in the array's buffer."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset :]
    return strings.buffers()[2][int(offsets[first]) : int(offsets[last])].to_pybytes()


def _named(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(batch.columns, names=names)
