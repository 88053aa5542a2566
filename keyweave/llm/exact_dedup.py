"""Exact deduplication with Patricia tries over length-and-content-hash partitions.

Map side, each task folds the copies it sees into one row per text (and one narrow row for the
copies), so a text that makes up a third of the table reaches the shuffle once per task. Rows are
dealt by (length, content hash); each partition inserts the full byte strings into a compressed
radix trie whose terminal nodes hold the owner's id and the number of copies. A trie over its
memory budget spills its largest subtree: the strings below that edge go to a file of the task's
temporary folder, later ones are appended, and the file is worked off as a trie of its own.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import fresh, text_or_empty

#: Stands for a null id: below every other one.
NO_ID = -(2**63)
#: Copies that a map task remembers at once, and bytes of strings that a trie holds before it spills.
REMEMBERED, TRIE_BYTES = 200_000, 96 << 20

_PART = pa.schema([("n_bytes", pa.int64()), ("digest", pa.binary()), ("content", pa.binary()), ("owner", pa.int64()), ("copies", pa.int64())])
_OWNER = pa.schema([("digest", pa.binary()), ("owner", pa.int64()), ("copies", pa.int64())])


class _Node:
    __slots__ = ("children", "terminal")

    def __init__(self) -> None:
        self.children: dict[int, tuple[bytes, _Node]] = {}  # first byte -> (edge label, node)
        self.terminal: list | None = None  # [owner, copies]


class PatriciaTrie:
    """Byte strings -> [owner, copies]; ``prefer`` chooses between two owners (min or max)."""

    def __init__(self, prefer: Callable[[int, int], int] = min, budget: int = TRIE_BYTES) -> None:
        self.prefer, self.budget = prefer, budget
        self.root, self.held = _Node(), 0
        self.by_edge: dict[int, int] = {}  # bytes held below each edge of the root
        self.spilled: dict[int, object] = {}  # first byte -> file of the strings below that edge

    def insert(self, string: bytes, owner: int, copies: int) -> None:
        if string and (file := self.spilled.get(string[0])) is not None:
            pickle.dump((string, owner, copies), file, pickle.HIGHEST_PROTOCOL)
            return
        before = self.held
        node = self._node_of(string)
        if node.terminal is None:
            node.terminal = [owner, copies]
            self.held += 120
        else:
            node.terminal[0] = self.prefer(node.terminal[0], owner)
            node.terminal[1] += copies
        if string:
            self.by_edge[string[0]] = self.by_edge.get(string[0], 0) + self.held - before
        if self.held > self.budget and self.by_edge:
            self._spill()

    def _node_of(self, string: bytes) -> _Node:
        node, at, size = self.root, 0, len(string)
        while at < size:
            edge = node.children.get(string[at])
            if edge is None:
                leaf = _Node()
                node.children[string[at]] = (string[at:], leaf)
                self.held += size - at + 300
                return leaf
            label, below = edge
            if string.startswith(label, at):
                node, at = below, at + len(label)
                continue
            same = _common(label, string, at)
            middle = _Node()
            middle.children[label[same]] = (label[same:], below)
            node.children[string[at]] = (label[:same], middle)
            self.held += 300
            node, at = middle, at + same
        return node

    def _spill(self) -> None:
        """Move the largest subtree below the root to a file."""
        first = max(self.by_edge, key=self.by_edge.get)
        file = tempfile.TemporaryFile()
        label, node = self.root.children.pop(first)
        for string, (owner, copies) in _walk(node, label):
            pickle.dump((string, owner, copies), file, pickle.HIGHEST_PROTOCOL)
        self.held -= self.by_edge.pop(first)
        self.spilled[first] = file

    def items(self) -> Iterator[tuple[bytes, list]]:
        """Every string with its [owner, copies], held ones first, then each spilled subtree from a trie of its own."""
        yield from _walk(self.root, b"")
        self.root, self.held, self.by_edge = _Node(), 0, {}
        files, self.spilled = list(zip([b""] * len(self.spilled), self.spilled.values())), {}
        while files:
            head, file = files.pop()
            shared = None  # the common prefix is cut, so that the next trie branches at its root
            for string, _, _ in _entries(file):
                shared = string if shared is None else string if shared.startswith(string) else shared if string.startswith(shared) else shared[: _common(shared, string, 0)]
            below = PatriciaTrie(self.prefer, self.budget)
            for string, owner, copies in _entries(file):
                below.insert(string[len(shared) :], owner, copies)
            file.close()
            yield from _walk(below.root, head + shared)
            files += [(head + shared, x) for x in below.spilled.values()]


def _entries(file) -> Iterator[tuple[bytes, int, int]]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _common(label: bytes, string: bytes, at: int) -> int:
    """Length of the common prefix of label and string[at:], which differ somewhere in label."""
    low, high = 0, min(len(label), len(string) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[:mid] == string[at : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _walk(node: _Node, prefix: bytes) -> Iterator[tuple[bytes, list]]:
    stack = [(node, prefix)]
    while stack:
        node, prefix = stack.pop()
        if node.terminal is not None:
            yield prefix, node.terminal
        stack += [(below, prefix + label) for label, below in node.children.values()]


def _combine(batches: Iterable[pa.RecordBatch], prefer: Callable[[int, int], int]) -> Iterator[pa.RecordBatch]:
    """One row with the string at its first sight, and one without it for the copies seen later."""
    later: dict[bytes, list] = {}

    def copies() -> pa.RecordBatch:
        rows = [(d, *x) for d, x in later.items() if x[1]]
        later.clear()
        return pa.record_batch([[x[3] for x in rows], [x[0] for x in rows], pa.nulls(len(rows), pa.binary()), [x[1] for x in rows], [x[2] for x in rows]], schema=_PART)

    for batch in batches:
        rows = []
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            id_ = NO_ID if id_ is None else id_
            string = text.encode()
            digest = hashlib.sha256(string).digest()
            if (known := later.get(digest)) is None:
                later[digest] = [id_, 0, len(string)]
                rows.append((len(string), digest, string, id_, 1))
            else:
                known[0] = prefer(known[0], id_)
                known[1] += 1
        yield pa.record_batch([list(x) for x in zip(*rows)] or [[]] * 5, schema=_PART)
        if len(later) > REMEMBERED:
            yield copies()
    yield copies()


def _own(batches: Iterable[pa.RecordBatch], prefer: Callable[[int, int], int], budget: int) -> Iterator[pa.RecordBatch]:
    trie, later = PatriciaTrie(prefer, budget), {}
    for batch in batches:
        for digest, string, owner, copies in zip(*(batch.column(n).to_pylist() for n in ("digest", "content", "owner", "copies"))):
            if string is not None:
                trie.insert(string, owner, copies)
            elif (known := later.get(digest)) is None:
                later[digest] = [owner, copies]
            else:
                known[0] = prefer(known[0], owner)
                known[1] += copies
    rows = []
    for string, (owner, copies) in trie.items():
        digest = hashlib.sha256(string).digest()
        if (more := later.get(digest)) is not None:
            owner, copies = prefer(owner, more[0]), copies + more[1]
        rows.append((digest, owner, copies))
        if len(rows) == 10_000:
            yield pa.record_batch([list(x) for x in zip(*rows)], schema=_OWNER)
            rows = []
    if rows:
        yield pa.record_batch([list(x) for x in zip(*rows)], schema=_OWNER)


def owners(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id, group_size.

    ``keep`` is "smallest" or "largest", the copy that owns the text. A null text counts as the
    empty one; a null id is below every other id, and owns a text only where no copy has an id
    or, with "smallest", where one has none (keep_id is then null).
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    prefer = min if keep == "smallest" else max
    parts = docs.select(F.col(id_col).cast("long"), text_or_empty(text_col)).mapInArrow(lambda b: _combine(b, prefer), "n_bytes long, digest binary, content binary, owner long, copies long")
    dealt = parts.repartition("n_bytes", "digest")
    found = dealt.mapInArrow(lambda b: _own(b, prefer, trie_bytes), "digest binary, owner long, copies long")
    return found.select(
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.when(F.col("owner") != NO_ID, F.col("owner")).alias("keep_id"),
        F.col("copies").alias("group_size"),
    )


def groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256.

    Documents whose id repeats within a group of equal texts are all marked alike: kept says that
    the row carries the owner's id. An empty table gives an empty result.
    """
    each = docs.select(F.col(id_col).cast("long").alias(id_col), F.sha2(text_or_empty(text_col), 256).alias("text_sha256"))
    return each.join(owners(docs, keep, id_col, text_col, trie_bytes), "text_sha256").select(
        id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that own their text, all columns, whatever their names.

    Of rows that repeat the owner's id and text, which nothing tells apart, only one is returned.
    """
    text = text_or_empty(text_col)
    sha_of, sha, owner, size = fresh(docs.columns, "_sha_of", "_sha", "_keep", "_size")
    own = owners(docs, keep, id_col, text_col).select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(owner), F.col("group_size").alias(size))
    at = docs.withColumn(sha_of, F.sha2(text, 256))
    kept = at.join(own, (F.col(sha_of) == F.col(sha)) & docs[id_col].cast("long").eqNullSafe(F.col(owner)))
    alone = kept.where(F.col(size) == 1).select(*docs.columns)
    shared = kept.where(F.col(size) > 1).dropDuplicates([sha_of]).select(*docs.columns)
    return alone.unionByName(shared)
