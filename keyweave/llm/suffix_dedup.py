"""Removal of repeated passages with a logarithmic family of suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id.
Each such string (window) holds GRAMS short grams; the gram with the smallest hash, its minimizer,
depends on the window alone. So equal windows have equal minimizers, and consecutive windows with the
same minimizer form runs of about 14 windows that travel together.

1. Map side, a document whose text a task has seen under a smaller id is settled at once: copies
   never pile up. The others go to blocks by the hash of their text.
2. Blocks send the distinct minimizers of their runs to buckets, which answer with those that another
   block has too. Most text ends here.
3. Blocks send the distinct runs with a shared minimizer, each with the smallest id that has it, to index
   buckets. Runs of a minimizer that very many blocks share are sent window by window, dealt by
   the window's own hash, so that no bucket collects a hot passage.
4. An index bucket takes its runs in the order of ids, batch by batch. A batch gets a suffix array: its
   window positions in the order of the bytes that follow (LENGTH of them, as longer matches are runs
   of such). It is merge-scanned against each level of the index for equal strings, then becomes a
   level itself, and levels of equal size class merge, so there are logarithmically many.
5. Blocks get back which windows of a run start in a smaller document, and cut their texts.

Blocks and buckets have a bounded size, their number grows with the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import pieces, text_bytes, text_or_empty

LENGTH, GRAM = 50, 25
GRAMS = LENGTH - GRAM + 1
#: Text of a block; of documents worked on at once; windows of a batch; blocks that make a minimizer hot; texts that a map task remembers.
BLOCK_BYTES, CHUNK_BYTES, BATCH_WINDOWS, HOT_BLOCKS, REMEMBERED = 4 << 20, 1 << 20, 1 << 18, 512, 500_000
#: Stands for a null id: no id is larger.
NO_ID = 2**63 - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = hashlib.sha256(b"").hexdigest()


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64."""
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Roller:
    """Fingerprints of all strings of a fixed length in a byte array."""

    def __init__(self, base: int = int(_BASE)) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, data: np.ndarray, length: int) -> np.ndarray:
        n = len(data)
        if n < length:
            return np.zeros(0, np.uint64)
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[length:] - sums[:-length]) * self.down[: n - length + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        return h


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while 2 * w <= width:
        h = np.minimum(h[:-w], h[w:])
        w *= 2
    rest = width - w
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def runs_of(texts: list[bytes], roller: Roller) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, and for each run its minimizer, first window, number of windows, and text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    nothing = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return data, np.zeros(0, np.uint64), nothing, nothing, nothing
    least = _sliding_min(roller(data, GRAM), GRAMS)
    inside = np.ones(len(least), bool)
    for end in ends.tolist():
        inside[max(0, end - LENGTH + 1) : end] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return data, np.zeros(0, np.uint64), nothing, nothing, nothing
    mins = least[at]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (mins[1:] != mins[:-1])]))
    starts = at[first]
    return data, mins[first], starts, np.diff(np.append(first, len(at))), np.searchsorted(ends, starts, side="right")


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK_BYTES):
            size += len(texts[last])
            last += 1
        yield first, texts[first:last]
        first = last


def _code(minimizers: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper, key in the lower 32 bits."""
    return (((minimizers >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (minimizers & np.uint64(0xFFFFFFFF))


def _texts(block: pa.Table) -> list[tuple[bytes, int]]:
    """The distinct texts of a block with their smallest ids, in an order that reruns share."""
    least: dict[bytes, int] = {}
    for text, id_ in zip(block["text"].to_pylist(), block["id"].to_pylist()):
        if text is not None and id_ < least.get(text, NO_ID + 1):
            least[text] = id_
    return sorted(least.items(), key=lambda x: (x[1], x[0]))


def _settle(batches: Iterable[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows for the blocks; a copy of a text under a smaller id goes without its text, settled."""
    schema = pa.schema([("block", pa.int32()), ("id", pa.int64()), ("text", pa.binary()), ("n_bytes", pa.int64()), ("kept_sha256", pa.string())])
    seen: dict[bytes, int] = {}
    for batch in batches:
        rows = []
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            id_ = NO_ID if id_ is None else id_
            sha = hashlib.sha256(text)
            digest = sha.digest()
            least = seen.get(digest)
            if least is not None and least < id_:
                rows.append((id_ % blocks, id_, None, len(text), _EMPTY if len(text) >= LENGTH else sha.hexdigest()))
            else:
                seen[digest] = id_
                rows.append((int.from_bytes(digest[:7], "little") % blocks, id_, text, len(text), None))
        if len(seen) > REMEMBERED:
            seen.clear()
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def _split(sorted_: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions of equal neighbours in groups, with the end appended, and the groups."""
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, np.int64)
    return np.append(first, len(sorted_)), groups[first]


def _send_minimizers(block: pa.Table, buckets: int) -> pa.Table:
    roller, found = Roller(), []
    for _, texts in _chunks([t for t, _ in _texts(block)]):
        found.append(np.unique(_code(runs_of(texts, roller)[1], buckets)))
    codes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    at, which = _split(codes, codes >> np.uint64(32))
    keys = (codes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return pa.table({
        "bucket": pa.array(which.astype(np.int32)),
        "block": pa.array([block["block"][0].as_py()] * len(which), pa.int32()),
        "keys": pa.array([keys[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
    })


def _shared_minimizers(bucket: pa.Table, hot_blocks: int) -> pa.Table:
    """To each block, which of its keys another block has too, and which very many have: one sort over the keys of all blocks."""
    each = [np.frombuffer(k, np.uint32) for k in bucket["keys"].to_pylist()]
    keys, blocks = np.concatenate(each), np.repeat(bucket["block"].to_numpy(), [len(k) for k in each])
    order = np.argsort(keys, kind="stable")
    at, _ = _split(order, keys[order])
    times = np.empty(len(keys), np.int64)
    times[order] = np.repeat(np.diff(at), np.diff(at))
    some = times > 1
    keys, blocks, hot = keys[some], blocks[some], times[some] >= hot_blocks
    at, which = _split(blocks, blocks)  # the keys of a block stand side by side
    spans = list(zip(at[:-1].tolist(), at[1:].tolist()))
    return pa.table({
        "block": pa.array(which.astype(np.int32)),
        "bucket": pa.array([bucket["bucket"][0].as_py()] * len(which), pa.int32()),
        "shared": pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
        "hot": pa.array([keys[a:b][hot[a:b]].tobytes() for a, b in spans], pa.binary()),
    })


class _BlockRuns:
    """The runs of a block that may be shared: the distinct strings, numbered, and where they stand."""

    def __init__(self, texts: list[tuple[bytes, int]], answers: pa.Table, buckets: int) -> None:
        which = answers["bucket"].to_pylist()

        def codes(name: str) -> np.ndarray:
            found = [np.frombuffer(k, np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, k in zip(which, answers[name].to_pylist())]
            return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)

        shared, hot = codes("shared"), codes("hot")
        roller = Roller()
        # a minimizer that two texts of this block have is shared as well
        kept = []
        for first, part in _chunks([t for t, _ in texts]):
            data, mins, starts, windows, text = runs_of(part, roller)
            kept.append((first, data, _code(mins, buckets), starts, windows, text + first))
        own = np.concatenate([k[2] for k in kept]) if kept else np.zeros(0, np.uint64)
        of = np.concatenate([k[5] for k in kept]) if kept else np.zeros(0, np.int64)
        order = np.lexsort((of, own))
        same = (own[order][1:] == own[order][:-1]) & (of[order][1:] != of[order][:-1])
        shared = np.union1d(shared, own[order][1:][same])
        ids = [i for _, i in texts]
        self.number: dict[bytes, int] = {}
        self.least: list[int] = []  # smallest id in this block, by number
        self.codes: list[int] = []
        self.hot: list[bool] = []
        self.places: list[tuple[int, int, int, int]] = []  # text, first window in it, windows, number
        begins = np.concatenate([[0], np.cumsum([len(t) for t, _ in texts])])
        for first, data, code, starts, windows, text in kept:
            held, is_hot = np.isin(code, shared), np.isin(code, hot)
            raw, offset = data.tobytes(), begins[first]
            for at, n, t, c, h in zip(starts[held].tolist(), windows[held].tolist(), text[held].tolist(), code[held].tolist(), is_hot[held].tolist()):
                for a, m in ((at + i, 1) for i in range(n)) if h else ((at, n),):
                    string = raw[a : a + m + LENGTH - 1]
                    number = self.number.setdefault(string, len(self.least))
                    if number == len(self.least):
                        self.least.append(ids[t])
                        self.codes.append(c)
                        self.hot.append(h)
                    elif ids[t] < self.least[number]:
                        self.least[number] = ids[t]
                    self.places.append((t, int(a + offset - begins[t]), m, number))


def _send_runs(block: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    runs = _BlockRuns(_texts(block), answers, buckets)
    strings = list(runs.number)
    codes = np.array(runs.codes, np.uint64)
    # other bits than those that chose the block of the minimizer; hot ones by the window itself
    to = ((codes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)) % np.uint64(buckets)
    for i in np.flatnonzero(np.array(runs.hot, bool)).tolist():
        to[i] = int.from_bytes(hashlib.blake2b(strings[i], digest_size=7).digest(), "little") % buckets
    order = np.argsort(to, kind="stable")
    at, which = _split(order, to[order])
    least = np.array(runs.least, np.int64)
    groups = [order[a:b] for a, b in zip(at[:-1], at[1:])]
    return pa.table({
        "bucket": pa.array(which.astype(np.int32)),
        "block": pa.array([_block_of(block, answers)] * len(which), pa.int32()),
        "strings": pa.array([[strings[i] for i in g] for g in groups], pa.list_(pa.binary())),
        "numbers": pa.array([g.astype(np.int32).tobytes() for g in groups], pa.binary()),
        "ids": pa.array([least[g].tobytes() for g in groups], pa.binary()),
    })


def _block_of(*tables: pa.Table) -> int:
    return next(t["block"][0].as_py() for t in tables if t.num_rows)


def _strings_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The LENGTH bytes from each position, as strings of that size, which numpy orders as bytes."""
    if not len(at):
        return np.zeros(0, f"S{LENGTH}")
    return np.ndarray((len(data) - LENGTH + 1,), f"S{LENGTH}", data, strides=(1,))[at]


class SuffixArrayFamily:
    """A logarithmic family of suffix arrays; batches come in ascending order of ids.

    A level is (size class, the distinct strings of its windows in order, the smallest id of each).
    """

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]] | None = None) -> None:
        self.levels = [] if levels is None else levels

    def add(self, strings: list[bytes], ids: np.ndarray) -> np.ndarray:
        """For each window of the strings, string by string: does it start under a smaller id, here or in earlier batches?"""
        data = np.frombuffer(b"".join(strings), np.uint8)
        windows = np.array([len(s) - LENGTH + 1 for s in strings])
        begins = np.cumsum([0, *(len(s) for s in strings[:-1])])
        at = np.repeat(begins, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        own, every = np.repeat(ids, windows), _strings_at(data, at)
        order = np.argsort(every, kind="stable")  # the suffix array; ids ascend among equal strings
        first, found = _split(order, every[order])
        least, group = own[order[first[:-1]]], np.repeat(np.arange(len(first) - 1), np.diff(first))
        for _, known, known_ids in self.levels:  # merge-scan: both sides are in order
            i = np.searchsorted(known, found)
            hit = np.flatnonzero((i < len(known)) & (known[np.minimum(i, len(known) - 1)] == found))
            least[hit] = np.minimum(least[hit], known_ids[i[hit]])
        smaller = np.empty(len(at), bool)
        smaller[order] = least[group] < own[order]
        self._insert(found, least)
        return smaller

    def _insert(self, found: np.ndarray, least: np.ndarray) -> None:
        self.levels.append((0, found, least))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, f1, i1), (_, f2, i2) = self.levels[-2:]
            both = np.concatenate([f1, f2])
            order = np.argsort(both, kind="stable")  # of two runs in order, so a merge
            first, strings = _split(order, both[order])
            self.levels[-2:] = [(rank + 1, strings, np.minimum.reduceat(np.concatenate([i1, i2])[order], first[:-1]))]


def smaller_windows(strings: list[bytes], ids: np.ndarray, batch_windows: int = BATCH_WINDOWS, family: SuffixArrayFamily | None = None) -> np.ndarray:
    """Does each window, string by string, start in a string of a smaller id? The strings come in ascending order of ids."""
    family, found, first = family or SuffixArrayFamily(), [], 0
    while first < len(strings):
        last, size = first, 0
        while last < len(strings) and size < batch_windows:
            size += len(strings[last]) - LENGTH + 1
            last += 1
        found.append(family.add(strings[first:last], ids[first:last]))
        first = last
    return np.concatenate(found) if found else np.zeros(0, bool)


def _index(bucket: pa.Table) -> pa.Table:
    strings, ids, blocks, numbers = [], [], [], []
    for block, some, numbered, least in zip(*(bucket[n].to_pylist() for n in ("block", "strings", "numbers", "ids"))):
        strings += some
        numbers.append(np.frombuffer(numbered, np.int32))
        ids.append(np.frombuffer(least, np.int64))
        blocks.append(np.full(len(some), block, np.int32))
    ids, blocks, numbers = (np.concatenate(x) for x in (ids, blocks, numbers))
    order = np.argsort(ids, kind="stable")
    flags = smaller_windows([strings[i] for i in order], ids[order])
    windows = np.array([len(strings[i]) - LENGTH + 1 for i in order])
    ends = np.cumsum(windows)
    any_ = np.add.reduceat(flags, ends - windows) > 0
    # of the runs with such a window: their numbers, and the flags of all their windows
    out: dict[int, tuple[list, list]] = {}
    for k in np.flatnonzero(any_).tolist():
        i = order[k]
        some = out.setdefault(int(blocks[i]), ([], []))
        some[0].append(numbers[i])
        some[1].append(flags[ends[k] - windows[k] : ends[k]])
    return pa.table({
        "block": pa.array(list(out), pa.int32()),
        "numbers": pa.array([np.array(n, np.int32).tobytes() for n, _ in out.values()], pa.binary()),
        "flags": pa.array([np.packbits(np.concatenate(f)).tobytes() for _, f in out.values()], pa.binary()),
    })


_RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _cut(block: pa.Table, answers: pa.Table, buckets: int, with_text: bool) -> pa.Table:
    texts = _texts(block)
    runs = _BlockRuns(texts, answers.filter(pc.is_valid(answers["shared"])), buckets)
    windows = [0] * len(runs.least)
    for _, _, n, number in runs.places:
        windows[number] = n
    flagged: dict[int, np.ndarray] = {}
    told = answers.filter(pc.is_valid(answers["flags"]))
    for numbers, packed in zip(told["numbers"].to_pylist(), told["flags"].to_pylist()):
        flags, at = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool), 0
        for number in np.frombuffer(numbers, np.int32).tolist():
            flagged[number] = flags[at : at + windows[number]]
            at += windows[number]
    marks: list[np.ndarray | None] = [None] * len(texts)
    for t, at, n, number in runs.places:
        later = texts[t][1] > runs.least[number]
        if later or number in flagged:
            if marks[t] is None:
                marks[t] = np.zeros(len(texts[t][0]), bool)
            if later:
                marks[t][at : at + n] = True
            else:
                marks[t][at : at + n] |= flagged[number]
    settled: dict[bytes, tuple] = {}
    for (text, least), mark in zip(texts, marks):
        if mark is None:
            settled[text] = (least, 0, 0, hashlib.sha256(text).hexdigest(), text)
            continue
        covered = np.cumsum(mark)
        covered[LENGTH:] = covered[LENGTH:] - covered[:-LENGTH].copy()
        covered = covered > 0
        spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
        rest = np.frombuffer(text, np.uint8)[~covered].tobytes()
        settled[text] = (least, int(covered.sum()), spans, hashlib.sha256(rest).hexdigest(), rest)
    rows = []
    for id_, text, n, sha in zip(*(block[c].to_pylist() for c in ("id", "text", "n_bytes", "kept_sha256"))):
        if text is not None and (found := settled[text])[0] == id_:
            rows.append((id_, n, *found[1:]))
        else:  # a copy of a text with a smaller id
            long = n >= LENGTH
            sha = sha or (_EMPTY if long else hashlib.sha256(text).hexdigest())
            rows.append((id_, n, n if long else 0, int(long), sha, b"" if long else text))
    columns = list(zip(*rows)) or [[]] * 6
    columns[0] = [None if i == NO_ID else i for i in columns[0]]
    if not with_text:
        columns[5] = [None] * len(rows)
    return pa.table([pa.array(c, t) for c, t in zip(columns, _RESULT.types)], schema=_RESULT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, block_bytes: int = BLOCK_BYTES, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes, null unless with_text).

    A null text counts as empty. A document must fit in a task, and a block holds block_bytes or its
    longest document. Documents shorter than LENGTH bytes stay whole. A null id is larger
    than every other one; rows with the same id are not smaller than one another. Short copies that
    a map task settles have kept null even with_text where they are shorter than LENGTH; their text
    is the input's. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(text_or_empty(text_col), "utf-8").alias("text"))
    blocks = buckets = pieces(text_bytes(docs, text_col), block_bytes)
    each = texts.mapInArrow(lambda b: _settle(b, blocks), "block int, id long, text binary, n_bytes long, kept_sha256 string")
    by_block = each.groupBy("block")
    sent = by_block.applyInArrow(lambda t: _send_minimizers(t, buckets), "bucket int, block int, keys binary")
    shared = sent.groupBy("bucket").applyInArrow(lambda t: _shared_minimizers(t, hot_blocks), "block int, bucket int, shared binary, hot binary")
    runs = by_block.cogroup(shared.groupBy("block")).applyInArrow(lambda t, a: _send_runs(t, a, buckets), "bucket int, block int, strings array<binary>, numbers binary, ids binary")
    flags = runs.groupBy("bucket").applyInArrow(_index, "block int, numbers binary, flags binary")
    both = shared.select("block", "bucket", "shared", "hot", F.lit(None).cast("binary").alias("numbers"), F.lit(None).cast("binary").alias("flags")).unionByName(flags, allowMissingColumns=True)
    cut = by_block.cogroup(both.groupBy("block")).applyInArrow(lambda t, a: _cut(t, a, buckets, with_text), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return cut.withColumnRenamed("id", id_col)
