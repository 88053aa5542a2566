"""The most similar fingerprints, block by block.

Fingerprints are packed into few rows of many, and every block of queries meets every block of
fingerprints in a task of its own. Inside, both are in order of their bit counts: counts that can't
reach a query's bound are left out, the others are compared as words. The bound starts at the
threshold and rises to the score of a query's k-th best so far; what only equals it is still compared
by id, so nothing is lost and a block returns k rows per query at most.

Many fingerprints of 64 bits don't all meet. Of two that differ in h bits one of the four chunks of
16 bits differs in h / 4 at most. A task takes the queries with some values of one chunk; those of a value
meet the fingerprints whose chunk differs in 0 or 1 bit, then in 2 and so on, until the bound leaves
no h that needs another step. That ends with all pairs at the latest, so it is exact for any data.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.operators.durable import checkpointed

#: Queries and fingerprints of a block, and of a tile that is compared at once.
QUERY_ROWS, BLOCK_ROWS, TILE, STRIP = 1 << 14, 1 << 20, 64, 1 << 13
#: Fingerprints from which on chunks pay, fingerprints of a block then, and tasks that share one chunk.
CHUNKED_FROM, CHUNKED_ROWS, PARTS = 1 << 18, 1 << 22, 12
CHUNKS, BITS, CLASSES = 4, 16, 6
#: Candidates that a tile collects before its bounds rise.
HELD = 4096


def _pack(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, bits, run) as one row per run, width and block: ids in order as an Arrow stream, the words of all bits."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    width, run = pc.list_value_length(table["bits"]).to_numpy(), table["run"].to_numpy()
    for r, w in np.unique(np.stack([run, width]), axis=1).T:
        same = table.filter(pa.array((run == r) & (width == w)))
        for at in range(0, same.num_rows, rows):
            part = same.slice(at, rows)
            part = part.take(pc.sort_indices(part, sort_keys=[("id", "ascending")], null_placement="at_start")).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.select(["id"]).schema) as out:
                out.write_table(part.select(["id"]))
            words = pc.list_flatten(part["bits"]).to_numpy()
            columns = [pa.array([r], pa.int32()), pa.array([w], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([words.tobytes()], pa.binary())]
            yield pa.record_batch(columns, names=["run", "width", "ids", "bits"])


def _common(a: np.ndarray, b: np.ndarray, both: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Bits in common of each of a with each of b (words x rows); both and counted are room for it."""
    n, m = a.shape[1], b.shape[1]
    both, counted = both[: n * m].reshape(n, m), counted[: n * m].reshape(n, m)
    if len(a) == 1:
        return np.bitwise_count(np.bitwise_and(a[0][:, None], b[0][None, :], out=both), out=counted)
    total = np.zeros((n, m), np.int32)
    for x, y in zip(a, b):
        total += np.bitwise_count(np.bitwise_and(x[:, None], y[None, :], out=both), out=counted)
    return total


def _best(q: np.ndarray, place: np.ndarray, score: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each query by score and place, in order of queries."""
    # unequal scores of n bits differ by 1 / n^2 or more, far more than is lost here
    order = np.lexsort((place, 2.0 * q - score))
    q, place, score = q[order], place[order], score[order]
    if k is not None:
        stay = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, place, score = q[stay], place[stay], score[stay]
    return q, place, score


def top_k(a: np.ndarray, b: np.ndarray, threshold: float, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of queries a and fingerprints b (rows x words): query, fingerprint and score of the k best of each query at or above the threshold, ties by position."""
    ones = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    a_count, b_count = ones(a), ones(b)
    a_order, b_order = np.argsort(a_count, kind="stable"), np.argsort(b_count, kind="stable")
    a_words, b_words = np.ascontiguousarray(a[a_order].T), np.ascontiguousarray(b[b_order].T)
    a_count, b_count = a_count[a_order], b_count[b_order]
    counts, first = np.unique(b_count, return_index=True)
    last = np.append(first[1:], len(b_count))
    both, counted = np.empty(TILE * STRIP, np.uint64), np.empty(TILE * STRIP, np.uint8)
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(a_count), TILE):
        words, own = a_words[:, at : at + TILE], a_count[at : at + TILE]
        bound = np.full(len(own), threshold)
        top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        held: list[tuple[np.ndarray, ...]] = [top]
        waiting = 0
        # counts near the queries' own first, as the highest scores are there
        for g in np.argsort(np.abs(counts - np.median(own)), kind="stable"):
            n = int(counts[g])
            for start in range(first[g], last[g], STRIP):
                stop = min(start + STRIP, last[g])
                need = np.ceil(bound * (own + n) / (1 + bound) - 1e-9)
                may = np.flatnonzero(need <= np.minimum(own, n))
                if not len(may):
                    break
                common = _common(words[:, may] if len(may) < len(own) else words, b_words[:, start:stop], both, counted)
                near = np.flatnonzero(common >= need[may, None].astype(common.dtype))
                if not len(near):
                    continue
                i, j = np.divmod(near, stop - start)
                c = common.ravel()[near].astype(np.float64)
                i = may[i]
                either = own[i] + n - c
                score = np.divide(c, either, out=np.zeros(len(c)), where=either > 0)
                fits = score >= threshold
                held.append((i[fits], b_order[start + j[fits]], score[fits]))
                waiting += len(near)
                if k is not None and waiting >= HELD:
                    top = _best(*(np.concatenate(x) for x in zip(*held)), k)
                    held, waiting = [top], 0
                    full = np.flatnonzero(np.bincount(top[0], minlength=len(own)) == k)
                    bound[full] = top[2][np.searchsorted(top[0], full, "right") - 1]
        i, j, score = _best(*(np.concatenate(x) for x in zip(*held)), k)
        found.append((a_order[at + i], j, score))
    return tuple(np.concatenate(x) for x in zip(*found))


def _chunk(x: np.ndarray, chunk: int) -> np.ndarray:
    return (x >> np.uint64(BITS * chunk) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _first_chunk(differing: np.ndarray) -> np.ndarray:
    """The first chunk with at most a quarter of the differing bits."""
    most = np.bitwise_count(differing) // CHUNKS
    return np.argmax([np.bitwise_count(_chunk(differing, c)) <= most for c in range(CHUNKS)], axis=0)


def top_k_by_chunk(a: np.ndarray, b: np.ndarray, threshold: float, k: int, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As top_k for words of 64 bits: those of the k best whose first chunk with at most a quarter of the differing bits it is."""
    values = np.arange(1 << BITS)
    distance = np.bitwise_count(values)
    masks = [np.flatnonzero(distance <= 1), *(np.flatnonzero(distance == r) for r in range(2, BITS + 1))]
    value, b_count = _chunk(a, chunk), np.bitwise_count(b)
    mine = np.argsort(value, kind="stable")
    # fingerprints by value of the chunk, those of a value by classes of counts
    n = np.arange(65)
    present = np.bincount(b_count, minlength=65) > 0
    class_of = (np.cumsum(np.bincount(b_count, minlength=65)) - 1) * CLASSES // max(1, len(b))
    class_of = np.clip(class_of, 0, CLASSES - 1)
    key = _chunk(b, chunk) * CLASSES + class_of[b_count]
    b_order = np.argsort(key, kind="stable")
    b_words, b_count = b[b_order], b_count[b_order]
    offset = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=CLASSES << BITS))])
    both, counted = np.empty(TILE * STRIP, np.uint64), np.empty(TILE * STRIP, np.uint8)
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    ends = np.append(np.flatnonzero(np.diff(value[mine])) + 1, len(mine))
    tiles = [(at, min(at + TILE, stop)) for start, stop in zip(np.append(0, ends[:-1]), ends) for at in range(start, stop, TILE)]
    for at, to in tiles:
        tile = mine[at:to]
        words, v = a[tile], value[tile[0]]
        own = np.bitwise_count(words).astype(np.int64)
        bound = np.full(len(tile), threshold)
        top = found[0]
        for step, shell in enumerate(masks):
            radius = step + 1 if step else 0
            share = (bound / (1 + bound))[:, None]
            need = np.ceil(share * (own[:, None] + n) - 1e-9).astype(np.int64)
            able = present & (need <= np.minimum(own[:, None], n))
            open_ = able & (own[:, None] + n - 2 * need >= CHUNKS * radius)
            rows = np.flatnonzero(open_.any(axis=1))
            if not len(rows):
                break
            wanted = class_of[np.flatnonzero(open_.any(axis=0))]
            near = (v ^ shell) * CLASSES
            starts = offset[near + wanted[0]]
            sizes = offset[near + wanted[-1] + 1] - starts
            stay = sizes > 0
            starts, sizes = starts[stay], sizes[stay]
            after = np.cumsum(sizes)
            if not len(after):
                continue
            index = np.repeat(starts - after + sizes, sizes) + np.arange(after[-1])
            # need without most of what depends on the fingerprint's count, so that one bound per query is nearly exact
            slope = np.floor(share.mean() * n).astype(np.int8)
            least = np.where(able, need - slope, 127).min(axis=1)[rows].astype(np.int8)[:, None]
            held = [top]
            for begin in range(0, len(index), STRIP):
                some = index[begin : begin + STRIP]
                common = _common(words[None, rows], b_words[None, some], both, counted).view(np.int8)
                hit = np.flatnonzero(common - slope[b_count[some]] >= least)
                if len(hit):
                    i, j = np.divmod(hit, len(some))
                    c, j = common.ravel()[hit].astype(np.float64), some[j]
                    i = rows[i]
                    score = c / np.maximum(own[i] + b_count[j] - c, 1)
                    fits = score >= bound[i]
                    held.append((i[fits], b_order[j[fits]], score[fits]))
            if len(held) > 1:
                top = _best(*(np.concatenate(x) for x in zip(*held)), k)
                full = np.flatnonzero(np.bincount(top[0], minlength=len(tile)) == k)
                bound[full] = top[2][np.searchsorted(top[0], full, "right") - 1]
        i, j, score = top
        first = _first_chunk(words[i] ^ b[j]) == chunk if len(i) else slice(0)
        found.append((tile[i][first], j[first], score[first]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _ids(packed: bytes) -> pa.ChunkedArray:
    return pa.ipc.open_stream(packed).read_all()["id"]


def _meet(batches: Iterable[pa.RecordBatch], threshold: float, k: int | None, types: tuple[pa.DataType, pa.DataType]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("query_id", types[0]), ("id", types[1]), ("score", pa.float64())])
    for batch in batches:
        for row in range(batch.num_rows):
            width, b_width, a_ids, a_bits, b_ids, b_bits = (batch.column(c)[row].as_py() for c in ("a_width", "b_width", "a_ids", "a_bits", "b_ids", "b_bits"))
            if width != b_width:
                continue
            words = lambda raw: np.frombuffer(raw, np.uint64).reshape(-1, width)
            run = batch.column("a_run")[row].as_py()
            if run < 0:
                i, j, score = top_k(words(a_bits), words(b_bits), threshold, k)
            else:
                i, j, score = top_k_by_chunk(words(a_bits)[:, 0], words(b_bits)[:, 0], threshold, k, run % CHUNKS)
            left, right = _ids(a_ids), _ids(b_ids)
            for at in range(0, len(i), 1 << 16):
                some = slice(at, at + (1 << 16))
                table = pa.table([left.take(pa.array(i[some])).cast(types[0]), right.take(pa.array(j[some])).cast(types[1]), pa.array(score[some])], schema=schema)
                yield from table.combine_chunks().to_batches()


def nearest(queries: DataFrame, fingerprints: DataFrame, threshold: float, k: int | None, query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS, chunked_from: int = CHUNKED_FROM) -> DataFrame:
    """query_id, id, score for queries and fingerprints (id, bits: an array of longs): of each block of fingerprints the k best of each query, at or above the threshold.

    Only fingerprints of one width meet.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    queries, fingerprints = (df.where("size(bits) > 0 and not exists(bits, x -> x is null)") for df in (queries, fingerprints))
    sizes = [df.count() for df in (queries, fingerprints)]
    chunked = k is not None and min(sizes) >= chunked_from
    block = CHUNKED_ROWS if chunked else block_rows
    none = F.lit(-1)

    def packed(df: DataFrame, rows: int, name: str) -> DataFrame:
        return checkpointed(df.mapInArrow(lambda b: _pack(b, rows), "run int, width int, ids binary, bits binary")).toDF(*(f"{name}_{c}" for c in ("run", "width", "ids", "bits")))

    if chunked:
        # a query of 64 bits once for each chunk, with those whose chunk has a value of the same part
        value = lambda c: F.shiftrightunsigned(F.get("bits", F.lit(0)), BITS * c).bitwiseAND(F.lit((1 << BITS) - 1))
        each = F.array(*[(c + CHUNKS * F.pmod(value(c), F.lit(PARTS))).cast("int") for c in range(CHUNKS)])
        dealt = queries.withColumn("run", F.explode(F.when(F.size("bits") == 1, each).otherwise(F.array(none)))).repartitionByRange(CHUNKS * PARTS, "run")
    else:
        dealt = queries.withColumn("run", none).repartition(max(1, -(-sizes[0] // query_rows)))
    a = packed(dealt, block if chunked else query_rows, "a")
    b = packed(fingerprints.withColumn("run", none).repartition(max(1, -(-sizes[1] // block))), block, "b")
    types = tuple(to_arrow_type(df.schema["id"].dataType) for df in (queries, fingerprints))
    names = [f"{n} {df.schema['id'].dataType.simpleString()}" for n, df in (("query_id", queries), ("id", fingerprints))]
    return a.crossJoin(b).mapInArrow(lambda x: _meet(x, threshold, k, types), f"{', '.join(names)}, score double")
