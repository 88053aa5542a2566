"""SimHash near-duplicates by segment popcounts.

A fingerprint is cut into 32 segments of 2 bits and mapped to its vector of segment popcounts
(0, 1 or 2). The Manhattan distance of two such vectors never exceeds the Hamming distance of the
fingerprints, so it is a lower bound to search by. Written in unary (each segment's bits sorted), the
vector is again 64 bits, and the Manhattan distance of two vectors is the number of bits in which
their unary codes differ.

The grid: the 32 coordinates are dealt into radius + k groups. Two vectors within the radius differ
in at most radius groups, so at least k groups agree; a cell is a set of k groups with the
popcounts in it, and a vector lies in one cell for each set. More groups make more copies of each
vector, but sharper cells (k = 2, 3, 4 select one in about 2,300, 19,000 and 88,000 unrelated pairs),
so k grows with the number of vectors and the pairs compared stay far below its square; whatever k
is, no pair is lost. The points of a cell are range-joined
under the Manhattan distance, survivors are verified on the fingerprints. Equal fingerprints are
folded before the grid. Cells with more than CELL_ROWS points are split into blocks, each pair of
blocks a task of its own, and a task returns a spanning forest of the links it finds instead of all
pairs, so the output stays linear where thousands of near copies share a cell.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import checkpointed, fresh, text_or_empty
from keyweave.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Points of a cell that one task compares; larger cells are split into blocks of this size.
CELL_ROWS = 4096
_LOW = 0x5555555555555555


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if it is set in more than half of the shingles' XXH64; no word gives zero."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = len(words) - shingle + 1
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), (ends[shingle - 1 :] - 1).tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and fp (the 64 bits as a long). A null text has no words."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, shingle, seed) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(found)], schema=schema)

    named = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col))
    return named.mapInArrow(run, "id long, fp long").withColumnRenamed("id", id_col)


def unary(fp: Column) -> Column:
    """The 2-bit segment popcounts in unary: 0, 1, 3 for 0, 1, 2 set bits."""
    low = F.lit(_LOW)
    odd = F.shiftrightunsigned(fp, 1)
    both, any_ = fp.bitwiseAND(odd).bitwiseAND(low), fp.bitwiseOR(odd).bitwiseAND(low)
    return F.shiftleft(both, 1).bitwiseOR(any_)


def selectivity(radius: int, agree: int) -> float:
    """The share of unrelated pairs that meet, once for each cell: two segments agree with probability 3/8."""
    groups = radius + agree
    sizes = [32 // groups + (g < 32 % groups) for g in range(groups)]
    return sum((3 / 8) ** sum(c) for c in combinations(sizes, agree))


def agreeing_groups(points: int, radius: int = RADIUS) -> int:
    """How many groups must agree: where copies (about 1.5 microseconds each) and comparisons (about 2 nanoseconds) cost least for so many points."""
    cost = lambda k: comb(radius + k, k) * 1.5 + points * selectivity(radius, k) * 0.002
    return min(range(2, max(3, min(9, 33 - radius))), key=cost)


def cell_masks(radius: int = RADIUS, agree: int = 2) -> list[int]:
    """Of every choice of so many of the radius + agree groups of segments, the bits; as signed longs."""
    n = radius + agree
    groups = [sum(3 << (2 * s) for s in range(32) if s % n == g) for g in range(n)]
    return [int(np.array(sum(c), np.uint64).view(np.int64)) for c in combinations(groups, agree)]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (smallest index, index) of the components of the edges a-b over range(n)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    leaf = np.flatnonzero(label != np.arange(n))
    return label[leaf], leaf


def _close(fp: np.ndarray, code: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs are links: the Manhattan distance as a lower bound, then the Hamming distance."""
    near = np.flatnonzero(np.bitwise_count(code[i] ^ code[j]) <= radius)
    return near[np.bitwise_count(fp[i[near]] ^ fp[j[near]]) <= radius]


def _pairs_in_runs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs within runs, shift by shift, vectorised over the runs that are long enough."""
    run_of = np.repeat(np.arange(len(starts)), sizes)
    at = np.repeat(starts, sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    last = starts + sizes
    shift = 1
    while len(at):
        keep = at + shift < last[run_of]
        at, run_of = at[keep], run_of[keep]
        yield at, at + shift
        shift += 1


def _link(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, block_a, block_b): the links within each run, as forests."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[pa.RecordBatch] = []

    def work(table: pa.Table) -> pa.RecordBatch:
        names = ("pair", "cell", "block_a", "block_b")
        keys = [table[n].to_numpy() for n in names]
        rep, fp, side = (table[n].to_numpy() for n in ("rep", "fp", "side"))
        fp = fp.view(np.uint64)
        odd = (fp >> np.uint64(1)) & np.uint64(_LOW)
        even = fp & np.uint64(_LOW)
        code = ((odd & even) << np.uint64(1)) | (odd | even)
        n = len(rep)
        new = np.ones(n, bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        whole = keys[2][starts] == keys[3][starts]
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        short = (sizes > 1) & (sizes <= 64) & whole
        for i, j in _pairs_in_runs(starts[short], sizes[short]):
            near = _close(fp, code, i, j, radius)
            a.append(i[near])
            b.append(j[near])
        for start, size, same in zip(starts[(sizes > 1) & ~short], sizes[(sizes > 1) & ~short], whole[(sizes > 1) & ~short]):
            inside = np.arange(start, start + size)
            left = inside if same else inside[side[inside] == 0]
            right = inside if same else inside[side[inside] == 1]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            step = max(1, (1 << 21) // max(1, len(right)))
            for at in range(0, len(left), step):
                rows = left[at : at + step]
                i, j = np.nonzero(np.bitwise_count(code[rows][:, None] ^ code[right][None, :]) <= radius)
                i, j = rows[i], right[j]
                keep = i < j if same else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
                near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
                x, y = _forest(i[near] - start, j[near] - start, size)
                found.append((x + start, y + start))
            a += [x for x, _ in found]
            b += [y for _, y in found]
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        nodes, at = np.unique(rep[np.concatenate([i, j])], return_inverse=True)
        x, y = _forest(at[: len(i)], at[len(i) :], len(nodes))
        return pa.record_batch([pa.array(nodes[x]), pa.array(nodes[y])], schema=schema)

    def flush(upto_last_run: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        cut = table.num_rows
        if upto_last_run:
            last = [table[n][cut - 1].as_py() for n in ("pair", "cell", "block_a", "block_b")]
            same = np.all([table[n].to_numpy() == v for n, v in zip(("pair", "cell", "block_a", "block_b"), last)], axis=0)
            cut = int(np.argmax(same))
        if cut:
            yield work(table.slice(0, cut))
        held = table.slice(cut).to_batches()

    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 200_000:
            yield from flush(True)
            rows = sum(x.num_rows for x in held)
    yield from flush(False)


def links(points: DataFrame, radius: int = RADIUS, cell_rows: int = CELL_ROWS, agree: int | None = None) -> DataFrame:
    """Edges (a, b) between the reps of points (rep, fp; distinct fp) that connect what links within radius connect; agree is chosen by their number if not given."""
    code = unary(F.col("fp"))
    masks = cell_masks(radius, agreeing_groups(points.count(), radius) if agree is None else agree)
    grid = points.select("rep", "fp", F.posexplode(F.array(*[code.bitwiseAND(F.lit(m)) for m in masks])).alias("pair", "cell"))
    counted = grid.groupBy("pair", "cell").agg(F.count("*").alias("n")).where("n > 1")
    at = grid.join(counted, ["pair", "cell"])
    # block i meets block j in the run (i, j); a cell of one block is the run (0, 0)
    blocks = F.ceil(F.col("n") / cell_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    at = at.select("pair", "cell", "rep", "fp", blocks.alias("blocks"), own.alias("own"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    runs = at.select(
        "pair", "cell", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"), "rep", "fp", (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    keys = ["pair", "cell", "block_a", "block_b"]
    sorted_ = runs.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(lambda b: _link(b, radius), "a long, b long").distinct()


def classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, fingerprint (16 hex digits), component_id (the smallest id reachable over links, its own included).

    Documents without words have fingerprint zero and are linked like any other. Rows without an id
    get a fingerprint and the component of the rows linked to them; it is null if none of these has
    an id. Repeated ids give a row each. An empty table gives an empty result.
    """
    each = checkpointed(fingerprints(docs, shingle, seed, id_col, text_col))
    # NO id sorts behind every other one
    none = F.lit(2**63 - 1)
    points = checkpointed(each.groupBy("fp").agg(F.min(F.coalesce(F.col(id_col), none)).alias("least")))
    # ids may repeat over fingerprints, so the fingerprint itself is the node; its order doesn't matter
    edges = links(points.select(F.col("fp").alias("rep"), "fp"), radius)
    found = components(edges)
    label = points.join(found, points["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = label.groupBy("component").agg(F.min("least").alias("component_id"))
    named = label.join(least, "component").select(F.col("fp").alias("_fp"), F.nullif(F.col("component_id"), none).alias("component_id"))
    return each.join(named, each["fp"] == named["_fp"]).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs whose id is their component's id, all columns, whatever their names.

    Rows that repeat an id all stay or go together. Rows without an id go where their component has
    an id, and all stay where it has none, near copies included, as nothing names one of them.
    """
    found = classes(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **settings)
    (own,) = fresh(docs.columns, "_sh_id")
    stay = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(own)).distinct()
    return docs.join(stay, docs[id_col].cast("long").eqNullSafe(stay[own]), "left_semi")
