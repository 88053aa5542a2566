"""Near-duplicates by the Jaccard similarity of word shingles: SimHash candidates, then exact verification.

The method is that of simhash.py, with settings for a Jaccard similarity of 0.8. A set of shingles
has a fingerprint of WORDS x 64 bits, cut into segments of 2 bits; the Manhattan distance of two
vectors of segment popcounts (a bit count of their unary codes) is a lower bound of the Hamming
distance. Sets at similarity 0.8 differ in 15 % of the bits, very small ones in up to 19 %, unrelated
ones in half. RADIUS is the distance that a pair at FLIPS exceeds with probability 1e-8; at 64 bits 3 % of all
unrelated pairs would lie within it, at 384 bits none do. No choice of agreeing segments is selective
at that radius, so the grid is one of sizes: similar sets have similar sizes, and points meet those
of their own and the next size class. Candidates chain into coarse components; the texts of
each meet in a task, which compares the shingle sets themselves and returns a spanning forest of the
links. Large size classes and components are split into blocks, each pair of blocks a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import checkpointed, fresh, text_or_empty
from keyweave.llm.components import components
from keyweave.llm.simhash import _LOW, _forest

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
WORDS, FLIPS, MISS = 6, 0.19, 1e-8


def _radius(bits: int, flips: float, miss: float) -> int:
    """The least distance that is exceeded with less than that probability."""
    left = 1.0
    for r in range(bits):
        left -= comb(bits, r) * flips**r * (1 - flips) ** (bits - r)
        if left < miss:
            return r
    return bits


RADIUS = _radius(64 * WORDS, FLIPS, MISS)
#: Points of a size class that a task compares with as many others, points that it compares at once, pairs that it holds.
POINT_ROWS, TILE, STRIP, HELD = 1 << 14, 64, 1 << 13, 1 << 19
#: Texts and bytes that a block of a component holds, about.
BLOCK_ROWS, BLOCK_BYTES = 512, 8 << 20


def shingles(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of words; fewer words make one run, no word none."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes.lower() changes A-Z only
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = len(words) - shingle + 1
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), (ends[shingle - 1 :] - 1).tolist())), np.uint64, n)


def _mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Each hash as WORDS independent ones."""
    rng = np.random.default_rng(seed)
    salts, odd = rng.integers(0, 1 << 63, (2, WORDS), np.uint64)
    x = (hashes[:, None] ^ salts) * (odd | np.uint64(1))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprint(hashes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """WORDS words; a bit is set if it is set in more than half of the distinct hashes."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 255):
        bits = np.unpackbits(_mixed(hashes[at : at + 255], seed).view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def unary(fps: np.ndarray) -> np.ndarray:
    """The 2-bit segment popcounts in unary: 0, 1, 3 for 0, 1, 2 set bits."""
    odd, even = (fps >> np.uint64(1)) & np.uint64(_LOW), fps & np.uint64(_LOW)
    return ((odd & even) << np.uint64(1)) | (odd | even)


def _keys(batches: Iterable[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingles(x, shingle, seed)) for x in batch.column(2).to_pylist()]
        fps = np.concatenate([np.zeros((0, WORDS), np.uint64), *(fingerprint(x, seed)[None] for x in sets)]).view(np.int64)
        columns = [batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(f) for f in fps.T)]
        yield pa.record_batch(columns, names=["id", "key", "n", *(f"f{w}" for w in range(WORDS))])


def _near(table: pa.Table, similarity: float, radius: int) -> pa.Table:
    """Of one block, or between two, the pairs of similar size within the radius, as a forest."""
    side, n = table["side"].to_numpy(), table["n"].to_numpy()
    whole = (table["class_a"][0].as_py(), table["block_a"][0].as_py()) == (table["class_b"][0].as_py(), table["block_b"][0].as_py())
    order = np.argsort(n, kind="stable")
    left, right = (order, order) if whole else (order[side[order] == 0], order[side[order] == 1])
    fps = np.stack([table[f"f{w}"].to_numpy().view(np.uint64) for w in range(WORDS)])
    codes_a, codes_b = unary(fps[:, left]), unary(fps[:, right])
    size_b = n[right]
    words, each, total = np.empty(TILE * STRIP, np.uint64), np.empty(TILE * STRIP, np.uint8), np.empty(TILE * STRIP, np.uint8)
    a, b, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for at in range(0, len(left), TILE):
        rows = left[at : at + TILE]
        first, last = np.searchsorted(size_b, n[rows[0]] * similarity - 1e-6), np.searchsorted(size_b, n[rows[-1]] / similarity + 1e-6, "right")
        for start in range(max(first, at) if whole else first, last, STRIP):
            stop = min(start + STRIP, last)
            shape, room = (len(rows), stop - start), len(rows) * (stop - start)
            differ, count, distance = words[:room].reshape(shape), each[:room].reshape(shape), total[:room].reshape(shape)
            distance[:] = 0
            for x, y in zip(codes_a, codes_b):
                np.bitwise_xor(x[at : at + TILE, None], y[None, start:stop], out=differ)
                np.add(distance, np.bitwise_count(differ, out=count), out=distance)  # a sum over 255 wraps, which lets through more
            i, j = np.divmod(np.flatnonzero(distance <= radius), shape[1])
            i, j, up = rows[i], right[start + j], at + i < start + j
            i, j = (i[up], j[up]) if whole else (i, j)
            fits = np.zeros(len(i), np.int64)
            for f in fps:
                fits += np.bitwise_count(f[i] ^ f[j])
            a.append(i[fits <= radius])
            b.append(j[fits <= radius])
            held += len(a[-1])
            if held > HELD:
                x, y = _forest(np.concatenate(a), np.concatenate(b), len(n))
                a, b, held = [x], [y], len(x)
    x, y = _forest(np.concatenate(a), np.concatenate(b), len(n))
    keys = table["key"].to_numpy()
    return pa.table({"a": keys[x], "b": keys[y]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def candidates(points: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, point_rows: int = POINT_ROWS) -> DataFrame:
    """Edges (a, b) between keys of points (key, n, f0 and so on; distinct keys) that connect all pairs of similar size within the radius."""
    # a little wider than the similarity, so that sizes on its edge are in neighbouring classes; without shingles in one of its own
    width = float(-np.log(similarity)) + 1e-4
    points = points.withColumn("class", F.when(F.col("n") > 0, F.floor(F.log(F.col("n").cast("double")) / width)).otherwise(-2).cast("int"))
    # about a hundred numbers: classes grow by a factor
    blocks = {c: -(-n // point_rows) for c, n in points.groupBy("class").count().collect()}
    number = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c_ in blocks.items() for x in c_]), c), F.lit(0)) if blocks else F.lit(0)
    at = points.withColumn("own", F.pmod(F.xxhash64("key"), F.greatest(number(F.col("class")), F.lit(1))).cast("int"))
    run = lambda k, l, i, j, side: F.struct(k.alias("class_a"), l.alias("class_b"), i.cast("int").alias("block_a"), j.cast("int").alias("block_b"), side.cast("int").alias("side"))
    own, here = F.col("own"), F.col("class")
    others = lambda c: F.filter(F.sequence(F.lit(0), F.greatest(number(c), F.lit(1)) - 1), lambda j: j < number(c))
    # block i meets block j of its class in the run (i, j), and each block of the classes before and after
    met = F.concat(
        F.transform(others(here), lambda j: run(here, here, F.least(own, j), F.greatest(own, j), own > j)),
        F.transform(others(here + 1), lambda j: run(here, here + 1, own, j, F.lit(0))),
        F.transform(others(here - 1), lambda j: run(here - 1, here, j, own, F.lit(1))),
    )
    runs = at.select("key", "n", *(f"f{w}" for w in range(WORDS)), F.explode(met).alias("run")).select("*", "run.*").drop("run")
    return runs.groupBy("class_a", "class_b", "block_a", "block_b").applyInArrow(lambda t: _near(t, similarity, radius), "a long, b long")


def _verify(table: pa.Table, shingle: int, seed: int, similarity: float) -> pa.Table:
    """The links of one component or pair of blocks, as a forest."""
    keys, side = table["key"].to_numpy(), table["side"].to_numpy()
    sets = [np.unique(shingles(x, shingle, seed)) for x in table["text"].to_pylist()]
    size = np.array([len(x) for x in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.concatenate([[0], np.cumsum(size)])
    have = np.zeros(len(code) + 1, bool)
    whole = table["block_a"][0].as_py() == table["block_b"][0].as_py()
    a, b = [], []
    for i in range(len(sets)):
        if not whole and side[i]:
            continue
        own = code[first[i] : first[i + 1]]
        have[own] = True
        hits = np.concatenate([[0], np.cumsum(have[code])])
        common = hits[first[1:]] - hits[first[:-1]]
        have[own] = False
        either = size + size[i] - common
        near = np.flatnonzero((common >= similarity * either - 1e-9) & ((np.arange(len(sets)) > i) if whole else (side == 1)))
        a.append(np.full(len(near), i))
        b.append(near)
    x, y = _forest(np.concatenate(a), np.concatenate(b), len(sets)) if a else (np.zeros(0, np.int64),) * 2
    return pa.table({"a": keys[x], "b": keys[y]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def links(docs: DataFrame, points: DataFrame, shingle: int, similarity: float, seed: int, block_rows: int, point_rows: int) -> DataFrame:
    """Edges (a, b) between keys that connect what pairs of that similarity connect."""
    coarse = checkpointed(components(candidates(points, similarity, RADIUS, point_rows)))
    texts = docs.join(coarse, docs["key"] == coarse["node"]).groupBy("key", "component").agg(F.first("text").alias("text"))
    texts = checkpointed(texts)
    counted = texts.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    at = texts.join(counted, "component").withColumn("blocks", F.greatest("blocks", F.lit(1)))
    # block i meets block j in the run (i, j); a component of one block is the run (0, 0)
    at = at.withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    runs = at.select("component", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"), "key", "text", (F.col("own") > F.col("other")).cast("int").alias("side"))
    return runs.groupBy("component", "block_a", "block_b").applyInArrow(lambda t: _verify(t, shingle, seed, similarity), "a long, b long")


def classes(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS, point_rows: int = POINT_ROWS
) -> DataFrame:
    """One row per document: its id and component_id (the smallest id reachable over links, its own included).

    Two documents are linked where their shingle sets have that Jaccard similarity; those without
    words are linked with each other. Rows without an id get the component of the rows linked to
    them, null if none of these has an id. An empty table gives an empty result.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"the radius is laid out for a similarity of {SIMILARITY} or more")
    text = text_or_empty(text_col)
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    bits = [f"f{w}" for w in range(WORDS)]
    each = checkpointed(named.mapInArrow(lambda b: _keys(b, shingle, seed), f"id long, key long, n long, {', '.join(f'{f} long' for f in bits)}"))
    points = each.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", *bits)])
    edges = links(named.select("key", "text"), points, shingle, similarity, seed, block_rows, point_rows)
    found = components(edges.distinct())
    # NO id sorts behind every other one
    none = F.lit(2**63 - 1)
    points = each.groupBy("key").agg(F.min(F.coalesce("id", none)).alias("least"))
    label = points.join(found, points["key"] == found["node"], "left").select("key", "least", F.coalesce("component", "key").alias("component"))
    least = label.groupBy("component").agg(F.min("least").alias("component_id"))
    by_key = label.join(least, "component").select("key", F.nullif(F.col("component_id"), none).alias("component_id"))
    return each.select("id", "key").join(by_key, "key").select(F.col("id").alias(id_col), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs whose id is their component's id, all columns, whatever their names.

    Rows that repeat an id all stay or go together. Rows without an id go where their component has
    an id, and all stay where it has none, near copies included, as nothing names one of them.
    """
    found = classes(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **settings)
    (own,) = fresh(docs.columns, "_nd_id")
    stay = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(own)).distinct()
    return docs.join(stay, docs[id_col].cast("long").eqNullSafe(stay[own]), "left_semi")
