"""Similarity of names, fingerprints and candidate records."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _indel(a: str, b: str) -> float:
    """200 x the longest common subsequence over the summed lengths, bit-parallel over the characters of a."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100; null if either is null."""
    return pd.Series([None if x is None or y is None else _indel(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 for names that are equal after trimming and lower-casing, else the Ratcliff-Obershelp ratio; 0 for a missing one."""

    return pd.Series([_ratcliff(x, y) for x, y in zip(a, b)], dtype="float64")


def _ratcliff(x: str | None, y: str | None) -> float:
    if not x or not y:
        return 0.0
    x, y = x.strip().lower(), y.strip().lower()
    return 1.0 if x == y else SequenceMatcher(None, x, y).ratio()


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def name_matrix(names: pd.Series) -> pd.Series:
    """Of an array of names, text_similarity of each with each (in this order: the ratio isn't symmetric)."""
    return pd.Series([[[_ratcliff(x, y) for y in row] for x in row] for row in names])


@F.pandas_udf(T.DoubleType())
def best_name_score(query: pd.Series, names: pd.Series) -> pd.Series:
    """The highest indel ratio, in [0, 1] and with case, of a query and an array of names; 0 without any name."""
    return pd.Series([max((_indel(q, n) for n in ns if n), default=0.0) / 100 if q is not None else 0.0 for q, ns in zip(query, names)], dtype="float64")


def _partial(a: str, b: str) -> float:
    """The highest ratio of the shorter text with a part of the longer one of its length, or shorter at the ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    n, best = len(a), 0.0
    for start in range(1 - n, len(b)):
        part = b[max(0, start) : start + n]
        best = max(best, _indel(a, part))
        if best == 100.0:
            break
    return best


def _token_set(a: str, b: str) -> float:
    """The highest ratio of the words that both have with and without the words that one has, all in order."""
    x, y = {*a.split()}, {*b.split()}
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    joined = [" ".join(w) for w in (both, both + left, both + right)]
    pairs = [(joined[1], joined[2])] + ([(joined[0], joined[1]), (joined[0], joined[2])] if both else [])
    return max(_indel(u, v) for u, v in pairs)


def _token_sort(a: str, b: str) -> float:
    return _indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _token_ratio(a: str, b: str) -> float:
    return max(_token_sort(a, b), _token_set(a, b))


def _partial_token_ratio(a: str, b: str) -> float:
    x, y = {*a.split()}, {*b.split()}
    if x & y:
        return 100.0
    return max(_partial(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), _partial(" ".join(sorted(x)), " ".join(sorted(y))))


def _weighted(a: str, b: str) -> float:
    """The whole ratio, or one that allows for order (times 0.95) or, where one text is 1.5 times as long, for parts (times 0.9, from 8 times as long 0.6)."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = _indel(a, b)
    if longer < 1.5:
        return max(best, 0.95 * _token_ratio(a, b))
    scale = 0.9 if longer <= 8 else 0.6
    return max(best, scale * _partial(a, b), 0.95 * scale * _partial_token_ratio(a, b))


def _quick(a: str, b: str) -> float:
    return _indel(a, b) if a and b else 0.0


#: Scorers of two names, 0 to 100, by the names that users know them by.
SCORERS = {"ratio": _indel, "partial_ratio": _partial, "token_sort_ratio": _token_sort, "token_set_ratio": _token_set, "token_ratio": _token_ratio, "WRatio": _weighted, "QRatio": _quick}


def scorer(name: str):
    """The scorer of that name as a function of two columns; null if either is null."""
    score = SCORERS[name]

    @F.pandas_udf(T.DoubleType())
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="float64")

    return scored


def may_reach(a: Column, b: Column, cutoff: float) -> Column:
    """Lossless filter before indel_ratio >= cutoff: first by length, then by the builtin Levenshtein distance, which stops at its threshold.

    indel >= levenshtein, and ratio >= c means indel <= (1 - c / 100) x (|a| + |b|).
    """
    allowed = F.lit(1 - cutoff / 100) * (F.length(a) + F.length(b)) + F.lit(1e-9)
    near = F.call_function("levenshtein", a, b, F.floor(allowed).cast("int")) >= 0  # -1 beyond it
    return (F.abs(F.length(a) - F.length(b)) <= allowed) & near


def default_process(c: Column) -> Column:
    """Lower case, other characters than letters and digits to spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", " "))


def token_sort(c: Column) -> Column:
    """The words in order, for a ratio that ignores their order."""
    return F.array_join(F.array_sort(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")), " ")


def tanimoto(a: Column, b: Column) -> Column:
    """Of two fingerprints as array<bigint>; 0 if neither has a bit."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(either > 0, both / either).otherwise(0.0)


def sign_bits(vector: str) -> Column:
    """The signs of a vector column as one long: bit i is set if element i is positive; 64 elements at most."""
    return F.expr(f"aggregate(transform({vector}, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")


#: Field -> weight of an agreement of two candidate records.
FIELD_WEIGHTS = {"cas": 3.0, "canonical_smiles": 4.0, "inchikey": 3.0, "inchi": 2.0, "formula": 1.0, "mass": 2.0, "name": 1.0}


def candidate_similarity(left: str | Column, right: str | Column, name_similarity: Column | None = None) -> Column:
    """Weighted agreement in [0, 1] of two candidates, each a struct or the prefix of its columns.

    Only fields present on both sides count. Registry numbers agree if the sets overlap, masses fully
    within 0.2 and by half within 1.0. A name counts if its similarity is positive: fully from 0.9, by
    half from 0.7; without name_similarity that of two names is 1 if they are equal without case, else 0.
    """
    c = lambda side, f: F.col(f"{side}{f}") if isinstance(side, str) else side[f]
    gains: list[tuple[Column, Column, float]] = []
    for field, weight in FIELD_WEIGHTS.items():
        a, b = c(left, field), c(right, field)
        if field == "cas":
            gains.append(((F.size(a) > 0) & (F.size(b) > 0), F.arrays_overlap(a, b).cast("double"), weight))
        elif field == "mass":
            gap = F.abs(a - b)
            gains.append((gap.isNotNull(), F.when(gap <= 0.2, 1.0).when(gap <= 1.0, 0.5).otherwise(0.0), weight))
        elif field == "name":
            same = name_similarity if name_similarity is not None else (F.lower(F.trim(a)) == F.lower(F.trim(b))).cast("double")
            gains.append((F.coalesce(same, F.lit(0.0)) > 0, F.when(same >= 0.9, 1.0).when(same >= 0.7, 0.5).otherwise(0.0), weight))
        else:
            gains.append((a.isNotNull() & b.isNotNull(), (a == b).cast("double"), weight))
    total = sum((F.when(on, w).otherwise(0.0) for on, _, w in gains), F.lit(0.0))
    gained = sum((F.when(on, g * w).otherwise(0.0) for on, g, w in gains), F.lit(0.0))
    return F.when(total > 0, gained / total).otherwise(0.0)
