"""Batch lookups: every scalar lookup is a join of a query table with a catalog.

A query table has a key column and any others; the result has at least one row per query, nulls on a
miss. Where a catalog has several rows for a key, the order given decides, so results don't depend on
how rows are stored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.functions.similarity import indel_ratio, may_reach
from keyweave.operators.durable import checkpointed
from keyweave.operators.nearest import nearest

Fold = Callable[[Column], Column]


def first_k(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int | None) -> DataFrame:
    """The first k rows of each group, with their rank from 1; None keeps all."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def lookup(queries: DataFrame, catalog: DataFrame, key: str, on: str, order: Sequence[str], k: int | None = 1, fold: Fold | None = None) -> DataFrame:
    """Left join of queries (distinct keys) with the first k catalog rows of each key; fold (such as F.lower) is applied to both sides."""
    of = fold or (lambda c: c)
    right = catalog.withColumn("_key", of(F.col(on)))
    if k is not None:
        right = first_k(right.where(F.col("_key").isNotNull()), ["_key"], list(order), k).drop("rank")
    left = queries.withColumn("_query_key", of(F.col(key)))
    return left.join(right, F.col("_query_key") == F.col("_key"), "left").drop("_key", "_query_key")


def lookup_cascade(queries: DataFrame, catalog: DataFrame, keys: Sequence[str], on: str, id_col: str, order: Sequence[str]) -> DataFrame:
    """The first of several query keys that the catalog has: raw, then canonical and so on."""
    done, pending = None, queries
    for key in keys:
        found = checkpointed(lookup(pending, catalog, key, on, order))  # once: for the hits and for what is left
        hit = found.where(F.col(on).isNotNull())
        done = hit if done is None else done.unionByName(hit)
        pending = pending.join(hit.select(id_col), id_col, "left_anti")
    rest = pending
    for c in done.columns:
        if c not in rest.columns:
            rest = rest.withColumn(c, F.lit(None).cast(done.schema[c].dataType))
    return done.unionByName(rest)


def exact_or_alias(queries: DataFrame, catalog: DataFrame, key: str, columns: Sequence[str], id_col: str, fold: Fold = F.lower) -> DataFrame:
    """Catalog rows that equal the key in any of the columns: one equi-join for each instead of an OR, then distinct."""
    left = queries.select(fold(F.col(key)).alias("_k"), F.col(key).alias("query")).distinct()
    found = None
    for column in columns:
        hit = left.join(catalog.withColumn("_c", fold(F.col(column))), F.col("_k") == F.col("_c")).drop("_k", "_c")
        found = hit if found is None else found.unionByName(hit)
    return found.distinct()


def contains_pairs(queries: DataFrame, texts: DataFrame, key: str, text: str, id_col: str) -> DataFrame:
    """(key, id) where the text contains the key without regard to case.

    A key is met through its rarest trigram (keys of one or two characters through themselves): only
    texts that have it are compared, which is an equi-join.
    """
    wanted = queries.select(F.lower(F.col(key)).alias("_k"), F.col(key).alias("key")).where("_k <> ''").distinct()
    held = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text)).alias("_t"))
    # only (id, gram) is dealt by grams; texts are joined to the pairs that are left
    size = F.least(F.length("_k"), F.lit(3))
    asked = wanted.select("key", "_k", F.explode(_grams(F.col("_k"), size)).alias("gram"))
    each = None
    for n in (1, 2, 3):
        some = held.where(F.length("_t") >= n).select("id", F.explode(_grams(F.col("_t"), F.lit(n))).alias("gram"))
        some = some.join(asked.select("gram").where(F.length("gram") == n).distinct(), "gram", "left_semi")
        each = some if each is None else each.unionByName(some)
    counts = each.groupBy("gram").count()
    # a key with a gram that no text has can't be contained
    rarest = asked.join(counts, "gram", "left").groupBy("key", "_k").agg(F.min_by("gram", F.struct(F.coalesce("count", F.lit(0)), "gram")).alias("gram"))
    met = rarest.join(each, "gram").select("key", "_k", "id")
    return met.join(held, "id").where(F.contains("_t", "_k")).select("key", "id").distinct()


def _grams(text: Column, n: Column) -> Column:
    """The distinct runs of n characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n)))


def search_top_up(queries: DataFrame, catalog: DataFrame, key: str, first: str, then: str, id_col: str, k: int) -> DataFrame:
    """Up to k catalog ids per key: substring matches of one column, topped up from another, each id once."""
    one = contains_pairs(queries, catalog, key, first, id_col).withColumn("pass", F.lit(1))
    two = contains_pairs(queries, catalog, key, then, id_col).withColumn("pass", F.lit(2))
    best = one.unionByName(two).groupBy("key", "id").agg(F.min("pass").alias("pass"))
    return first_k(best, ["key"], ["pass", "id"], k)


def pattern_search(catalog: DataFrame, column: str, like: str, order: Sequence[str], limit: int | None = None, case_sensitive: bool = False) -> DataFrame:
    """Rows whose column is LIKE the pattern, the first limit ones in order."""
    found = catalog.where(F.col(column).like(like) if case_sensitive else F.col(column).ilike(like))
    return found.orderBy(*order).limit(limit) if limit is not None else found


def prefix_lookup(queries: DataFrame, catalog: DataFrame, key: str, on: str, length: int, id_col: str, k: int) -> DataFrame:
    """Catalog rows that share the first length characters with a key: an equi-join on the prefix."""
    left = queries.select(F.col(key).alias("query"), F.substring(key, 1, length).alias("prefix")).where(F.length("prefix") == length).distinct()
    right = catalog.withColumn("prefix", F.substring(on, 1, length))
    return first_k(left.join(right, "prefix"), ["query"], [id_col], k)


def fuzzy_top_n(queries: DataFrame, names: DataFrame, key: str, name: str, cutoff: float = 80.0, n: int = 5, process: Fold | None = None, salts: int = 16) -> DataFrame:
    """query, name, score, rank: per query the n best names with indel ratio >= cutoff, ties by name.

    Distinct names only. Pairs come from an equi-join on (length, salt): a query asks for those lengths of
    names that the cutoff allows, once for each salt, so no task gets all names of a length. Then a
    Levenshtein bound, which loses nothing, and the exact ratio for what is left.
    """
    of = process or (lambda c: c)
    share = min(1.0, 1 - cutoff / 100)
    right = names.select(F.col(name).alias("name"), of(F.col(name)).alias("_b")).where("_b is not null").distinct()
    # the lengths that names have: at most as many as the longest name has characters
    lengths = sorted(r[0] for r in right.select(F.length("_b")).distinct().collect())
    right = right.withColumn("_length", F.length("_b")).withColumn("_salt", F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int"))
    left = queries.select(F.col(key).alias("query"), of(F.col(key)).alias("_a")).where("_a is not null").distinct()
    # |len a - len b| <= share x (len a + len b)
    possible = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: F.abs(n - F.length("_a")) <= share * (n + F.length("_a")) + 1e-9)
    left = left.withColumn("_length", F.explode(possible)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    near = left.join(right, ["_length", "_salt"]).where(may_reach(F.col("_a"), F.col("_b"), cutoff))
    scored = near.withColumn("score", indel_ratio("_a", "_b")).where(F.col("score") >= cutoff - 1e-9)
    return first_k(scored.select("query", "name", "score"), ["query"], [F.desc("score"), "name"], n)


def exact_then_fuzzy(queries: DataFrame, names: DataFrame, key: str, name: str, norm: Fold, cutoff: float = 80.0, n: int = 5) -> DataFrame:
    """query, name, score, rank, match_method: exact names first; only queries without one are widened to fuzzy ones."""
    left = queries.select(F.col(key).alias("query")).where("query is not null").distinct()
    held = names.select(F.col(name).alias("name")).distinct()
    exact = left.withColumn("_k", norm(F.col("query"))).join(held.withColumn("_n", norm(F.col("name"))), F.col("_k") == F.col("_n")).select("query", "name", F.lit(100.0).alias("score"))
    exact = first_k(exact, ["query"], ["name"], n).withColumn("match_method", F.lit("exact_name"))
    pending = left.join(exact.select("query"), "query", "left_anti")
    wider = fuzzy_top_n(pending, held, "query", "name", cutoff, n, norm).withColumn("match_method", F.lit("fuzzy_name"))
    return exact.unionByName(wider)


def tanimoto_top_k(queries: DataFrame, fingerprints: DataFrame, id_col: str, bits: str, threshold: float, k: int | None) -> DataFrame:
    """query_id, id, score, rank: per query the k fingerprints with Tanimoto >= threshold, ties by id.

    bits is a long, or an array of longs for fingerprints of any size (2,048 bits are 32 longs);
    fingerprints without a bit meet nothing. Blocks of queries meet blocks of fingerprints, so the
    work is that of all pairs whose bit counts allow the score, a word operation each.
    """
    whole = lambda df: F.col(bits) if df.schema[bits].dataType.typeName() == "array" else F.array(bits)
    held = lambda df: df.select(F.col(id_col).alias("id"), whole(df).alias("bits")).where("exists(bits, x -> x <> 0)")
    return first_k(nearest(held(queries), held(fingerprints), threshold, k), ["query_id"], [F.desc("score"), "id"], k)


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, ancestor) over any number of steps, each pair once; a node on a cycle is its own ancestor.

    Round k joins the pairs that are exactly 2^k steps apart with all pairs found so far, so n steps
    take about log2 n rounds, until one finds nothing new.
    """
    known = checkpointed(edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).distinct())
    hop = known
    while True:
        step = hop.select("node", F.col("ancestor").alias("_via"))
        further = known.select(F.col("node").alias("_via"), "ancestor")
        new = checkpointed(step.join(further, "_via").select("node", "ancestor").distinct().join(known, ["node", "ancestor"], "left_anti"))
        if new.isEmpty():
            return known
        known = checkpointed(known.unionByName(new))
        hop = checkpointed(step.join(hop.select(F.col("node").alias("_via"), "ancestor"), "_via").select("node", "ancestor").distinct())
