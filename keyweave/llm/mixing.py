"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the budget by its weight, but no more than max_epochs times its own
size; what it cannot take is shared out among the others by weight until no share is above its cap.
The level that does so is found by rounds over the table of sources: those that the level fills are
set to their cap, the rest of the budget is shared by the rest of the weights. A document is then
taken floor(target / size) times, and a seeded part of each source once more: a hash puts documents
in order and deals them to buckets, whole buckets are taken while they fit, and in the bucket where the
quota ends (and the next) each document that still fits. No task or driver ever holds a source, and
nothing orders all sources or all buckets of a source in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.llm.common import checkpointed, text_or_empty, word_count

#: Documents in a bucket of a source's order, and buckets in a group of buckets, about.
BUCKET_ROWS, GROUP_BUCKETS = 4096, 4096
#: A table of sources of up to so many rows and picked documents is broadcast, so that texts aren't dealt by source; a larger one is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_PICKS = 100_000, 1_000_000
#: The fill of a quota ends where less than this share of a source's target is left.
CLOSE = 0.005


def _order(id_col: str, text_col: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the document alone, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string"), text_or_empty(text_col), F.lit(seed)), 11) / F.lit(float(2**53))


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes (one row per source) with the rank of each source in code point order, null last: a range sort, and one count for each of its partitions."""
    dealt = sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    dealt = checkpointed(dealt)
    before, at = {}, 0
    for r in dealt.groupBy("part").count().orderBy("part").collect():  # one row for each partition
        before[r["part"]], at = at, at + r["count"]
    if not before:
        return dealt.withColumn("rank", F.lit(0).cast("long")).drop("part")
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    first = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv])
    return dealt.withColumn("rank", (within + first[F.col("part").cast("long")]).cast("long")).drop("part")


def targets(sizes: DataFrame, weights: Sequence[float], budget_share: float, max_epochs: float) -> DataFrame:
    """For each row (source, source_size, n) its target; weights repeat over the sources in code point order, null last.

    Each round raises the level and fills more sources, so there are at most as many as there are
    different ratios of cap to weight below the last level; two numbers for each reach the driver.
    """
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % n + 1).cast("int"))
    at = _ranked(sizes).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs))
    at = checkpointed(at)
    budget = (at.agg(F.sum("source_size")).first()[0] or 0) * float(budget_share)
    level, seen = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        caps, rest, count = at.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if not rest or count == seen:
            break
        level, seen = max(level, (budget - (caps or 0.0)) / rest), count
    target = F.least("cap", F.col("weight") * F.lit(level)) if rest else F.col("cap")
    return at.select("source", "source_size", "n", target.alias("target"))


def _fill(group: pd.DataFrame) -> pd.DataFrame:
    """Of a source's units in order: up to which one they are taken, and which of those before it are not.

    Each unit that still fits into what is left is taken, until that is close enough; at the end the
    smallest one left out, if going over is nearer than staying short.
    """
    group = group.sort_values(["u", "size"], kind="stable")
    us, sizes = group["u"].to_numpy(), group["size"].to_numpy()
    left, close, taken = float(group["left"].iloc[0]), float(group["close"].iloc[0]), []
    for i, size in enumerate(sizes):
        if left <= close:
            break
        if 0 < size <= left:
            left -= size
            taken.append(i)
    out = sorted({i for i in range(len(sizes)) if sizes[i] > 0} - {*taken}, key=lambda i: (sizes[i], i))
    if out and sizes[out[0]] - left < left:
        taken = sorted([*taken, out[0]])
    if not taken:
        return pd.DataFrame({"source": [], "cut": [], "skipped": []}, dtype=object)  # no numbers: Arrow makes no lists of them
    skipped = us[sorted({*range(taken[-1])} - {*taken})].tolist()
    return pd.DataFrame({"source": [group["source"].iloc[0]], "cut": [us[taken[-1]]], "skipped": [skipped]})


#: What plan() adds, under its prefix.
ADDED = ("size", "source_size", "target", "times")


def prefix_of(columns: Sequence[str]) -> str:
    """The prefix of plan()'s columns: _mx_, with more underscores in front where docs has a column that begins with it."""
    prefix = "_mx_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def _quotas(slim: DataFrame, shares: DataFrame, small: bool) -> DataFrame:
    """For each source (at) with a quota: the bucket in which it ends, and up to which u and without which u's the documents from there on are taken.

    Buckets are summed by source, group of buckets and bucket; running sums go over the groups of a
    source, then over the buckets of the group where the quota ends.
    """
    quota = shares.where("quota > 0").select(F.col("at").alias("of"), "quota", "buckets", "target")
    dealt = slim.join(F.broadcast(quota) if small else quota, slim["source"].eqNullSafe(F.col("of")))
    dealt = dealt.withColumn("bucket", F.floor(F.col("u") * F.col("buckets"))).withColumn("cluster", F.floor(F.col("bucket") / GROUP_BUCKETS))
    sums = checkpointed(dealt.groupBy("of", "quota", "target", "cluster", "bucket").agg(F.sum("size").alias("sum")))

    def ending(rows: DataFrame, by: str, left: str) -> DataFrame:
        """The first group or bucket of each source that does not fit whole, and what is left for it."""
        before = F.coalesce(F.sum("sum").over(Window.partitionBy("of").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        state = rows.withColumn("rest", F.col(left) - before).where("sum > rest and rest > 0")
        return state.groupBy("of").agg(F.min(F.struct(by, "rest")).alias("end"))

    groups = sums.groupBy("of", "quota", "cluster").agg(F.sum("sum").alias("sum"))
    last = ending(groups, "cluster", "quota").select(F.col("of").alias("of_"), F.col("end")["cluster"].alias("cluster_"), F.col("end")["rest"].alias("rest_"))
    inside = sums.join(last, sums["of"].eqNullSafe(F.col("of_")) & (F.col("cluster") == F.col("cluster_")))
    ends = checkpointed(ending(inside, "bucket", "rest_").select(F.col("of").alias("of_"), F.col("end")["bucket"].alias("end"), F.col("end")["rest"].alias("left")))
    # the bucket where the quota ends and the next one: small documents may follow a long one that doesn't fit
    near = dealt.join(F.broadcast(ends) if small else ends, F.col("of").eqNullSafe(F.col("of_")) & F.col("bucket").between(F.col("end"), F.col("end") + 1))
    units = near.groupBy("source", "u", "left", "target").agg(F.sum("size").cast("long").alias("size")).withColumn("close", F.col("target") * CLOSE)
    picked = units.groupBy("source").applyInPandas(_fill, "source string, cut double, skipped array<double>")
    picked = picked.select(F.col("source").alias("of"), "cut", "skipped")
    return ends.join(picked, F.col("of_").eqNullSafe(F.col("of")), "left").select(F.col("of_").alias("of"), "end", "cut", "skipped")


def plan(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    budget_share: float = 1.5,
    max_epochs: float = 2,
    seed: int = 42,
    id_col: str = "doc_id",
    bucket_rows: int = BUCKET_ROWS,
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """docs with its columns plus size, source_size, target, times (how often the mix repeats the row) under prefix_of(docs.columns).

    A null text has no words. Rows equal in id and text are taken alike. A source without words has
    target 0 and is not taken; in other sources rows without words are repeated as whole epochs and
    whole buckets are. The words taken of a source miss its target by CLOSE of it, or by half the
    smallest document left out of the bucket where the quota ends and the next, at most. An empty
    table stays empty.
    """
    p = prefix_of(docs.columns)
    own = docs.withColumns({p + "size": word_count(text_or_empty(text_col)), p + "u": _order(id_col, text_col, seed), p + "of": F.col(source_col).cast("string")})
    slim = checkpointed(own.select(F.col(p + "of").alias("source"), F.col(p + "size").alias("size"), F.col(p + "u").alias("u")))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = targets(sizes, weights, budget_share, max_epochs).withColumn("epochs", epochs)
    shares = checkpointed(
        shares.select(
            F.col("source").alias("at"),
            "source_size",
            "target",
            F.floor("epochs").alias("whole"),
            ((F.col("epochs") - F.floor("epochs")) * F.col("source_size")).alias("quota"),
            F.ceil(F.col("n") / bucket_rows).alias("buckets"),
        )
    )
    small = shares.count() <= BROADCAST_ROWS
    table = shares.join(_quotas(slim, shares, small), F.col("at").eqNullSafe(F.col("of")), "left")
    table = checkpointed(table.select(*[F.col(c).alias(p + "s_" + c) for c in ("at", "source_size", "target", "whole", "quota", "buckets", "end", "cut", "skipped")]))
    if small and (table.agg(F.sum(F.size(p + "s_skipped"))).first()[0] or 0) <= BROADCAST_PICKS:
        table = F.broadcast(table)
    at = own.join(table, F.col(p + "of").eqNullSafe(F.col(p + "s_at")))
    s = lambda c: F.col(p + "s_" + c)
    u = F.col(p + "u")
    bucket = F.floor(u * s("buckets"))
    picked = (bucket >= s("end")) & (u <= s("cut")) & ~F.array_contains(s("skipped"), u)
    # without an end the quota is the whole source, but for rounding
    more = F.when(s("quota") <= 0, False).otherwise(F.coalesce((bucket < s("end")) | picked, s("end").isNull()))
    times = (s("whole") + F.when(more, 1).otherwise(0)).cast("int")
    return at.select(*docs.columns, p + "size", s("source_size").alias(p + "source_size"), s("target").alias(p + "target"), times.alias(p + "times"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed rows, each as often as the plan says, with the columns of docs."""
    planned = plan(docs, **settings)
    return planned.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col(prefix_of(docs.columns) + "times")))).select(*docs.columns)
