"""Enrichment of tables: resolve each distinct key once, ordered cascades, waterfalls, acceptance tests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.functions.cols import is_missing
from keyweave.operators.durable import checkpointed


def enrich(df: DataFrame, column: str, resolve: Callable[[DataFrame], DataFrame], prefix: str = "kw_") -> DataFrame:
    """df with the columns that resolve returns for its keys, under prefix.

    resolve gets a table (query) of the distinct present keys, trimmed, and returns one row for each,
    with the column query. Rows and columns of df stay; missing keys are never resolved.
    """
    if column not in df.columns:
        raise KeyError(column)
    key = F.when(~is_missing(F.col(column)), F.trim(F.col(column).cast("string")))
    keys = df.select(key.alias("query")).where("query is not null").distinct()
    found = resolve(keys)
    named = found.select(F.col("query").alias("_kw_query"), *[F.col(c).alias(prefix + c) for c in found.columns if c != "query"])
    if clash := sorted({*named.columns} & {*df.columns}):
        raise ValueError(f"columns exist already: {clash}")
    return df.withColumn("_kw_key", key).join(named, F.col("_kw_key") == F.col("_kw_query"), "left").drop("_kw_key", "_kw_query")


Accept = Callable[[], Column]


def resolve_cascade(
    df: DataFrame,
    id_col: str,
    stages: Sequence[tuple[str, str, Callable[[DataFrame], DataFrame]]],
    accept: Accept | None = None,
    prefix: str = "kw_",
    fallback: tuple[str, str] | None = None,
) -> DataFrame:
    """Ordered stages (label, key column, resolve); each sees the rows that are still open and have its key.

    A hit (a row that resolve returns for the key) counts if accept() isn't empty: an array<string>
    Column over df's and the hit's columns. Every row of df gets the hit's columns under prefix, and
    resolved_by (the label, else that of the fallback (label, column) where the column is present, else
    none) and validated_by (what accept said, joined by +). All stages must return the same columns.
    """
    done: DataFrame | None = None
    pending = df
    for label, column, resolve in stages:
        key = F.when(~is_missing(F.col(column)), F.trim(F.col(column).cast("string")))
        keyed = pending.withColumn("_kw_key", key)
        found = resolve(keyed.select(F.col("_kw_key").alias("query")).where("query is not null").distinct())
        named = found.select(F.col("query").alias("_kw_query"), *[F.col(c).alias(prefix + c) for c in found.columns if c != "query"])
        met = keyed.join(named, F.col("_kw_key") == F.col("_kw_query"))
        met = met.withColumn("_kw_said", accept() if accept else F.array().cast("array<string>"))
        ok = met if accept is None else met.where(F.size("_kw_said") > 0)
        ok = ok.withColumns({"resolved_by": F.lit(label), "validated_by": F.nullif(F.array_join("_kw_said", "+"), F.lit(""))}).drop("_kw_key", "_kw_query", "_kw_said")
        ok = checkpointed(ok)  # once: for the result and for the rows that stay open
        done = ok if done is None else done.unionByName(ok)
        pending = pending.join(ok.select(id_col), id_col, "left_anti")
    left = F.when(~is_missing(F.col(fallback[1])), fallback[0]).otherwise("none") if fallback else F.lit("none")
    rest = pending.withColumns({"resolved_by": left, "validated_by": F.lit(None).cast("string")})
    return done.unionByName(rest, allowMissingColumns=True)


def within_tolerance(own: str, found: str, tolerance: float, same: dict[str, tuple[str, str]] | None = None) -> Accept:
    """Accepts a hit whose number is within tolerance of the row's, and says which other columns agree without case."""

    def accept() -> Column:
        near = F.abs(F.col(own) - F.col(found)) <= tolerance
        said = [F.lit("value"), *[F.when(F.lower(F.col(a)) == F.lower(F.col(b)), F.lit(label)) for label, (a, b) in (same or {}).items()]]
        return F.when(near, F.filter(F.array(*said), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))

    return accept


def waterfall(keys: DataFrame, sources: Sequence[tuple[str, DataFrame]], key: str, fields: Sequence[str], until: str, last: int = 0) -> DataFrame:
    """Sources in order; the next one is asked only while the field until is missing. The final ``last`` ones fill in any case.

    A source has one row per key. foundby names the source that filled until.
    """
    out = keys.select(key, *[F.lit(None).cast("string").alias(f) for f in fields], F.lit(None).cast("string").alias("foundby"))
    for i, (name, source) in enumerate(sources):
        right = source.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
        asked = F.lit(True) if i >= len(sources) - last else F.col(until).isNull()
        fills = asked & F.col(until).isNull() & F.col(f"_{until}").isNotNull()
        out = out.join(right, F.col(key) == F.col("_k"), "left").select(
            key, *[F.coalesce(F.col(f), F.when(asked, F.col(f"_{f}").cast("string"))).alias(f) for f in fields], F.coalesce("foundby", F.when(fills, name)).alias("foundby")
        )
    return out
