"""Multi-label classification with a memo, and maps from names to classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.operators.memo import memoised

#: A model: a batch of structures to {class id: score} each, None where it can't tell.
Predict = Callable[[list[str]], list[dict[str, float] | None]]


def predicted(keys: DataFrame, predict: Predict) -> DataFrame:
    """key, structure -> key, labels map<string,double>; null labels where the model has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "labels": predict(b["structure"].tolist())})

    return keys.select("key", "structure").mapInPandas(run, "key string, labels map<string,double>")


def classify(rows: DataFrame, predict: Predict, memo: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """rows (structure, inchikey) with labels, and the new memo rows; only keys that the memo (key, labels) lacks are predicted.

    The key is the InChIKey, or the structure where there is none, with the model's version.
    """
    key = F.concat_ws("::", F.coalesce("inchikey", "structure"), F.lit(version))
    keyed = rows.withColumn("_key", key)
    distinct = keyed.groupBy(F.col("_key").alias("key")).agg(F.min("structure").alias("structure"))
    found, new = memoised(distinct, memo, lambda misses: predicted(misses.join(distinct, "key"), predict))
    return keyed.join(found.withColumnRenamed("key", "_key"), "_key", "left").drop("_key"), new


def _short(score: Column) -> Column:
    """Six significant digits without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6g", score), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def label_columns(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """labels as pipe-joined ids and scores, and names if a table (id, name) is given; ids in order."""
    ids = F.array_sort(F.map_keys("labels"))
    out = rows.withColumn("class_ids", F.array_join(ids, "|")).withColumn("class_scores", F.array_join(F.transform(ids, lambda i: _short(F.col("labels")[i])), "|"))
    if names is None:
        return out
    # names by the distinct ids of each list of classes: a join by id, whatever the number of names
    lists = out.select("class_ids").where("class_ids <> ''").distinct()
    each = lists.select("class_ids", F.posexplode(F.split("class_ids", r"\|")).alias("_at", "_id")).join(names.select(F.col("id").alias("_id"), F.col("name").alias("_name")), "_id", "left")
    found = F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_name", "_id").alias("_name"))))
    named = each.groupBy("class_ids").agg(F.array_join(F.transform(found, lambda x: x["_name"]), "|").alias("class_names"))
    return out.join(named, "class_ids", "left").withColumn("class_names", F.when(F.col("class_ids") == "", "").otherwise(F.col("class_names"))).select(*out.columns, "class_names")


def to_labels(rows: DataFrame, key: str, level: str, order: str) -> DataFrame:
    """key -> value of level; of repeated keys the last in order wins."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(level, order).alias(level))


def element_classes(nodes: DataFrame, elements: DataFrame, pattern: str, id_col: str = "id", name_col: str = "name", aliases: dict[str, str] | None = None) -> DataFrame:
    """number -> class id: the element's name is group 1 of pattern in a node's name; the last id wins. Nodes without a name are skipped."""
    word: Column = F.nullif(F.regexp_extract(F.lower(name_col), pattern, 1), F.lit(""))
    for alias, element in (aliases or {}).items():
        word = F.when(word == alias, element).otherwise(word)
    named = nodes.where(F.col(name_col).isNotNull()).select(F.col(id_col).alias("class_id"), word.alias("element"))
    return named.join(elements, "element").groupBy("number").agg(F.max("class_id").alias("class_id"))
