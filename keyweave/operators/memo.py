"""A keyed memo table for costly functions: probe, compute the misses only, append."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyweave.operators.durable import checkpointed
from pyspark.sql import functions as F


def probe(keys: DataFrame, memo: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Known rows with their values (a stored null is a value), and the keys to compute."""
    distinct = keys.select(key).distinct()
    return distinct.join(memo, key), distinct.join(memo.select(key), key, "left_anti")


def memoised(keys: DataFrame, memo: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "key") -> tuple[DataFrame, DataFrame]:
    """All values for the distinct keys, and the new rows to append to the memo. Each miss is computed once, when this is called."""
    known, misses = probe(keys, memo, key)
    new = checkpointed(compute(misses))
    return known.select(*new.columns).unionByName(new), new


class MemoStore:
    """A memo table as Parquet below a shared folder, one folder per service; appends only."""

    def __init__(self, spark: SparkSession, folder: str, service: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, f"{folder.rstrip('/')}/{service}", schema

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def table(self) -> DataFrame:
        files, path = self._folder()
        if not files.exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def clear(self) -> None:
        files, path = self._folder()
        files.delete(path, True)

    def info(self) -> dict[str, int]:
        files, path = self._folder()
        size = files.getContentSummary(path).getLength() if files.exists(path) else 0
        return {"entries": self.table().count(), "bytes": int(size)}

    def export(self, path: str, format: str = "parquet") -> None:
        self.table().write.mode("overwrite").format(format).save(path)

    def load(self, path: str, format: str = "parquet", merge: bool = True) -> None:
        rows = self.spark.read.schema(self.schema).format(format).load(path)
        if not merge:
            self.clear()
        known = self.table()
        key = known.columns[0]
        self.append(rows.join(known.select(key), key, "left_anti").dropDuplicates([key]).select(*known.columns))
