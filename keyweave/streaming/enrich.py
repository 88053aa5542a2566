"""Extension: enrichment of a stream, batch by batch against static catalogs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keyweave.operators.enrich import enrich


def enrich_stream(stream: DataFrame, column: str, resolve: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, prefix: str = "kw_", once: bool = False) -> StreamingQuery:
    """Each micro-batch goes through enrich and is appended to path as Parquet; a batch that is retried replaces its own folder, so nothing is written twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        enrich(batch, column, resolve, prefix).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
