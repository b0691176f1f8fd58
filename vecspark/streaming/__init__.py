"""Vectors that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions import distance as D
from ..operators import flat, mutable


def upserts(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Upsert batches of ``vec_id, embedding`` into versions of a table under ``path``.

    Each batch writes the folder ``v<batch>`` from the one before, so a batch
    that is repeated after a failure writes the same version again.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base = spark.read.parquet(f"{path}/v{number - 1}") if number else spark.createDataFrame([], batch.schema)
        mutable.upsert(base, batch).write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def knn_of_stream(base: DataFrame, k: int, metric: str | D.Distance = "ip") -> Callable[[DataFrame, int], DataFrame]:
    """A function for ``foreachBatch`` that finds the k closest vectors of ``base`` for each arriving query (query_id, q)."""

    def search(batch: DataFrame, number: int) -> DataFrame:
        return flat.knn(base, batch, k, metric)

    return search
