"""The k closest rows of each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(scored: DataFrame, k: int, by: str = "query_id", order: tuple[str, ...] = ("dist", "vec_id"), rank: str = "rank") -> DataFrame:
    """Rows of rank 1 to ``k`` in each group, closest first, ties by id.

    Each task keeps its own k rows of a group before the shuffle.
    """
    window = Window.partitionBy(by).orderBy(*order)
    return scored.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def merged(parts: list[DataFrame], k: int) -> DataFrame:
    """The k closest rows of each query over several results."""
    out = parts[0].drop("rank")
    for part in parts[1:]:
        out = out.unionByName(part.drop("rank"))
    return top_k(out, k)
