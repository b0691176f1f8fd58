"""Checks of a table's size before it is sent to every executor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are sent to every executor at most.
SENT_BYTES = 64 << 20


def sent(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast, if ``rows`` rows of ``row_bytes`` bytes are few enough; else as it is, for Spark to plan by its statistics."""
    return F.broadcast(df) if rows * row_bytes <= SENT_BYTES else df


def blocks(queries: DataFrame, row_bytes: int, most: int = 4096) -> list[DataFrame]:
    """``queries`` in parts by a hash of their ids, each small enough to be sent to every executor."""
    rows = max(1, min(most, SENT_BYTES // row_bytes))
    n = -(-queries.count() // rows)
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k) for k in range(n)] if n > 1 else [queries]


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
