"""Connected components of a graph of any size, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _least(edges: DataFrame) -> DataFrame:
    """Each edge ``u, v`` with the least node next to ``u``."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the nodes of ``edges`` (u, v: long); a component is named by its least node.

    Stars of neighbours are contracted by turns towards the least node seen from
    above (larger neighbours) and from below (smaller ones), until each
    component is a star around its least node.  The number of rounds grows with
    the logarithm of a component's size.  Every round works on one row for each
    edge and is written to the shared folder.  Loops and repeated edges do no
    harm; an empty table gives an empty result.
    """
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "components", few=True)
    seen = None
    while now.limit(1).count():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        found = _least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        now = stage(found, "components", few=True)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    tops = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
