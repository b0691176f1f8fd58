"""Inverted lists: vectors by nearest centroid, searched in the lists near a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from .kmeans import Centroids, assign, with_centroids
from .sizes import blocks, union
from .topk import top_k


def build(base: DataFrame, centroids: Centroids) -> DataFrame:
    """``vec_id, embedding, cid``; written with ``partitionBy('cid')``, a search reads its lists only."""
    return assign(base.select("vec_id", "embedding"), centroids)


def probes(queries: DataFrame, centroids: Centroids, nprobe: int = 10) -> DataFrame:
    """``query_id, rank, cid, dist`` of the ``nprobe`` nearest centroids of each query, ties by cid."""
    near = F.array_sort(F.transform("centroids", lambda c: F.struct(D.squared_l2(F.col("q"), c["c"]).alias("dist"), c["cid"].alias("cid"))))
    found = with_centroids(queries, centroids).select("query_id", F.posexplode(F.slice(near, 1, min(nprobe, len(centroids)))).alias("at", "x"))
    return found.select("query_id", (F.col("at") + 1).alias("rank"), "x.cid", "x.dist")


def search(index: DataFrame, queries: DataFrame, chosen: DataFrame, k: int = 10, metric: str | D.Distance = "l2", lists: int = 1024) -> DataFrame:
    """The k closest vectors of the lists ``chosen`` (query_id, cid) for each query.

    Queries and what they ask for go to the vectors, in blocks of checked size
    (``lists`` bounds the lists of a query), so the index stays where it is.
    """
    measure = D.metric(metric)
    return top_k(at_lists(index, queries, chosen.select("query_id", "cid"), 16 * lists).withColumn("dist", measure(F.col("q"), F.col("embedding"))), k).select("query_id", "rank", "vec_id", "dist")


def at_lists(index: DataFrame, queries: DataFrame, chosen: DataFrame, asked_bytes: int, query_bytes: int = 8 * 1024, by: str = "cid") -> DataFrame:
    """``index`` joined by ``by`` with ``chosen`` (query_id, by), and with the queries' other columns.

    Both travel to the index, for one block of queries after the other;
    ``asked_bytes`` bounds what is chosen for a query, ``query_bytes`` its row.
    """
    parts = blocks(queries, asked_bytes + query_bytes)
    found = []
    for part in parts:
        asked = chosen if len(parts) == 1 else chosen.join(F.broadcast(part.select("query_id")), "query_id", "left_semi")
        found.append(index.join(F.broadcast(asked), by).join(F.broadcast(part), "query_id"))
    return union(found)


def pruned(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """``index`` with a literal list of the chosen cids, for the scan to skip the files of all other lists.

    The list has one entry for each list of the index at most.
    """
    cids = [r["cid"] for r in chosen.select("cid").distinct().collect()]
    return index.where(F.col("cid").isin(cids))


def add(index: DataFrame, more: DataFrame, centroids: Centroids) -> DataFrame:
    """The index with more vectors."""
    return index.unionByName(build(more, centroids))


def grouped_queries(found: DataFrame, batch: int = 64) -> list[list[int]]:
    """Queries in groups that probe similar lists.

    The first query left begins a group and takes the ones that share most lists
    with it, ties by query id.  The order is serial by nature: this runs on the
    driver, over the probes of one block of queries (``search_in_groups``).
    """
    lists = {r["query_id"]: set(r["cids"]) for r in found.groupBy("query_id").agg(F.collect_set("cid").alias("cids")).collect()}
    left, groups = sorted(lists), []
    while left:
        seed = left.pop(0)
        left_by = sorted(left, key=lambda q: (-len(lists[seed] & lists[q]), q))[: batch - 1]
        groups.append([seed, *left_by])
        left = [q for q in left if q not in set(left_by)]
    return groups


def shared_probes(found: DataFrame, batch: int, nprobe: int) -> DataFrame:
    """For each query, the lists of its group: the 2 nprobe ones that most of its queries probe, ties by cid."""
    spark = found.sparkSession
    members = [(g, q) for g, group in enumerate(grouped_queries(found, batch)) for q in group]
    groups = F.broadcast(spark.createDataFrame(members, "grp int, query_id long"))
    counts = found.join(groups, "query_id").groupBy("grp", "cid").agg(F.count("*").alias("n"))
    best = counts.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "cid"))).where(F.col("place") <= 2 * nprobe)
    return best.join(groups, "grp").select("query_id", "cid")


def search_in_groups(index: DataFrame, queries: DataFrame, centroids: Centroids, k: int = 10, nprobe: int = 10, batch: int = 64) -> DataFrame:
    """Every query scans the lists that its group shares; groups are made within blocks of 1024 queries or a few more."""
    found = [search(index, part, shared_probes(probes(part, centroids, nprobe), batch, nprobe), k, lists=2 * nprobe) for part in blocks(queries, 8 * 1024, 1024)]
    return union(found)
