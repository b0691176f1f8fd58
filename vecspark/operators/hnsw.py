"""Hierarchical navigable small-world graphs: one graph for each shard, searched in the shards and merged.

A graph is built by one task from the vectors of one shard, whose size is
bounded by the number of shards; it travels as one binary value.  Everything
between shards (dealing out, merging, re-ranking) is a DataFrame operation.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..workers import ship
from . import ivf, kmeans
from .sizes import blocks, sent, union
from .topk import top_k

#: Vectors that a shard's graph should hold at most.
SHARD_ROWS = 20_000


def _run(found: Iterable[tuple[float, int]], doc_of: dict[int, int], documents: int) -> Iterator[tuple[float, int]]:
    """What stands before the first vector of one document too many."""
    docs: set[int] = set()
    for x in found:
        docs.add(doc_of[x[1]])
        if len(docs) > documents:
            return
        yield x


class Graph:
    """A graph over vectors with labels; ``measured`` counts distances, ``hops`` the nodes that walks went on from."""

    def __init__(self, dim: int, m: int = 16, ef_build: int = 200, metric: str = "l2", seed: int = 100):
        self.m, self.ef_build, self.metric = m, max(ef_build, m), metric
        self.chance = np.random.default_rng(seed)
        self.vectors = np.zeros((16, dim))
        self.labels: list[int] = []
        self.links: list[list[list[int]]] = []  # by node, by level
        self.entry = -1
        self.deleted: set[int] = set()
        self.place: dict[int, int] = {}
        self.measured = self.hops = 0

    def __len__(self) -> int:
        return len(self.labels)

    def far(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        """Distances of some nodes."""
        self.measured += len(nodes)
        x = self.vectors[nodes]
        if self.metric == "l2":
            return ((x - q) ** 2).sum(1)
        return 1 - x @ q

    def _prepared(self, v: Iterable[float]) -> np.ndarray:
        v = np.asarray(v, np.float64)
        return v / (math.sqrt(v @ v) + 1e-30) if self.metric == "cosine" else v

    def _descend(self, q: np.ndarray, level: int) -> int:
        """From the top, the node that no neighbour betters, down to the level above ``level``."""
        at, best = self.entry, self.far(q, [self.entry])[0]
        for upper in range(len(self.links[self.entry]) - 1, level, -1):
            moved = True
            while moved and self.links[at][upper]:
                near = self.far(q, self.links[at][upper])
                k = int(near.argmin())
                moved = near[k] < best
                if moved:
                    at, best = self.links[at][upper][k], near[k]
        return at

    def _beam(self, q: np.ndarray, starts: list[int], level: int, ef: int, allowed: Callable[[int], bool] | None = None, whole: bool = False) -> list[tuple[float, int]]:
        """The ``ef`` closest nodes that a best-first walk meets, closest first; all nodes are walked, allowed ones are kept.

        With ``whole`` (on level 0), where links lead to fewer than ``ef``, the
        walk goes on from the nodes that they don't lead to.
        """
        seen = set(starts)
        first = [(float(d), s) for d, s in zip(self.far(q, starts), starts)]
        waiting = list(first)
        heapq.heapify(waiting)
        kept = [(-d, s) for d, s in first if allowed is None or allowed(s)]
        heapq.heapify(kept)
        while waiting or (whole and len(kept) < ef and len(seen) < len(self)):
            if waiting:
                d, node = heapq.heappop(waiting)
                if len(kept) >= ef and d > -kept[0][0]:
                    break
                self.hops += 1
                new = [x for x in self.links[node][level] if x not in seen]
            else:
                new = self._unmet(seen)
            if not new:
                continue
            seen.update(new)
            for far, x in zip(self.far(q, new).tolist(), new):
                if len(kept) < ef or far < -kept[0][0]:
                    heapq.heappush(waiting, (far, x))
                    if allowed is None or allowed(x):
                        heapq.heappush(kept, (-far, x))
                        if len(kept) > ef:
                            heapq.heappop(kept)
        return sorted((-d, x) for d, x in kept)

    def _unmet(self, met: set[int]) -> list[int]:
        """The nodes that a walk has not met: pruning may leave a node that no other one links to."""
        return [x for x in range(len(self)) if x not in met]

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of nodes, closest first, those that are closer to the middle than to any one taken before."""
        if len(found) <= most:
            return [x for _, x in found]
        taken: list[int] = []
        for d, x in found:
            if not taken or (self.far(self.vectors[x], taken) >= d).all():
                taken.append(x)
                if len(taken) == most:
                    break
        return taken

    def add(self, label: int, vector: Iterable[float], level: int | None = None) -> None:
        """Add a vector; a label that is there gets its place anew with the new vector."""
        if label in self.place:
            self._unlink(self.place[label])
        vector = self._prepared(vector)
        if level is None:
            level = int(-math.log(1 - self.chance.random()) / math.log(self.m))
        node = len(self.labels)
        if node == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[node] = vector
        self.labels.append(label)
        self.links.append([[] for _ in range(level + 1)])
        self.place[label] = node
        if self.entry < 0:
            self.entry = node
            return
        top = len(self.links[self.entry]) - 1
        starts = [self._descend(vector, min(level, top))]
        for at in range(min(level, top), -1, -1):
            found = self._beam(vector, starts, at, self.ef_build)
            most = 2 * self.m if at == 0 else self.m
            chosen = self._spread(found, self.m)
            self.links[node][at] = chosen
            for other in chosen:
                back = self.links[other][at]
                back.append(node)
                if len(back) > most:
                    far = self.far(self.vectors[other], back)
                    self.links[other][at] = self._spread(sorted(zip(far.tolist(), back)), most)
            starts = [x for _, x in found]
        if level > top:
            self.entry = node

    def _unlink(self, node: int) -> None:
        """Hide a node whose label has moved on; the walk still leads through it."""
        self.deleted.add(node)
        self.place.pop(self.labels[node], None)

    def delete(self, label: int) -> None:
        node = self.place[label]
        if node in self.deleted:
            raise ValueError(f"{label} is deleted already")
        self.deleted.add(node)

    def undelete(self, label: int) -> None:
        node = self.place[label]
        if node not in self.deleted:
            raise ValueError(f"{label} is not deleted")
        self.deleted.discard(node)

    def search(self, q: Iterable[float], k: int, ef: int = 10, allowed: Callable[[int], bool] | None = None) -> list[tuple[float, int]]:
        """``(distance, label)`` of k close vectors, closest first; ``allowed`` looks at labels.

        With ``ef`` as large as the graph they are the k closest ones.
        """
        if self.entry < 0:
            return []
        q = self._prepared(q)
        keep = None
        if self.deleted or allowed:
            keep = lambda x: x not in self.deleted and (allowed is None or allowed(self.labels[x]))
        found = self._beam(q, [self._descend(q, 0)], 0, max(ef, k), keep, whole=True)
        return sorted((d, self.labels[x]) for d, x in found)[:k]

    def walk(self, q: Iterable[float], allowed: Callable[[int], bool] | None = None) -> Iterator[tuple[float, int]]:
        """``(distance, label)`` of vectors near ``q``, each time the closest one met and not given out yet.

        The walk goes on from what it gives out, so distances rise but for
        shortcuts found late, and a caller ends it when it has seen enough.  Left
        alone it gives out all vectors, at the end those that links don't lead
        to.  Deleted ones and those not ``allowed`` are walked through only.
        """
        if self.entry < 0:
            return
        q = self._prepared(q)
        start = self._descend(q, 0)
        front, met = [(float(self.far(q, [start])[0]), start)], {start}
        while front or len(met) < len(self):
            if not front:
                new = self._unmet(met)
                met.update(new)
                front = sorted(zip(self.far(q, new).tolist(), new))
            far, node = heapq.heappop(front)
            self.hops += 1
            new = [x for x in self.links[node][0] if x not in met]
            met.update(new)
            for x in zip(self.far(q, new).tolist() if new else [], new):
                heapq.heappush(front, x)
            if node not in self.deleted and (allowed is None or allowed(self.labels[node])):
                yield far, self.labels[node]

    def within(self, q: Iterable[float], radius: float, least: int = 64, most: int | None = None, allowed: Callable[[int], bool] | None = None) -> list[tuple[float, int]]:
        """``(distance, label)`` of vectors within ``radius``, the ``most`` closest ones.

        The walk ends beyond the radius, or beyond ``most`` vectors within it,
        after ``least`` vectors at least.
        """
        inside: list[tuple[float, int]] = []
        edge: list[float] = []  # distances of the ``most`` closest, negative
        for seen, x in enumerate(self.walk(q, allowed)):
            if x[0] <= radius:
                inside.append(x)
                if most is not None:
                    (heapq.heappushpop if len(edge) >= most else heapq.heappush)(edge, -x[0])
            if seen >= least and (x[0] > radius or (most is not None and len(inside) > most and x[0] > -edge[0])):
                break
        return sorted(inside)[:most]

    def documents(self, q: Iterable[float], doc_of: dict[int, int], documents: int, wide: int = 10, allowed: Callable[[int], bool] | None = None) -> list[tuple[float, int]]:
        """``(distance, label)`` of the longest run of closest vectors that has ``documents`` documents at most.

        ``doc_of`` has each label's document.  The walk ends when it has met
        ``wide`` documents, and one more than are wanted.
        """
        found: list[tuple[float, int]] = []
        met: set[int] = set()
        for x in self.walk(q, allowed):
            met.add(doc_of[x[1]])
            if len(met) > max(wide, documents):
                break
            found.append(x)
        return list(_run(sorted(found), doc_of, documents))

    def edges(self) -> Iterator[tuple[int, int, int]]:
        """``level, node, neighbour`` by labels."""
        for node, by_level in enumerate(self.links):
            for level, near in enumerate(by_level):
                for x in near:
                    yield level, self.labels[node], self.labels[x]

    def dumped(self) -> bytes:
        flat = [(node, level, len(near)) for node, by_level in enumerate(self.links) for level, near in enumerate(by_level)]
        out = io.BytesIO()
        np.savez(
            out, vectors=self.vectors[: len(self)], labels=np.array(self.labels, np.int64), shape=np.array(flat, np.int64).reshape(-1, 3),
            near=np.array([x for by_level in self.links for near in by_level for x in near], np.int64), deleted=np.array(sorted(self.deleted), np.int64),
            head=np.array([self.m, self.ef_build, self.entry]), metric=np.array(self.metric),
        )
        return out.getvalue()

    @staticmethod
    def loaded(data: bytes) -> Graph:
        with np.load(io.BytesIO(data)) as x:
            out = Graph(x["vectors"].shape[1], int(x["head"][0]), int(x["head"][1]), str(x["metric"]))
            out.vectors, out.labels, out.entry = x["vectors"].copy(), x["labels"].tolist(), int(x["head"][2])
            if not len(out.vectors):
                out.vectors = np.zeros((16, x["vectors"].shape[1]))
            out.deleted = set(x["deleted"].tolist())
            near, at = x["near"].tolist(), 0
            out.links = [[] for _ in out.labels]
            for node, _, n in x["shape"].tolist():
                out.links[node].append(near[at : at + n])
                at += n
        out.place = {label: node for node, label in enumerate(out.labels)}
        return out


def shard_at_random(base: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``base`` with ``shard``, drawn from a seeded hash of the id."""
    return base.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(shards)).cast("int"))


def shard_in_turn(base: DataFrame, shards: int) -> DataFrame:
    """``base`` with ``shard``: the id modulo the number of shards."""
    return base.withColumn("shard", F.pmod("vec_id", F.lit(shards)).cast("int"))


def shard_by_cluster(base: DataFrame, centroids: kmeans.Centroids) -> DataFrame:
    """``base`` with ``shard``, the nearest centroid."""
    return kmeans.assign(base, centroids).withColumnRenamed("cid", "shard")


def shard_by_hash(base: DataFrame, shards: int) -> DataFrame:
    """``base`` with ``shard`` by the hash of the vector."""
    return D.hash_shards(base, shards)


def _split(sharded: DataFrame) -> DataFrame:
    """``sharded`` with ``part`` and ``parts``: shards of over ``SHARD_ROWS`` vectors are split by a hash of the id."""
    spark = sharded.sparkSession
    large = [(r["shard"], -(-r["n"] // SHARD_ROWS)) for r in sharded.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_ROWS).collect()]
    parts = sent(spark.createDataFrame(large, "shard int, parts int"), len(large), 16) if large else None
    sharded = sharded.withColumn("parts", F.lit(None).cast("int")) if parts is None else sharded.join(parts, "shard", "left")
    return _with_part(sharded.withColumn("parts", F.coalesce("parts", F.lit(1))))


def _with_part(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))


def build(sharded: DataFrame, m: int = 16, ef_build: int = 200, metric: str = "l2", seed: int = 100) -> DataFrame:
    """``shard, part, parts, n, graph`` of ``shard, vec_id, embedding``, each graph built in order of id.

    A shard of over ``SHARD_ROWS`` vectors gets several graphs, so a task never
    holds many more; searches ask all graphs of a shard.
    """

    def one(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
        ids, vectors = table.column("vec_id").to_pylist(), table.column("embedding").to_pylist()
        graph = Graph(len(vectors[0]), m, ef_build, metric, seed)
        for k in order:
            graph.add(ids[k], vectors[k])
        shard, part, parts = (pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("shard", "part", "parts"))
        return pa.table({"shard": shard, "part": part, "parts": parts, "n": pa.array([len(ids)], pa.int64()), "graph": pa.array([graph.dumped()], pa.binary())})

    ship(sharded.sparkSession)
    return _split(sharded.select("shard", "vec_id", "embedding")).groupBy("shard", "part").applyInArrow(one, "shard int, part int, parts int, n long, graph binary")


Asked = Callable[["Graph", list[float], dict | None], list[tuple[float, int]]]


def _of_shards(graphs: DataFrame, rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``graphs`` with the values of the rows (shard, vec_id) of each graph in one array, as many as it has vectors at most."""
    parts = graphs.select("shard", "parts").distinct()
    placed = _with_part(rows.join(parts, "shard")).groupBy("shard", "part").agg(F.collect_list(value).alias(name))
    return graphs.join(placed, ["shard", "part"])


def search_shards(graphs: DataFrame, queries: DataFrame, k: int = 10, ef: int = 50, allowed: DataFrame | None = None) -> DataFrame:
    """``query_id, rank, vec_id, dist``: every shard is searched for every query of a block, the results merged.

    ``allowed`` (shard, vec_id), if given, has the only vectors to be found;
    the walk leads through the others all the same.
    """
    graphs = graphs if allowed is None else _of_shards(graphs, allowed, F.col("vec_id"), "allowed")
    return top_k(_searched(graphs, queries, _k_closest(k, ef)), k).select("query_id", "rank", "vec_id", "dist")


def search_within(graphs: DataFrame, queries: DataFrame, radius: float, least: int = 64, most: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, dist`` of the vectors within ``radius``, or the ``most`` closest of them.

    In each graph the walk ends beyond the radius, after ``least`` vectors at
    least; with ``least`` as large as the largest graph the result is exact.
    """
    found = _searched(graphs, queries, lambda graph, q, _: graph.within(q, radius, least, most))
    if most:
        return top_k(found, most).select("query_id", "rank", "vec_id", "dist")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "vec_id"))).select("query_id", "rank", "vec_id", "dist")


def search_documents(graphs: DataFrame, queries: DataFrame, owners: DataFrame, documents: int, wide: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, doc_id, dist``: the longest run of closest vectors that has ``documents`` documents at most.

    ``owners`` (shard, vec_id, doc_id) has each vector's document.  Every graph
    gives its own run; the run over all is within them, as a graph meets no more
    documents within a distance than all graphs together.  With ``wide`` as
    large as the number of documents the result is exact.
    """
    graphs = _of_shards(graphs, owners, F.struct("vec_id", "doc_id"), "owned")
    found = _searched(graphs, queries, lambda graph, q, doc_of: graph.documents(q, doc_of, documents, wide))
    by_query = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    first = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("dist", "vec_id")) == 1
    runs = found.withColumn("first", first.cast("int")).withColumn("docs", F.sum("first").over(by_query.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("rank", F.row_number().over(by_query)).where(F.col("docs") <= documents).select("query_id", "rank", "vec_id", "doc_id", "dist")


def _k_closest(k: int, ef: int) -> Asked:
    return lambda graph, q, only: graph.search(q, k, ef, None if only is None else only.__contains__)


def _searched(graphs: DataFrame, queries: DataFrame, ask: Asked) -> DataFrame:
    """What ``ask`` finds in each graph, for the queries in ``asked`` (null or no such column: all).

    It gets the graph, a query, and the graph's vectors in ``allowed`` or the
    documents of those in ``owned``, if there is such a column.
    """
    parts = blocks(queries, 8 * 1024)
    if len(parts) > 1:
        return union([_searched(graphs, part, ask) for part in parts])
    table = queries.select("query_id", "q").toArrow()
    ship(graphs.sparkSession)
    spread = graphs.sparkSession.sparkContext.broadcast(dict(zip(table.column("query_id").to_pylist(), table.column("q").to_pylist())))
    owned = "owned" in graphs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cells = {name: batch.column(name)[row] for name in batch.schema.names}
                graph, asked = Graph.loaded(cells["graph"].as_py()), cells["asked"].as_py() if "asked" in cells else None
                only = {label: label for label in cells["allowed"].as_py()} if "allowed" in cells else {x["vec_id"]: x["doc_id"] for x in cells["owned"].as_py()} if owned else None
                wanted = spread.value if asked is None else [query for query in asked if query in spread.value]
                rows = [(query, label, d, *([only[label]] if owned else [])) for query in wanted for d, label in ask(graph, spread.value[query], only)]
                columns = list(zip(*rows)) if rows else [[]] * (4 if owned else 3)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["query_id", "vec_id", "dist", "doc_id"][: len(columns)])

    wanted = [c for c in ("graph", "asked", "allowed", "owned") if c in graphs.columns]
    return graphs.select(*wanted).mapInArrow(run, "query_id long, vec_id long, dist double" + (", doc_id long" if owned else ""))


def search_lists(graphs: DataFrame, queries: DataFrame, centroids: kmeans.Centroids, k: int = 10, nprobe: int = 10, ef: int = 50, base: DataFrame | None = None, factor: int = 3) -> DataFrame:
    """Graphs by cluster (shard = cid): only those near a query are searched.

    With ``base``, ``factor`` times k candidates are re-ranked by their exact
    squared distances.
    """
    asked = ivf.probes(queries, centroids, nprobe).groupBy(F.col("cid").alias("shard")).agg(F.sort_array(F.collect_list("query_id")).alias("asked"))
    most = k * factor if base is not None else k
    best = top_k(_searched(graphs.join(asked, "shard"), queries, _k_closest(most, max(ef, most))), most)
    if base is None:
        return best.select("query_id", "rank", "vec_id", "dist")
    from .pq import rerank

    return rerank(best, base, queries, k, "l2")


def edge_table(graphs: DataFrame) -> DataFrame:
    """``shard, level, node, neighbour`` of all graphs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("graph")):
                rows = list(zip(*((shard, *e) for e in Graph.loaded(data.as_py()).edges()))) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["shard", "level", "node", "neighbour"])

    ship(graphs.sparkSession)
    return graphs.select("shard", "graph").mapInArrow(run, "shard int, level int, node long, neighbour long")


def integrity(edges: DataFrame, most: int = 32) -> DataFrame:
    """``loops, repeats, crowded``: links to a node itself, links twice there, and nodes with over ``most`` links; all should be 0."""
    by_link = edges.groupBy("shard", "level", "node", "neighbour").agg(F.count("*").alias("n"))
    by_node = by_link.groupBy("shard", "level", "node").agg(
        F.sum(F.when(F.col("node") == F.col("neighbour"), 1).otherwise(0)).alias("loops"), F.sum(F.col("n") - 1).alias("repeats"), F.when(F.sum("n") > most, 1).otherwise(0).alias("crowded")
    )
    return by_node.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("loops", "repeats", "crowded")])


def shard_statistics(sharded: DataFrame | Column) -> DataFrame:
    """``shards, least, most, mean`` rows of a shard."""
    counts = sharded.groupBy("shard").agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("shards"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))
