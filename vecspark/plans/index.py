"""Index objects: a space, a dimension, vectors by id, and search.

Objects are handles on tables.  Every change makes new tables, so a search that
was planned before goes on with what it saw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as D
from ..operators import flat, hnsw, hybrid, ivf, kmeans, mutable, pq
from ..sources.store import Store

VECTORS = "vec_id long, embedding array<double>"


class FlatIndex:
    """Exact search over upserted vectors, with hard deletes."""

    def __init__(self, spark: SparkSession, space: str, dim: int):
        D.metric(space)
        self.spark, self.space, self.dim = spark, space, dim
        self.base: DataFrame | None = None
        self.deleted: DataFrame | None = None
        self.most = 0

    def init_index(self, max_elements: int) -> None:
        if self.base is not None:
            raise RuntimeError("the index is there already")
        self.most = max_elements
        self.base = self.spark.createDataFrame([], VECTORS)
        self.deleted = self.spark.createDataFrame([], "vec_id long")

    def _ready(self) -> DataFrame:
        if self.base is None:
            raise RuntimeError("the index has to be made first")
        return self.base

    def _checked(self, items: DataFrame) -> DataFrame:
        """The items as ``vec_id, embedding``; raises for nulls, NaN and other dimensions."""
        rows = items.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        wrong = F.col("vec_id").isNull() | F.col("embedding").isNull() | (F.size("embedding") != self.dim) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
        if rows.where(wrong).limit(1).count():
            raise ValueError(f"every vector needs an id and {self.dim} numbers")
        return rows.withColumn("embedding", D.normalized(F.col("embedding"))) if self.space == "cosine" else rows

    def add_items(self, items: DataFrame) -> None:
        """Add vectors; those with known ids take their places and are no longer deleted."""
        items = self._checked(items)
        base = mutable.upsert(self._ready(), items)
        if base.count() > self.most:
            raise RuntimeError(f"the index holds {self.most} vectors at most")
        self.base = base
        self.deleted = self.deleted.join(items, "vec_id", "left_anti")

    def delete_vector(self, vec_id: int) -> None:
        """Remove a vector; an unknown id doesn't matter."""
        self.base = self._ready().where(F.col("vec_id") != vec_id)

    def get_items(self, ids: list[int] | None = None) -> DataFrame:
        if isinstance(ids, int):
            raise ValueError("ids come as a list")
        return mutable.vectors(self._ready(), ids, self.deleted)

    def get_ids_list(self) -> DataFrame:
        """All ids, deleted ones too."""
        return self._ready().select("vec_id")

    @property
    def element_count(self) -> int:
        return self._ready().count()

    @property
    def max_elements(self) -> int:
        return self.most

    def resize_index(self, max_elements: int) -> None:
        if max_elements < self.element_count:
            raise ValueError("the index has more vectors than that")
        self.most = max_elements

    def _search(self, queries: DataFrame, k: int, allowed: Column | None) -> DataFrame:
        return flat.knn(self._ready(), queries, k, self.space, allowed, deleted=self.deleted)

    def knn_query(self, queries: DataFrame, k: int = 1, filter: Column | None = None, strict: bool = False) -> DataFrame:
        """``query_id, rank, vec_id, dist``; with ``strict`` it is an error if a query has fewer than k results."""
        found = self._search(queries, k, filter)
        if strict:
            full = found.groupBy("query_id").count().where(F.col("count") == k).count()
            if full < queries.count():
                raise RuntimeError(f"a query has fewer than {k} results")
        return found

    def parameters(self) -> dict:
        return {"space": self.space, "dim": self.dim, "most": self.most}

    def save(self, path: str) -> None:
        Store(self.spark, path).save({"base": self._ready(), "deleted": self.deleted}, self.parameters())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FlatIndex:
        tables, parameters = Store(spark, path).load()
        index = cls(spark, parameters["space"], parameters["dim"])
        index.most, index.base, index.deleted = parameters["most"], tables["base"], tables["deleted"]
        return index


class GraphIndex(FlatIndex):
    """Approximate search by one graph for each shard, with soft deletes.

    Changed shards are built anew when they are next searched.  ``ef`` is a
    parameter of searches and not stored.
    """

    def __init__(self, spark: SparkSession, space: str, dim: int, m: int = 16, ef_construction: int = 200, shards: int = 1, seed: int = 100):
        super().__init__(spark, space, dim)
        self.m, self.ef_construction, self.shards, self.seed, self.ef = m, ef_construction, shards, seed, 10
        self.graphs: DataFrame | None = None
        self.stale: list[int] = list(range(shards))

    def _sharded(self) -> DataFrame:
        return hnsw.shard_at_random(self._ready(), self.shards, self.seed)

    def _mark_stale(self, ids: DataFrame) -> None:
        found = hnsw.shard_at_random(ids, self.shards, self.seed).select("shard").distinct().collect()
        self.stale = sorted({*self.stale, *(r["shard"] for r in found)})

    def add_items(self, items: DataFrame, replace_deleted: bool = False) -> None:
        """Add vectors; with ``replace_deleted`` new ones first take the places of deleted ones."""
        if replace_deleted:
            items = self._checked(items)
            gone = self.deleted
            self.base, self.deleted = mutable.replaced(self._ready(), self.deleted, items)
            self._mark_stale(gone)
            if self.base.count() > self.most:
                raise RuntimeError(f"the index holds {self.most} vectors at most")
        else:
            super().add_items(items)
        self._mark_stale(items)

    def mark_deleted(self, ids: DataFrame) -> None:
        self.deleted = mutable.marked(self.deleted, ids, self._ready())

    def unmark_deleted(self, ids: DataFrame) -> None:
        self.deleted = mutable.unmarked(self.deleted, ids)

    def deleted_count(self) -> int:
        return self.deleted.count()

    def _built(self) -> DataFrame:
        """The graphs of all shards, those of changed ones new."""
        if self.stale:
            new = hnsw.build(self._sharded().where(F.col("shard").isin(self.stale)), self.m, self.ef_construction, "cosine" if self.space == "cosine" else self.space, self.seed)
            old = None if self.graphs is None else self.graphs.where(~F.col("shard").isin(self.stale))
            graphs = new if old is None else old.unionByName(new)
            kept = graphs.checkpoint() if self.spark.sparkContext.getCheckpointDir() else graphs.persist()  # in the shared folder, graphs outlive their executors
            self.graphs, self.stale = kept, []
        return self.graphs

    def _search(self, queries: DataFrame, k: int, allowed: Column | None) -> DataFrame:
        keep = None
        if allowed is not None or self.deleted.limit(1).count():
            rows = mutable.alive(self._sharded(), self.deleted)
            keep = (rows.where(allowed) if allowed is not None else rows).select("shard", "vec_id")
        return hnsw.search_shards(self._built(), queries, k, max(self.ef, k), keep)

    def parameters(self) -> dict:
        return super().parameters() | {"m": self.m, "ef_construction": self.ef_construction, "shards": self.shards, "seed": self.seed}

    def save(self, path: str) -> None:
        Store(self.spark, path).save({"base": self._ready(), "deleted": self.deleted, "graphs": self._built()}, self.parameters())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphIndex:
        tables, p = Store(spark, path).load()
        index = cls(spark, p["space"], p["dim"], p["m"], p["ef_construction"], p["shards"], p["seed"])
        index.most, index.base, index.deleted, index.graphs, index.stale = p["most"], tables["base"], tables["deleted"], tables["graphs"], []
        return index

    def rebuilt(self) -> GraphIndex:
        """An index of the same vectors whose graphs are all new."""
        index = GraphIndex(self.spark, self.space, self.dim, self.m, self.ef_construction, self.shards, self.seed)
        index.most, index.base, index.deleted = self.most, self.base, self.deleted
        return index


class LazyIndex(GraphIndex):
    """An index that begins to exist with its first vectors; before, searches find nothing."""

    def __init__(self, spark: SparkSession, space: str, dim: int, max_elements: int = 1024, **options):
        super().__init__(spark, space, dim, **options)
        self.first_most = max_elements

    def add_items(self, items: DataFrame, replace_deleted: bool = False) -> None:
        if self.base is None:
            self.init_index(self.first_most)
        super().add_items(items, replace_deleted)

    def knn_query(self, queries: DataFrame, k: int = 1, filter: Column | None = None, strict: bool = False) -> DataFrame:
        if self.base is None:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, dist double")
        return super().knn_query(queries, k, filter, strict)


class LabelledIndex:
    """Search by labels of any type: a table ``label, vec_id`` beside an index."""

    def __init__(self, index: FlatIndex, labels: DataFrame):
        self.index, self.labels = index, labels

    def knn_query(self, queries: DataFrame, k: int = 1) -> DataFrame:
        return self.index.knn_query(queries, k).join(self.labels, "vec_id").select("query_id", "rank", "label", "dist")


# Searches with a stored index: built with the first call, read again afterwards


def _centroids_of(table: DataFrame) -> kmeans.Centroids:
    return [(r["cid"], list(r["c"])) for r in table.orderBy("cid").collect()]


def ivf_search(path: str, base: DataFrame, queries: DataFrame, k: int = 10, nprobe: int = 16, clusters: int = 1024) -> DataFrame:
    """Inverted lists by squared distance; only the files of probed lists are read."""

    def build() -> tuple[dict[str, DataFrame], dict]:
        centroids = kmeans.train(base, clusters)
        return {"centroids": kmeans.centroid_table(base.sparkSession, centroids), "lists": ivf.build(base, centroids)}, {}

    tables, _ = Store(base.sparkSession, path).get_or_build(build, {"kind": "ivf", "clusters": clusters}, {"lists": "cid"})
    chosen = ivf.probes(queries, _centroids_of(tables["centroids"]), nprobe)
    return ivf.search(ivf.pruned(tables["lists"], chosen), queries, chosen, k)


def pq_search(path: str, base: DataFrame, queries: DataFrame, k: int = 10, rerank: int = 100, m: int = 8, ks: int = 256, rounds: int = 20) -> DataFrame:
    """Codes scored by inner product, ``rerank`` of them re-ranked."""

    def build() -> tuple[dict[str, DataFrame], dict]:
        book = pq.train(base, m, ks, rounds)
        return {"book": book.table(base.sparkSession), "codes": pq.encode_by_product(base.select("vec_id", "embedding"), book).drop("embedding")}, {}

    tables, _ = Store(base.sparkSession, path).get_or_build(build, {"kind": "pq", "m": m, "ks": ks})
    return pq.search(tables["codes"], base, queries, pq.Codebook.of_table(tables["book"]), k, rerank)


def ivfpq_search(path: str, base: DataFrame, queries: DataFrame, k: int = 10, nprobe: int = 9, candidates: int = 710, clusters: int | None = None, m: int = 8, ks: int = 256, rounds: int = 20) -> DataFrame:
    """Inverted lists of quantized residuals."""
    clusters = clusters or kmeans.list_count(base.count())

    def build() -> tuple[dict[str, DataFrame], dict]:
        centroids = kmeans.train(base, clusters)
        book = hybrid.train(base, centroids, m, ks, rounds)
        return {"centroids": kmeans.centroid_table(base.sparkSession, centroids), "book": book.table(base.sparkSession), "lists": hybrid.build(base, centroids, book)}, {}

    tables, _ = Store(base.sparkSession, path).get_or_build(build, {"kind": "ivfpq", "clusters": clusters, "m": m, "ks": ks}, {"lists": "cid"})
    return hybrid.search(tables["lists"], queries, _centroids_of(tables["centroids"]), pq.Codebook.of_table(tables["book"]), k, nprobe, candidates)


def pq_ivf_search(path: str, base: DataFrame, queries: DataFrame, k: int = 10, nprobe: int = 16, clusters: int = 1024, m: int = 8, ks: int = 256, rounds: int = 20) -> DataFrame:
    """Inverted lists over codes (experimental)."""

    def build() -> tuple[dict[str, DataFrame], dict]:
        book = pq.train(base, m, ks, rounds)
        centroids, lists = hybrid.code_lists(pq.encode(base.select("vec_id", "embedding"), book), clusters, rounds)
        return {"centroids": kmeans.centroid_table(base.sparkSession, centroids), "book": book.table(base.sparkSession), "lists": lists}, {}

    tables, _ = Store(base.sparkSession, path).get_or_build(build, {"kind": "pq-ivf", "clusters": clusters, "m": m, "ks": ks}, {"lists": "cid"})
    return hybrid.search_code_lists(tables["lists"], queries, _centroids_of(tables["centroids"]), pq.Codebook.of_table(tables["book"]), k, nprobe)


def ivf_hnsw_search(path: str, base: DataFrame, queries: DataFrame, k: int = 10, nprobe: int = 16, ef: int = 50, rerank: bool = True, clusters: int | None = None, m: int = 16, ef_construction: int = 200) -> DataFrame:
    """A graph for each cluster; the clusters near a query are searched."""
    clusters = clusters or kmeans.list_count(base.count(), "ivfhnsw")

    def build() -> tuple[dict[str, DataFrame], dict]:
        centroids = kmeans.train(base, clusters)
        return {"centroids": kmeans.centroid_table(base.sparkSession, centroids), "graphs": hnsw.build(hnsw.shard_by_cluster(base, centroids), m, ef_construction)}, {}

    tables, _ = Store(base.sparkSession, path).get_or_build(build, {"kind": "ivf-hnsw", "clusters": clusters, "m": m})
    return hnsw.search_lists(tables["graphs"], queries, _centroids_of(tables["centroids"]), k, nprobe, ef, base if rerank else None)


def sharded_hnsw_search(path: str, base: DataFrame, queries: DataFrame, k: int = 10, ef: int = 50, shards: int | None = None, strategy: str = "random", m: int = 16, ef_construction: int = 200) -> DataFrame:
    """A graph for each shard; all shards are searched, each for max(2 k, ef) candidates."""
    shards = shards or max(2, -(-base.count() // hnsw.SHARD_ROWS))

    def build() -> tuple[dict[str, DataFrame], dict]:
        ways = {
            "random": lambda: hnsw.shard_at_random(base, shards), "in_turn": lambda: hnsw.shard_in_turn(base, shards), "hash": lambda: hnsw.shard_by_hash(base, shards),
            "kmeans": lambda: hnsw.shard_by_cluster(base, kmeans.train(base, shards)),
        }
        return {"graphs": hnsw.build(ways[strategy](), m, ef_construction)}, {}

    tables, _ = Store(base.sparkSession, path).get_or_build(build, {"kind": "sharded-hnsw", "shards": shards, "strategy": strategy, "m": m})
    return hnsw.search_shards(tables["graphs"], queries, k, max(2 * k, ef))
