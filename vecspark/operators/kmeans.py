"""k-means: seeded starts, Lloyd's iterations, assignment, and cluster sizes.

Centroids are few by choice of parameters, so they travel to the executors as
one row with an array; assigning a vector is then a projection without shuffle.
Sums of coordinates are taken over integers (units of 1e-9), so they don't
depend on the order in which tasks end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..workers import ship

Centroids = list[tuple[int, list[float]]]
CENTROIDS = "cid int, c array<double>"


def centroid_table(spark: SparkSession, centroids: Centroids) -> DataFrame:
    return spark.createDataFrame(sorted(centroids), CENTROIDS)


def with_centroids(df: DataFrame, centroids: Centroids, name: str = "centroids") -> DataFrame:
    """``df`` with all centroids in each row, as an array of ``cid, c``."""
    one = centroid_table(df.sparkSession, centroids).coalesce(1).agg(F.array_sort(F.collect_list(F.struct("cid", "c"))).alias(name))
    return df.crossJoin(F.broadcast(one))


def nearest(vector: Column, centroids: Column, distance: D.Distance = D.squared_l2) -> Column:
    """``dist, cid`` of the nearest centroid; of equal ones, the least."""
    return F.array_min(F.transform(centroids, lambda c: F.struct(distance(vector, c["c"]).alias("dist"), c["cid"].alias("cid"))))


def first_rows(base: DataFrame, k: int, vector: str = "embedding") -> Centroids:
    """The vectors of the k least ids, as starting centroids."""
    rows = base.orderBy("vec_id").limit(k).select("vec_id", F.transform(vector, lambda x: x.cast("double")).alias("c")).orderBy("vec_id").collect()
    if len(rows) < k:
        raise ValueError(f"{k} centroids need as many vectors; there are {len(rows)}")
    return [(cid, list(row["c"])) for cid, row in enumerate(rows)]


def sampled(base: DataFrame, rows: int, vector: str = "embedding") -> np.ndarray:
    """A bounded sample of vectors, the first by a hash of their ids."""
    found = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select(vector).toArrow().column(0).to_pylist()
    return np.array(found, np.float64)


def plus_plus(points: np.ndarray, k: int, seed: int = 0, distance=None) -> Centroids:
    """Starting centroids drawn from ``points`` in proportion to their distance from those drawn before.

    ``distance`` takes all points and one of them; it is the squared Euclidean
    distance if not given.
    """
    if len(points) < k:
        raise ValueError(f"{k} centroids need as many vectors; there are {len(points)}")
    distance = distance or (lambda x, c: ((x - c) ** 2).sum(1))
    chance = np.random.default_rng(seed)
    chosen = [int(chance.integers(len(points)))]
    least = distance(points, points[chosen[0]]).astype(float)
    while len(chosen) < k:
        weights = least if least.sum() > 0 else np.isin(np.arange(len(points)), chosen, invert=True).astype(float)
        chosen.append(int(chance.choice(len(points), p=weights / weights.sum())))
        least = np.minimum(least, distance(points, points[chosen[-1]]))
    return [(cid, points[at].tolist()) for cid, at in enumerate(chosen)]


def code_distance(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Places in which codes differ from one code."""
    return (codes != code).sum(1)


def assign(base: DataFrame, centroids: Centroids, vector: str = "embedding", distance: D.Distance = D.squared_l2) -> DataFrame:
    """``base`` with the ``cid`` of the nearest centroid."""
    near = with_centroids(base, centroids).withColumn("cid", nearest(F.col(vector), F.col("centroids"), distance)["cid"])
    return near.drop("centroids")


def _means(assigned: DataFrame, vector: str) -> dict[int, list[float]]:
    values = assigned.select("cid", F.posexplode(vector).alias("i", "x"))
    unit = F.round(F.col("x").cast("double") * F.lit(1e9)).cast("long")
    sums = values.groupBy("cid", "i").agg((F.sum(unit).cast("double") / F.count("*").cast("double") / F.lit(1e9)).alias("v"))
    rows = sums.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("c")).collect()
    return {r["cid"]: list(r["c"]) for r in rows}


def _means_by_product(base: DataFrame, centroids: Centroids, vector: str) -> dict[int, list[float]]:
    """Means of the clusters, assigned and added up by matrix products within each task."""
    cids, c = [k for k, _ in centroids], np.array([v for _, v in centroids])
    ship(base.sparkSession)
    sent = base.sparkSession.sparkContext.broadcast(c)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        sums, counts = np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            at = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
            np.add.at(sums, at, np.rint(x * 1e9).astype(np.int64))
            counts += np.bincount(at, minlength=len(c))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(c)), pa.int32()), pa.array(counts), pa.array(list(sums), pa.list_(pa.int64()))], ["k", "n", "sums"])

    parts = base.select(vector).mapInArrow(add, "k int, n long, sums array<long>")
    rows = parts.select("k", "n", F.posexplode("sums").alias("i", "s")).groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0").orderBy("k", "i").collect()
    out: dict[int, list[float]] = {}
    for r in rows:
        out.setdefault(cids[r["k"]], []).append(r["s"] / r["n"] / 1e9)
    return out


def lloyd(base: DataFrame, centroids: Centroids, iterations: int = 20, vector: str = "embedding", method: str = "columns") -> Centroids:
    """Centroids after at most ``iterations`` rounds; earlier if none of them moves any more.

    A cluster without vectors keeps its centroid.  ``method`` is ``columns``
    (expressions in the JVM, the same sums as SQL) or ``product`` (matrix
    products, faster for many centroids).
    """
    for _ in range(iterations):
        means = _means(assign(base, centroids, vector), vector) if method == "columns" else _means_by_product(base, centroids, vector)
        now = [(cid, means.get(cid, c)) for cid, c in centroids]
        if now == centroids:
            break
        centroids = now
    return centroids


def train(base: DataFrame, k: int, iterations: int = 20, seed: int = 0, sample: int = 65536, vector: str = "embedding") -> Centroids:
    """Centroids of all of ``base``; only the start is drawn from a sample of ``sample`` vectors."""
    return lloyd(base, plus_plus(sampled(base, max(sample, k), vector), k, seed), iterations, vector, "product")


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    """``cid, n, begin``: vectors of each cluster, and where it begins if clusters stand one after the other."""
    counts = assigned.groupBy("cid").agg(F.count("*").alias("n"))
    return counts.withColumn("begin", F.sum("n").over(Window.orderBy("cid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))


def cluster_statistics(assigned: DataFrame, clusters: int) -> DataFrame:
    """``clusters, filled, least, most, mean``: how the vectors spread over the clusters that have any."""
    counts = assigned.groupBy("cid").agg(F.count("*").alias("n"))
    return counts.agg(F.lit(clusters).cast("long").alias("clusters"), F.count("*").alias("filled"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def list_count(n: int, kind: str = "ivfpq") -> int:
    """Clusters that suit n vectors."""
    if kind == "ivfpq":
        return max(10, min(1000, int(min(4 * n**0.5, n / 10))))
    return max(10, min(512, int(min(2 * n**0.5, n / 50))))
