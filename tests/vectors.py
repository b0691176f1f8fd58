"""Fixtures: tables of vectors with a fixed seed."""

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def frame(spark: SparkSession, x: np.ndarray, first: int = 0) -> DataFrame:
    return spark.createDataFrame([(first + k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<float>")


def asked(spark: SparkSession, q: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(q)], "query_id long, q array<float>")


def blobs(n: int, dim: int, clusters: int = 20, queries: int = 50, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian clusters, and queries near their vectors."""
    chance = np.random.default_rng(seed)
    middle = chance.normal(size=(clusters, dim)) * 4
    x = (middle[chance.integers(clusters, size=n)] + chance.normal(size=(n, dim))).astype(np.float32)
    return x, (x[chance.integers(n, size=queries)] + 0.1 * chance.normal(size=(queries, dim))).astype(np.float32)


def exact(x: np.ndarray, q: np.ndarray, k: int, metric: str = "l2") -> list[list[int]]:
    x, q = x.astype(float), q.astype(float)
    if metric == "cosine":
        x, q = x / np.linalg.norm(x, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
    far = ((q[:, None] - x[None]) ** 2).sum(2) if metric == "l2" else 1 - q @ x.T
    return [np.lexsort((np.arange(len(x)), row))[:k].tolist() for row in far]


def lists(found: DataFrame) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def recall(found: DataFrame, truth: list[list[int]]) -> float:
    got = lists(found)
    return float(np.mean([len(set(got.get(k, [])) & set(t)) / len(t) for k, t in enumerate(truth)]))
