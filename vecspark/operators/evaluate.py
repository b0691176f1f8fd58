"""Recall, latency and comparison of results."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, recall``: the share of the k true neighbours (query_id, vec_id, rank) that were found."""
    true = truth.where(F.col("rank") <= k).select("query_id", "vec_id")
    hits = true.join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.lit(float(k))).alias("recall"))


def mean_recall(found: DataFrame, truth: DataFrame, k: int = 10) -> float:
    return recall(found, truth, k).agg(F.avg("recall")).first()[0]


def timed(search: Callable[[], DataFrame], queries: int) -> dict[str, float]:
    """Mean microseconds of a query and queries a second, of one run."""
    began = time.perf_counter()
    search().collect()
    took = time.perf_counter() - began
    return {"latency_us": 1e6 * took / queries, "qps": queries / took}


def sweep(configurations: dict[str, Callable[[], DataFrame]], truth: DataFrame, k: int = 10) -> DataFrame:
    """``name, recall`` of each configuration's result."""
    parts = [recall(search(), truth, k).agg(F.avg("recall").alias("recall")).select(F.lit(name).alias("name"), "recall") for name, search in configurations.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def measured(configurations: dict[str, Callable[[], DataFrame]], queries: int, runs: int = 2) -> dict[str, dict[str, float]]:
    """Latency, queries a second and speed-up over the first configuration, by name; of several runs after one to warm up, the fastest counts."""
    out: dict[str, dict[str, float]] = {}
    for name, search in configurations.items():
        timed(search, queries)
        out[name] = min((timed(search, queries) for _ in range(runs)), key=lambda x: x["latency_us"])
    first = next(iter(out.values()))["latency_us"] if out else 0.0
    for found in out.values():
        found["speed_up"] = first / found["latency_us"]
    return out


def memory(spark: SparkSession) -> dict[str, float]:
    """Resident megabytes of the driver's Python and its JVM, ``now`` and at their ``peak``; empty where the system has no ``/proc``.

    In local mode the JVM is also the executor; Python workers are not in it.
    """
    pids = {"python": os.getpid(), "jvm": spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()}
    out: dict[str, float] = {}
    for name, pid in pids.items():
        status = Path(f"/proc/{pid}/status")
        if status.exists():
            fields = dict(line.split(":", 1) for line in status.read_text().splitlines() if ":" in line)
            out |= {f"{name}_{label}": int(fields[field].split()[0]) / 1024 for label, field in (("now", "VmRSS"), ("peak", "VmHWM"))}
    return out


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each query: the largest difference of distances at equal rank, and the ranks with other ids."""
    both = a.select("query_id", "rank", F.col("vec_id").alias("vec_a"), F.col("dist").alias("dist_a")).join(b.select("query_id", "rank", F.col("vec_id").alias("vec_b"), F.col("dist").alias("dist_b")), ["query_id", "rank"], "full_outer")
    return both.groupBy("query_id").agg(F.max(F.abs(F.col("dist_a") - F.col("dist_b"))).alias("max_diff"), F.sum(F.when(F.col("vec_a").eqNullSafe(F.col("vec_b")), 0).otherwise(1)).alias("other_ids"))
