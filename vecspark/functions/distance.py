"""Distances between array columns, summed from left to right in double precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import ship

Distance = Callable[[Column, Column], Column]


def folded(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    """Sum of ``term`` over the elements of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return folded(a, b, lambda x, y: x * y)


def inner_product(a: Column, b: Column) -> Column:
    """One minus the inner product."""
    return F.lit(1.0) - dot(a, b)


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; no root is taken."""
    return folded(a, b, lambda x, y: (x - y) * (x - y))


def normalized(v: Column) -> Column:
    """The vector over its length; the zero vector stays zero."""
    length = F.sqrt(dot(v, v)) + F.lit(1e-30)
    return F.transform(v, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    return inner_product(normalized(a), normalized(b))


def integer_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of integer vectors, as a long."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    """Places in which two codes differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))


def residual(v: Column, centroid: Column) -> Column:
    return F.zip_with(v, centroid, lambda x, c: x.cast("double") - c.cast("double"))


def subvector(v: Column, m: Column | int, size: int) -> Column:
    """The m-th block, from 0, of ``size`` elements, as doubles."""
    m = F.lit(m) if isinstance(m, int) else m
    return F.transform(F.slice(v, m * size + 1, F.lit(size)), lambda x: x.cast("double"))


def overlap(a: Column, b: Column) -> Column:
    """Number of distinct elements that two lists share."""
    return F.size(F.array_intersect(a, b))


METRICS: dict[str, Distance] = {"ip": inner_product, "l2": squared_l2, "cosine": cosine}


def metric(name: str | Distance) -> Distance:
    """The distance of that name, or the given function itself."""
    if callable(name):
        return name
    if name not in METRICS:
        raise ValueError(f"no metric is called {name!r}; there are {', '.join(METRICS)}")
    return METRICS[name]


def hash_shards(base: DataFrame, shards: int, vector: str = "embedding") -> DataFrame:
    """``base`` with ``shard``: the hash h = 31 h + bits of a vector's float32 values, modulo 2^64, modulo ``shards``."""
    ship(base.sparkSession)
    schema = T.StructType([*base.schema.fields, T.StructField("shard", T.IntegerType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(vector):
                bits = np.asarray(value.as_py(), np.float32).view(np.uint32).astype(np.uint64)
                power = np.cumprod(np.concatenate(([1], np.full(max(len(bits) - 1, 0), 31))).astype(np.uint64))[::-1]
                found.append(int((bits * power[: len(bits)]).sum(dtype=np.uint64) % np.uint64(shards)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], schema.names)

    return base.mapInArrow(compute, schema)
