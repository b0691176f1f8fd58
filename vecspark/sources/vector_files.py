"""A data source for binary files of vectors.

``spark.read.format("vectors").option("kind", ...).load(path)`` gives
``vec_id`` (the row's place) and ``embedding``.  Kinds:

- ``fbin``, ``ibin``: rows and dimension as int32, then float32 or int32 values;
- ``raw``: float32 values without a header, with the option ``dim``;
- ``bvecs``, ``ivecs``, ``fvecs``: before each row its dimension as int32.

All records have one length, so a file is cut into ranges of rows, and each task
reads only its range.  Files must be in a folder that all executors share.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..workers import ship

HEADED = {"fbin": "<f4", "ibin": "<i4"}
ROWED = {"fvecs": "<f4", "ivecs": "<i4", "bvecs": "u1"}


class Rows(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


class VectorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"], options.get("kind", "fbin")
        self.rows_at_once = int(options.get("rows", 1 << 16))
        size = os.path.getsize(self.path)
        with open(self.path, "rb") as f:
            head = np.frombuffer(f.read(8), "<i4")
        if self.kind in HEADED:
            self.rows, self.dim, self.skip, self.each = int(head[0]), int(head[1]), 8, 0
            self.value = np.dtype(HEADED[self.kind])
        elif self.kind in ROWED:
            self.value = np.dtype(ROWED[self.kind])
            self.dim, self.skip, self.each = int(head[0]), 0, 4
            self.rows = size // (4 + self.dim * self.value.itemsize)
        elif self.kind == "raw":
            self.value, self.dim, self.skip, self.each = np.dtype("<f4"), int(options["dim"]), 0, 0
            self.rows = size // (4 * self.dim)
        else:
            raise ValueError(f"no file of vectors is of kind {self.kind!r}")
        self.length = self.each + self.dim * self.value.itemsize
        if self.skip + self.rows * self.length > size:
            raise ValueError(f"{self.path} ends before its {self.rows} rows do")

    def partitions(self) -> list[Rows]:
        return [Rows(k, min(self.rows, k + self.rows_at_once)) for k in range(0, self.rows, self.rows_at_once)] or [Rows(0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        for k in range(part.begin, part.end, 8192):
            n = min(8192, part.end - k)
            with open(self.path, "rb") as f:
                f.seek(self.skip + k * self.length)
                raw = np.frombuffer(f.read(n * self.length), np.uint8).reshape(n, self.length)
            values = np.ascontiguousarray(raw[:, self.each :]).view(self.value).reshape(n, self.dim).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * self.dim + 1, self.dim), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + n)), flat], ["vec_id", "embedding"])


class VectorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return "vec_id long, embedding array<float>"

    def reader(self, schema) -> VectorReader:
        return VectorReader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(VectorFiles)


def write_fbin(path: str, vectors: np.ndarray) -> None:
    """Write a small array as ``fbin`` (float32) or ``ibin`` (int32)."""
    values = vectors.astype("<i4" if vectors.dtype.kind == "i" else "<f4")
    with open(path, "wb") as f:
        f.write(np.array(vectors.shape, "<i4").tobytes() + values.tobytes())
