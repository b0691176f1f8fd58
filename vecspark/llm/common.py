"""What the operators share: tables, staging in the shared folder, size checks."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import ship

#: A word: a run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that are sent to a Python worker at a time: texts may be long.
BATCH_BYTES = 4 << 20
GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one named in ``spark.checkpoint.dir``.  Only where that is unset
    and Spark runs in one process (tests) is a temporary folder used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="vecspark-")
        spark.conf.set("spark.checkpoint.dir", named) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stage(df: DataFrame, name: str = "stage", few: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs its running tasks only, and
    what was written is read back by any other one.  With ``few``, for tables
    that are much smaller than the texts, files are fewer: a quarter of the
    shuffle partitions, but no fewer than there are cores.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    if few:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, partitions(spark) // 4))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders that this driver has staged and not removed.
_staged: list[str] = []


def staged() -> list[str]:
    """The folders staged so far."""
    return list(_staged)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Remove staged folders that nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        _staged.remove(name)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Jobs of tables that are made inside leave no shuffle files: theirs go when they end.

    Else these stay until the driver happens to collect its garbage.
    """
    conf, key = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        yield
    finally:
        conf.set(key, before)


def staged_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a staged table, from one listing of each folder."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    folders = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
    paths = [jvm.org.apache.hadoop.fs.Path(name) for name in folders]
    return sum(path.getFileSystem(conf).getContentSummary(path).getLength() for path in paths)


#: What a value takes in memory at least, beside the characters of texts and arrays.
ROW_BYTES, VALUE_BYTES = 16, 8


def small(df: DataFrame, limit: int = 16 << 20, in_memory: int = 64 << 20) -> DataFrame:
    """A staged table, marked for broadcast if its files are at most ``limit`` bytes and its rows ``in_memory`` bytes.

    Files may be compressed to a fraction of what their rows take, so rows are
    counted where the files are small: each is taken to need 16 bytes, 8 for
    each column, and as much again for texts and arrays as files have at four
    times their size.  Beyond a limit the table stays as it is and the join
    shuffles.
    """
    size = staged_bytes(df)
    if size > limit:
        return df
    wide = any(isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)) for f in df.schema.fields)
    needed = df.count() * (ROW_BYTES + VALUE_BYTES * len(df.columns)) + (4 * size if wide else 0)
    return F.broadcast(df) if needed <= in_memory else df


def in_arrow(df: DataFrame, work: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``BATCH_BYTES`` bytes or one row.

    The setting is the session's, as it counts when the query runs; it is only
    ever lowered.
    """
    ship(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(key).rstrip("b")) <= BATCH_BYTES:
        conf.set(key, BATCH_BYTES)
    return df.mapInArrow(work, schema)


def give_back(spark: SparkSession) -> None:
    """Executors collect their Java garbage and return the room to the system.

    A heap that earlier jobs filled stays as large as they left it, and Python
    workers need their memory beside it.  There are as many tasks as cores, so
    each executor that is idle gets some; one that is busy may be left out.
    """
    n = spark.sparkContext.defaultParallelism
    collected = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, n, 1, n).select(collected.alias("_")).write.format("noop").mode("overwrite").save()


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """A table that a Python worker keeps from one task to the next.

    A worker holds one table at a time: asking for another one lets the first
    go.  Memory that earlier tasks no longer use goes back to the system.
    """
    if name not in _held:
        _held.clear()
        _held[name] = make()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    return _held[name]


#: Numbers in a block of a vector that tasks add up.
BLOCK = 8192


def in_blocks(vector: np.ndarray) -> pa.RecordBatch:
    """A vector of integers as rows (block, values) for ``added_up``; blocks of zeros are left out."""
    vector = vector.astype(np.int64)
    blocks = [(k // BLOCK, vector[k : k + BLOCK].tobytes()) for k in range(0, len(vector), BLOCK) if vector[k : k + BLOCK].any()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in blocks], pa.int32()), pa.array([v for _, v in blocks], pa.binary())], ["block", "values"])


def added_up(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of the vectors of ``size`` integers that tasks gave in blocks, added up in two rounds.

    The first round adds up each block over groups of tasks, about as many
    groups as each has tasks, so the second one has little left to move.
    The driver gets one vector of fixed size.  Sums of integers are the same
    whichever tasks there are and however they end.
    """
    spark = rows.sparkSession

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, values in zip(batch.column("block").to_pylist(), batch.column("values")):
                values = np.frombuffer(values.as_py(), np.int64)
                sums[block] = sums[block] + values if block in sums else values
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "values"])

    n = partitions(spark)
    groups = math.ceil(math.sqrt(n))
    half = rows.repartition(n, "block", F.spark_partition_id() % groups).transform(in_arrow, add, "block int, values binary")
    found = half.repartition(n, "block").transform(in_arrow, add, "block int, values binary").toArrow()
    total = np.zeros(size, np.int64)
    for block, values in zip(found.column("block").to_pylist(), found.column("values").to_pylist()):
        total[block * BLOCK : block * BLOCK + len(values) // 8] = np.frombuffer(values, np.int64)
    return total


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one, so that none meets a working column of the same name."""
    return docs.select(*needed, F.struct(F.lit(0).alias("_"), *[docs[c] for c in docs.columns if c not in needed]).alias("_others"))


def unpacked(rows: DataFrame, columns: list[str], *new: str) -> DataFrame:
    """The columns of the table before it was packed, less those named like a new one, and the new ones."""
    others = rows.schema["_others"].dataType.names
    return rows.select(*[F.col("_others")[c].alias(c) if c in others else rows[c] for c in columns if c not in new], *new)
