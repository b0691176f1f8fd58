"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many places (virtual nodes) on a ring.  A document goes to the
owner of the next place clockwise; once a shard holds its full load, what comes
after continues clockwise to the next shard that has room.

Where a document stands on the ring follows from its text and, among equal
texts, from its id.  So equal texts are neighbours and stay together as far as
loads allow, and a group of copies of any size spreads over many tasks.

The documents are put in ring order once (a range partitioning of a few narrow
columns).  The driver sees only how many documents each task has in each arc,
and deals out the arcs by these counts; the result, a list of stretches of the
ring order with their shards, is at most a few times as long as the list of
virtual nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, in_arrow, packed, partitions, stage, unpacked

RING = 1 << 63


def virtual_nodes(shards: int, replicas: int) -> tuple[np.ndarray, np.ndarray]:
    """Places on the ring in order, and their owners."""
    at = [(int.from_bytes(hashlib.md5(f"{s}:{r}".encode()).digest()[:8], "big") >> 1, s) for s in range(shards) for r in range(replicas)]
    at.sort()
    return np.array([p for p, _ in at], np.int64), np.array([s for _, s in at], np.int64)


def deal(counts: np.ndarray, owners: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int]]:
    """Deal out arcs that have ``counts`` keys: ``(arc, keys, shard)`` in ring order.

    Each arc's keys first go to its owner, then what didn't fit goes on, one
    place further clockwise at a time.  The capacities must hold all keys.
    """
    free, left = capacity.copy(), counts.copy()
    parts: list[list[tuple[int, int]]] = [[] for _ in counts]
    for step in range(len(owners)):
        waiting = np.flatnonzero(left)
        if not len(waiting):
            break
        for arc in waiting:
            shard = owners[(arc + step) % len(owners)]
            if (n := min(left[arc], free[shard])) > 0:
                free[shard] -= n
                left[arc] -= n
                parts[arc].append((int(n), int(shard)))
    return [(arc, n, shard) for arc, own in enumerate(parts) for n, shard in own]


def assign(docs: DataFrame, shards: int = 24, replicas: int = 64, slack: float = 0.0) -> DataFrame:
    """The documents without their texts, with ``size, text_crc32, law, shard, slot``.

    ``docs`` needs ``doc_id`` and ``text``.  A shard holds at most
    ``1 + slack`` times an even share of the rows, rounded up; without slack
    the counts of any two shards differ by one at most, and ``law`` is ``rows``
    (else null).  ``slot`` counts the documents of a shard from 0.

    A null text has no bytes, size 8 and the checksum of nothing.  Null ids are
    ids like others; rows that are alike in all columns stand side by side on
    the ring, in any order.  Columns named like a new one are replaced.  An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    new = ["size", "text_crc32", "law", "shard", "slot"]
    places, owners = virtual_nodes(shards, replicas)
    shift = int(places[-1]) + 1  # counted from the last place, every document has a place after it
    places = np.where(places < shift, places + (RING - 1 - shift) + 1, 0)
    places[-1] = RING - 1
    order = np.argsort(places, kind="stable")
    places, owners = places[order], owners[order]

    columns, docs = docs.columns, packed(docs, "doc_id", "text")
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    spot = F.shiftrightunsigned(F.xxhash64(text), 1).bitwiseAND(F.lit((RING - 1) ^ 0xFFFFFF)).bitwiseOR(F.xxhash64(docs["doc_id"].cast("string")).bitwiseAND(F.lit(0xFFFFFF)))
    spot = F.when(spot >= F.lit(shift), spot - F.lit(shift)).otherwise(spot + F.lit(RING - 1 - shift) + 1)
    kept = ["doc_id", "_others"]
    narrow = docs.select(*kept, (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), spot.alias("_spot"))
    narrow = narrow.repartitionByRange(partitions(spark), "_spot", "doc_id").sortWithinPartitions("_spot", "doc_id")
    row = F.monotonically_increasing_id()
    ring = stage(narrow.select("*", F.shiftright(row, 33).cast("int").alias("_part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")), "ring")

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.stack([batch.column("_part").to_numpy(), np.searchsorted(places, batch.column("_spot").to_numpy())], 1)
            found, count = np.unique(both, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0], pa.int32()), pa.array(found[:, 1], pa.int32()), pa.array(count, pa.int64())], ["_part", "arc", "count"])

    found = ring.select("_part", "_spot").transform(in_arrow, arcs, "_part int, arc int, count long").groupBy("_part", "arc").agg(F.sum("count").alias("count")).collect()
    counts, offsets = np.zeros(len(places), np.int64), np.zeros(max((r["_part"] for r in found), default=0) + 2, np.int64)
    for r in found:
        counts[r["arc"]] += r["count"]
        offsets[r["_part"] + 1] += r["count"]
    offsets = offsets.cumsum()
    rows = int(offsets[-1])
    capacity = np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)
    capacity = np.maximum(capacity, int(np.ceil((1 + slack) * rows / shards))) if slack else capacity
    dealt = deal(counts, owners, capacity)
    begins = np.cumsum([0, *(n for _, n, _ in dealt)])[:-1] if dealt else np.zeros(0, np.int64)
    slots, full = [], np.zeros(shards, np.int64)
    for _, n, shard in dealt:
        slots.append(full[shard])
        full[shard] += n
    law = None if slack else "rows"
    plan = spark.sparkContext.broadcast((offsets, begins, np.array(slots, np.int64), np.array([s for _, _, s in dealt], np.int32)))
    schema = T.StructType([f for f in ring.schema.fields if f.name in [*kept, "size", "text_crc32"]] + [T.StructField("law", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, begins, slots, owner = plan.value
        for batch in batches:
            rank = offsets[batch.column("_part").to_numpy()] + batch.column("_row").to_numpy()
            piece = np.searchsorted(begins, rank, "right") - 1
            added = [pa.array([law] * len(rank), pa.string()), pa.array(owner[piece], pa.int32()), pa.array(slots[piece] + rank - begins[piece], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in schema.names[:-3]] + added, schema.names)

    return unpacked(ring.transform(in_arrow, place, schema), [c for c in columns if c != "text"], *new)


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``rows``."""
    placed = assign(documents(spark, sf_dir).select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
