"""Document fingerprints by SimHash, and a search by permuted block tables.

A text's terms are its shingles of two words, each weighted by how often it
occurs.  Every term's hash votes on each of 128 bits, for or against; the signs
of the sums are the fingerprint.  The share of bits in which two fingerprints
differ, times pi, estimates the angle between the texts' term vectors.

``search`` finds the closest pairs.  It cuts a fingerprint into 8 blocks.  Two
fingerprints within 6 bits agree in two blocks at least, so there is a table for
each pair of blocks, and a query looks for its own blocks in each of the tables.

Near copies are further apart than that.  ``within`` takes any radius: it
compares every fingerprint with every query, in blocks of queries.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, held, in_arrow, partitions, small, stage

BITS, BLOCKS = 128, 8
RADIUS = BLOCKS - 2
#: Bits by which near copies differ at most: an estimated cosine of 0.88.
NEAR = 20
#: Queries that each task compares with its fingerprints at a time.
QUERIES_AT_ONCE = 1 << 17
#: Terms that vote at a time, and words whose hashes a worker remembers.
TERMS_AT_ONCE, WORDS_KEPT = 1 << 15, 200_000


class WordHashes(dict):
    """64-bit hashes of words, remembered for a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_KEPT:
            self[word] = value
        return value

    def of(self, text: str) -> np.ndarray:
        return self.of_bytes(text.encode())

    def of_bytes(self, text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread each value over all 64 bits."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def fingerprint(words: np.ndarray) -> bytes:
    """The fingerprint of a sequence of word hashes; zero bits if there are none."""
    if not len(words):
        return bytes(BITS // 8)
    terms = mixed(words[:-1] * np.uint64(31) + mixed(words[1:])) if len(words) > 1 else mixed(words)
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(terms), TERMS_AT_ONCE):
        part = terms[k : k + TERMS_AT_ONCE]
        both = np.stack([part, mixed(part + np.uint64(1))], 1)
        votes += np.unpackbits(both.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(terms)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated cosine of two texts' term vectors, 0 to 1; 1 for equal fingerprints."""
    apart = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return max(0.0, math.cos(math.pi * apart / BITS)) if apart < BITS // 2 else 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """The documents with ``fingerprint`` (hex) in place of ``text``; a null text has that of an empty one."""
    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("text", "fingerprint")] + [T.StructField("fingerprint", T.StringType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held("words", WordHashes)
        for batch in batches:
            prints = [fingerprint(hashes.of(t.as_py() or "")).hex() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in schema.names[:-1]] + [pa.array(prints, pa.string())], schema.names)

    return docs.transform(in_arrow, compute, schema)


def _blocks(print_: Column) -> Column:
    wide = BITS // 4 // BLOCKS
    return F.array(*[F.substring(print_, k * wide + 1, wide) for k in range(BLOCKS)])


def _tables(prints: DataFrame, name: str) -> DataFrame:
    """One row for each table: the pair of blocks with what stands in them."""
    both = list(combinations(range(BLOCKS), 2))
    blocks = prints.withColumn("b", _blocks(F.col("fingerprint")))
    keys = F.array(*[F.struct(F.lit(i * BLOCKS + j).alias("table"), F.concat(F.col("b")[i], F.col("b")[j]).alias("key"), F.lit(j + 1).alias("upto")) for i, j in both])
    return blocks.select(F.col("fingerprint").alias(f"{name}_print"), F.col("b").alias(f"{name}_b"), *[c for c in prints.columns if c != "fingerprint"], F.explode(keys).alias("t")).select("*", "t.table", "t.key", "t.upto").drop("t")


def _apart(a: str, b: str) -> Column:
    def half(name: str, k: int) -> Column:
        return F.conv(F.substring(F.col(name), 1 + 8 * k, 8), 16, 10).cast("long")

    return sum((F.bit_count(half(a, k).bitwiseXOR(half(b, k))) for k in range(BITS // 32)), F.lit(0))


def search(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs ``query_print, found_print, found_n, apart`` of a query's and a document's fingerprint within ``radius`` (at most 6) bits.

    Both tables have ``fingerprint``; equal ones are one class, and ``found_n``
    is the number of documents that have the found one.  A pair is found once,
    in the first table that has it.  Nulls are left out.
    """
    if radius > RADIUS:
        raise ValueError(f"{BLOCKS} blocks, two of which agree, find {RADIUS} bits at most")
    asked = stage(_tables(queries.select("fingerprint").where("fingerprint is not null").distinct(), "query"), "simhash-queries", few=True)
    known = _tables(prints.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("found_n")), "found")
    asked = asked.select("query_print", "query_b", F.col("table").alias("query_table"), F.col("key").alias("query_key"))
    agree = F.size(F.filter(F.sequence(F.lit(0), F.col("upto") - 1), lambda k: F.get("query_b", k) == F.get("found_b", k)))
    on = (F.col("table") == F.col("query_table")) & (F.col("key") == F.col("query_key")) & (agree == 2) & (_apart("query_print", "found_print") <= radius)
    return known.join(small(asked), on).select("query_print", "found_print", "found_n", _apart("query_print", "found_print").alias("apart"))


def _words(prints: list[str]) -> np.ndarray:
    """Fingerprints in hex as two rows of 64-bit numbers."""
    return np.ascontiguousarray(np.frombuffer(bytes.fromhex("".join(prints)), np.uint64).reshape(-1, 2).T)


def within(queries: DataFrame, prints: DataFrame, radius: int = NEAR) -> DataFrame:
    """``query_print, n_within``: the number of documents within ``radius`` bits of each fingerprint of ``queries``.

    Both tables have ``fingerprint``.  All pairs are compared, so any radius is
    exact and common fingerprints cost no more than others; a task gives one row
    for each query that it found something for.  Nulls are left out, and so are
    queries with no document within the radius.
    """
    asked = stage(queries.select("fingerprint").where("fingerprint is not null").distinct(), "simhash-queries", few=True)
    known = prints.select("fingerprint").where("fingerprint is not null")
    n = max(1, -(-asked.count() // QUERIES_AT_ONCE))
    parts = []
    for block in range(n):
        names = asked.where(F.pmod(F.xxhash64("fingerprint"), F.lit(n)) == block).toArrow().column("fingerprint").to_pylist()
        sent = prints.sparkSession.sparkContext.broadcast(names)

        def compare(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names = sent.value
            first, second = _words(names)
            counts = np.zeros(len(names), np.int64)
            for batch in batches:
                a, b = _words(batch.column("fingerprint").to_pylist())
                bits, apart = np.empty_like(a), np.empty(len(a), np.uint8)
                for k in range(len(names)):
                    np.bitwise_count(np.bitwise_xor(a, first[k], out=bits), out=apart)
                    left = np.flatnonzero(apart <= radius)
                    counts[k] += np.count_nonzero(apart[left] + np.bitwise_count(b[left] ^ second[k]) <= radius)
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in found], pa.string()), pa.array(counts[found])], ["query_print", "n"])

        parts.append(known.transform(in_arrow, compare, "query_print string, n long"))
    return reduce(DataFrame.unionByName, parts).groupBy("query_print").agg(F.sum("n").alias("n_within"))


def _neighbours(docs: DataFrame) -> DataFrame:
    """Documents in order of id within buckets of ids, each bucket with the first document behind it.

    Ids are cut into buckets at their quantiles; an id that holds several
    quantiles is cut further, into even ranges of the texts' hashes.  Whatever
    bucket ends, its last document needs the first one of the next bucket, which
    is sent to both; the very first one is sent to the last bucket too.  Cuts and
    first documents are four for each shuffle partition, sent as arrays.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    at = docs.select(F.coalesce(docs["doc_id"], F.lit(-(1 << 63))).alias("at"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_key"), "text")
    found = at.agg(F.percentile_approx("at", [k / n for k in range(1, n)], 100 * n)).first()[0] or []
    cuts, often = np.unique(np.array(found, np.int64), return_counts=True)
    #: bucket at which each cut begins, and the cuts within the ids that come up more than once
    begins = np.concatenate([[0], np.cumsum(np.where(often > 1, often, 1))])
    within = {int(cuts[k]): (int(begins[k]) + 1, np.array([-(1 << 63) + (j << 64) // int(often[k]) for j in range(1, often[k])], np.int64)) for k in np.flatnonzero(often > 1)}

    def bucketed(rows: DataFrame, heads: dict[int, tuple[int, int, int]]) -> DataFrame:
        """``rows`` with ``bucket`` and, for those equal to the first document of a bucket, the bucket before it."""
        schema = T.StructType([*rows.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("before", T.IntegerType())])
        sent = spark.sparkContext.broadcast((cuts, begins, within, heads))

        def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cuts, begins, within, heads = sent.value
            for batch in batches:
                ids, keys = batch.column("at").to_numpy(), batch.column("text_key").to_numpy()
                bucket = begins[np.searchsorted(cuts, ids, "right")]
                for hot, (first, inner) in within.items():
                    own = ids == hot
                    bucket[own] = first + np.searchsorted(inner, keys[own], "right")
                before = [heads[b][2] if b in heads and heads[b][:2] == (i, k) else None for b, i, k in zip(bucket.tolist(), ids.tolist(), keys.tolist())] if heads else [None] * len(ids)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket.astype(np.int32)), pa.array(before, pa.int32())], schema.names)

        return rows.transform(in_arrow, compute, schema)

    first = sorted((r["bucket"], r["head"]["at"], r["head"]["text_key"]) for r in bucketed(at.select("at", "text_key"), {}).groupBy("bucket").agg(F.min(F.struct("at", "text_key")).alias("head")).collect())
    heads = {b: (i, k, first[place - 1][0]) for place, (b, i, k) in enumerate(first)}
    to = F.array(F.struct(F.col("bucket").alias("to"), F.lit(0).alias("peek")), F.struct(F.col("before").alias("to"), F.lit(1).alias("peek")))
    dealt = bucketed(at, heads).select("at", "text_key", "text", F.explode(to).alias("s")).select("s.to", "s.peek", "at", "text_key", "text").where("to is not null")
    return dealt.repartition(partitions(spark), "to").sortWithinPartitions("to", "peek", "at", "text_key")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness.

    ``docs`` needs ``doc_id`` (a whole number) and ``text``.  The edited text
    has the last quarter of its characters, rounded down, replaced by as many
    first ones of the next document by id; the last document takes the first
    one's.  Documents with one id are in order of a hash of their texts.  Null
    ids come first, null texts count as empty.  An empty table gives an empty
    result; a single document is its own next one.
    """
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
    )

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last_row = held("words", WordHashes), None
        for batch in batches:
            rows = []
            for to, peek, at, text in zip(*(batch.column(c) for c in ("to", "peek", "at", "text"))):
                to, peek, at, text = to.as_py(), peek.as_py(), at.as_py(), text.as_py() or ""
                if last_row and last_row[0] == to and last_row[1] == 1:
                    continue  # more of the first documents of the next bucket, equal to the one before
                own = fingerprint(hashes.of(text))
                if last_row and last_row[0] == to:
                    _, _, last_at, last, last_print = last_row
                    cut = len(last) // 4
                    edited = last[: len(last) - cut] + text[:cut]
                    changed = fingerprint(hashes.of(edited))
                    rows.append((None if last_at == -(1 << 63) else last_at, len(last), hashlib.sha256(edited.encode()).hexdigest(), last_print.hex(), changed.hex(), likeness(last_print, changed), likeness(last_print, own)))
                last_row = (to, peek, at, text, own)
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)

    return _neighbours(docs).transform(in_arrow, compute, schema)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents.

    For those whose id is divisible by 100 also how many documents are within 6
    bits, by block tables (``n_close``), and within 20, by comparing them with
    all (``n_within``).
    """
    prints = stage(edited_fingerprints(documents(spark, sf_dir).select("doc_id", "text")), "simhash")
    asked = prints.where("doc_id % 100 = 0")
    close = search(asked, prints).groupBy("query_print").agg(F.sum("found_n").alias("n_close"))
    found = stage(within(asked, prints).join(close, "query_print", "left"), "simhash-found", few=True)
    counted = prints.join(small(found), (F.col("doc_id") % 100 == 0) & (F.col("fingerprint") == F.col("query_print")), "left")
    return counted.select(*prints.columns, "n_close", "n_within")
