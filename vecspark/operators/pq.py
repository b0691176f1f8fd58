"""Product quantization: codebooks, codes, tables of partial scores, search with exact re-ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distance as D
from ..workers import ship
from . import ivf, kmeans
from .sizes import blocks, union
from .topk import top_k


@dataclass(frozen=True)
class Codebook:
    """Codewords of each of the m subspaces."""

    words: tuple[tuple[tuple[float, ...], ...], ...]

    @property
    def m(self) -> int:
        return len(self.words)

    @property
    def size(self) -> int:
        return len(self.words[0][0])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(m, k, list(word)) for m, words in enumerate(self.words) for k, word in enumerate(words)]
        return spark.createDataFrame(rows, "m int, k int, cw array<double>")

    @staticmethod
    def of_table(table: DataFrame) -> Codebook:
        rows = table.orderBy("m", "k").collect()
        return Codebook(tuple(tuple(tuple(r["cw"]) for r in rows if r["m"] == m) for m in range(rows[-1]["m"] + 1)))


def with_codebook(df: DataFrame, book: Codebook) -> DataFrame:
    """``df`` with all codewords in each row: an array by m of arrays by k."""
    one = df.sparkSession.createDataFrame([([[list(w) for w in words] for words in book.words],)], "book array<array<array<double>>>").coalesce(1)
    return df.crossJoin(F.broadcast(one))


def code(vector: Column, m: int, size: int) -> Column:
    """For each subspace the nearest codeword, of equal ones the first."""

    def of(part: Column) -> Column:
        own = F.get(F.col("book"), part)
        sub = D.subvector(vector, part, size)
        return F.array_min(F.transform(own, lambda w, k: F.struct(D.squared_l2(sub, w).alias("d"), k.alias("k"))))["k"].cast("short")

    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), of)


def _check(dim: int, m: int, rows: int, ks: int) -> None:
    if dim % m:
        raise ValueError(f"{dim} dimensions are not a multiple of {m} subspaces")
    if rows < ks:
        raise ValueError(f"{ks} codewords need as many vectors; there are {rows}")


def train(base: DataFrame, m: int = 8, ks: int = 256, iterations: int = 20, vector: str = "embedding", start: np.ndarray | None = None) -> Codebook:
    """A codebook by k-means in every subspace at once, one job for each round.

    The first codewords are the subvectors of ``start`` (ks vectors), else of
    the vectors of the ks least ids.
    """
    if start is None:
        start = np.array([c for _, c in kmeans.first_rows(base, ks, vector)])
    dim = start.shape[1]
    _check(dim, m, len(start), ks)
    size = dim // m
    book = Codebook(tuple(tuple(tuple(row[p * size : (p + 1) * size].tolist()) for row in start[:ks]) for p in range(m)))
    for _ in range(iterations):
        means = _means(base, book, vector)
        now = Codebook(tuple(tuple(means.get((p, k), word) for k, word in enumerate(words)) for p, words in enumerate(book.words)))
        if now == book:
            break
        book = now
    return book


def _nearest_words(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Rows by subspaces: the nearest codeword of each block of each vector, of equal ones the first."""
    m, _, size = words.shape
    parts = x.reshape(len(x), m, size)
    return np.stack([((words[p] ** 2).sum(1)[None] - 2 * parts[:, p] @ words[p].T).argmin(1) for p in range(m)], 1)


def _means(base: DataFrame, book: Codebook, vector: str) -> dict[tuple[int, int], tuple[float, ...]]:
    """Means of the blocks next to each codeword; tasks add up integers (units of 1e-9), so their order doesn't count."""
    ship(base.sparkSession)
    sent = base.sparkSession.sparkContext.broadcast(np.array(book.words))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        m, ks, size = words.shape
        sums, counts = np.zeros((m, ks, size), np.int64), np.zeros((m, ks), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            near, units = _nearest_words(x, words), np.rint(x * 1e9).astype(np.int64).reshape(len(x), m, size)
            for p in range(m):
                np.add.at(sums[p], near[:, p], units[:, p])
                counts[p] += np.bincount(near[:, p], minlength=ks)
        p, k = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(counts[p, k]), pa.array(list(sums[p, k]), pa.list_(pa.int64()))], ["m", "k", "n", "sums"])

    parts = base.select(vector).mapInArrow(add, "m int, k int, n long, sums array<long>")
    size = book.size
    rows = parts.groupBy("m", "k").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size)]).collect()
    return {(r["m"], r["k"]): tuple(r[f"s{i}"] / r["n"] / 1e9 for i in range(size)) for r in rows}


def encode(base: DataFrame, book: Codebook, vector: str = "embedding") -> DataFrame:
    """``base`` with ``code``."""
    return with_codebook(base, book).withColumn("code", code(F.col(vector), book.m, book.size)).drop("book")


def encode_by_product(base: DataFrame, book: Codebook, vector: str = "embedding") -> DataFrame:
    """The same codes by matrix products over Arrow batches, for large codebooks."""
    words = np.array(book.words)
    ship(base.sparkSession)
    spread = base.sparkSession.sparkContext.broadcast(words)
    schema = T.StructType([*base.schema.fields, T.StructField("code", T.ArrayType(T.ShortType()))])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = spread.value
        m, _, size = words.shape
        for batch in batches:
            x = np.array(batch.column(vector).to_pylist(), np.float64).reshape(batch.num_rows, m * size)
            codes = _nearest_words(x, words).astype(np.int16)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(codes), pa.list_(pa.int16()))], schema.names)

    return base.mapInArrow(compute, schema)


def tables(queries: DataFrame, book: Codebook, term: D.Distance = D.dot, vector: str = "q") -> DataFrame:
    """``queries`` with ``lut``: for each m and k, ``term`` (the inner product) of the query's block and the codeword."""
    lut = F.transform("book", lambda words, m: F.transform(words, lambda w: term(D.subvector(F.col(vector), m, book.size), w)))
    return with_codebook(queries, book).withColumn("lut", lut).drop("book")


def looked_up(lut: Column, code: Column) -> Column:
    """Sum over m of the entry for the code."""
    return F.aggregate(F.zip_with(lut, code, lambda row, k: F.get(row, k.cast("int"))), F.lit(0.0), lambda s, x: s + x)


def rerank(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int, metric: str | D.Distance = "ip", most: int = 1024) -> DataFrame:
    """The k closest of the candidates (query_id, vec_id), ``most`` of a query at most, by their vectors.

    Ids of candidates and queries go to the vectors in blocks of checked size.
    """
    near = ivf.at_lists(base.select("vec_id", "embedding"), queries, candidates.select("query_id", "vec_id"), 16 * most, by="vec_id")
    return top_k(near.withColumn("dist", D.metric(metric)(F.col("q"), F.col("embedding"))), k).select("query_id", "rank", "vec_id", "dist")


def scores(codes: DataFrame, queries: DataFrame, book: Codebook) -> DataFrame:
    """One minus the looked-up inner product, for each code and each query; tables are sent to the codes in blocks of bounded size."""
    parts = blocks(queries, 8 * book.m * len(book.words[0]))
    pairs = union([codes.select("vec_id", "code").crossJoin(F.broadcast(tables(part, book).select("query_id", "lut"))) for part in parts])
    return pairs.select("query_id", "vec_id", (F.lit(1.0) - looked_up(F.col("lut"), F.col("code"))).alias("dist"))


def search(codes: DataFrame, base: DataFrame, queries: DataFrame, book: Codebook, k: int = 10, candidates: int = 0) -> DataFrame:
    """The best ``candidates`` by code (3 k if 0, k at least), then the k closest of them by inner product."""
    most = max(candidates or 3 * k, k)
    return rerank(top_k(scores(codes, queries, book), most), base, queries, k, most=most)
