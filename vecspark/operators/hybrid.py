"""Inverted lists of quantized residuals, and inverted lists over codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from . import ivf, kmeans, pq
from .topk import top_k


def residuals(index: DataFrame, centroids: kmeans.Centroids) -> DataFrame:
    """``index`` (with cid) with ``residual``: the vector less its centroid."""
    table = F.broadcast(kmeans.centroid_table(index.sparkSession, centroids))
    return index.join(table, "cid").withColumn("residual", D.residual(F.col("embedding"), F.col("c"))).drop("c")


def train(base: DataFrame, centroids: kmeans.Centroids, m: int = 8, ks: int = 256, iterations: int = 20) -> pq.Codebook:
    """A codebook of the residuals."""
    return pq.train(residuals(ivf.build(base, centroids), centroids), m, ks, iterations, "residual")


def build(base: DataFrame, centroids: kmeans.Centroids, book: pq.Codebook) -> DataFrame:
    """``vec_id, embedding, cid, code, terms`` with the code of each vector's residual, and what a score needs of list and code alone."""
    coded = pq.encode(residuals(ivf.build(base, centroids), centroids), book, "residual").drop("residual")
    return with_terms(coded, centroids, book)


def with_terms(index: DataFrame, centroids: kmeans.Centroids, book: pq.Codebook) -> DataFrame:
    """``index`` with ``terms``: sums over the code's words w of 2 <c, w> + |w|^2 and, for older scores, 3 <c, w> + 2 |w|^2.

    With q the query and c the centroid, |q - c - w|^2 = |q - c|^2 - 2 <q, w> +
    2 <c, w> + |w|^2: only the first two parts depend on the query, and none of
    them on query and code and list at once.  So the tables of a list shrink to
    one number for each of its vectors.
    """
    rows = pq.with_codebook(index, book).join(F.broadcast(kmeans.centroid_table(index.sparkSession, centroids)), "cid")
    word = F.transform("code", lambda k, m: F.get(F.get(F.col("book"), m), k.cast("int")))

    def total(term: D.Distance) -> Column:
        return F.aggregate(F.transform(word, lambda w, m: term(D.subvector(F.col("c"), m, book.size), w)), F.lit(0.0), lambda s, x: s + x)

    both, squares = total(D.dot), total(lambda c, w: D.dot(w, w))
    return rows.withColumn("terms", F.array(F.lit(2.0) * both + squares, F.lit(3.0) * both + F.lit(2.0) * squares)).drop("book", "c")


def scores(index: DataFrame, queries: DataFrame, centroids: kmeans.Centroids, book: pq.Codebook, nprobe: int = 10, score: str = "residual") -> DataFrame:
    """``query_id, vec_id, dist`` of the codes in the probed lists.

    ``residual``: the squared distance of the query's residual to the code's
    words.  ``legacy``: a formula with other weights, for comparison only.  A
    query's inner products with all words and its distances to its lists go to
    the index, in blocks of checked size.
    """
    if "terms" not in index.columns:
        index = with_terms(index, centroids, book)
    chosen = ivf.probes(queries, centroids, nprobe).select("query_id", "cid", F.col("dist").alias("to_list"))
    tables = pq.tables(queries, book).select("query_id", "lut")
    near = ivf.at_lists(index.select("vec_id", "cid", "code", "terms"), tables, chosen, 24 * nprobe, 8 * book.m * len(book.words[0]))
    weight, term = (1.0, 0) if score == "residual" else (float(book.m), 1)
    dist = F.lit(weight) * F.col("to_list") - F.lit(2.0) * pq.looked_up(F.col("lut"), F.col("code")) + F.col("terms")[term]
    return near.select("query_id", "vec_id", dist.alias("dist"))


def search(index: DataFrame, queries: DataFrame, centroids: kmeans.Centroids, book: pq.Codebook, k: int = 10, nprobe: int = 10, candidates: int = 500, score: str = "residual", exact: bool = True) -> DataFrame:
    """The best candidates by code in the probed lists; with ``exact``, the k closest of them by squared distance."""
    most = max(candidates or 3 * k, k) if exact else k
    best = top_k(scores(index, queries, centroids, book, nprobe, score), most)
    return pq.rerank(best, index, queries, k, "l2", most) if exact else best.select("query_id", "rank", "vec_id", "dist")


def code_lists(codes: DataFrame, k: int, iterations: int = 20) -> tuple[kmeans.Centroids, DataFrame]:
    """Clusters of the codes, taken as vectors of numbers, and ``codes`` with ``cid``.

    Codewords have no order, so these clusters have no geometry to go by: the
    method is experimental.
    """
    centroids = kmeans.lloyd(codes, kmeans.first_rows(codes, k, "code"), iterations, "code")
    return centroids, kmeans.assign(codes, centroids, "code")


def search_code_lists(index: DataFrame, queries: DataFrame, centroids: kmeans.Centroids, book: pq.Codebook, k: int = 10, nprobe: int = 10, candidates: int = 500, exact: bool = True) -> DataFrame:
    """Lists are chosen by the query's own code, codes scored by inner product, candidates re-ranked by squared distance."""
    coded = pq.encode(queries, book, "q")
    chosen = ivf.probes(coded.select("query_id", F.col("code").alias("q")), centroids, nprobe).select("query_id", "cid")
    tables = pq.tables(queries, book).select("query_id", "lut")
    near = ivf.at_lists(index.select("vec_id", "cid", "code"), tables, chosen, 16 * nprobe, 8 * book.m * len(book.words[0]))
    near = near.select("query_id", "vec_id", (F.lit(1.0) - pq.looked_up(F.col("lut"), F.col("code"))).alias("dist"))
    most = max(candidates, k) if exact else k
    best = top_k(near, most)
    return pq.rerank(best, index, queries, k, "l2", most) if exact else best.select("query_id", "rank", "vec_id", "dist")
