"""The engine's queries and their SQL, by name.

Searches take every vector whose id is divisible by 100 as a query, against all
vectors.  Distances are rounded to six decimals, ids and ranks are longs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import distance as D
from .operators import evaluate, flat, hnsw, hybrid, ivf, kmeans, linalg, mutable, pq
from .operators.sizes import blocks, union
from .plans import sql as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Parameters of the registered queries.
K, CLUSTERS, ROUNDS, NPROBE = 10, 8, 3, 3
#: Lists probed by the queries without SQL: recall of 0.9 on the whole table.
PROBED = 6
M, KS, PQ_ROUNDS = 8, 16, 2
RADIUS = 1.6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = _base(spark, sf_dir)
    return base, flat.query_set(base)


def _out(found: DataFrame) -> DataFrame:
    return found.select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("long").alias("rank"), F.col("vec_id").cast("long").alias("vec_id"), F.round("dist", 6).alias("dist"))


def _knn_sql(distance: str = "", where: str = "true", base: str = "embeddings", k: int = K) -> str:
    return S.select([S.QUERIES, S.pairs(distance, where, base), S.top("d", k)], S.out())


# Exact search

UNIT = S.normalized("embeddings", "u")
SCALED = "s as (select vec_id, label, list_transform(embedding, lambda x: x::double * (1 + label)) as embedding from embeddings)"


def _queries_of(table: str) -> str:
    return S.QUERIES.replace("embeddings", table)


@query("flat_knn_ip", _knn_sql())
def flat_knn_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(flat.knn(*_both(spark, sf_dir), K, "ip"))


@query("flat_knn_l2", _knn_sql(S.l2("q.q", "e.embedding")))
def flat_knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(flat.knn(*_both(spark, sf_dir), K, "l2"))


@query("flat_knn_cosine", S.select([*UNIT, _queries_of("u"), S.pairs(base="u"), S.top("d", K)], S.out()))
def flat_knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(flat.knn(*_both(spark, sf_dir), K, "cosine"))


def _scaled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of different lengths, for metrics to rank differently."""
    base = _base(spark, sf_dir)
    base = base.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label"))))
    return base, flat.query_set(base)


for _metric, _base_sql, _distance in (("ip", "s", S.ip), ("l2", "s", S.l2), ("cosine", "u", S.ip)):
    _ctes = [SCALED, *S.normalized("s", "u"), _queries_of(_base_sql), S.pairs(_distance("q.q", "e.embedding"), base=_base_sql), S.top("d", K)]

    @query(f"flat_knn_scaled_{_metric}", S.select(_ctes, S.out()))
    def flat_knn_scaled(spark: SparkSession, sf_dir: str, metric: str = _metric) -> DataFrame:
        return _out(flat.knn(*_scaled(spark, sf_dir), K, metric))


@query("flat_knn_gemm", _knn_sql())
def flat_knn_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(flat.knn_blocks(*_both(spark, sf_dir), K, "ip"))


@query("flat_knn_gemm_l2", _knn_sql(S.l2("q.q", "e.embedding")))
def flat_knn_gemm_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(flat.knn_blocks(*_both(spark, sf_dir), K, "l2"))


@query("flat_knn_all_pairs", _knn_sql().replace(" where vec_id % 100 = 0", ""))
def flat_knn_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is a query, in blocks."""
    base = _base(spark, sf_dir)
    return _out(flat.knn_blocks(base, flat.query_set(base, 1), K, "ip"))


def _bytes(base: DataFrame) -> DataFrame:
    return base.withColumn("embedding", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int")))


@query(
    "flat_l2_uint8",
    S.select(
        ["u as (select vec_id, list_transform(embedding, lambda x: floor((x::double + 1) * 127.5)::int) as embedding from embeddings)", "q as (select vec_id as query_id, embedding as q from u where vec_id % 100 = 0)",
         "d as (select query_id, vec_id, list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - embedding[i]) * (q[i] - embedding[i])))::double as dist from q, u)", S.top("d", K)],
        S.out(),
    ),
)
def flat_l2_uint8(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _bytes(_base(spark, sf_dir))
    return _out(flat.knn(base, flat.query_set(base), K, D.integer_l2).withColumn("dist", F.col("dist").cast("double")))


@query("filtered_knn_mod", _knn_sql(where="e.vec_id % 3 = 0"))
def filtered_knn_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(flat.knn(*_both(spark, sf_dir), K, allowed=F.col("vec_id") % 3 == 0))


@query("filtered_knn_allowlist", _knn_sql(where="e.vec_id in (select vec_id from embeddings where label in (2, 5))"))
def filtered_knn_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _both(spark, sf_dir)
    return _out(flat.knn(base, queries, K, allow_list=base.where(F.col("label").isin(2, 5)).select("vec_id")))


@query("filtered_knn_none", _knn_sql(where="false"))
def filtered_knn_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(flat.knn(*_both(spark, sf_dir), K, allowed=F.lit(False)))


@query("filtered_knn_tombstone", _knn_sql(where="e.vec_id not in (select vec_id from embeddings where label = 0)"))
def filtered_knn_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _both(spark, sf_dir)
    return _out(flat.knn(base, queries, K, deleted=base.where("label = 0").select("vec_id")))


IN_RADIUS = S.select([S.QUERIES, S.pairs(S.l2("q.q", "e.embedding")), f"r as (select *, row_number() over (partition by query_id order by dist, vec_id) as rank from d where dist <= {RADIUS})"], S.out("r"))


@query("range_search_l2", IN_RADIUS)
def range_search_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(flat.within(*_both(spark, sf_dir), RADIUS))


@query("range_search_most", S.select([S.QUERIES, S.pairs(S.l2("q.q", "e.embedding")), f"r as (select *, row_number() over (partition by query_id order by dist, vec_id) as rank from d where dist <= {RADIUS} qualify rank <= 5)"], S.out("r")))
def range_search_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(flat.within(*_both(spark, sf_dir), RADIUS, most=5))


TOP_DOCS = S.select(
        [S.QUERIES, f"d as (select q.query_id, e.vec_id, e.label, {S.l2('q.q', 'e.embedding')} as dist from q, embeddings e)",
         "f as (select *, (row_number() over (partition by query_id, label order by dist, vec_id) = 1)::int as fresh from d)",
         "r as (select *, row_number() over w as rank, sum(fresh) over (partition by query_id order by dist, vec_id rows between unbounded preceding and current row) as docs from f window w as (partition by query_id order by dist, vec_id))"],
        "select query_id, rank, vec_id, label::bigint as doc_id, round(dist, 6) as dist from r where docs <= 5",
)


@query("multivector_topdocs", TOP_DOCS)
def multivector_topdocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_out(flat.distinct_documents(*_both(spark, sf_dir), 5, doc="label"))


def _documents_out(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.col("doc_id").cast("long").alias("doc_id"), F.round("dist", 6).alias("dist"))


@query("ground_truth_ids", S.select([S.QUERIES, S.pairs(), S.top("d", 20)], "select query_id, string_agg(vec_id::varchar, ',' order by rank) as ids from top group by query_id"))
def ground_truth_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat.ground_truth(*_both(spark, sf_dir), 20).select("query_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


# Functions of vectors


@query(
    "pairwise_distance",
    S.select(
        [S.QUERIES, *UNIT, "n as (select vec_id as query_id, embedding as n from u where vec_id % 100 = 0)",
         f"d as (select q.query_id, e.vec_id, {S.ip('q.q', 'e.embedding')} as ip, {S.l2('q.q', 'e.embedding')} as l2, {S.ip('n.n', 'u.embedding')} as cosine from q join n using (query_id), embeddings e join u using (vec_id))"],
        f"select query_id, vec_id, {S.rounded('ip')} as ip, {S.rounded('l2')} as l2, {S.rounded('cosine')} as cosine from d",
    ),
)
def pairwise_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat.all_pairs(*_both(spark, sf_dir)).select("query_id", "vec_id", *[F.round(d, 6).alias(d) for d in ("ip", "l2", "cosine")])


def _elements(df: DataFrame, *keys: str, vector: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("i", "v")).select(*keys, F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@query("normalize_vectors", S.select([SCALED, *S.normalized("s", "n")], "select vec_id, i - 1 as i, round(embedding[i], 6) as v from n, unnest(range(1, len(embedding) + 1)) t(i)"))
def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _ = _scaled(spark, sf_dir)
    return _elements(base.withColumn("n", D.normalized(F.col("embedding"))), "vec_id", vector="n")


@query(
    "vector_hash_shard",
    "select vec_id, (list_reduce(list_transform(embedding, lambda v: cast(cast(v as bit) as uinteger)::hugeint), lambda h, v: (h * 31 + v) % 18446744073709551616, 0::hugeint) % 7)::int as shard from embeddings",
)
def vector_hash_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.shard_by_hash(_base(spark, sf_dir), 7).select("vec_id", "shard")


# k-means and inverted lists


def _centroids(spark: SparkSession, sf_dir: str, k: int = CLUSTERS, rounds: int = ROUNDS) -> kmeans.Centroids:
    base = _base(spark, sf_dir)
    return kmeans.lloyd(base, kmeans.first_rows(base, k), rounds, method="product")


KM = S.kmeans(CLUSTERS, ROUNDS)
CENTROIDS = f"c{ROUNDS}"


@query("kmeans_centroids", S.select(KM, f"select cid, i - 1 as i, round(c[i], 6) as v from {CENTROIDS}, unnest(range(1, len(c) + 1)) t(i)"))
def kmeans_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(kmeans.centroid_table(spark, _centroids(spark, sf_dir)), "cid", vector="c")


@query("kmeans_assign", S.select(KM, "select vec_id, cid from a"))
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.assign(_base(spark, sf_dir), _centroids(spark, sf_dir)).select("vec_id", "cid")


@query("residuals", S.select(KM, f"select a.vec_id, a.cid, i - 1 as i, round(a.embedding[i]::double - c.c[i], 6) as v from a join {CENTROIDS} c using (cid), unnest(range(1, len(c.c) + 1)) t(i)"))
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids = _centroids(spark, sf_dir)
    return _elements(hybrid.residuals(ivf.build(_base(spark, sf_dir), centroids), centroids), "vec_id", "cid", vector="residual")


@query("cluster_offsets", S.select(KM, "select cid, count(*) as n, (sum(count(*)) over (order by cid) - count(*))::bigint as begin from a group by cid"))
def cluster_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster_sizes(kmeans.assign(_base(spark, sf_dir), _centroids(spark, sf_dir)))


@query("cluster_stats", S.select([*KM, "n as (select cid, count(*) as n from a group by cid)"], f"select {CLUSTERS}::bigint as clusters, count(*) as filled, min(n) as least, max(n) as most, avg(n) as mean from n"))
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster_statistics(kmeans.assign(_base(spark, sf_dir), _centroids(spark, sf_dir)), CLUSTERS)


@query("ivf_probes", S.select([S.QUERIES, *KM, S.probes(CENTROIDS, NPROBE)], "select query_id, rank, cid, round(dist, 6) as dist from probes"))
def ivf_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, queries = _both(spark, sf_dir)
    found = ivf.probes(queries, _centroids(spark, sf_dir), NPROBE)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "cid", F.round("dist", 6).alias("dist"))


IN_LISTS = f"d as (select p.query_id, a.vec_id, {S.l2('q.q', 'a.embedding')} as dist from probes p join q using (query_id) join a using (cid))"


def _ivf(spark: SparkSession, sf_dir: str, nprobe: int) -> DataFrame:
    base, queries = _both(spark, sf_dir)
    centroids = _centroids(spark, sf_dir)
    return _out(ivf.search(ivf.build(base, centroids), queries, ivf.probes(queries, centroids, nprobe), K))


@query("ivf_knn", S.select([S.QUERIES, *KM, S.probes(CENTROIDS, NPROBE), IN_LISTS, S.top("d", K)], S.out()))
def ivf_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ivf(spark, sf_dir, NPROBE)


@query("ivf_knn_full_probe", _knn_sql(S.l2("q.q", "e.embedding")))
def ivf_knn_full_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ivf(spark, sf_dir, CLUSTERS)


@query("ivf_explicit_probes", S.select([S.QUERIES, *KM, "probes as (select query_id, c as cid from q, unnest([1, 4]) t(c))", IN_LISTS, S.top("d", K)], S.out()))
def ivf_explicit_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _both(spark, sf_dir)
    chosen = queries.select("query_id", F.explode(F.array(F.lit(1), F.lit(4))).alias("cid"))
    index = ivf.pruned(ivf.build(base, _centroids(spark, sf_dir)), chosen)
    return _out(ivf.search(index, queries, chosen, K))


@query("ivf_batch_grouped")
def ivf_batch_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _both(spark, sf_dir)
    centroids = _centroids(spark, sf_dir)
    return _out(ivf.search_in_groups(ivf.build(base, centroids), queries, centroids, K, PROBED, 4))


@query(
    "cluster_overlap",
    S.select([S.QUERIES, *KM, S.probes(CENTROIDS, NPROBE), "l as (select query_id, list(cid order by rank) as cids from probes group by query_id)"], "select a.query_id as query_a, b.query_id as query_b, len(list_intersect(a.cids, b.cids))::int as shared from l a join l b on a.query_id < b.query_id"),
)
def cluster_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that the queries of the stated set share."""
    _, queries = _both(spark, sf_dir)
    lists = ivf.probes(queries, _centroids(spark, sf_dir), NPROBE).groupBy("query_id").agg(F.collect_list("cid").alias("cids"))
    a, b = lists.toDF("query_a", "cids_a"), lists.toDF("query_b", "cids_b")
    return a.join(b, F.col("query_a") < F.col("query_b")).select("query_a", "query_b", D.overlap(F.col("cids_a"), F.col("cids_b")).alias("shared"))


# Product quantization

PQ = S.pq(M, KS, PQ_ROUNDS)
BOOK = f"pb{PQ_ROUNDS}"
ADC = f"d as (select lut.query_id, c.vec_id, 1.0::double - {S.looked_up('lut.lut', 'c.code')} as dist from lut, pcodes c)"


def _book(spark: SparkSession, sf_dir: str) -> pq.Codebook:
    return pq.train(_base(spark, sf_dir), M, KS, PQ_ROUNDS)


@query("pq_codebook", S.select(PQ, f"select m, k, i - 1 as i, round(cw[i], 6) as v from {BOOK}, unnest(range(1, len(cw) + 1)) t(i)"))
def pq_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_book(spark, sf_dir).table(spark), "m", "k", vector="cw")


CODES_SQL = S.select(PQ, "select vec_id, i - 1 as m, code[i]::int as k from pcodes, unnest(range(1, len(code) + 1)) t(i)")


def _codes_out(coded: DataFrame) -> DataFrame:
    return coded.select("vec_id", F.posexplode("code").alias("m", "k")).select("vec_id", F.col("m").cast("long").alias("m"), F.col("k").cast("int").alias("k"))


@query("pq_codes", CODES_SQL)
def pq_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes_out(pq.encode(_base(spark, sf_dir), _book(spark, sf_dir)))


@query("pq_codes_gemm", CODES_SQL)
def pq_codes_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes_out(pq.encode_by_product(_base(spark, sf_dir), _book(spark, sf_dir)))


@query("pq_lut", S.select([S.QUERIES, *PQ, S.lut(BOOK)], "select query_id, m, k, round(v, 6) as v from lut0"))
def pq_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, queries = _both(spark, sf_dir)
    rows = pq.tables(queries, _book(spark, sf_dir)).select("query_id", F.posexplode("lut").alias("m", "row"))
    return rows.select("query_id", "m", F.posexplode("row").alias("k", "v")).select("query_id", "m", "k", F.round("v", 6).alias("v"))


@query("pq_adc_knn", S.select([S.QUERIES, *PQ, S.lut(BOOK), ADC, S.top("d", K)], S.out()))
def pq_adc_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _both(spark, sf_dir)
    book = _book(spark, sf_dir)
    return _out(flat.top_k(pq.scores(pq.encode(base, book), queries, book), K))


def _rerank_sql(distance: str, ctes: list[str], candidates: int) -> str:
    exact = f"x as (select t.query_id, t.vec_id, {distance} as dist from best t join q using (query_id) join embeddings e using (vec_id))"
    return S.select([*ctes, S.top("d", candidates, "best"), exact, S.top("x", K)], S.out())


@query("pq_rerank_knn", _rerank_sql(S.ip("q.q", "e.embedding"), [S.QUERIES, *PQ, S.lut(BOOK), ADC], 3 * K))
def pq_rerank_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _both(spark, sf_dir)
    book = _book(spark, sf_dir)
    return _out(pq.search(pq.encode(base, book), base, queries, book, K))


@query("code_hamming", S.select([*PQ], "select a.vec_id as query_id, b.vec_id, len(list_filter(range(1, len(a.code) + 1), lambda i: a.code[i] != b.code[i]))::int as dist from pcodes a, pcodes b where a.vec_id % 100 = 0"))
def code_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pq.encode(_base(spark, sf_dir), _book(spark, sf_dir)).select("vec_id", "code")
    asked = coded.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("code").alias("other"))
    pairs = union([coded.crossJoin(F.broadcast(part)) for part in blocks(asked, 2 * M)])
    return pairs.select("query_id", "vec_id", D.hamming(F.col("code"), F.col("other")).alias("dist"))


# Inverted lists of codes

RESIDUAL = [*KM, f"res as (select a.vec_id, a.cid, list_transform(range(1, len(c.c) + 1), lambda i: a.embedding[i]::double - c.c[i]) as r from a join {CENTROIDS} c using (cid))", *S.pq(M, KS, PQ_ROUNDS, "res", "r")]
ASKED = f"asked as (select p.query_id, p.cid, c.c, list_transform(range(1, len(c.c) + 1), lambda i: q.q[i]::double - c.c[i]) as r from probes p join q using (query_id) join {CENTROIDS} c using (cid))"
RES_LUT = S.lut(BOOK, "asked", "r", S.l2, "query_id, cid")
RES_ADC = f"d as (select l.query_id, a.vec_id, {S.looked_up('l.lut', 'x.code')} as dist from lut l join a using (cid) join pcodes x using (vec_id))"


def _ivfpq(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    base, queries = _both(spark, sf_dir)
    centroids = _centroids(spark, sf_dir)
    book = hybrid.train(base, centroids, M, KS, PQ_ROUNDS)
    return _out(hybrid.search(hybrid.build(base, centroids, book), queries, centroids, book, K, NPROBE, 50, **options))


@query("ivfpq_knn", _rerank_sql(S.l2("q.q", "e.embedding"), [S.QUERIES, *RESIDUAL, S.probes(CENTROIDS, NPROBE), ASKED, RES_LUT, RES_ADC], 50))
def ivfpq_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ivfpq(spark, sf_dir)


@query("ivfpq_adc_knn", S.select([S.QUERIES, *RESIDUAL, S.probes(CENTROIDS, NPROBE), ASKED, RES_LUT, RES_ADC, S.top("d", K)], S.out()))
def ivfpq_adc_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ivfpq(spark, sf_dir, exact=False)


def _legacy_sql() -> str:
    block = lambda v: f"{v}[b.m * len(b.cw) + 1 : (b.m + 1) * len(b.cw)]"
    term = f"{S.dot(block('q.c'), 'b.cw')} + 2.0::double * {S.dot('b.cw', 'b.cw')} - 2.0::double * {S.dot(block('q.r'), 'b.cw')}"
    lut = f"lut0 as (select q.query_id, q.cid, b.m, b.k, {term} as v from asked q, {BOOK} b), lut as (select query_id, cid, list(vs order by m) as lut from (select query_id, cid, m, list(v order by k) as vs from lut0 group by query_id, cid, m) group by query_id, cid)"
    adc = f"d as (select l.query_id, a.vec_id, {S.dot('s.r', 's.r')} * {float(M)}::double + {S.looked_up('l.lut', 'x.code')} as dist from lut l join asked s using (query_id, cid) join a using (cid) join pcodes x using (vec_id))"
    return S.select([S.QUERIES, *RESIDUAL, S.probes(CENTROIDS, NPROBE), ASKED, lut, adc, S.top("d", K)], S.out())


@query("ivfpq_legacy_score", _legacy_sql())
def ivfpq_legacy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ivfpq(spark, sf_dir, score="legacy", exact=False)


PQIVF = [*PQ, *S.kmeans(CLUSTERS, ROUNDS, "pcodes", "code", "k"), "qc as (select vec_id as query_id, code from pcodes where vec_id % 100 = 0)", S.probes(f"kc{ROUNDS}", NPROBE, "qc", "code"), S.lut(BOOK)]
PQIVF_ADC = f"d as (select p.query_id, x.vec_id, 1.0::double - {S.looked_up('l.lut', 'x.code')} as dist from probes p join lut l using (query_id) join ka x using (cid))"


@query("pqivf_knn", _rerank_sql(S.l2("q.q", "e.embedding"), [S.QUERIES, *PQIVF, PQIVF_ADC], 50))
def pqivf_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _both(spark, sf_dir)
    book = _book(spark, sf_dir)
    centroids, index = hybrid.code_lists(pq.encode(base, book), CLUSTERS, ROUNDS)
    return _out(hybrid.search_code_lists(index, queries, centroids, book, K, NPROBE, 50))


# Graphs


@query("hnsw_exhaustive_ef", _knn_sql(S.l2("q.q", "e.embedding")))
def hnsw_exhaustive_ef(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a beam as wide as the largest graph, the result is exact."""
    base, queries = _both(spark, sf_dir)
    sharded = hnsw.shard_in_turn(base, 4)
    return _out(hnsw.search_shards(hnsw.build(sharded, ef_build=100), queries, K, max(K, _widest(sharded))))


def _widest(sharded: DataFrame) -> int:
    return sharded.groupBy("shard").count().agg(F.max("count")).first()[0] or 0


@query("hnsw_filtered_exhaustive", _knn_sql(S.l2("q.q", "e.embedding"), "e.label in (2, 5)"))
def hnsw_filtered_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks lead through all vectors and keep those of two labels."""
    base, queries = _both(spark, sf_dir)
    sharded = hnsw.shard_in_turn(base, 4)
    return _out(hnsw.search_shards(hnsw.build(sharded, ef_build=100), queries, K, max(K, _widest(sharded)), sharded.where("label in (2, 5)")))


@query("hnsw_range_exhaustive", IN_RADIUS)
def hnsw_range_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks that end at a radius, after as many vectors as the largest graph has."""
    base, queries = _both(spark, sf_dir)
    sharded = hnsw.shard_in_turn(base, 4)
    return _out(hnsw.search_within(hnsw.build(sharded, ef_build=100), queries, RADIUS, _widest(sharded)))


@query("hnsw_topdocs_exhaustive", TOP_DOCS)
def hnsw_topdocs_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks that end at a number of documents, having met all of them."""
    base, queries = _both(spark, sf_dir)
    sharded = hnsw.shard_in_turn(base, 4)
    graphs = hnsw.build(sharded, ef_build=100)
    return _documents_out(hnsw.search_documents(graphs, queries, sharded.select("shard", "vec_id", F.col("label").alias("doc_id")), 5, base.select("label").distinct().count()))


@query("hnsw_knn")
def hnsw_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _both(spark, sf_dir)
    return _out(hnsw.search_shards(hnsw.build(base.withColumn("shard", F.lit(0)), ef_build=150, metric="ip"), queries, K, 50))


@query("ivf_hnsw_knn")
def ivf_hnsw_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _both(spark, sf_dir)
    centroids = _centroids(spark, sf_dir)
    graphs = hnsw.build(hnsw.shard_by_cluster(base, centroids))
    return _out(hnsw.search_lists(graphs, queries, centroids, K, PROBED, 50, base))


@query("sharded_hnsw_knn")
def sharded_hnsw_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _both(spark, sf_dir)
    return _out(hnsw.search_shards(hnsw.build(hnsw.shard_at_random(base, 4)), queries, K, 50))


@query("hnsw_integrity", "select 0::bigint as loops, 0::bigint as repeats, 0::bigint as crowded")
def hnsw_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.integrity(hnsw.edge_table(hnsw.build(hnsw.shard_in_turn(_base(spark, sf_dir), 4), ef_build=100)))


@query("shard_round_robin", "select vec_id, (vec_id % 4)::int as shard from embeddings")
def shard_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.shard_in_turn(_base(spark, sf_dir), 4).select("vec_id", "shard")


@query("shard_kmeans", S.select(S.kmeans(4, ROUNDS), "select vec_id, cid as shard from a"))
def shard_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.shard_by_cluster(_base(spark, sf_dir), _centroids(spark, sf_dir, 4)).select("vec_id", "shard")


@query("shard_stats", "select count(*) as shards, min(n) as least, max(n) as most, avg(n) as mean from (select vec_id % 4 as shard, count(*) as n from embeddings group by shard)")
def shard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.shard_statistics(hnsw.shard_in_turn(_base(spark, sf_dir), 4))


# Changes

FLIPPED = "list_transform(embedding, lambda x: -x)"


def _flipped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("embedding", F.transform("embedding", lambda x: -x))


@query("upsert_knn", S.select([f"b as (select vec_id, case when vec_id % 10 = 3 then {FLIPPED} else embedding end as embedding from embeddings union all select vec_id + 1000000, {FLIPPED} from embeddings where vec_id % 10 = 4)", S.QUERIES, S.pairs(base="b"), S.top("d", K)], S.out()))
def upsert_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some vectors are turned around, and some such ones come in addition."""
    base, queries = _both(spark, sf_dir)
    base = base.select("vec_id", "embedding")
    more = _flipped(base.where("vec_id % 10 = 3")).unionByName(_flipped(base.where("vec_id % 10 = 4")).withColumn("vec_id", F.col("vec_id") + 1000000))
    return _out(flat.knn(mutable.upsert(base, more), queries, K))


@query("delete_undelete_knn", _knn_sql(where="not (e.label = 1 and e.vec_id % 2 = 0)"))
def delete_undelete_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's vectors are deleted, half of them restored."""
    base, queries = _both(spark, sf_dir)
    none = base.select("vec_id").where("false")
    marks = mutable.marked(none, base.where("label = 1").select("vec_id"), base)
    marks = mutable.unmarked(marks, base.where("label = 1 and vec_id % 2 = 1").select("vec_id"))
    return _out(flat.knn(base, queries, K, deleted=marks))


@query("replace_deleted", S.select(["g as (select vec_id from embeddings where label = 1 order by vec_id limit (select count(*) from embeddings where vec_id % 50 = 7))", f"b as (select vec_id, embedding from embeddings where vec_id not in (select vec_id from g) union all select vec_id + 1000000, {FLIPPED} from embeddings where vec_id % 50 = 7)"], "select vec_id, round(embedding[1]::double, 6) as first from b"))
def replace_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _base(spark, sf_dir)
    rows = base.select("vec_id", "embedding")
    more = _flipped(rows.where("vec_id % 50 = 7")).withColumn("vec_id", F.col("vec_id") + 1000000)
    now, _ = mutable.replaced(rows, base.where("label = 1").select("vec_id"), more)
    return now.select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("delete_counts", "select count(*) as total, count(*) filter (label = 1) as deleted from embeddings")
def delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _base(spark, sf_dir)
    return mutable.counts(base, base.where("label = 1").select("vec_id"))


# Evaluation

TRUTH = [S.QUERIES, S.pairs(S.l2("q.q", "e.embedding"), name="t"), S.top("t", K, "truth")]


@query("recall_at_k", S.select([*TRUTH, *KM, S.probes(CENTROIDS, NPROBE), IN_LISTS, S.top("d", K)], f"select t.query_id, count(f.vec_id)::double / {K}.0::double as recall from truth t left join top f on f.query_id = t.query_id and f.vec_id = t.vec_id group by t.query_id"))
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _both(spark, sf_dir)
    return evaluate.recall(_ivf(spark, sf_dir, NPROBE), flat.knn(base, queries, K, "l2"), K)


def _sweep_sql() -> str:
    parts, ctes = [], [*TRUTH, *KM, S.probes(CENTROIDS, CLUSTERS)]
    for n in (1, 2, 4, 8):
        ctes.append(f"d{n} as (select p.query_id, a.vec_id, {S.l2('q.q', 'a.embedding')} as dist from probes p join q using (query_id) join a using (cid) where p.rank <= {n})")
        ctes.append(S.top(f"d{n}", K, f"top{n}"))
        parts.append(f"select {n}::int as nprobe, round((select count(*) from truth t join top{n} f on f.query_id = t.query_id and f.vec_id = t.vec_id)::double / (select count(*) from truth), 6) as recall")
    return S.select(ctes, " union all ".join(parts))


@query("recall_vs_nprobe", _sweep_sql())
def recall_vs_nprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _both(spark, sf_dir)
    centroids = _centroids(spark, sf_dir)
    index, truth = ivf.build(base, centroids), flat.knn(base, queries, K, "l2")
    found = evaluate.sweep({str(n): lambda n=n: ivf.search(index, queries, ivf.probes(queries, centroids, n), K) for n in (1, 2, 4, 8)}, truth, K)
    return found.select(F.col("name").cast("int").alias("nprobe"), F.round("recall", 6).alias("recall"))


@query("flat_vs_gemm", "select vec_id as query_id, true as close, 0::bigint as other_ids from embeddings where vec_id % 100 = 0")
def flat_vs_gemm(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, queries = _both(spark, sf_dir)
    found = evaluate.compared(flat.knn(base, queries, K), flat.knn_blocks(base, queries, K))
    return found.select("query_id", (F.col("max_diff") < 1e-9).alias("close"), F.col("other_ids").cast("long").alias("other_ids"))


# Kernels

SIDE, COUNT = 64, 1024


@query("matvec", f"select i, sum(j::double * (i + j)) as out from range({SIDE}) a(i), range({SIDE}) b(j) group by i")
def matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.multiply(linalg.vector(spark, SIDE), linalg.matrix(spark, SIDE))


def _ones(spark: SparkSession) -> DataFrame:
    return spark.range(COUNT).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))


ONES_SQL = f"select {COUNT}.0::double as total"


@query("array_sum_naive", ONES_SQL)
def array_sum_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.total(_ones(spark))


for _chains in (2, 4):

    @query(f"array_sum_{_chains}_chains", ONES_SQL)
    def array_sum_chains(spark: SparkSession, sf_dir: str, chains: int = _chains) -> DataFrame:
        return linalg.total_in_chains(_ones(spark), chains)


for _mode, _name in ((1, "halves"), (2, "tree")):

    @query(f"array_sum_{_name}", ONES_SQL)
    def array_sum_folded(spark: SparkSession, sf_dir: str, mode: int = _mode) -> DataFrame:
        return linalg.total_by_folding(_ones(spark), COUNT, mode)


@query("array_sum_other_mode", "select -1.0::double as total")
def array_sum_other_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.total_by_folding(_ones(spark), COUNT, 3)
