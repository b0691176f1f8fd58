import numpy as np
import pytest
from pyspark.sql import functions as F
from vectors import asked, blobs, exact, frame, lists, recall

from vecspark.functions import distance as D
from vecspark.operators import evaluate, flat, hnsw, hybrid, ivf, kmeans, linalg, mutable, pq
from vecspark.operators.topk import merged
from vecspark.queries import QUERIES


@pytest.mark.parametrize(("left", "right"), [(1, 1), (6, 4), (31, 127)])
def test_known_distances(spark, left, right):
    rows = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0, 1], [1, 1, 1]], float)
    rows = np.pad(rows, ((0, 0), (left, right)))
    want = {"l2": [0, 1, 2, 2, 2], "ip": [-2, -1, 0, 0, 0], "cosine": [0, 0.1835, 0.4226, 0.4226, 0.4226]}
    for metric, values in want.items():
        for found in (flat.knn, flat.knn_blocks):
            got = found(frame(spark, rows), asked(spark, rows[-1:]), 5, metric).orderBy("rank").collect()
            assert np.allclose([r["dist"] for r in got], values, atol=1e-3)


@pytest.mark.parametrize("metric", ["ip", "l2", "cosine"])
def test_exact_search(spark, metric):
    x, q = blobs(600, 13)
    x = x * (1 + np.arange(600) % 3)[:, None].astype(np.float32)
    truth = exact(x, q, 7, metric)
    base, queries = frame(spark, x).repartition(5), asked(spark, q)
    assert list(lists(flat.knn(base, queries, 7, metric)).values()) == truth
    assert list(lists(flat.knn_blocks(base, queries, 7, metric, block=16)).values()) == truth


def test_ties_go_to_the_least_id(spark):
    x = np.repeat(np.eye(4, dtype=np.float32), 50, axis=0)
    base, queries = frame(spark, x).repartition(6), asked(spark, x[:1])
    assert lists(flat.knn(base, queries, 9, "l2"))[0] == list(range(9))
    assert lists(flat.knn_blocks(base, queries, 9, "l2"))[0] == list(range(9))


def test_fewer_than_k(spark):
    x, q = blobs(4, 3, 2, 2)
    assert flat.knn_blocks(frame(spark, x), asked(spark, q), 10).count() == 8
    assert flat.knn_blocks(frame(spark, x), asked(spark, q).where("false"), 10).count() == 0
    assert flat.knn_blocks(frame(spark, x).where("false"), asked(spark, q), 10).count() == 0


def test_filters(spark):
    x, q = blobs(100, 4, 3, 10)
    base, queries = frame(spark, x, 17), asked(spark, q)
    found = flat.knn(base, queries, 10, "l2", F.col("vec_id") % 3 == 0)
    assert found.where("vec_id % 3 != 0").count() == 0 and found.count() == 100
    ids = spark.createDataFrame([(i,) for i in (26, 39, 52, 65, 999)], "vec_id long")
    assert {r["vec_id"] for r in flat.knn(base, queries, 10, "l2", allow_list=ids).collect()} == {26, 39, 52, 65}
    assert flat.knn(base, queries, 10, "l2", F.lit(False)).count() == 0
    assert flat.knn(base, queries, 100, "l2", deleted=ids).where("vec_id in (26, 39, 52, 65)").count() == 0


def test_range_and_documents(spark):
    chance = np.random.default_rng(2)
    x, q = chance.random((800, 6)).astype(np.float32), chance.random((10, 6)).astype(np.float32)
    far = ((q[:, None].astype(float) - x[None]) ** 2).sum(2)
    base, queries = frame(spark, x).withColumn("doc_id", F.col("vec_id") % 50), asked(spark, q)
    got = flat.within(base, queries, 0.2).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(a, b) for a, b in np.argwhere(far <= 0.2).tolist()}
    assert flat.within(base, queries, 0.2, most=3).groupBy("query_id").count().where("count > 3").count() == 0
    for r in flat.distinct_documents(base, queries, 10).groupBy("query_id").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("n")).collect():
        order = (np.argsort(far[r["query_id"]], kind="stable") % 50).tolist()
        n = next(k for k in range(801) if k == 800 or len(set(order[: k + 1])) > 10)
        assert (r["docs"], r["n"]) == (10, n)


def test_own_distance(spark):
    x, q = blobs(50, 4, 2, 3)
    largest = lambda a, b: F.array_max(F.zip_with(a, b, lambda u, v: F.abs(u.cast("double") - v.cast("double"))))
    truth = [np.argsort(np.abs(x.astype(float) - row).max(1), kind="stable")[:5].tolist() for row in q.astype(float)]
    assert list(lists(flat.knn(frame(spark, x), asked(spark, q), 5, largest)).values()) == truth
    with pytest.raises(ValueError):
        D.metric("manhattan")


def test_hash_shards(spark):
    x = np.array([[0.5, -1.25, 3.0], [0, 0, 0], [1e-20, 1e20, -0.0]], np.float32)
    got = {r["vec_id"]: r["shard"] for r in D.hash_shards(frame(spark, x), 11).collect()}
    for k, row in enumerate(x):
        h = 0
        for bits in row.view(np.uint32).tolist():
            h = (h * 31 + bits) % 2**64
        assert got[k] == h % 11


def test_merge_and_recall(spark):
    x, q = blobs(300, 5)
    base, queries = frame(spark, x), asked(spark, q)
    whole = flat.knn(base, queries, 6, "l2")
    parts = [flat.knn(base.where(F.col("vec_id") % 3 == k), queries, 6, "l2") for k in range(3)]
    assert lists(merged(parts, 6)) == lists(whole)
    assert evaluate.mean_recall(parts[0], whole, 6) < 1 == evaluate.mean_recall(whole, whole, 6)
    assert set(evaluate.timed(lambda: whole, 50)) == {"latency_us", "qps"}
    times = evaluate.measured({"whole": lambda: whole, "part": lambda: parts[0]}, 50, runs=1)
    assert list(times) == ["whole", "part"] and times["whole"]["speed_up"] == 1
    assert times["part"]["speed_up"] == times["whole"]["latency_us"] / times["part"]["latency_us"]
    assert evaluate.measured({}, 50) == {}
    held = evaluate.memory(spark)
    assert all(0 < held[f"{name}_now"] <= held[f"{name}_peak"] for name in ("python", "jvm") if f"{name}_now" in held)
    worst = evaluate.compared(whole, parts[0]).agg(F.sum("other_ids")).first()[0]
    assert worst > 0 and evaluate.compared(whole, whole).agg(F.max("max_diff")).first()[0] == 0


def test_kmeans(spark):
    x, _ = blobs(2000, 8, 12)
    base = frame(spark, x)
    start = kmeans.plus_plus(kmeans.sampled(base, 500), 12, seed=3)
    by_columns, by_product = (kmeans.lloyd(base, start, 4, method=m) for m in ("columns", "product"))
    assert np.allclose([c for _, c in by_columns], [c for _, c in by_product], atol=1e-6)
    before = np.array([c for _, c in start])
    for _ in range(4):
        at = ((x[:, None].astype(float) - before[None]) ** 2).sum(2).argmin(1)
        before = np.array([x[at == k].mean(0, dtype=float) if (at == k).any() else before[k] for k in range(12)])
    assert np.allclose([c for _, c in by_columns], before, atol=1e-5)
    empty = [*start[:2], (2, [1e6] * 8)]
    assert kmeans.lloyd(base, empty, 2)[2][1] == [1e6] * 8  # a cluster without vectors stays
    with pytest.raises(ValueError):
        kmeans.first_rows(base.limit(3), 4)
    assert [kmeans.list_count(n) for n in (500, 2000, 100_000)] == [50, 178, 1000]
    assert [kmeans.list_count(n, "ivfhnsw") for n in (500, 2000, 100_000)] == [10, 40, 512]
    codes = np.array([[0, 1], [0, 2], [5, 5]])
    assert kmeans.code_distance(codes, codes[0]).tolist() == [0, 1, 2]
    assert len(kmeans.plus_plus(codes.astype(float), 3, distance=kmeans.code_distance)) == 3


@pytest.fixture(scope="module")
def clustered(spark):
    x, q = blobs(3000, 32)
    base, queries = frame(spark, x).cache(), asked(spark, q).cache()
    return x, q, base, queries, exact(x, q, 10), kmeans.train(base, 20, 10, seed=1)


def test_inverted_lists(spark, clustered):
    x, q, base, queries, truth, centroids = clustered
    index = ivf.build(base, centroids).cache()
    seen = [recall(ivf.search(index, queries, ivf.probes(queries, centroids, n), 10), truth) for n in (1, 4, 20)]
    assert seen == sorted(seen) and seen[1] > 0.95 and seen[2] == 1
    chosen = ivf.probes(queries, centroids, 2)
    assert lists(ivf.search(ivf.pruned(index, chosen), queries, chosen, 10)) == lists(ivf.search(index, queries, chosen, 10, lists=4))
    assert recall(ivf.search_in_groups(index, queries, centroids, 10, 4, 8), truth) > 0.9
    more = ivf.add(index, frame(spark, q, 10_000), centroids)
    assert all(r["vec_id"] == 10_000 + r["query_id"] for r in ivf.search(more, queries, ivf.probes(queries, centroids, 1), 1).collect())


def test_query_groups(spark):
    rows = [(0, 1), (0, 2), (1, 7), (1, 8), (2, 1), (2, 2), (3, 2), (3, 9)]
    found = spark.createDataFrame(rows, "query_id long, cid int")
    assert ivf.grouped_queries(found, 2) == [[0, 2], [1, 3]]
    shared = {(r["query_id"], r["cid"]) for r in ivf.shared_probes(found, 2, 1).collect()}
    assert shared == {(0, 1), (0, 2), (2, 1), (2, 2), (1, 2), (1, 7), (3, 2), (3, 7)}


def test_quantized_search(spark, clustered):
    x, q, base, queries, truth, centroids = clustered
    book = pq.train(base, 8, 32, 4, start=kmeans.sampled(base, 32))
    codes = pq.encode_by_product(base, book)
    assert codes.join(pq.encode(base, book).withColumnRenamed("code", "other"), "vec_id").where("code != other").count() == 0
    by_ip = exact(x, q, 10, "ip")
    assert recall(pq.search(codes, base, queries, book, 10, 3000), by_ip) == 1
    seen = [recall(pq.search(codes, base, queries, book, 10, n), by_ip) for n in (20, 300)]
    assert seen[0] <= seen[1] and seen[1] > 0.9
    assert pq.Codebook.of_table(book.table(spark)) == book
    with pytest.raises(ValueError):
        pq.train(base, 7, 16)
    with pytest.raises(ValueError):
        pq.train(base.limit(8), 8, 16)


def test_lists_of_codes(spark, clustered):
    x, q, base, queries, truth, centroids = clustered
    book = hybrid.train(base, centroids, 8, 32, 3)
    index = hybrid.build(base, centroids, book).cache()
    assert recall(hybrid.search(index, queries, centroids, book, 10, 4, 200), truth) > 0.9
    assert recall(hybrid.search(index, queries, centroids, book, 10, 20, 3000), truth) == 1
    assert hybrid.search(index, queries, centroids, book, 10, 4, exact=False).count() == 500
    plain = pq.train(base, 8, 16, 2)
    lists_, coded = hybrid.code_lists(pq.encode(base, plain), 6, 2)
    assert recall(hybrid.search_code_lists(coded, queries, lists_, plain, 10, 6, 3000), truth) == 1
    nearest = hybrid.search_code_lists(coded, queries, lists_, plain, 5, 6, exact=False)
    assert nearest.where("rank = 1").count() == len(q)


def test_graphs(spark, clustered):
    x, q, base, queries, truth, centroids = clustered
    graphs = hnsw.build(hnsw.shard_in_turn(base, 3), ef_build=100).cache()
    seen = [recall(hnsw.search_shards(graphs, queries, 10, ef), truth) for ef in (10, 200)]
    assert seen[0] <= seen[1] and seen[1] > 0.95
    assert tuple(hnsw.integrity(hnsw.edge_table(graphs)).first()) == (0, 0, 0)
    allowed = hnsw.shard_in_turn(base, 3).where("vec_id % 2 = 0").select("shard", "vec_id")
    even = hnsw.search_shards(graphs, queries, 10, 100, allowed)
    assert even.where("vec_id % 2 = 1").count() == 0 and even.count() == 10 * len(q)
    by_cluster = hnsw.build(hnsw.shard_by_cluster(base, centroids), ef_build=100)
    assert recall(hnsw.search_lists(by_cluster, queries, centroids, 10, 4, 60, base), truth) > 0.95
    for shard in (hnsw.shard_at_random(base, 4), hnsw.shard_by_hash(base, 4)):
        assert hnsw.shard_statistics(shard).first()["shards"] == 4


def test_one_graph():
    x, q = blobs(700, 8, 5)
    graph = hnsw.Graph(8, 8, 60)
    for k, row in enumerate(x):
        graph.add(k, row)
    graph = hnsw.Graph.loaded(graph.dumped())
    truth = exact(x, q, 5)
    assert np.mean([len({i for _, i in graph.search(row, 5, 60)} & set(t)) / 5 for row, t in zip(q, truth)]) > 0.95
    for k in range(0, 700, 2):
        graph.delete(k)
    assert all(i % 2 for row in q for _, i in graph.search(row, 5, 60))
    with pytest.raises(ValueError):
        graph.delete(0)
    graph.undelete(0)
    assert graph.search(x[0], 1, 60)[0][1] == 0
    graph.add(1, x[1] + 100)  # moved far away
    assert graph.search(x[1] + 100, 1, 60)[0] == (0, 1)
    far = ((x.astype(float) - q[0]) ** 2).sum(1)
    odd = [k for k in range(700) if (k % 2 or k == 0) and k != 1]
    want = {k for k in odd if far[k] <= np.median(far[odd]) / 4}
    got = {i for _, i in graph.within(q[0], np.median(far[odd]) / 4)}
    assert len(got & want) >= 0.95 * len(want) and got <= want
    assert hnsw.Graph(3).search([0, 0, 0], 2) == []


def test_changes(spark):
    x, q = blobs(60, 3, 2, 4)
    base = frame(spark, x)
    none = base.select("vec_id").where("false")
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "vec_id long")
    marks = mutable.marked(none, ids(1, 2, 3), base)
    assert tuple(mutable.counts(base, marks).first()) == (60, 3)
    for wrong in (ids(2), ids(1000)):
        with pytest.raises(ValueError):
            mutable.marked(marks, wrong, base)
    with pytest.raises(ValueError):
        mutable.unmarked(marks, ids(4))
    assert mutable.unmarked(marks, ids(2)).count() == 2
    assert mutable.removed(base, ids(5, 999)).count() == 59
    now, left = mutable.replaced(base, marks, frame(spark, q[:2], 500))
    assert now.count() == 60 and left.count() == 1 and now.where("vec_id in (1, 2)").count() == 0
    assert mutable.vectors(base, [3, 4]).count() == 2
    with pytest.raises(KeyError):
        mutable.vectors(base, [3], marks)
    with pytest.raises(ValueError):
        mutable.check_capacity(base, 1, 60)


@pytest.mark.parametrize("n", [1, 2, 64])
def test_sums(spark, n):
    ones = spark.range(n).selectExpr("id as i", "1.0D as v")
    for total in (linalg.total(ones), linalg.total_in_chains(ones, 2), linalg.total_in_chains(ones, 4), linalg.total_by_folding(ones, n, 1), linalg.total_by_folding(ones, n, 2)):
        assert total.first()["total"] == n
    assert linalg.total_by_folding(ones, n, 5).first()["total"] == (1 if n == 1 else -1)
    got = {r["i"]: r["out"] for r in linalg.multiply(linalg.vector(spark, n), linalg.matrix(spark, n)).collect()}
    assert got == {i: sum(j * (i + j) for j in range(n)) for i in range(n)}


def test_many_queries_go_in_blocks(spark, monkeypatch):
    from vecspark.operators import sizes

    x, q = blobs(200, 6)
    base, queries = frame(spark, x), asked(spark, q)
    whole, coded = lists(flat.knn(base, queries, 4, "l2")), pq.train(base, 2, 8, 1)
    by_code = lists(pq.search(pq.encode(base, coded), base, queries, coded, 4))
    graphs = hnsw.build(hnsw.shard_in_turn(base, 2), 8, 40)
    by_graph = lists(hnsw.search_shards(graphs, queries, 4, 60))
    monkeypatch.setattr(sizes, "SENT_BYTES", 8 * 1024 * 11)
    monkeypatch.setattr(flat, "QUERY_BLOCK", 13)
    assert len(sizes.blocks(queries, 8 * 6, 13)) == 4
    assert lists(flat.knn(base, queries, 4, "l2")) == lists(flat.knn_blocks(base, queries, 4, "l2", 7)) == whole
    assert lists(pq.search(pq.encode(base, coded), base, queries, coded, 4)) == by_code
    assert lists(hnsw.search_shards(graphs, queries, 4, 60)) == by_graph


def test_index_stays_where_it_is(spark, monkeypatch):
    """With automatic broadcast off, no exchange carries vectors or codes to a list's key; blocks of queries give the same result."""
    from vecspark.operators import sizes

    x, q = blobs(300, 8)
    base, queries = frame(spark, x), asked(spark, q)
    centroids = kmeans.lloyd(base, kmeans.first_rows(base, 5), 2)
    index, book = ivf.build(base, centroids), hybrid.train(base, centroids, 2, 8, 2)
    coded = hybrid.build(base, centroids, book)
    find = lambda: [ivf.search(index, queries, ivf.probes(queries, centroids, 2), 5), hybrid.search(coded, queries, centroids, book, 5, 2, 20)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        whole = [lists(f) for f in find()]
        for f in find():
            plan = f._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan
        monkeypatch.setattr(sizes, "SENT_BYTES", 24 * 1024 * 20)
        assert [lists(f) for f in find()] == whole
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_shards_are_split(spark, monkeypatch):
    x, q = blobs(300, 6, 8, 9)
    base, queries = frame(spark, x), asked(spark, q)
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 100)
    sharded = hnsw.shard_in_turn(base, 2)
    graphs = hnsw.build(sharded, 8, 60).cache()
    assert [r["n"] for r in graphs.select(F.max("n").alias("n")).collect()][0] < 110 and graphs.count() == 4
    assert lists(hnsw.search_shards(graphs, queries, 5, 300)) == lists(flat.knn(base, queries, 5, "l2"))
    even = hnsw.search_shards(graphs, queries, 5, 300, sharded.where("vec_id % 4 = 0"))
    assert lists(even) == lists(flat.knn(base.where("vec_id % 4 = 0"), queries, 5, "l2"))
    assert lists(hnsw.search_within(graphs, queries, 1e9, 300, 7)) == lists(flat.knn(base, queries, 7, "l2"))


def test_walks_with_own_ends():
    x, q = blobs(900, 6, 8, 30)
    graph = hnsw.Graph(6, 12, 100)
    for k, row in enumerate(x):
        graph.add(k, row)
    far = ((q[:, None].astype(float) - x[None]) ** 2).sum(2)
    hit = wanted = 0
    for row, values in zip(q, far):
        radius = np.partition(values, 25)[25]
        got = {i for _, i in graph.within(row, radius, 100, 400)}
        want = set(np.flatnonzero(values <= radius).tolist())
        assert got <= want
        hit, wanted = hit + len(got), wanted + len(want)
    assert hit > 0.95 * wanted
    doc_of = {k: k % 40 for k in range(900)}
    good = 0
    for row, values in zip(q, far):
        got = [i for _, i in graph.documents(row, doc_of, 5, 15)]
        order = np.argsort(values, kind="stable").tolist()
        n = next(k for k in range(900) if len({doc_of[i] for i in order[: k + 1]}) > 5)
        assert len({doc_of[i] for i in got}) == 5
        good += len(set(got) & set(order[:n])) / n
    assert good / len(q) > 0.95 and graph.hops > 0 and graph.measured > graph.hops
    odd = graph.within(q[0], 1e9, 900, 900, lambda label: label % 2 == 1)
    assert len(odd) == 450 and all(label % 2 for _, label in odd)
    assert [i for _, i in graph.within(q[0], 1e9, 0, 7)] == np.argsort(far[0], kind="stable")[:7].tolist()
    assert sorted(i for _, i in graph.walk(q[0])) == list(range(900))


def test_exhaustive_searches_find_what_no_link_leads_to():
    """Pruning may leave nodes without links to them; here some are cut off, one alone and a group."""
    x, q = blobs(400, 8, queries=5)
    graph = hnsw.Graph(8, m=4, ef_build=20)
    for k, v in enumerate(x):
        graph.add(k, v)
    off, group = 17, set(range(100, 130))
    for node, by_level in enumerate(graph.links):
        by_level[0] = [y for y in by_level[0] if y != off and (y in group) == (node in group)]
    far = ((q[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    doc_of = {k: k % 7 for k in range(400)}
    for asked_for, d in zip(q, far):
        want = np.argsort(d, kind="stable").tolist()
        assert [k for _, k in graph.search(asked_for, 400, 400)] == want
        assert [k for _, k in graph.search(asked_for, 10, 400)] == want[:10]
        assert [k for _, k in graph.search(asked_for, 10, 400, lambda k: k % 3 == 0)] == [k for k in want if k % 3 == 0][:10]
        assert sorted(k for _, k in graph.walk(asked_for)) == list(range(400))
        radius = float(np.sort(d)[150])
        assert [k for _, k in graph.within(asked_for, radius, 400)] == want[:151]
        run = [k for k in range(400) if len({doc_of[y] for y in want[: k + 1]}) <= 3]
        assert [k for _, k in graph.documents(asked_for, doc_of, 3, 7)] == want[: len(run)]


def test_all_pairs(spark, monkeypatch):
    """The same numbers as distances of columns; zero vectors and no queries at all are taken."""
    monkeypatch.setattr(flat, "PAIRS", 16)
    x, q = blobs(60, 8, queries=7)
    x[3] = 0
    base, queries = frame(spark, x), asked(spark, q)
    got = {(r["query_id"], r["vec_id"]): tuple(r)[2:] for r in flat.all_pairs(base, queries).collect()}
    a, b = F.col("q"), F.col("embedding")
    want = base.crossJoin(queries).select("query_id", "vec_id", D.inner_product(a, b), D.squared_l2(a, b), D.cosine(a, b)).collect()
    assert len(got) == 420 and got == {(r["query_id"], r["vec_id"]): tuple(r)[2:] for r in want}
    assert flat.all_pairs(base, queries.where("false")).count() == flat.all_pairs(base.where("false"), queries).count() == 0


def test_pairs_are_not_normalized_one_by_one(spark):
    """Each vector's length is taken once, not for each pair and element."""
    plan = QUERIES["pairwise_distance"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "NestedLoop" not in plan
