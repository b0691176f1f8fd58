import numpy as np
import pytest
from pyspark.sql import functions as F
from vectors import asked, blobs, exact, frame, lists, recall

from vecspark.plans import index as I  # noqa: E741
from vecspark.sources import store, vector_files
from vecspark.streaming import knn_of_stream, upserts


@pytest.fixture(scope="module")
def data(spark):
    x, q = blobs(600, 16, 8)
    return x, q, frame(spark, x).cache(), asked(spark, q).cache()


def ids(spark, *values):
    return spark.createDataFrame([(i,) for i in values], "vec_id long")


@pytest.mark.parametrize("space", ["l2", "ip", "cosine"])
def test_flat_index(spark, data, tmp_path, space):
    x, q, base, queries = data
    index = I.FlatIndex(spark, space, 16)
    with pytest.raises(RuntimeError):
        index.add_items(base)
    index.init_index(1000)
    with pytest.raises(RuntimeError):
        index.init_index(1000)
    index.add_items(base)
    truth = exact(x, q, 5, space)
    assert list(lists(index.knn_query(queries, 5)).values()) == truth
    index.delete_vector(truth[0][0])
    index.delete_vector(10**6)
    assert truth[0][0] not in lists(index.knn_query(queries, 5))[0] and index.element_count == 599
    index.save(str(tmp_path / "flat"))
    again = I.FlatIndex.load(spark, str(tmp_path / "flat"))
    assert lists(again.knn_query(queries, 5)) == lists(index.knn_query(queries, 5)) and again.max_elements == 1000
    if space == "cosine":
        assert np.allclose([np.linalg.norm(r["embedding"]) for r in index.get_items([3, 4]).collect()], 1)


def test_checks(spark, data):
    _, _, base, queries = data
    index = I.FlatIndex(spark, "l2", 16)
    index.init_index(10)
    with pytest.raises(ValueError):
        I.FlatIndex(spark, "hamming", 4)
    with pytest.raises(RuntimeError):
        index.add_items(base)  # more than fit
    for wrong in ([1.0] * 15, None, [float("nan")] * 16):
        with pytest.raises(ValueError):
            index.add_items(spark.createDataFrame([(1, wrong)], "vec_id long, embedding array<double>"))
    index.add_items(base.limit(5))
    with pytest.raises(RuntimeError):
        index.knn_query(queries, 6, strict=True)
    with pytest.raises(ValueError):
        index.get_items(3)
    with pytest.raises(ValueError):
        index.resize_index(4)
    index.resize_index(700)
    index.add_items(base)
    assert index.element_count == index.get_ids_list().count() == index.get_items().count() == 600


def test_graph_index(spark, data, tmp_path):
    x, q, base, queries = data
    index = I.GraphIndex(spark, "l2", 16, 8, 80, shards=2)
    index.init_index(600)
    index.add_items(base.where("vec_id < 300"))
    index.add_items(base.where("vec_id >= 300"))
    index.ef = 100
    truth = exact(x, q, 10)
    assert recall(index.knn_query(queries, 10), truth) > 0.95
    assert index.knn_query(queries, 5, F.col("vec_id") % 7 == 0).where("vec_id % 7 != 0").count() == 0

    index.mark_deleted(base.where("vec_id < 300").select("vec_id"))
    assert index.knn_query(queries, 10).where("vec_id < 300").count() == 0 and index.deleted_count() == 300
    index.save(str(tmp_path / "graph"))
    again = I.GraphIndex.load(spark, str(tmp_path / "graph"))
    assert again.ef == 10
    again.ef = 100
    assert again.knn_query(queries, 10).where("vec_id < 300").count() == 0
    again.unmark_deleted(base.where("vec_id < 300").select("vec_id"))
    assert recall(again.knn_query(queries, 10), truth) > 0.95
    with pytest.raises(ValueError):
        again.unmark_deleted(ids(spark, 1))

    fresh = frame(spark, x[:50] + 0.5, 10_000)
    index.add_items(fresh, replace_deleted=True)
    assert index.element_count == 600 and index.deleted_count() == 250 and index.get_items([10_003]).count() == 1
    with pytest.raises(RuntimeError):
        index.add_items(frame(spark, x[:300], 20_000), replace_deleted=True)


def test_replaced_vectors_are_found(spark, data):
    x, q, base, queries = data
    index = I.GraphIndex(spark, "l2", 16, 8, 80, shards=2)
    index.init_index(600)
    index.add_items(base)
    index.add_items(frame(spark, x[::-1].copy()))  # every id has another vector now
    index.ef = 100
    truth = exact(x[::-1], q, 10)
    seen = recall(index.knn_query(queries, 10), truth)
    assert seen > 0.95 and abs(seen - recall(index.rebuilt().knn_query(queries, 10), truth)) < 0.2


def test_lazy_and_labelled(spark, data):
    _, _, base, queries = data
    lazy = I.LazyIndex(spark, "l2", 16)
    assert lazy.knn_query(queries, 3).count() == 0
    lazy.add_items(base.limit(50))
    assert lazy.knn_query(queries.limit(2), 3).count() == 6
    flat = I.FlatIndex(spark, "l2", 16)
    flat.init_index(600)
    flat.add_items(base)
    names = base.select("vec_id", F.concat(F.lit("name "), "vec_id").alias("label"))
    got = I.LabelledIndex(flat, names).knn_query(queries, 1).collect()
    assert all(r["label"].startswith("name ") for r in got) and len(got) == 50


def test_stored_searches(spark, data, tmp_path):
    x, q, base, queries = data
    truth, by_ip = exact(x, q, 10), exact(x, q, 10, "ip")
    small = {"m": 4, "ks": 16, "rounds": 2}
    runs = {
        "ivf": lambda p: recall(I.ivf_search(p, base, queries, nprobe=8, clusters=8), truth),
        "pq": lambda p: recall(I.pq_search(p, base, queries, rerank=600, **small), by_ip),
        "ivfpq": lambda p: recall(I.ivfpq_search(p, base, queries, nprobe=8, candidates=600, clusters=8, **small), truth),
        "pqivf": lambda p: recall(I.pq_ivf_search(p, base, queries, nprobe=4, clusters=4, **small), truth),
        "ivfhnsw": lambda p: recall(I.ivf_hnsw_search(p, base, queries, nprobe=4, clusters=8), truth),
        "sharded": lambda p: recall(I.sharded_hnsw_search(p, base, queries, ef=100, shards=3, strategy="kmeans"), truth),
    }
    for name, run in runs.items():
        path = str(tmp_path / name)
        first = run(path)
        assert first > 0.9, (name, first)
        assert run(path) == first  # read again
    found, parameters = store.Store(spark, str(tmp_path / "ivf")).load()
    assert parameters["clusters"] == 8 and set(found) == {"centroids", "lists"}
    plan = found["lists"].where(F.col("cid").isin(1, 2))._jdf.queryExecution().toString()
    assert "PartitionFilters: [cid" in plan


def test_vector_files(spark, tmp_path):
    vector_files.register(spark)
    chance = np.random.default_rng(1)
    x = chance.normal(size=(1000, 7)).astype(np.float32)
    whole = chance.integers(0, 255, (300, 5))

    def read(name, **options):
        return spark.read.format("vectors").options(**options).load(str(tmp_path / name)).orderBy("vec_id").collect()

    vector_files.write_fbin(str(tmp_path / "x.fbin"), x)
    got = read("x.fbin", kind="fbin", rows=77)
    assert [r["vec_id"] for r in got] == list(range(1000)) and np.array_equal(np.array([r["embedding"] for r in got], np.float32), x)
    vector_files.write_fbin(str(tmp_path / "x.ibin"), whole)
    assert np.array_equal([r["embedding"] for r in read("x.ibin", kind="ibin")], whole)
    (tmp_path / "x.raw").write_bytes(x.tobytes())
    assert len(read("x.raw", kind="raw", dim=7)) == 1000
    for kind, values in (("bvecs", whole.astype("u1")), ("ivecs", whole.astype("<i4")), ("fvecs", whole.astype("<f4"))):
        (tmp_path / f"x.{kind}").write_bytes(b"".join(np.int32(5).tobytes() + row.tobytes() for row in values))
        assert np.array_equal([r["embedding"] for r in read(f"x.{kind}", kind=kind)], whole)
    (tmp_path / "short.fbin").write_bytes((tmp_path / "x.fbin").read_bytes()[:100])
    with pytest.raises(Exception, match="ends before"):
        read("short.fbin", kind="fbin")


def test_csv(spark, data, tmp_path):
    frame_ = spark.createDataFrame([(1, 0.5)], "query_id long, recall double")
    store.write_csv(frame_, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["query_id", "recall"]


def test_streams(spark, data, tmp_path):
    x, q, base, queries = data
    first, second = frame(spark, x[:20]), frame(spark, x[100:120], 10)
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upserts(source(), str(tmp_path / "table"), str(tmp_path / "checkpoint")).awaitTermination()
    second.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    upserts(source(), str(tmp_path / "table"), str(tmp_path / "checkpoint")).awaitTermination()
    now = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(str(tmp_path / "table" / "v1")).collect()}
    assert len(now) == 30 and np.allclose(now[10], x[100]) and np.allclose(now[9], x[9])
    assert list(lists(knn_of_stream(base, 4, "l2")(queries, 0)).values()) == exact(x, q, 4)
