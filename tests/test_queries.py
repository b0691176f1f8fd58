import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_points
from vecspark.operators import flat, hnsw
from vecspark.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NO_SQL = {"ivf_batch_grouped", "hnsw_knn", "ivf_hnsw_knn", "sharded_hnsw_knn"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def values(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr(tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql(spark, con, name):
    found = QUERIES[name](spark, DATA)
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(names)
    assert values(found.collect(), found.columns) == values(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_query_without_sql(spark, name):
    found = QUERIES[name](spark, DATA)
    assert found.columns == ["query_id", "rank", "vec_id", "dist"] and found.where("rank = 1").count() == 5


@pytest.mark.parametrize("name", ["ivf_batch_grouped", "ivf_hnsw_knn"])
def test_recall_of_registered_lists(spark, name):
    data = "/root/testdata/sf0.1"
    pairs = lambda df: {(r["query_id"], r["vec_id"]) for r in df.collect()}
    want = pairs(QUERIES["flat_knn_l2"](spark, data))
    assert len(pairs(QUERIES[name](spark, data)) & want) >= 0.9 * len(want)


def test_exhaustive_beam_is_as_wide_as_the_largest_graph(spark, tmp_path, monkeypatch):
    """Shards of more than 1,000 vectors; the graphs themselves are not built here."""
    rows = spark.range(4, 6004).selectExpr("id as vec_id", "array(cast(id as float), 1f) as embedding")
    rows = rows.unionByName(spark.range(500).selectExpr("10000 + 4 * id as vec_id", "array(cast(id as float), 2f) as embedding"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    beams = []

    def search(graphs, queries, k, ef):
        beams.append(ef)
        return flat.knn(queries.selectExpr("query_id as vec_id", "q as embedding"), queries, k, "l2")

    monkeypatch.setattr(hnsw, "build", lambda sharded, **_: sharded)
    monkeypatch.setattr(hnsw, "search_shards", search)
    QUERIES["hnsw_exhaustive_ef"](spark, str(tmp_path))
    assert beams == [2000]


def test_registry(spark):
    assert set(QUERIES) - set(SQL) == NO_SQL
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0


def test_the_engine_stands_alone(tmp_path):
    """Without the llm folders and the pipeline, everything else is there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text(open(f"{root}/{name}").read())
    subprocess.run(["cp", "-r", f"{root}/vecspark", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "vecspark" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flat_knn_ip' in q and not any(n.startswith('op') for n in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_workers_find_the_package_from_anywhere(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.queries()["flat_knn_gemm"](spark, {DATA!r}).count() == 50
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith("SPARK") and not k.startswith("PYSPARK")}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
