import random

import duckdb
from pyspark.sql import functions as F
from tables import odd_rows, table

from vecspark.llm import mixing


def water(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    """Targets by the rule: what is above a limit is shared out again until none is above."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(w[k] for k in open_)
        over = {k for k in open_ if left * w[k] / total >= repeats * sizes[k]}
        if not over:
            for k in open_:
                target[k] = left * w[k] / total
            break
        for k in over:
            target[k] = repeats * sizes[k]
        left -= sum(target[k] for k in over)
        open_ -= over
    return target


def test_targets(spark):
    random.seed(1)
    for _ in range(5):
        sizes = [random.choice((0, 1, 10, 100, 1000, 5000)) for _ in range(random.randrange(1, 9))]
        rows = [(f"s{k}", s) for k, s in enumerate(sizes)]
        got = mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).orderBy("source").collect()
        for r, want in zip(got, water(sizes)):
            assert abs(r["target"] - want) < 1e-6


def corpus(n=800):
    random.seed(2)
    return [(k, " ".join(["w"] * random.randrange(0, 60)), random.choice(["a", "a", "a", "b", "c", "d", None, "é"])) for k in range(n)]


def test_as_sql(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)  # many buckets and slices
    rows = corpus()
    got = {r["doc_id"]: r for r in mixing.mix(table(spark, rows)).collect()}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    want = con.execute(mixing.OP10_SQL).fetchall()
    assert len(want) == len(got) == len(rows)
    for i, size, source_size, target, taken in want:
        r = got[i]
        assert (r["size"], r["source_size"], r["size"] * r["copies"]) == (size, source_size, taken) and abs(r["target"] - target) < 1e-6


def test_near_the_targets_and_again(spark):
    docs = table(spark, corpus())
    mixed = mixing.mix(docs)
    for r in mixed.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken")).collect():
        assert abs(r["taken"] - r["target"]) <= 2 * 60
    assert mixed.where("copies > 2").count() == 0
    again = mixing.mix(docs.repartition(9))
    assert sorted(map(str, mixed.collect())) == sorted(map(str, again.collect()))


def test_one_large_source(spark):
    got = mixing.mix(table(spark, [(k, "x y z", "only") for k in range(500)])).groupBy().agg(F.sum("copies")).first()[0]
    assert got == 750


def test_small_buckets(spark, monkeypatch):
    """Running sums over groups of buckets and slices take the same documents."""
    import random

    random.seed(8)
    rows = [(k, " ".join(["w"] * random.randrange(0, 30)) + f" {k}", random.choice("aaab") if k % 50 else None) for k in range(700)]
    docs = table(spark, rows)
    taken = lambda: sorted((r["doc_id"], r["copies"], r["target"]) for r in mixing.mix(docs).collect())
    whole = taken()
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 0.2)
    assert taken() == whole


def test_odd_tables(spark):
    docs = table(spark, odd_rows()).selectExpr("*", "1 as copies", "'x' as size", "2 as key", "3 as rank")
    got = mixing.mix(docs).collect()
    assert len(got) == len(odd_rows())
    assert all(r["copies"] == 0 for r in got if r["size"] == 0)
    assert len({r["copies"] for r in got if r["doc_id"] == 1}) == 1
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.mix(docs.where("doc_id in (2, 3, 4)")).count() == 3
