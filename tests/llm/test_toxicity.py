import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tables import odd_rows, table

from vecspark.llm import toxicity

BAD = ["scoundrel", "rotter", "blighter", "cad"]


def corpus(n, seed):
    random.seed(seed)
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = random.choices(plain, k=random.randrange(20, 200))
        bad = random.random() < 0.15
        if bad:
            for _ in range(random.randrange(2, 6)):
                words.insert(random.randrange(len(words)), random.choice(BAD) + random.choice(("", "s", "ly", ",")))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1500, 1)
    docs = table(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.where("doc_id < 1000"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(got[i], t) for i, t in labels if i >= 1000]
    assert sum((s >= 0.5) == t for s, t in held) / len(held) > 0.97
    assert np.mean([s for s, t in held if not t]) < 0.2


def test_risk_and_steps_against_plain_python():
    """The risk by its definition; training lowers it, and undoes steps that make the risk on clean texts negative."""
    import math

    chance = np.random.default_rng(0)
    zt, zu, prior = chance.normal(1, 2, 30), chance.normal(-1, 2, 50), 0.2
    loss = lambda z, y: math.log(1 + math.exp(-z * y))
    on_toxic = prior * sum(loss(z, 1) for z in zt) / 30
    on_clean = sum(loss(z, -1) for z in zu) / 50 - prior * sum(loss(z, -1) for z in zt) / 30
    assert np.allclose(toxicity.risk(zt, zu, prior), (on_toxic, on_clean))
    rows, labels = corpus(600, 4)
    found = [toxicity.features(t) for _, t in rows]
    toxic = [f for f, (_, t) in zip(found, labels) if t]
    start = math.log(0.15 / 0.85)
    first = toxicity.risk(np.full(len(toxic), start), np.full(len(found), start), 0.15)
    model = toxicity.train(toxic, found, 0.15, models=1)
    logit = lambda rows: np.array([model.weights[f, 0].sum(dtype=float) for f in rows]) + model.bias[0]
    last = toxicity.risk(logit(toxic), logit(found), 0.15)
    assert last[1] > -0.05 and last[0] + max(last[1], 0) < 0.5 * (first[0] + first[1])


def test_prior_needs_no_negatives(spark):
    rows, labels = corpus(3000, 5)
    found = [toxicity.features(t) for _, t in rows]
    toxic = [f for f, (_, t) in zip(found, labels) if t]
    share = len(toxic) / len(found)
    assert 0.8 * share < toxicity.estimated_prior(toxic[:200], found) < 1.4 * share
    assert toxicity.estimated_prior([], found) == 0
    assert toxicity.estimated_prior(toxic[:3], found[:40]) == 0.1  # too few for any feature to count
    docs = table(spark, [*rows[:300], *[(rows[0][0], f"more {k} text") for k in range(300)]])
    marks = spark.createDataFrame(labels[:300], "doc_id long, toxic int")
    assert toxicity.fit(docs, marks).weights.any()


def test_unlabelled_rows_need_no_labels():
    """Marks of the unlabelled sample are never looked at: the classifier sees them as one lot."""
    rows, labels = corpus(800, 2)
    found = [toxicity.features(t) for _, t in rows]
    toxic = [f for f, (_, t) in zip(found, labels) if t]
    model = toxicity.train(toxic, found, prior=0.15)
    logits = np.array([model.weights[f].sum(0) for f in found])
    scores = model.scores(logits)
    truth = np.array([t for _, t in labels])
    assert ((scores >= 0.5) == truth).mean() > 0.95


def test_without_toxic_examples():
    model = toxicity.train([], [toxicity.features("a b c")], prior=0.1)
    assert np.allclose(model.scores(np.zeros((1, 1))), 0.1)


def test_odd_tables(spark):
    rows, labels = corpus(400, 3)
    docs = table(spark, rows)
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (10**9, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    odd = table(spark, odd_rows()).selectExpr("*", "'x' as score", "1 as features")
    got = toxicity.score(odd, model, keep_text=True).collect()
    assert len(got) == len(odd_rows())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    empty = {r["score"] for r in got if not (r["text"] or "").strip()}
    assert len(empty) == 1
    assert toxicity.score(odd.where("false"), model).count() == 0
    nothing = toxicity.fit(docs, marks.where("false"))
    assert toxicity.score(docs, nothing).where("predicted = 1").count() == 0


def test_held_out_rows(spark):
    got = spark.range(200).withColumn("held", toxicity.held_out(F.col("id"))).collect()
    assert all(r["held"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
