import random
import time

import numpy as np
import pytest
from tables import odd_rows, table

from vecspark.llm import masked_lm as lm


def sentences(n, seed):
    """Texts in which every word follows from its neighbours."""
    chance = random.Random(seed)
    return [" ".join(f"a{k} b{k} c{k} and" for k in chance.choices(range(8), k=chance.randrange(5, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    return lm.fit(lm.tokenize(table(spark, list(enumerate(sentences(1500, 1))))), rounds=3)


def test_order_matters(spark, model):
    good = sentences(60, 2)
    rows = [(k, t) for k, t in enumerate(good)]
    for k, t in enumerate(good):
        words = t.split()
        random.Random(k).shuffle(words)
        rows.append((1000 + k, " ".join(words)))
    got = {r["doc_id"]: r["mean_log_prob"] for r in lm.score(lm.tokenize(table(spark, rows)), model).collect()}
    assert np.mean([got[k] > got[1000 + k] for k in range(60)]) > 0.95
    assert np.mean([got[k] for k in range(60)]) > np.mean([got[1000 + k] for k in range(60)]) + 0.2


def plain_probs(model, tokens):
    """Probabilities of a text's tokens, place by place."""
    tables, bias = lm.unpack(model.weights.astype(np.float64))
    rows = [lm.ROWS] * lm.PAD + model.rows[tokens].tolist() + [lm.ROWS] * lm.PAD
    probs = []
    for k, token in enumerate(tokens):
        gates = np.exp(bias + sum(tables[t][rows[k + lm.PAD + place]] for place, t in zip(lm.WINDOW, lm.TABLE)))
        probs.append(gates / gates.sum() @ model.shares[token].astype(np.float64))
    return probs


def test_probabilities(model):
    tokens = lm.tokens_of(lm.WordHashes(), sentences(1, 3)[0])
    want = plain_probs(model, tokens)
    assert np.allclose(lm.token_probs(model, [tokens]), want, rtol=1e-3)
    # a text's score doesn't depend on its neighbours in a batch
    assert np.allclose(lm.token_probs(model, [tokens[:3], tokens, tokens[:1]])[3:-1], want, rtol=1e-3)
    assert np.allclose(model.shares.sum(0), 1, rtol=1e-3)  # so a token's probabilities sum up to 1 whatever the gates are


def test_score_against_plain_python(spark, model):
    """Contexts that occur elsewhere vote; everything else is the network's."""
    texts = [*sentences(40, 9), *sentences(3, 9), "", None, "and and", "one of its own kind that stands nowhere else but here and so on"]
    rows = lm.tokenize(table(spark, list(enumerate(texts))))
    got = {r["doc_id"]: r["log_prob"] for r in lm.score(rows, model).collect()}
    tokens = {k: lm.tokens_of(lm.WordHashes(), t) for k, t in enumerate(texts)}
    stood: dict = {}
    for t in tokens.values():
        for at, context in zip(*lm.contexts(t)):
            assert context == sum(int(t[at + d]) << s for d, s in ((-2, 48), (-1, 32), (1, 16), (2, 0))) - (1 << 64) * int(t[at - 2] >= 1 << 15)
            stood.setdefault(int(context), []).append(int(t[at]))
    assert any(len(v) > 1 for v in stood.values())
    for k, t in tokens.items():
        probs = plain_probs(model, t)
        for at, context in zip(*lm.contexts(t)):
            words = stood[int(context)]
            probs[at] = (probs[at] + words.count(int(t[at])) - 1) / len(words)
        assert np.isclose(got[k], np.log(probs).sum() if len(probs) else 0, rtol=1e-3, atol=1e-6)


def test_equal_for_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 4000)
    docs = table(spark, [(k, t) for k, t in enumerate(sentences(500, 11) + ["", None])])
    found = []
    for parts in (4, 16):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            tokens = lm.tokenize(docs.repartition(parts))
            found.append({r["doc_id"]: r["log_prob"] for r in lm.score(tokens, lm.fit(tokens)).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1]


def test_better_than_unigrams_and_twice_is_told_apart(spark):
    """On sf0.1, with a model of the odd ids: half a nat a token on the even ones; texts that occur twice score above others."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null").select("doc_id", "text")
    tokens = lm.tokenize(docs).cache()
    odd, even = tokens.where("doc_id % 2 = 1"), tokens.where("doc_id % 10 = 0")
    model, counts = lm.fit(odd), lm.corpus_counts(odd)
    unigram = np.log((counts + 0.5) / (counts + 0.5).sum())
    held = [lm._read(t) for t in even.select("tokens").toArrow().column(0)]
    assert np.log(lm.token_probs(model, held)).mean() > np.concatenate([unigram[t] for t in held]).mean() + 0.5
    got = lm.score(odd.where("octet_length(tokens) > 100"), model).toPandas()
    keys = {r["doc_id"]: r["key"] for r in odd.select("doc_id", "key").collect()}
    many = got.doc_id.map(keys).map(got.doc_id.map(keys).value_counts())
    assert (many > 1).sum() > 10 and (got.mean_log_prob[many > 1] > got.mean_log_prob[many == 1].median() + 0.5).mean() > 0.85


def test_counts_cover_all_tokens(spark):
    texts = sentences(300, 4)
    counts = lm.corpus_counts(lm.tokenize(table(spark, list(enumerate(texts))).repartition(7)))
    assert counts.sum() == sum(len(t.split()) for t in texts)


def test_every_token_is_trained_in_every_round(spark):
    texts = [*sentences(300, 5), "", None, "long " * 60_000, "end"]
    docs = lm.tokenize(table(spark, list(enumerate(texts))))
    n = sum(len((t or "").split()) for t in texts)
    for parts in (1, 5):
        assert lm.fit(docs.repartition(parts), rounds=2).trained == 2 * n


def test_steps_share_out_all_places(monkeypatch, model):
    seen = []
    step = lm.train_step
    monkeypatch.setattr(lm, "train_step", lambda flat, squares, shares, rows, buckets, at: (seen.append(at), step(flat, squares, shares, rows, buckets, at))[1])
    tokens = [lm.tokens_of(lm.WordHashes(), t) for t in sentences(200, 6)]
    _, _, places = model.padded(tokens)
    parts = np.zeros((lm.BUCKETS, lm.PARTS))
    assert lm.train_texts(model, model.weights.copy(), np.full_like(model.weights, 1e-6), parts, tokens) == len(places) > 2 * lm.AT_ONCE
    assert sorted(np.concatenate(seen)) == places.tolist() and max(map(len, seen)) <= lm.AT_ONCE
    assert np.allclose(parts.sum(1), np.bincount(np.concatenate(tokens), minlength=lm.BUCKETS), rtol=1e-4)


def test_gradient(model):
    chance = np.random.default_rng(0)
    flat = (0.3 * chance.standard_normal(lm.WEIGHTS)).astype(np.float32)
    buckets = np.concatenate([[0] * lm.PAD, chance.choice(np.argsort(-model.shares.max(1))[:25], 40), [0] * lm.PAD])
    rows = np.where(np.arange(len(buckets)) % 43 < lm.PAD, lm.ROWS, model.rows[buckets])
    at = np.arange(lm.PAD, lm.PAD + 40)

    def loss(f):
        return -np.log(lm.forward(lm.unpack(f), model.shares.astype(np.float64), rows, buckets, at)[2]).mean()

    moved, squares = flat.copy(), np.zeros_like(flat)
    lm.train_step(moved, squares, model.shares, rows, buckets, at)
    gradient, flat = np.sqrt(squares) * np.sign(flat - moved), flat.astype(np.float64)
    for k in chance.choice(np.flatnonzero(np.abs(gradient) > 1e-3), 10):
        step = np.zeros_like(flat)
        step[k] = 1e-5
        assert np.isclose(gradient[k], (loss(flat + step) - loss(flat - step)) / 2e-5, rtol=2e-2, atol=1e-5)


def test_odd_tables(spark, model):
    docs = lm.tokenize(table(spark, odd_rows()).selectExpr("*", "1 as n_tokens", "'x' as block", "2 as tokens", "3 as net", "4 as spots", "5 as gain", "6 as context", "7 as key"))
    got = lm.score(docs, model).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        if r["n_tokens"] == 0:
            assert r["log_prob"] == 0 and r["mean_log_prob"] is None
    assert sorted(r["n_tokens"] for r in got)[-1] == 30_000
    empty = lm.fit(docs.where("false"))
    assert lm.score(docs, empty).count() == len(odd_rows())
    assert lm.score(docs.where("false"), model).count() == 0


def test_large_weights_stay_finite(model):
    flat = 1000 * np.random.default_rng(1).standard_normal(lm.WEIGHTS).astype(np.float32)
    rows = np.array([lm.ROWS] * lm.PAD + [1, 2, 3] + [lm.ROWS] * lm.PAD)
    assert (lm.forward(lm.unpack(flat), model.shares, rows, rows % lm.ROWS, np.arange(3, 6))[2] > 0).all()


def test_all_contexts_are_counted(spark, model, monkeypatch):
    """Every place with two words on either side, in one bucket or many, a few at a time or all at once."""
    chance = np.random.default_rng(3)
    tokens = chance.integers(0, lm.BUCKETS, 500)
    assert lm.contexts(tokens)[0].tolist() == list(range(2, 498))
    texts = sentences(40, 12) + sentences(2, 12) + [" ".join(f"u{k}" for k in range(50))] * 2
    docs = lm.tokenize(table(spark, list(enumerate(texts))))
    found = []
    for dealt, places in ((1 << 19, 1 << 20), (50, 30)):
        monkeypatch.setattr(lm, "DEALT", dealt)
        monkeypatch.setattr(lm, "BUCKET_PLACES", places)
        found.append({r["doc_id"]: (r["n_tokens"], r["log_prob"]) for r in lm.score(docs, model).collect()})
    assert found[0] == found[1]
    # the last text stands twice: at 46 of its 50 places the other copy votes, with (p + 1) / 2
    probs = plain_probs(model, lm.tokens_of(lm.WordHashes(), texts[-1]))
    assert np.isclose(found[0][43][1], sum(np.log((p + 1) / 2 if 2 <= k < 48 else p) for k, p in enumerate(probs)), rtol=1e-3)


def shuffle_files(spark):
    time.sleep(1)  # they go in the background
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_disk_is_given_back(spark, model, monkeypatch):
    """Neither training nor counting leaves shuffle files; places are shuffled a quarter at a time; tables on the way go."""
    monkeypatch.setattr(lm, "BUCKET_PLACES", 100)
    before, seen = shuffle_files(spark), []
    dealt = lm._dealt

    def dealing(rows, buckets, turns=1, turn=0):
        out = dealt(rows, buckets, turns, turn)
        seen.append((turn, sum(len(r["word"]) // 2 for r in out.collect())))
        assert shuffle_files(spark) <= before
        return out

    monkeypatch.setattr(lm, "_dealt", dealing)
    paths = len(lm.staged())
    docs = lm.stage(lm.tokenize(table(spark, list(enumerate(sentences(200, 21))))), "lm-tokens")
    tokens = lm.staged()[paths:]
    lm.fit(docs)
    assert shuffle_files(spark) <= before
    n = sum(max(0, len(lm._read(t)) - 4) for t in docs.select("tokens").toArrow().column(0))
    before |= shuffle_files(spark)
    got = lm.score(docs, model, tokens)
    assert shuffle_files(spark) <= before
    assert [k for k, _ in seen] == list(range(lm.TURNS)) and sum(m for _, m in seen) == n and max(m for _, m in seen) < n / 2
    assert [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in lm.staged()[paths:]] == ["lm-scores", "lm-gained"]
    assert got.count() == 200


def test_a_text_is_given_its_votes_once(spark, model):
    """However many buckets a text's places lie in, what they give is added up in blocks."""
    texts = [sentences(1, 31)[0] + f" end{k % 50}" for k in range(300)]
    rows = lm.network_scores(lm.tokenize(table(spark, list(enumerate(texts)))), model).cache()
    found = []
    for buckets in (1, 40):
        votes = lm._voted(lm._dealt(rows, buckets)).toPandas()
        assert votes.key.is_unique and len(votes) == 50
        found.append(dict(zip(votes.key, votes.units)))
    assert found[0] == found[1]
    rows.unpersist()
