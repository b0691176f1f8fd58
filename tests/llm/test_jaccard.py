import random

import numpy as np
import pytest
from tables import odd_rows, table

from vecspark.llm import jaccard


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(sets[k]), links[k], least[find(k)]) for k, (i, _) in enumerate(rows)}


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_against_brute_force(spark, words, percent):
    random.seed(words)
    vocabulary = [f"v{k}" for k in range(400)]
    passage = random.choices(vocabulary, k=30)
    rows = []
    for size, copies in ((120, 90), (60, 12), (300, 5), (20, 40), (8, 30), (3, 10)):
        base = random.choices(vocabulary, k=size)
        for _ in range(copies):
            w = list(base)
            for _ in range(random.randrange(0, max(2, size // 20))):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            if random.random() < 0.3:
                w = w[: int(len(w) * random.uniform(0.8, 1))]
            rows.append((len(rows), " ".join(w)))
    for _ in range(120):
        rows.append((len(rows), " ".join(random.choices(vocabulary, k=random.randrange(1, 90)) + random.choice(([], passage)))))
    random.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["n_links"], r["component_id"]) for r in jaccard.join(table(spark, rows), words, percent).collect()}
    assert got == brute(rows, words, percent)


def test_lengths_follow_costs():
    quiet = jaccard.choose_length(1000, np.array([3]), np.array([2]), 80)
    busy = jaccard.choose_length(1000, np.arange(0, 240, 2), np.full(120, 12), 80)
    assert quiet[0] <= busy[0] and busy[0] > 1
    crowded = jaccard.choose_length(1000, np.arange(200), np.full(200, 10**6), 80)
    assert crowded[1] >= crowded[0]


def test_blocks(spark):
    random.seed(2)
    sets = [np.unique(np.array(random.choices(range(40), k=30), np.uint64)) for _ in range(50)]
    got = jaccard.block_links(sets[:20], sets[20:], 60)
    for i, a in enumerate(sets[:20]):
        for j, b in enumerate(sets[20:]):
            a_, b_ = set(a.tolist()), set(b.tolist())
            assert got[i, j] == (100 * len(a_ & b_) >= 60 * len(a_ | b_))


def test_small_blocks(spark, monkeypatch):
    """Crowded documents over many blocks link as within one."""
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    random.seed(4)
    base = [f"v{k}" for k in range(80)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(random.randrange(0, 4)):
            w[random.randrange(80)] = f"x{random.randrange(1000)}"
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["n_links"], r["component_id"]) for r in jaccard.join(table(spark, rows), 4, 85).collect()}
    assert got == brute(rows, 4, 85)


def test_passages_connect_nobody(spark):
    """Documents that share a long passage are no crowd: what they have of their own stands first."""
    random.seed(5)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, " ".join(f"w{random.randrange(10**6)}" for _ in range(90)) + " " + passage) for k in range(80)]
    rows += [(100 + k, rows[k][1] + " end") for k in range(5)]
    docs = table(spark, rows)
    counts = jaccard.shingle_counts(docs, 4)
    assert counts.sum() == sum(n for n, _, _ in brute(rows, 4, 85).values())
    sets = {r["doc_id"]: r["prefix"] for r in jaccard._sets(docs, 4, 85, counts).collect()}
    assert not set.intersection(*(set(sets[k]) for k in range(80)))
    got = {r["doc_id"]: (r["n_shingles"], r["n_links"], r["component_id"]) for r in jaccard.join(docs, 4, 85).collect()}
    assert got == brute(rows, 4, 85)


def test_bands(spark, monkeypatch):
    """A crowd of many sizes, over bands and blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 9)
    random.seed(6)
    base = [f"v{k}" for k in range(140)]
    rows = []
    for k in range(90):
        w = base[: random.randrange(40, 140)]
        w[random.randrange(len(w))] = f"x{random.randrange(1000)}"
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["n_links"], r["component_id"]) for r in jaccard.join(table(spark, rows), 4, 70).collect()}
    assert got == brute(rows, 4, 70)


def test_odd_tables(spark):
    rows = odd_rows()
    docs = table(spark, rows).selectExpr("*", "1 as set", "2 as component_id", "3 as n")
    got = jaccard.join(docs).collect()
    assert len(got) == len(rows) - 1  # the row without id
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["n_links"] == 1 and by_id[1]["component_id"] == 1
    for k in (2, 3, 4):
        assert (by_id[k]["n_shingles"], by_id[k]["n_links"], by_id[k]["component_id"]) == (0, 0, k)
    assert by_id[6]["n_shingles"] == 1
    assert jaccard.join(docs.where("false")).count() == 0


def test_blocks_that_are_empty(spark, monkeypatch):
    """More blocks than sets, as with few very long texts: some blocks have no set, and nothing is lost."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 100)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[:-1] + [f"x{k}"]) for k in range(30)] + ["quite another text of some words"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["n_links"], r["component_id"]) for r in jaccard.join(table(spark, rows), 4, 85).collect()}
    assert got == brute(rows, 4, 85)
    assert jaccard.block_links([], [np.arange(3, dtype=np.uint64)], 85).shape == (0, 1)
