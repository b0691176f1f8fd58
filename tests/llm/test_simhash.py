import hashlib
import random

import numpy as np
import pytest
from tables import odd_rows, table

from vecspark.llm import simhash


def test_edited_texts(spark):
    random.seed(1)
    rows = [(7 * k, " ".join(random.choices("alpha beta gamma délta 🙂 epsilon".split(), k=random.randrange(60)))) for k in range(80)]
    rows[5] = (35, None)
    random.shuffle(rows)
    got = {r["doc_id"]: r for r in simhash.edited_fingerprints(table(spark, rows)).collect()}
    order = sorted((i, t or "") for i, t in rows)
    hashes = simhash.WordHashes()
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        cut, following = len(t) // 4, order[(k + 1) % len(order)][1]
        edited = t[: len(t) - cut] + following[:cut]
        r, own = got[i], simhash.fingerprint(hashes.of(t))
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == own.hex() and r["edited_fingerprint"] == simhash.fingerprint(hashes.of(edited)).hex()
        assert r["near_next"] == simhash.likeness(own, simhash.fingerprint(hashes.of(following)))


def test_likeness_follows_likeness():
    random.seed(2)
    vocabulary = [f"w{k}" for k in range(5000)]
    hashes = simhash.WordHashes()
    words = random.choices(vocabulary, k=400)
    seen = []
    for share in (0, 0.1, 0.3, 0.6, 1):
        n = int(share * 400)
        other = words[: 400 - n] + random.choices(vocabulary, k=n)
        seen.append(simhash.likeness(simhash.fingerprint(hashes.of(" ".join(words))), simhash.fingerprint(hashes.of(" ".join(other)))))
    assert seen[0] == 1 and seen == sorted(seen, reverse=True) and seen[-1] < 0.3


def test_search_finds_all_within_the_radius(spark):
    random.seed(3)
    prints = [random.getrandbits(128) for _ in range(40)]
    for p in list(prints):
        for _ in range(8):
            q = p
            for bit in random.sample(range(128), random.randrange(0, 9)):
                q ^= 1 << bit
            prints.append(q)
    table_ = spark.createDataFrame([(f"{p:032x}",) for p in prints] + [(None,)], "fingerprint string")
    asked = spark.createDataFrame([(f"{p:032x}",) for p in prints[:60]], "fingerprint string")
    got = {(r["query_print"], r["found_print"]): (r["found_n"], r["apart"]) for r in simhash.search(asked, table_).collect()}
    want = {(f"{a:032x}", f"{b:032x}"): (prints.count(b), (a ^ b).bit_count()) for a in prints[:60] for b in prints if (a ^ b).bit_count() <= 6}
    assert got == want
    with pytest.raises(ValueError):
        simhash.search(asked, table_, 7)


@pytest.mark.parametrize("radius, at_once", [(6, 1 << 17), (20, 1 << 17), (20, 16), (70, 16)])
def test_within_counts_all_at_any_radius(spark, monkeypatch, radius, at_once):
    monkeypatch.setattr(simhash, "QUERIES_AT_ONCE", at_once)
    random.seed(4)
    prints = [random.getrandbits(128) for _ in range(40)]
    for p in list(prints):
        for _ in range(8):
            q = p
            for bit in random.sample(range(128), random.randrange(0, 30)):
                q ^= 1 << bit
            prints.append(q)
    prints += prints[:10]
    table_ = spark.createDataFrame([(f"{p:032x}",) for p in prints] + [(None,)], "fingerprint string")
    asked = spark.createDataFrame([(f"{p:032x}",) for p in prints[:60]] + [(None,)], "fingerprint string")
    got = {r["query_print"]: r["n_within"] for r in simhash.within(asked, table_, radius).collect()}
    assert got == {f"{a:032x}": sum((a ^ b).bit_count() <= radius for b in prints) for a in prints[:60]}
    assert simhash.within(asked, table_.where("false"), radius).count() == simhash.within(asked.where("false"), table_, radius).count() == 0


def test_near_copies_are_within_the_registered_radius(spark, tmp_path):
    """Two changed words in 150 are mostly over 6 bits apart, yet near."""
    random.seed(5)
    vocabulary = [f"w{k}" for k in range(5000)]
    rows = []
    for k in range(0, 2000, 100):
        words = random.choices(vocabulary, k=150)
        near = list(words)
        for at in (30, 90):
            near[at] = "changed"
        rows += [(k, " ".join(words)), (k + 1, " ".join(near))]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.op8_simhash(spark, str(tmp_path)).collect()}
    apart = {i: (int(r["fingerprint"], 16) ^ int(got[i + 1]["fingerprint"], 16)).bit_count() for i, r in got.items() if i % 100 == 0}
    assert sum(d > simhash.RADIUS for d in apart.values()) > 10
    assert [got[i]["n_within"] for i in apart] == [1 + (d <= simhash.NEAR) for d in apart.values()]
    assert sum(d <= simhash.NEAR for d in apart.values()) > 15


def test_one_id_for_a_third_of_all_rows(spark):
    """Its texts are cut into several buckets; neighbours stay right, in order of the texts' hashes."""
    rows = [(k, f"text {k} of some words") for k in range(0, 300)] + [(150, f"more {k} and so on") for k in range(200)]
    docs = table(spark, rows)
    keys = {(r["doc_id"], r["text"]): r["k"] for r in docs.selectExpr("doc_id", "text", "xxhash64(text) as k").collect()}
    order = sorted(rows, key=lambda r: (r[0], keys[r]))
    want = []
    for k, (i, t) in enumerate(order):
        after, cut = order[(k + 1) % len(order)][1], len(t) // 4
        want.append((i, hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    dealt = simhash._neighbours(docs)
    assert dealt.where("at = 150 and peek = 0").select("to").distinct().count() > 2
    assert sorted((r["doc_id"], r["edited_sha256"]) for r in simhash.edited_fingerprints(docs).collect()) == sorted(want)


def test_odd_tables(spark):
    docs = table(spark, odd_rows()).selectExpr("*", "1 as bucket", "'x' as fingerprint", "2 as at")
    got = simhash.edited_fingerprints(docs).collect()
    assert len(got) == len(odd_rows())
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in odd_rows())
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 1}) == 1
    assert simhash.edited_fingerprints(docs.where("false")).count() == 0
    single = simhash.edited_fingerprints(docs.where("doc_id = 7")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0
    prints = simhash.fingerprints(docs).collect()
    assert len(prints) == len(odd_rows()) and all(len(r["fingerprint"]) == 32 for r in prints)


def test_many_words_vote_in_parts():
    words = np.arange(1, 100_000, dtype=np.uint64)
    assert len(simhash.fingerprint(words)) == 16
