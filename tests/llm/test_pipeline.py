import gc
import hashlib
import importlib.util
import os
import sys
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tables import odd_rows, table

from vecspark.llm import bpe, jaccard, mixing

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_jaccard import brute as brute_links  # noqa: E402
from test_lines import brute as brute_lines  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402

SMALL = "/root/testdata/sf0.001"
STAGES = dict(pipeline.STAGES)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_stages_are_in_order():
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "mixing", "bpe"]
    assert importlib.util.find_spec("__spark_entry__")


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns

    kept = STAGES["toxicity"](spark, docs, SMALL).cache()
    assert kept.columns == columns and 0.8 * docs.count() < kept.count() <= docs.count()
    assert not set(rows_of(kept)) - set(rows_of(docs))

    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    lined = STAGES["line_dedup"](spark, kept, SMALL).cache()
    want = {i: t for i, t in brute_lines(sorted(texts.items())).items() if t.split() or t == texts[i]}
    assert {r["doc_id"]: r["text"] for r in lined.collect()} == want
    assert lined.columns == columns and all(r["n_chars"] == len(r["text"]) for r in lined.collect())

    apart = STAGES["ngram_jaccard"](spark, lined, SMALL).cache()
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    links = brute_links([(i, whole[i]) for i in sorted(want)], pipeline.SHINGLE, pipeline.SIMILAR)  # lines that went count again
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(i for i, (_, _, least) in links.items() if least == i)

    mixed = STAGES["mixing"](spark, apart, SMALL).cache()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(apart).collect()}
    assert mixed.columns == columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})

    encoded = STAGES["bpe"](spark, mixed, SMALL).collect()
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    true = tiktoken.Encoding("true", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    left = {r["doc_id"]: r["text"] for r in apart.collect()}
    assert len(encoded) == mixed.count()
    for r in encoded:
        assert r["ids"] == true.encode_ordinary(left[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(left[r["doc_id"]].encode()).hexdigest()


def test_run_is_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert rows_of(pipeline.run(spark, SMALL).drop("ids")) == rows_of(docs.drop("ids"))


def test_rows_of_one_id_go_by_themselves(spark):
    """(1, A), (5, A), (5, B): B is like nothing else and stays."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    kept = STAGES["ngram_jaccard"](spark, table(spark, [(1, a), (5, a), (5, b), (5, b), (5, b + " more"), (None, a), (5, "")]), SMALL)
    got = sorted((r["doc_id"] or 0, r["text"][:2]) for r in kept.collect())
    assert got == [(0, "a0"), (1, "a0"), (5, ""), (5, "b0")]


def test_near_copies_go_though_their_lines_went(spark):
    """On sf0.01, of the near copies among the original texts, 0.9 at least are gone after the stage; what is like nothing stays."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    links = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs, pipeline.SHINGLE, pipeline.SIMILAR).collect()}
    copies = {i for i, least in links.items() if least != i}
    lined = STAGES["line_dedup"](spark, docs, sf_dir).cache()
    kept = {r["doc_id"] for r in STAGES["ngram_jaccard"](spark, lined, sf_dir).collect()}
    assert len(copies) > 30 and len(copies & kept) <= 0.1 * len(copies)
    assert {r["doc_id"] for r in lined.collect()} - kept <= copies


def test_copies_and_near_copies_go(spark):
    words = [f"word{k}" for k in range(200)]
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (10, 60, 110)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), *[(3 + k, t) for k, t in enumerate(near)], (9, "quite another text of some words that stand nowhere else")]
    kept = STAGES["ngram_jaccard"](spark, table(spark, rows), SMALL)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 9]
    rows = [(1, "a line that repeats word by word\nits own first line here"), (2, "a line that repeats word by word"), (3, "")]
    kept = {r["doc_id"]: r["text"] for r in STAGES["line_dedup"](spark, table(spark, rows), SMALL).collect()}
    assert kept == {1: rows[0][1], 3: ""}


def test_odd_tables(spark):
    """Every stage takes nulls, empty tables and columns that are named like any working column."""
    more = [f"1 as {c}" for c in ("score", "predicted", "n_lines", "n_kept", "size", "copies", "target", "key", "set", "ids", "n_tokens", "_others", "features", "place")]
    docs = table(spark, odd_rows()).selectExpr("*", *more)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert out.where("score = 1 and copies = 1 and place = 1").count() == out.count() > 0
        assert stage(spark, docs.where("false"), SMALL).count() == 0, name
    assert STAGES["bpe"](spark, docs, SMALL).count() == len(odd_rows())
    assert STAGES["bpe"](spark, docs.where("false"), SMALL).count() == 0
    counts = defaultdict(int)
    for r in STAGES["ngram_jaccard"](spark, docs, SMALL).select(F.col("doc_id")).collect():
        counts[r["doc_id"]] += 1
    assert counts[1] == 1 and counts[None] == 1


def test_encoding_begins_with_java_memory_given_back(spark):
    docs = table(spark, [(1, "some words to encode")])
    jvm = spark.sparkContext._jvm
    grown = [jvm.java.nio.ByteBuffer.allocate(128 << 20) for _ in range(24)]
    before = jvm.java.lang.Runtime.getRuntime().totalMemory()
    grown.clear()
    gc.collect()
    STAGES["bpe"](spark, docs, SMALL)
    assert jvm.java.lang.Runtime.getRuntime().totalMemory() < before - (512 << 20)
