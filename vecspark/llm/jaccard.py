"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is its set of distinct word shingles, put in order of how often they
occur: rare ones first, by a table of counts of fixed size that shingles are
hashed into, equal counts by hash.  So what many documents share (passages,
licences) stands behind what tells them apart.  Two documents of the wanted
similarity share at least one shingle among their first few ones (their
prefixes); with prefixes longer by l - 1 shingles they share at least l.  Each
document gets the l for which its estimated candidates cost least: a longer
prefix meets more other documents, but a candidate has to match more often
before it is verified.

Shingles that more than ``COMMON`` sets have in their longest prefixes (of
large groups of near copies, or of documents made of common passages only) meet
nobody.  As a pair can share no more of them than the one that has fewer, so
many matches less are asked of the others.  Where even a document's longest
prefix has too many, it is a crowded one; crowded documents are split by the
common shingles that connect them, and where they are many by bands of size, so
that only neighbouring bands can be similar.  A band is dealt out to blocks of
bounded size, and blocks are compared as products of incidence matrices.  Of a
pair of blocks only a spanning forest of its links and each document's number of
links come out.

Equal sets are one class all along.  Links make components of any size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added_up, documents, held, in_arrow, in_blocks, partitions, small, stage
from .components import connected_components
from .simhash import WordHashes, mixed

#: Sets that may have a shingle in their prefixes for it to bring candidates.
COMMON = 16
#: The longest prefix has so much more of a set's shingles than the shortest one.
LONGER = 0.05
#: Cost of verifying a shingle of a candidate, of meeting another document being 1.
VERIFY = 0.1
#: Crowded documents in a block, and the shingles in a block.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Bits of a shingle's place in the table of counts.
COUNTED = 20


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes, in order, of the distinct shingles of n words; a shorter sequence is one shingle."""
    if not len(words):
        return words
    size = min(n, len(words))
    value = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k])
    return np.unique(value)


def _least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _prefix(n: int, percent: int) -> int:
    return n - _least_overlap(n, percent) + 1 if n else 0


def _longest(n: int) -> int:
    """The largest l of a set of n shingles."""
    return 1 + -(-n * int(100 * LONGER) // 100)


def _of_text(hashes: WordHashes, text: str | None, words: int) -> np.ndarray:
    return shingles(hashes.of_bytes((text or "").encode().lower()), words)


def _name(found: np.ndarray) -> int | None:
    """The hash of a set; none of an empty one."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None


def with_set(docs: DataFrame, words: int = 5) -> DataFrame:
    """The documents with ``set``, the hash of their set of shingles; null without words."""
    schema = T.StructType([*docs.schema.fields, T.StructField("set", T.LongType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held("words", WordHashes)
        for batch in batches:
            found = [_name(_of_text(hashes, t.as_py(), words)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], schema.names)

    return docs.transform(in_arrow, compute, schema)


def shingle_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How many documents have shingles of each place of a table of 2^``COUNTED`` places."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held("words", WordHashes)
        total = np.zeros(1 << COUNTED, np.int64)
        for batch in batches:
            found = [_places(_of_text(hashes, t.as_py(), words)) for t in batch.column("text")]
            total += np.bincount(np.concatenate([np.zeros(0, np.int64), *found]), minlength=len(total))
        yield in_blocks(total)

    return added_up(docs.select("text").transform(in_arrow, count, "block int, values binary"), 1 << COUNTED)


def _places(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - COUNTED)).astype(np.int64)


def _sets(docs: DataFrame, words: int, percent: int, counts: np.ndarray) -> DataFrame:
    """``doc_id, n, set, prefix``: size and hash of each document's set, and its longest prefix, rare shingles first."""
    sent = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32))  # 4 MB

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = held("words", WordHashes), sent.value
        for batch in batches:
            ns, keys, prefixes = [], [], []
            for text in batch.column("text"):
                found = _of_text(hashes, text.as_py(), words)
                n = len(found)
                ns.append(n)
                keys.append(_name(found))
                order = np.argsort(counts[_places(found)], kind="stable")[: _prefix(n, percent) + _longest(n) - 1]
                prefixes.append(found[order].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(keys, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "n", "set", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_arrow, compute, "doc_id long, n long, set long, prefix array<long>")


def choose_length(n: int, ranks: np.ndarray, counts: np.ndarray, percent: int) -> tuple[int, int]:
    """The l of a set of n shingles and the number of common shingles in its prefix.

    ``ranks`` and ``counts`` are, for the shingles of the longest prefix that
    other sets have too, their places and in how many sets they are.  Of m
    incidences with other documents, at most m / l bring a candidate that
    matches l times; that bounds the cost of verifying.
    """
    first, most = _prefix(n, percent), _longest(n)
    lengths = np.arange(1, most + 1)
    common = counts > COMMON
    upto = np.searchsorted(ranks, first + lengths - 1)
    meets = np.concatenate(([0], np.cumsum(np.where(common, 0, counts - 1))))[upto]
    crowd = np.concatenate(([0], np.cumsum(common)))[upto]
    need = lengths - crowd
    cost = np.where(need > 0, meets * (1 + VERIFY * n / np.maximum(need, 1)), np.inf)
    best = int(np.argmin(cost)) if np.isfinite(cost).any() else most - 1
    return best + 1, int(crowd[best])


def _prefixes(met: DataFrame, percent: int) -> DataFrame:
    """One row for each set that shares a shingle: its l, prefix end, common shingles, and the shingles that bring candidates."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["set", "n", "l", "upto", "common", "crowded", "tokens", "crowd"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            rows = []
            for key, n, found in zip(batch.column("set").to_pylist(), batch.column("n").to_pylist(), batch.column("found").to_pylist()):
                found.sort(key=lambda x: x["rank"])
                ranks, counts = np.array([x["rank"] for x in found]), np.array([x["sets"] for x in found])
                tokens = np.array([x["token"] for x in found], np.int64)
                l, common = choose_length(n, ranks, counts, percent)
                upto = min(n, _prefix(n, percent) + l - 1)
                within, rare = ranks < upto, counts <= COMMON
                crowded = common >= 1 + -(-n * percent * int(100 * LONGER) // 10000)
                rows.append((key, n, l, upto, common, crowded, tokens[within & rare], tokens[within & ~rare] if crowded else tokens[:0]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)

    return met.transform(in_arrow, compute, "set long, n long, l long, upto long, common long, crowded boolean, tokens array<long>, crowd array<long>")


def _overlap(a: Column, b: Column, percent: int) -> Column:
    """Shingles that sets of a and b must share."""
    return F.ceil((a + b) * percent / (100 + percent) - 1e-9)


def _candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of sets that match often enough for their sizes and prefixes."""
    rows = sets.where("size(tokens) > 0").select("set", "n", "l", "upto", "common", F.explode("tokens").alias("token"))
    a, b = ({c: f"{c}_{s}" for c in rows.columns if c != "token"} for s in "ab")
    pairs = rows.withColumnsRenamed(a).join(rows.withColumnsRenamed(b), "token")
    pairs = pairs.where((F.col("set_a") < F.col("set_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    pairs = pairs.groupBy("set_a", "set_b").agg(F.count("*").alias("matches"), *[F.first(f"{c}_{s}").alias(f"{c}_{s}") for c in ("n", "l", "upto", "common") for s in "ab"])
    most = F.col("matches") + F.least("common_a", "common_b")
    behind = F.greatest(F.col("n_a") - F.col("upto_a"), F.col("n_b") - F.col("upto_b"))
    return pairs.where((most >= F.least("l_a", "l_b")) & (most + behind >= _overlap(F.col("n_a"), F.col("n_b"), percent))).select("set_a", "set_b")


def _whole(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``set, copies, cluster, hashes`` of the wanted sets (set, doc_id, copies, cluster), from the texts again."""
    wanted = wanted.withColumnsRenamed({"doc_id": "wanted_id", "set": "wanted"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(wanted), F.col("doc_id") == F.col("wanted_id")).select("wanted", "copies", "cluster", "text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held("words", WordHashes)
        for batch in batches:
            found = [_of_text(hashes, t.as_py(), words) for t in batch.column("text")]
            own = pa.array([x == _name(f) for x, f in zip(batch.column("wanted").to_pylist(), found)], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column("wanted"), batch.column("copies"), batch.column("cluster"), pa.array([f.tobytes() for f in found], pa.binary())], ["set", "copies", "cluster", "hashes"])
            yield out.filter(own)

    return rows.transform(in_arrow, compute, "set long, copies long, cluster long, hashes binary").dropDuplicates(["set"])


def _verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar, with both numbers of copies."""
    side = whole.select("set", "copies", "hashes")
    a, b = (side.toDF(f"set_{s}", f"copies_{s}", f"hashes_{s}") for s in "ab")
    both = pairs.join(a, "set_a").join(b, "set_b")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("hashes_a"), batch.column("hashes_b")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["set_a", "set_b", "copies_a", "copies_b"]).filter(pa.array(keep, pa.bool_()))

    return both.transform(in_arrow, compute, "set_a long, set_b long, copies_a long, copies_b long")


def block_links(own: list[np.ndarray], others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of one list of sets are similar to which of another, by products of incidence matrices over shared shingles."""
    if not own or not others:  # a block that the hash left empty, as of few sets with very many shingles
        return np.zeros((len(own), len(others)), bool)
    n, m = np.array([len(x) for x in own]), np.array([len(x) for x in others])
    x, y = np.concatenate(own), np.concatenate(others)
    at_x, at_y = np.repeat(np.arange(len(own)), n), np.repeat(np.arange(len(others)), m)
    tokens = np.intersect1d(x, y)
    shared = np.zeros((len(own), len(others)), np.float32)
    keep_x, keep_y = np.isin(x, tokens), np.isin(y, tokens)
    column_x, column_y = np.searchsorted(tokens, x[keep_x]), np.searchsorted(tokens, y[keep_y])
    at_x, at_y = at_x[keep_x], at_y[keep_y]
    order_x, order_y = np.argsort(column_x, kind="stable"), np.argsort(column_y, kind="stable")
    column_x, at_x, column_y, at_y = column_x[order_x], at_x[order_x], column_y[order_y], at_y[order_y]
    wide = 2048
    for k in range(0, len(tokens), wide):
        left, right = np.zeros((len(own), wide), np.float32), np.zeros((len(others), wide), np.float32)
        i, j = np.searchsorted(column_x, [k, k + wide]), np.searchsorted(column_y, [k, k + wide])
        left[at_x[i[0] : i[1]], column_x[i[0] : i[1]] - k] = 1
        right[at_y[j[0] : j[1]], column_y[j[0] : j[1]] - k] = 1
        shared += left @ right.T
    shared = np.rint(shared).astype(np.int64)
    return 100 * shared >= percent * (n[:, None] + m[None, :] - shared)


def _forest(links: np.ndarray, count: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph whose edges are the rows of ``links``."""
    root = list(range(count))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, j in links.tolist():
        if (a := find(i)) != (b := find(j)):
            root[a] = b
            kept.append((i, j))
    return kept


def _crowded_links(whole: DataFrame, percent: int) -> DataFrame:
    """Links among crowded sets: rows ``u, v`` of a spanning forest, and rows ``u`` with its number ``links`` of linked documents (v null)."""
    spark = whole.sparkSession
    sizes = whole.select("set", "cluster", (F.length("hashes") / 8).cast("long").alias("n"))
    totals = [F.count("*").alias("sets"), F.sum("n").alias("total")]
    few = stage(sizes.groupBy("cluster").agg(*totals).where((F.col("sets") <= BLOCK) & (F.col("total") <= BLOCK_SHINGLES)).select("cluster"), "jaccard-few", few=True)
    #: similar sets are in one band or in neighbouring ones
    band = F.floor(F.log(F.col("n")) / (math.log(100 / percent) * 1.0001)).cast("int") if percent < 100 else F.col("n").cast("int")
    sizes = sizes.join(small(few).withColumn("one", F.lit(0)), "cluster", "left").withColumn("band", F.coalesce("one", band))
    bands = sizes.groupBy("cluster", "band").agg(*totals).select("cluster", "band", F.greatest(F.ceil(F.col("sets") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    bands = stage(bands, "jaccard-bands", few=True)
    near = lambda step, name: bands.select("cluster", (F.col("band") - step).alias("band"), F.col("blocks").alias(name))
    spans = stage(bands.join(near(1, "above"), ["cluster", "band"], "left").join(near(-1, "below"), ["cluster", "band"], "left"), "jaccard-spans", few=True)
    placed = sizes.select("set", "cluster", "band").join(small(spans), ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("set"), "blocks").cast("int"))

    def tasks(count: Column, of: Callable[[Column], tuple[Column, Column, Column, Column]]) -> Column:
        """Tasks of a set (a hash of cluster, lower band and both blocks) with ``count`` blocks, and its side there."""
        def one(k: Column) -> Column:
            low, first, second, side = of(k)
            return F.struct(F.xxhash64("cluster", low, first, second).alias("task"), side.alias("side"))

        return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), one)).otherwise(F.array().cast("array<struct<task:long,side:int>>"))

    own, block, lower = F.col("band"), F.col("block"), F.col("band") - 1
    marked = lambda first, second: F.concat_ws(":", first, second)
    same = tasks(F.col("blocks"), lambda k: (own, marked(F.least(k, block), F.greatest(k, block)), F.lit(0), F.when(k == block, 2).when(block < k, 0).otherwise(1)))
    up = tasks(F.coalesce("above", F.lit(0)), lambda k: (own, marked(block, k), F.lit(1), F.lit(0)))
    down = tasks(F.coalesce("below", F.lit(0)), lambda k: (lower, marked(k, block), F.lit(1), F.lit(1)))
    sides = placed.select("set", F.explode(F.concat(same, up, down)).alias("s")).select("set", "s.*")
    rows = whole.select("set", "copies", "hashes").join(sides, "set").select("task", "side", "set", "copies", "hashes")

    def compare(table: pa.Table) -> pa.Table:
        keys, copies = table.column("set").to_numpy(), table.column("copies").to_numpy()
        sides = table.column("side").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
        similar = block_links([sets[k] for k in left], [sets[k] for k in right], percent)
        same = sides[0] == 2
        if same:
            np.fill_diagonal(similar, False)
        degree = np.zeros(len(sets), np.int64)
        degree[left] += similar @ copies[right]
        if not same:
            degree[right] += copies[left] @ similar
        at = np.argwhere(np.triu(similar) if same else similar)
        edges = _forest(np.stack([left[at[:, 0]], right[at[:, 1]]], 1), len(sets))
        some = np.flatnonzero(degree)
        u = np.concatenate([keys[[i for i, _ in edges]], keys[some]]) if edges else keys[some]
        v = [int(keys[j]) for _, j in edges] + [None] * len(some)
        links = [None] * len(edges) + degree[some].tolist()
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(links, pa.int64())], ["u", "v", "links"])

    return rows.repartition(partitions(spark), "task").groupBy("task").applyInArrow(compare, "u long, v long, links long")


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, n_links, component_id, set`` of each document with an id.

    Two documents link if they share at least ``percent`` per cent of the
    distinct shingles of ``words`` words that either has.  Words are parted by
    ASCII white space and compared without case of A to Z; a text of fewer words
    is one shingle.  ``n_links`` counts the documents linked to this one,
    ``component_id`` is the least id reachable by links.

    Texts without words, null ones too, have no shingles, no links, and are
    their own component.  Documents with null ids are left out, as no id could
    name them.  Repeated rows are documents with equal texts and link; rows of
    one id with different texts are in the components of their own texts.  An
    empty table gives an empty result.  ``set`` names a document's set of
    shingles.
    """
    docs = docs.where("doc_id is not null")
    sets = stage(_sets(docs, words, percent, shingle_counts(docs, words)), "jaccard-sets")
    members = sets.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    members = stage(members, "jaccard-classes", few=True)
    distinct = stage(sets.where("n > 0").select("set", "n", "prefix").dropDuplicates(["set"]), "jaccard-prefixes")
    tokens = distinct.select("set", "n", F.posexplode("prefix").alias("rank", "token"))
    shared = stage(tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1"), "jaccard-shared")
    # shared is never sent to all executors: it grows with the corpus, and its hash table takes many times its files
    met = tokens.join(shared, "token").groupBy("set", "n").agg(F.collect_list(F.struct("rank", "token", "sets")).alias("found"))
    prefixes = stage(_prefixes(met, percent), "jaccard-chosen")

    pairs = stage(_candidates(prefixes, percent), "jaccard-pairs")
    crowd = prefixes.where("crowded").select("set", "crowd")
    firsts = crowd.select("set", F.array_min("crowd").alias("first"), F.explode("crowd").alias("token"))
    named = connected_components(firsts.select(F.col("token").alias("u"), F.col("first").alias("v")).distinct())
    crowd = crowd.select("set", F.array_min("crowd").alias("node")).join(named, "node", "left").select("set", F.coalesce("component", "node").alias("cluster"))
    wanted = pairs.select(F.col("set_a").alias("set")).union(pairs.select(F.col("set_b").alias("set"))).union(crowd.select("set")).distinct()
    wanted = stage(wanted.join(crowd, "set", "left").join(members, "set").select("set", "doc_id", "copies", "cluster"), "jaccard-wanted", few=True)
    whole = stage(_whole(docs, wanted, words), "jaccard-whole")

    links = stage(_verified(pairs, whole, percent), "jaccard-links")
    crowded = stage(_crowded_links(whole.where("cluster is not null"), percent), "jaccard-crowded")
    edges = links.select(F.col("set_a").alias("u"), F.col("set_b").alias("v")).union(crowded.where("v is not null").select("u", "v"))
    component = stage(connected_components(edges), "jaccard-components", few=True)

    #: a pair of crowded sets may have been verified both ways; its links count once
    in_crowd = whole.where("cluster is not null").select("set", "cluster")
    a, b = (in_crowd.toDF(f"set_{s}", f"cluster_{s}") for s in "ab")
    other = links.join(a, "set_a", "left").join(b, "set_b", "left").where(~F.coalesce(F.col("cluster_a") == F.col("cluster_b"), F.lit(False)))
    degree = other.select(F.col("set_a").alias("set"), F.col("copies_b").alias("links")).union(other.select("set_b", "copies_a")).union(crowded.where("v is null").select("u", "links"))
    degree = degree.groupBy("set").agg(F.sum("links").alias("links"))
    classes = members.join(component.withColumnRenamed("node", "set"), "set", "left").join(degree, "set", "left")
    classes = classes.select("set", "doc_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "set").alias("component"))
    least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    classes = stage(classes.join(least, "component").select("set", "n_links", "component_id"), "jaccard-named", few=True)
    out = sets.select("doc_id", "n", "set").join(small(classes), "set", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"), "set")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, 85 per cent of the union shared; every document of the table."""
    linked = join(documents(spark, sf_dir).select("doc_id", "text"), words=4, percent=85)
    return linked.select("doc_id", "n_shingles", "component_id", "n_links")
