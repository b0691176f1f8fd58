"""Scores by a masked language model: every token is predicted from both of its sides.

Words are hashed into token buckets.  A window network looks at the words on
either side of a place, by tables of their own for the word before, the word
behind and the others, and gives out how likely each of ``PARTS`` components is.
A component is a distribution over all buckets, so the probability of a token is
the sum over components of gate times share: normalized over all buckets without
ever adding them up.  The sum of the logarithms over a text's tokens is its
pseudo-log-likelihood.

Components begin as classes of words that stand beside the same frequent words,
by k-means on counts.  Then each round trains the network on every token of all
documents, by steps on numpy arrays, and takes new components from the tokens
that each one accounts for.  Documents are dealt to logical shards by a hash, as
many as the corpus has millions of tokens, and each shard's documents are trained
on in order of that hash; weights are averaged over shards and everything that
tasks add up is whole numbers.  So the model is the same however the table is
partitioned, while the driver only ever holds one model of fixed size.

What a network of fixed size can't hold is which contexts came up before.  All
contexts of four words are counted over the corpus, with the words that stood in
them: places are dealt to buckets by a hash of the context, as many as the corpus
has millions of tokens, and each bucket is counted by itself, a quarter of them
after the other.  Where a context
occurs elsewhere, its other occurrences vote with the network, by their number.
So a text that occurs twice scores above one of its kind that does not.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added_up, cleared, documents, forget, held, in_arrow, in_blocks, partitions, small, stage, staged
from .simhash import WordHashes, mixed

BUCKETS, PARTS = 1 << 16, 16
#: Rows of the tables of context words: the most frequent buckets have their own, the others share the rest by bucket.
ROWS, OWN = 4096, 3072
#: Frequent buckets that classes are made by.
BESIDE = 64
#: Places of the words that predict a word, and which table each is looked up in.
WINDOW, TABLE = (-3, -2, -1, 1, 2, 3), (2, 2, 0, 1, 2, 2)
PAD = max(WINDOW)
#: Rounds, rate of the steps, and the share of a component that is like the whole corpus.
ROUNDS, RATE, PLAIN = 2, 0.1, 0.02
#: Tokens trained and scored at a time; texts, and tokens after which no more texts join them, that are laid out together.
AT_ONCE, TEXTS = 4096, 128
TOKENS = 12 * AT_ONCE
#: Tokens of a logical shard, about.
SHARD_TOKENS = 1 << 20
#: Places whose contexts a task deals out at a time, and those in a bucket, about.
DEALT, BUCKET_PLACES = 1 << 19, 1 << 20
#: Turns in which buckets are counted.
TURNS = 4
#: Units of a gain, for sums of whole numbers.
GAIN = 10**9
#: Bits of such a sum that are added up apart from those above.
HIGH = 24
#: Units of the whole numbers that are added up.
UNIT = 1 << 10
SHAPES = ((3, ROWS + 1, PARTS), (PARTS,))
WEIGHTS = sum(int(np.prod(s)) for s in SHAPES)
#: Places of the cells of each row in a table.
CELLS = np.arange((ROWS + 1) * PARTS).reshape(-1, PARTS)
#: Below this, sums of weights can be exponents as they are.
EXPONENT = 80


def unpack(flat: np.ndarray) -> list[np.ndarray]:
    """Views of the weights: tables of context words, and the gates' bias."""
    size = int(np.prod(SHAPES[0]))
    return [flat[:size].reshape(SHAPES[0]), flat[size:]]


@dataclass
class Model:
    """Row of each bucket, the network's weights, each component's share of every bucket, and the places trained on in all rounds."""

    rows: np.ndarray
    weights: np.ndarray
    shares: np.ndarray
    trained: int = 0

    def padded(self, tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and buckets of some texts one after the other, parted by padding, and the places of their tokens."""
        size = sum(map(len, tokens)) + PAD * (len(tokens) + 1)
        rows, buckets = np.full(size, ROWS, np.int64), np.zeros(size, np.int64)
        spots, at = [], PAD
        for t in tokens:
            rows[at : at + len(t)], buckets[at : at + len(t)] = self.rows[t], t
            spots.append(np.arange(at, at + len(t)))
            at += len(t) + PAD
        return rows, buckets, np.concatenate(spots) if spots else np.zeros(0, np.int64)


def table_rows(counts: np.ndarray) -> np.ndarray:
    """The row of each bucket, given how often it occurs."""
    rows = OWN + np.arange(BUCKETS) % (ROWS - OWN)
    rows[np.argsort(-counts, kind="stable")[:OWN]] = np.arange(OWN)
    return rows


def shares_of(counts: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Shares of all buckets in each component, from the tokens (bucket, component) that it accounts for."""
    plain = (counts + 0.5) / (counts + 0.5).sum()
    parts = parts + 1e-6 * plain[:, None]
    return ((1 - PLAIN) * parts / parts.sum(0) + PLAIN * plain[:, None]).astype(np.float32)


def first_model(counts: np.ndarray, beside: np.ndarray, seed: int = 1) -> Model:
    """Components from classes of the table's rows by what they stand beside (rows by frequent buckets); gates are even."""
    rows = table_rows(counts)
    weight = beside.sum(1)
    usual = beside.sum(0) / max(beside.sum(), 1)
    points = np.sqrt((beside + 4 * usual) / (weight[:, None] + 4)) - np.sqrt(usual)
    known = np.flatnonzero(weight[:OWN] > 0)
    if not len(known):
        return Model(rows, np.zeros(WEIGHTS, np.float32), shares_of(counts, np.repeat(counts[:, None] / PARTS, PARTS, 1)))
    chance = np.random.default_rng(seed)
    centers = points[known[:1]]
    far = ((points[known] - centers[0]) ** 2).sum(1) * np.sqrt(weight[known])
    for _ in range(PARTS - 1):
        odds = far / far.sum() if far.sum() > 0 else np.full(len(known), 1 / len(known))
        centers = np.concatenate([centers, points[known[chance.choice(len(known), p=odds)]][None]])
        far = np.minimum(far, ((points[known] - centers[-1]) ** 2).sum(1) * np.sqrt(weight[known]))
    for _ in range(20):
        near = ((points[known][:, None] - centers[None]) ** 2).sum(2).argmin(1)
        for z in np.unique(near):
            centers[z] = np.average(points[known[near == z]], 0, weight[known[near == z]])
    parts = np.full((BUCKETS, PARTS), 0.2 / PARTS)
    classes = np.full(ROWS, -1)
    classes[known] = near
    of_bucket = classes[rows]
    sure = np.flatnonzero(of_bucket >= 0)
    parts[sure, of_bucket[sure]] += 0.8
    parts[of_bucket < 0] = 1 / PARTS
    return Model(rows, np.zeros(WEIGHTS, np.float32), shares_of(counts, parts * counts[:, None]))


def forward(weights: list[np.ndarray], shares: np.ndarray, rows: np.ndarray, buckets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gates at some places in order, what each component contributes to the token's probability, and that probability.

    All rows between the first place and the last are looked up once in each
    table, then moved to the places that they stand beside.  Whether exponents
    are taken less the largest follows from the weights alone, so a place's
    gates don't depend on the others.
    """
    tables, bias = weights
    near = rows[at[0] - PAD : at[-1] + PAD + 1] if len(at) else rows[:0]
    seen, spot = [_rows_of(table, near) for table in tables], at - at[:1]
    gates = np.repeat(bias[None], max(len(near) - 2 * PAD, 0), 0)
    for place, table in zip(WINDOW, TABLE):
        gates += seen[table][PAD + place : len(near) - PAD + place]
    gates = _rows_of(gates, spot)
    largest = [max(table.max(), -table.min()) for table in tables]
    if not np.abs(bias).max() + sum(largest[table] for table in TABLE) < EXPONENT:
        gates -= gates.max(1, keepdims=True)
    np.exp(gates, out=gates)
    gates /= np.einsum("ij->i", gates)[:, None]
    both = gates * _rows_of(shares, buckets[at])
    return gates, both, np.einsum("ij->i", both)


def _rows_of(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``table[rows]`` for rows that there are."""
    return np.take(table, rows, 0, mode="clip")  # several times as fast as by index


def train_step(flat: np.ndarray, squares: np.ndarray, shares: np.ndarray, rows: np.ndarray, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One step of AdaGrad on minus the mean log-probability of some places; returns how each component accounts for them."""
    weights = unpack(flat)
    gates, both, total = forward(weights, shares, rows, buckets, at)
    accounts = np.divide(both, total[:, None], out=both)
    back = np.subtract(gates, accounts, out=gates)
    back /= np.float32(len(at))
    near = rows[at[0] - PAD : at[-1] + PAD + 1]
    wide = np.zeros((len(near) - 2 * PAD, PARTS), np.float32)
    wide[at - at[0]] = back
    cells = _rows_of(CELLS, near)
    gradient = np.empty_like(flat)
    for k in range(len(SHAPES[0])):
        places = [PAD + place for place, table in zip(WINDOW, TABLE) if table == k]
        if len(places) == 1:
            beside, among = wide, cells[places[0] :][: len(wide)]
        else:
            beside, among = np.zeros((len(near), PARTS), np.float32), cells  # what the places around each row give back to it
            for place in places:
                beside[place:][: len(wide)] += wide
        gradient[k * CELLS.size : (k + 1) * CELLS.size] = np.bincount(among.reshape(-1), beside.reshape(-1), CELLS.size)
    gradient[-PARTS:] = np.einsum("ij->j", back)
    step = gradient * gradient
    squares += step
    np.sqrt(squares, out=step)
    step += np.float32(1e-6)
    gradient *= np.float32(RATE)
    gradient /= step
    flat -= gradient
    return accounts


def _spread(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The values, one for each of ``rows``, added up by row."""
    cells = (rows[:, None] * PARTS + np.arange(PARTS)).reshape(-1)
    return np.bincount(cells, values.reshape(-1), size * PARTS).reshape(size, PARTS)


def train_texts(model: Model, flat: np.ndarray, squares: np.ndarray, parts: np.ndarray, tokens: list[np.ndarray]) -> int:
    """Steps that together predict every token of some texts once; adds to ``parts`` and returns how many tokens.

    Steps take places in order; texts come in order of a hash, so each step
    still sees texts of all kinds.
    """
    rows, buckets, at = model.padded(tokens)
    accounts = np.empty((len(at), PARTS), np.float32)
    for k in range(0, len(at), AT_ONCE):
        accounts[k : k + AT_ONCE] = train_step(flat, squares, model.shares, rows, buckets, at[k : k + AT_ONCE])
    if len(at):
        order = np.argsort(buckets[at].astype(np.uint16), kind="stable")  # by their two bytes
        found = buckets[at][order]
        new = np.concatenate([[True], found[1:] != found[:-1]])
        parts[found[new]] += _spread(np.cumsum(new) - 1, _rows_of(accounts, order), np.count_nonzero(new))
    return len(at)


def tokens_of(hashes: WordHashes, text: str | None) -> np.ndarray:
    return (hashes.of_bytes((text or "").encode().lower()) & np.uint64(BUCKETS - 1)).astype(np.int64)


def tokenize(docs: DataFrame) -> DataFrame:
    """The documents with ``tokens`` (16-bit buckets, as bytes) and their hash ``key`` in place of ``text``; none for null and empty texts."""
    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("text", "tokens", "key")] + [T.StructField("tokens", T.BinaryType()), T.StructField("key", T.LongType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = held("words", WordHashes)
        for batch in batches:
            tokens = [tokens_of(hashes, t.as_py()).astype("<u2").tobytes() for t in batch.column("text")]
            keys = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in tokens]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in schema.names[:-2]] + [pa.array(tokens, pa.binary()), pa.array(keys, pa.int64())], schema.names)

    return docs.transform(in_arrow, compute, schema)


def _read(tokens: pa.Scalar) -> np.ndarray:
    return np.frombuffer(tokens.as_py() or b"", "<u2").astype(np.int64)


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a column of bytes one after the other, and how many each row has."""
    column = column.fill_null(b"")
    _, ends, values = column.buffers()
    if not len(column) or not values:
        return np.zeros(0, kind), np.zeros(len(column), np.int64)
    ends = np.frombuffer(ends, "<i8" if pa.types.is_large_binary(column.type) else "<i4")[column.offset :][: len(column) + 1]
    return np.frombuffer(values, np.uint8)[ends[0] : ends[-1]].view(kind), np.diff(ends) // np.dtype(kind).itemsize


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """Tokens of all tokenized documents by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            counts += np.bincount(_numbers(batch.column("tokens"), "<u2")[0], minlength=BUCKETS)
        yield in_blocks(counts)

    return added_up(docs.select("tokens").transform(in_arrow, count, "block int, values binary"), BUCKETS)


def beside_counts(docs: DataFrame, counts: np.ndarray) -> np.ndarray:
    """How often words of each row stand within the window of each of the most frequent buckets."""
    rows = table_rows(counts)
    column = np.where(rows < BESIDE, rows, BESIDE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ROWS + 1) * (BESIDE + 1), np.int64)  # what is beside padding goes to the last row and column
        for batch in batches:
            tokens, n = _numbers(batch.column("tokens"), "<u2")
            size, at = len(tokens) + PAD * len(n), np.arange(len(tokens)) + PAD * np.repeat(np.arange(len(n)), n)
            own, other = np.full(size, ROWS * (BESIDE + 1)), np.full(size, BESIDE)
            own[at], other[at] = rows[tokens] * (BESIDE + 1), column[tokens]
            for step in range(1, PAD + 1):
                for pairs in (own[:-step] + other[step:], own[step:] + other[:-step]):
                    total += np.bincount(pairs, minlength=len(total))
        yield in_blocks(total[: ROWS * (BESIDE + 1)])

    found = added_up(docs.select("tokens").transform(in_arrow, count, "block int, values binary"), ROWS * (BESIDE + 1))
    return found.reshape(ROWS, BESIDE + 1)[:, :BESIDE].astype(np.float64)


def in_shards(docs: DataFrame, total: int) -> DataFrame:
    """``shard, key, tokens`` of the documents with tokens, each shard in one partition, in order of their hash."""
    shards = max(1, -(-total // SHARD_TOKENS))
    dealt = docs.where(F.octet_length("tokens") > 0).select(F.pmod(F.xxhash64("key", "doc_id"), F.lit(shards)).alias("shard"), F.xxhash64("key").alias("place"), "key", "tokens")
    return dealt.repartition(partitions(docs.sparkSession), "shard").sortWithinPartitions("shard", "place", "key").select("shard", "tokens")


def fit(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """A model of all texts of ``docs`` (doc_id and what ``tokenize`` gives)."""
    with cleared(docs.sparkSession):
        return _fitted(docs, rounds)


def _fitted(docs: DataFrame, rounds: int) -> Model:
    counts = corpus_counts(docs)
    model = first_model(counts, beside_counts(docs, counts))
    if not counts.sum():
        return model
    for _ in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def train(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            model, now = sent.value, None
            sums = np.zeros(WEIGHTS + BUCKETS * PARTS + 1, np.int64)
            waiting: list[np.ndarray] = []

            def trained() -> int:
                n = train_texts(model, flat, squares, parts, waiting)
                waiting.clear()
                return n

            def closed(n: int) -> None:
                sums[:WEIGHTS] += np.rint(flat.astype(np.float64) * UNIT * n).astype(np.int64)
                sums[WEIGHTS:-1] += np.rint(parts.ravel() * UNIT).astype(np.int64)
                sums[-1] += n

            for batch in batches:
                for shard, tokens in zip(batch.column("shard").to_pylist(), batch.column("tokens")):
                    if shard != now:
                        if now is not None:
                            closed(n + trained())
                        now, n, n_waiting = shard, 0, 0
                        flat, squares, parts = model.weights.copy(), np.full_like(model.weights, 1e-6), np.zeros((BUCKETS, PARTS))
                    waiting.append(_read(tokens))
                    n_waiting += len(waiting[-1])
                    if n_waiting >= TOKENS or len(waiting) >= TEXTS:
                        n, n_waiting = n + trained(), 0
            if now is not None:
                closed(n + trained())
            yield in_blocks(sums)

        found = added_up(in_shards(docs, int(counts.sum())).transform(in_arrow, train, "block int, values binary"), WEIGHTS + BUCKETS * PARTS + 1)
        weights = (found[:WEIGHTS] / (UNIT * max(found[-1], 1))).astype(np.float32)
        model = Model(model.rows, weights, shares_of(counts, found[WEIGHTS:-1].reshape(BUCKETS, PARTS) / UNIT), model.trained + int(found[-1]))
    return model


def token_probs(model: Model, tokens: list[np.ndarray]) -> np.ndarray:
    """Probabilities of all tokens of some texts, one after the other."""
    rows, buckets, at = model.padded(tokens)
    weights = unpack(model.weights)
    found = np.empty(len(at))
    for k in range(0, len(at), AT_ONCE):
        found[k : k + AT_ONCE] = forward(weights, model.shares, rows, buckets, at[k : k + AT_ONCE])[2]
    return found


def contexts(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places with two words on either side, and their contexts (four buckets in one number)."""
    if len(tokens) < 5:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = tokens.astype(np.uint64)
    around = (t[:-4] << np.uint64(48)) | (t[1:-3] << np.uint64(32)) | (t[3:-1] << np.uint64(16)) | t[4:]
    return np.arange(2, len(tokens) - 2), around.view(np.int64)


def network_scores(docs: DataFrame, model: Model) -> DataFrame:
    """The tokenized documents with ``n_tokens``, ``net`` (the sum over tokens) and ``probs`` (of each token, as bytes)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("net", T.DoubleType()), T.StructField("probs", T.BinaryType())]
    names = {f.name for f in new}
    schema = T.StructType([f for f in docs.schema.fields if f.name not in names] + new)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                tokens = [_read(t) for t in part.column("tokens")]
                n = np.array([len(t) for t in tokens])
                probs = token_probs(model, tokens)
                logs = np.bincount(np.repeat(np.arange(len(tokens)), n), np.log(probs), len(tokens)).astype(np.float64)
                each = [p.astype("<f4").tobytes() for p in np.split(probs, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in schema.names[:-3]] + [pa.array(n, pa.int64()), pa.array(logs, pa.float64()), pa.array(each, pa.binary())], schema.names)

    return docs.transform(in_arrow, compute, schema)


#: What is dealt out of a bucket's places, in order of context: its four buckets one after the other, which compresses; the text's place in ``keys``, and the keys of these texts.
PLACES = {**{f"beside{k}": "<u2" for k in range(4)}, "word": "<u2", "prob": "<f4", "text_low": "<u2", "text_high": "<u2", "keys": "<i8"}


def _dealt(rows: DataFrame, buckets: int, turns: int = 1, turn: int = 0) -> DataFrame:
    """All places with a context in every ``turns``-th bucket, by ``bucket``, many in a row: the columns of ``PLACES`` as bytes."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        bits = buckets.bit_length()

        def dealt() -> pa.RecordBatch:
            texts = np.cumsum([0] + [len(w[0]) for w in waiting])
            keys, text = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] + first for w, first in zip(waiting, texts)])
            context, bucket, word, prob = (np.concatenate([w[k] for w in waiting]) for k in (2, 3, 4, 5))
            waiting.clear()
            order = np.argsort(bucket.astype(np.uint64) << np.uint64(64 - bits) | context >> np.uint64(bits))
            bucket = bucket[order]
            begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            out: list[tuple] = []
            for begin, end in zip(begins, [*begins[1:], len(order)]):
                at = order[begin:end]
                met = np.zeros(len(keys), bool)
                met[text[at]] = True
                index, beside = (np.cumsum(met) - 1)[text[at]], context[at]
                columns = (*(beside >> np.uint64(shift) & np.uint64(BUCKETS - 1) for shift in (48, 32, 16, 0)), word[at], prob[at], index & 0xFFFF, index >> 16, keys[met])
                out.append((int(bucket[begin]), *(x.astype(kind).tobytes() for x, kind in zip(columns, PLACES.values()))))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(zip(*out))], ["bucket", *PLACES])

        n = 0
        for batch in batches:
            tokens, sizes = _numbers(batch.column("tokens"), "<u2")
            at, context = contexts(tokens)
            text, context = np.repeat(np.arange(len(sizes)), sizes), context.view(np.uint64)
            bucket = (mixed(context) % np.uint64(buckets)).astype(np.int64)
            own = np.flatnonzero((text[at - 2] == text[at + 2]) & (bucket % turns == turn))
            if len(own):
                at = at[own]
                waiting.append((batch.column("key").to_numpy(), text[at], context[own], bucket[own], tokens[at], _numbers(batch.column("probs"), "<f4")[0][at]))
                n += len(own)
            if n >= DEALT:
                yield dealt()
                n = 0
        if waiting:
            yield dealt()

    return rows.select("key", "tokens", "probs").transform(in_arrow, deal, "bucket int, " + ", ".join(f"{c} binary" for c in PLACES))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and number of the run of equal values that each value is in."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    run = np.cumsum(new) - 1
    return np.bincount(run)[run], run


def gains(context: np.ndarray, word: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """What votes add to the logarithm at each place, in whole units; all places of their contexts are given."""
    order = np.argsort(context)
    n, run = _runs(context[order])
    again = np.flatnonzero(n > 1)
    words = run[again] << 16 | word[order[again]].astype(np.int64)
    by = np.argsort(words)
    (m, _), n, at = _runs(words[by]), n[again[by]], order[again[by]]
    p = prob[at].astype(np.float64)
    found = np.zeros(len(order), np.int64)
    found[at] = np.rint(GAIN * (np.log((p + m - 1) / n) - np.log(p))).astype(np.int64)
    return found


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys in order, and sums of values by key."""
    own, index = np.unique(keys, return_inverse=True)
    sums = np.zeros((len(values), len(own)), np.int64)
    for total, x in zip(sums, values):
        np.add.at(total, index, x)
    return own, *sums


def _voted(dealt: DataFrame) -> DataFrame:
    """``key, units``: what votes add to texts, each text once.

    A text's places lie in many buckets, so buckets give keys and sums as bytes,
    many in a row, by ``part`` of the texts, and each part is added up by itself.
    """
    parts = partitions(dealt.sparkSession)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting = None, []

        def voted() -> pa.RecordBatch:
            context = np.concatenate([w["beside0"] for w in waiting]).astype(np.uint64)
            for k in range(1, 4):
                context = context << np.uint64(16) | np.concatenate([w[f"beside{k}"] for w in waiting])
            word, prob = (np.concatenate([w[c] for w in waiting]) for c in ("word", "prob"))
            units, keys = gains(context, word, prob), np.concatenate([w["keys"][w["text_low"] + (w["text_high"].astype(np.int64) << 16)] for w in waiting])
            waiting.clear()
            keys, sums = _summed(keys[units != 0], units[units != 0])
            part = (mixed(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            own, begins = np.unique(part[order], return_index=True)
            split = [[p.tobytes() for p in np.split(x[order], begins[1:])][: len(own)] for x in (keys, sums)]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array(x, pa.binary()) for x in split)], ["part", "keys", "units"])

        for batch in batches:
            for k, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != now and waiting:
                    yield voted()
                now = bucket
                waiting.append({c: np.frombuffer(batch.column(c)[k].as_py(), kind) for c, kind in PLACES.items()})
        if waiting:
            yield voted()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, waiting, n = (np.zeros(0, np.int64),) * 3, [], 0
        for batch in batches:
            keys, units = (_numbers(batch.column(c), "<i8")[0] for c in ("keys", "units"))
            waiting.append((keys, units >> HIGH, units & (1 << HIGH) - 1))  # a text may have many copies
            n += len(keys)
            if n >= DEALT:
                sums, waiting, n = _summed(*map(np.concatenate, zip(sums, *waiting))), [], 0
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _summed(*map(np.concatenate, zip(sums, *waiting)))], ["key", "high", "low"])

    votes = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").transform(in_arrow, vote, "part int, keys binary, units binary")
    sums = votes.repartition(parts, "part").transform(in_arrow, add, "key long, high long, low long")
    return sums.select("key", (F.col("high").cast("decimal(28,0)") * F.lit(1 << HIGH).cast("decimal(9,0)") + F.col("low")).cast("decimal(38,0)").alias("units"))


def score(docs: DataFrame, model: Model, spent: Sequence[str] = ()) -> DataFrame:
    """The tokenized documents with ``n_tokens``, ``log_prob`` and ``mean_log_prob`` in place of ``tokens`` and ``key``.

    Where a context occurs n times in ``docs``, a word that stands in m of them
    has probability (p + m - 1) / n there, p being the network's and the place
    itself not counted.  Places without two words on either side have no
    context.  Null and empty texts have no tokens, log_prob 0 and a null mean.
    Other columns stay, except ones named like the new ones; rows of equal texts
    get the same scores, and an empty table gives an empty result.

    Contexts are counted in ``TURNS`` turns, each of which shuffles the places of
    its buckets only.  Folders named in ``spent`` are removed when the network
    has read ``docs``.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "tokens", "key", "n_tokens", "log_prob", "mean_log_prob")]
    docs = docs.select("doc_id", "tokens", "key", F.struct(F.lit(0).alias("_"), *others).alias("_others"))
    with cleared(docs.sparkSession):
        rows = stage(network_scores(docs, model), "lm-scores")
        forget(docs.sparkSession, list(spent))
        places = rows.agg(F.sum("n_tokens")).first()[0] or 0
        buckets, before = max(1, -(-places // BUCKET_PLACES)), len(staged())
        turns = min(TURNS, buckets)
        voted = [stage(_voted(_dealt(rows, buckets, turns, k)), "lm-voted", few=True) for k in range(turns)]
        gained = reduce(DataFrame.unionByName, voted).groupBy("key").agg(F.sum("units").cast("double").alias("units"))
        copies = rows.groupBy("key").agg(F.count("*").alias("rows"))
        gained = gained.join(copies, "key").select(F.col("key").alias("gain_key"), (F.col("units") / GAIN / F.col("rows")).alias("gain"))
        gained = stage(gained, "lm-gained", few=True)
        forget(docs.sparkSession, staged()[before:-1])
        gained = small(gained)
    out = rows.join(gained, F.col("key") == F.col("gain_key"), "left")
    log_prob = F.when(F.col("n_tokens") > 0, F.col("net") + F.coalesce("gain", F.lit(0.0))).otherwise(0.0)
    return out.select("doc_id", *[F.col("_others")[c].alias(c) for c in others], "n_tokens", log_prob.alias("log_prob"), F.when(F.col("n_tokens") > 0, log_prob / F.col("n_tokens")).alias("mean_log_prob"))


def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of all documents."""
    before = len(staged())
    docs = stage(tokenize(documents(spark, sf_dir).select("doc_id", "text")), "lm-tokens")
    return score(docs, fit(docs), staged()[before:]).select("doc_id", "n_tokens", "log_prob", "mean_log_prob")
