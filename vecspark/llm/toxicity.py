"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents are labels; all others are unlabelled, toxic ones
among them.  With the share of toxic documents (the class prior), the risk of a
classifier on clean documents follows from its risks on unlabelled and on toxic
ones.  That difference cannot be negative in truth, so whenever a step makes it
negative by overfitting, the next step goes the other way.

The prior is a parameter, or estimated without negatives: above any threshold lie
at least as many of the unlabelled as the prior times the share of the toxic ones
there, so the least ratio of the two bounds it from above.

Features of a text are its distinct words and their first letters, hashed.
Linear classifiers are trained in numpy on the driver from a bounded sample;
the weights, of fixed size, are broadcast, and every whole text is scored where
it lies.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, held, in_arrow

FEATURES = 1 << 18
#: Letters of a word's beginning that make a feature.
STEM = 5
#: ASCII characters that part words, besides white space.
PARTING = bytes(32 if chr(k) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789" else k for k in range(256))
WORDS_KEPT = 200_000
#: Share of toxic texts that the query and the pipeline assume for any table.
PRIOR = 0.1


def words(text: str) -> set[bytes]:
    return set(text.lower().encode().translate(PARTING).split())


def word_features(word: bytes) -> tuple[int, int]:
    """Features of a word: itself, and its first letters."""
    stem = word.decode("utf-8", "ignore")[:STEM].encode()
    return xxhash.xxh3_64_intdigest(word) % FEATURES, xxhash.xxh3_64_intdigest(stem, 1) % FEATURES


def features(text: str) -> np.ndarray:
    return np.array(sorted({f for w in words(text) for f in word_features(w)}), np.int32)


@dataclass
class Model:
    """Weights and intercepts of some linear classifiers."""

    weights: np.ndarray
    bias: np.ndarray

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(-np.clip(logits + self.bias, -30, 30)))).mean(-1)


def _rates(rows: list[np.ndarray]) -> np.ndarray:
    return np.bincount(np.concatenate(rows), minlength=FEATURES) / len(rows) if rows else np.zeros(FEATURES)


def train(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, kept: int = 4096, models: int = 3, steps: int = 400, rate: float = 0.05, decay: float = 1e-4, seed: int = 1) -> Model:
    """Classifiers of least non-negative PU risk under the logistic loss.

    Features count that are more frequent in toxic than in unlabelled texts, or
    less so, by more than chance explains.  Each classifier sees a random four
    fifths of both samples.  Without toxic texts every score is the prior.
    """
    prior = min(max(prior, 1e-4), 0.99)
    none = Model(np.zeros((FEATURES, 1), np.float32), np.array([math.log(prior / (1 - prior))]))
    if not toxic or not unlabelled:
        return none
    p, u = _rates(toxic), _rates(unlabelled)
    spread = np.sqrt(np.maximum(u * (1 - u), 1 / len(unlabelled)) * (1 / len(toxic) + 1 / len(unlabelled)))
    lift = np.abs(p - u) / spread
    lift[(p * len(toxic) < 3) & (u * len(unlabelled) < 10)] = 0
    chosen = np.sort(np.argsort(-lift, kind="stable")[:kept])
    chosen = chosen[lift[chosen] > 4]
    if not len(chosen):
        return none
    column = np.full(FEATURES, -1)
    column[chosen] = np.arange(len(chosen))

    def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        columns = column[np.concatenate(rows)]
        return at[columns >= 0], columns[columns >= 0]

    (tr, tc), (ur, uc) = sparse(toxic), sparse(unlabelled)
    weights, bias, chance = np.zeros((FEATURES, models), np.float32), np.zeros(models), np.random.default_rng(seed)
    for m in range(models):
        tw = (chance.random(len(toxic)) < 0.8).astype(float)
        uw = (chance.random(len(unlabelled)) < 0.8).astype(float)
        tw, uw = tw / max(tw.sum(), 1), uw / max(uw.sum(), 1)
        w = np.zeros(len(chosen) + 1)
        w[-1] = none.bias[0]
        mean, square = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            zt = np.bincount(tr, w[tc], len(toxic)) + w[-1]
            zu = np.bincount(ur, w[uc], len(unlabelled)) + w[-1]
            st, su = 1 / (1 + np.exp(-zt)), 1 / (1 + np.exp(-zu))
            clean_risk = uw @ np.logaddexp(0, zu) - prior * (tw @ np.logaddexp(0, zt))
            if clean_risk >= 0:
                gt, gu = prior * tw * (st - 1) - prior * tw * st, uw * su
            else:  # only undo the overfitting
                gt, gu = prior * tw * st, -uw * su
            g = np.append(np.bincount(tc, gt[tr], len(chosen)) + np.bincount(uc, gu[ur], len(chosen)), gt.sum() + gu.sum())
            g[:-1] += decay * w[:-1]
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            w -= rate * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights[chosen, m], bias[m] = w[:-1], w[-1]
    return Model(weights, bias)


def risk(zt: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """Risk on toxic texts, and that on clean ones, from logits of toxic and unlabelled texts (logistic loss)."""
    return prior * np.logaddexp(0, -zt).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zt).mean()


def estimated_prior(toxic: list[np.ndarray], unlabelled: list[np.ndarray], least: float = 0.3, nominal: float = 0.1, fewest: int = 60) -> float:
    """Share of toxic texts among the unlabelled ones.

    Every second text of both samples trains a classifier for a nominal prior;
    the others are scored.  Thresholds are those above which ``least`` or more
    of the toxic ones lie.  Without toxic texts it is 0; with fewer than
    ``fewest`` of them, or where the classifier tells nothing apart, the nominal
    prior stays.  It is below half: a larger one has to be given.
    """
    if not toxic or not unlabelled:
        return 0.0
    if len(toxic) < fewest:
        return nominal
    model = train(toxic[::2], unlabelled[::2], nominal, models=1, steps=200)
    p, u = (model.scores(np.array([model.weights[f].sum(0, dtype=np.float64) for f in rows[1::2]])) for rows in (toxic, unlabelled))
    cuts = np.quantile(p, np.linspace(0, 1 - least, 20))
    found = float(min((u >= c).mean() / (p >= c).mean() for c in cuts))
    return found if found < 0.5 else nominal


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 4000, most_unlabelled: int = 16000, prior: float | None = None) -> Model:
    """Train on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    At most ``most_toxic`` confirmed toxic and ``most_unlabelled`` other rows of
    ``labels`` are used, the first by a hash of their ids; only their hashed
    features reach the driver.  What the label of the unlabelled sample says is
    not looked at.  ``prior``, if not given, is estimated from the two samples,
    which errs upwards.
    Rows with null ids or texts teach nothing; of an id's texts, the one of the
    least hash counts.
    """
    known = labels.select("doc_id", "toxic").where("doc_id is not null")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic = known.where("toxic = 1").select("doc_id").distinct().orderBy(*order).limit(most_toxic)
    unlabelled = known.select("doc_id").distinct().orderBy(*order).limit(most_unlabelled)
    sample = unlabelled.withColumn("part", F.lit("u")).union(toxic.withColumn("part", F.lit("t")))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    #: one text of an id: tasks take theirs before the shuffle, so a repeated id neither stands in one task nor reaches the driver
    rows = rows.groupBy("part", "doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x")).select("part", "x.text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array([features(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())], ["part", "features"])

    got = rows.transform(in_arrow, compute, "part string, features binary").toArrow()
    sides: dict[str, list[np.ndarray]] = {"t": [], "u": []}
    for part, found in sorted(zip(got.column("part").to_pylist(), got.column("features").to_pylist())):
        sides[part].append(np.frombuffer(found, np.int32))
    return train(sides["t"], sides["u"], estimated_prior(sides["t"], sides["u"]) if prior is None else prior)


def score(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """The documents with ``score`` (0 to 1) and ``predicted`` (1 if the score is at least 0.5), without ``text`` unless it is to be kept.

    Null texts are scored like empty ones: by the intercepts alone.  Other
    columns stay, except ones named like the new ones.  An empty table gives an
    empty result, and equal texts get equal scores.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    gone = {"score", "predicted"} | (set() if keep_text else {"text"})
    schema = T.StructType([f for f in docs.schema.fields if f.name not in gone] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        counts = model.weights.any(1)
        known: dict[bytes, tuple[int, ...]] = held("toxicity " + hashlib.sha256(model.weights.tobytes()).hexdigest(), dict)

        def telling(word: bytes) -> tuple[int, ...]:
            found = known.get(word)
            if found is None:
                found = tuple(f for f in word_features(word) if counts[f])
                if len(known) < WORDS_KEPT:
                    known[word] = found
            return found

        for batch in batches:
            logits = np.zeros((batch.num_rows, model.weights.shape[1]))
            for k, text in enumerate(batch.column("text")):
                found: set[int] = set()
                for word in words(text.as_py() or ""):
                    found.update(telling(word))
                if found:
                    logits[k] = model.weights[sorted(found)].sum(0, dtype=np.float64)
            scores = model.scores(logits)
            added = [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in schema.names[:-2]] + added, schema.names)

    return docs.transform(in_arrow, compute, schema)


def held_out(doc_id) -> F.Column:
    """True for the documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(docs, labels.where(~held_out(F.col("doc_id"))), prior=PRIOR)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, fitted(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
