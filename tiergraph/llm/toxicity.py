"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are a text's distinct words, pairs of neighbours, and pairs with one word
between them, hashed into 2^BITS places. FTRL-proximal gives every coordinate its own
learning rate and drives rare, uninformative ones to exactly zero by its L1 term, so
the weights that matter are a few thousand numbers, which travel with the task.

Training takes at most ``max_train`` labelled rows, those with the least hash of
their id: a bounded, documented sample. One task learns from them as a stream, a pass
for each epoch in an order of its own, so it holds a coordinate table and one batch,
however long the texts are; only weights other than 0 come to the driver, 2^BITS at
most. Scoring takes every whole text.

Defined results: a null or empty text has no features and gets the score of the
intercept; labels that are null don't count; an id with labels of both kinds counts
once for each; of rows that repeat an id the least text is learnt from (null before any);
without any labels every score is 0.5; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.llm._common import bounded_batches, write_scratch
from tiergraph.llm._shingles import mix64

BITS = 20
MAX_TRAIN = 12_000
_TOKEN = re.compile(r"[^\W_]+")
_PAIR, _SKIP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


class _Tokens(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        found = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[token] = found
        return found


def features(text: str | None, tokens: dict) -> np.ndarray:
    """The places of a text's features, with repeats."""
    found = _TOKEN.findall((text or "").lower())
    w = np.fromiter(map(tokens.__getitem__, found), np.uint64, len(found))
    pairs = mix64(w[:-1] * _PAIR + w[1:])
    skips = mix64(w[:-2] * _SKIP + w[2:])
    return (np.concatenate([w, pairs, skips]) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """The state of FTRL-proximal. The intercept has a rate of its own and no penalty."""

    def __init__(self, *, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias, self.bias_n = 0.0, 0.0

    def weights_at(self, places: np.ndarray) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, places: np.ndarray, label: int) -> None:
        """One row: its distinct places, and its label."""
        w, n = self.weights_at(places), self.n[places]
        g = 1 / (1 + np.exp(-np.clip(self.bias + w.sum(), -35, 35))) - label
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[places] = n + g * g
        self.bias_n += g * g
        self.bias -= 0.1 * g / (1 + np.sqrt(self.bias_n))

    def weights(self) -> tuple[float, dict[int, float]]:
        """(intercept, weights other than 0)."""
        kept = np.flatnonzero(np.abs(self.z) > self.l1)
        return self.bias, dict(zip(kept.tolist(), self.weights_at(kept).tolist(), strict=True))


def train_ftrl(rows: list[tuple[np.ndarray, int]], *, epochs: int = 5, seed: int = 7, **rates) -> tuple[float, dict[int, float]]:
    """(intercept, weights other than 0) from (distinct places, label) rows that fit into memory."""
    state, order = Ftrl(**rates), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            state.learn(*rows[i])
    return state.weights()


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = _Tokens()
    for batch in batches:
        places = [np.unique(features(x.as_py(), tokens)).astype(np.int32).tobytes() for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(places, pa.binary()), batch.column("label")], ["id", "places", "label"])


def _learnt(rates: dict[str, float]):
    """Rows in order -> (place, weight); the intercept's place is -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, any_row = Ftrl(**rates), False
        for batch in batches:
            for places, label in zip(batch.column("places"), batch.column("label"), strict=True):
                state.learn(np.frombuffer(places.as_py(), np.int32).astype(np.int64), label.as_py())
                any_row = True
        if any_row:
            bias, weights = state.weights()
            yield pa.RecordBatch.from_arrays([pa.array([-1, *weights], pa.int32()), pa.array([bias, *weights.values()], pa.float64())], ["place", "weight"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, epochs: int = 5, seed: int = 7, **rates) -> tuple[float, dict[int, float]]:
    """(intercept, weights other than 0), learnt from at most ``max_train`` labelled documents."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    sample = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct().orderBy(F.xxhash64(F.col("id").cast("string")), "id", "label").limit(max_train)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # max_train rows of two numbers
    rows = texts.groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label").mapInArrow(_featurised, f"id {kind}, places binary, label int")
    #: A pass is a copy of the rows, in the order of a hash of its own. All go to one task, which keeps none of them.
    passes = write_scratch(rows, "training").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    order = passes.withColumn("turn", F.xxhash64(F.lit(seed), "epoch", F.col("id").cast("string"), "label"))
    found = order.coalesce(1).sortWithinPartitions("epoch", "turn", "id", "label").select("places", "label").mapInArrow(_learnt(rates), "place int, weight double").collect()
    weights = {r.place: r.weight for r in found}
    return weights.pop(-1, 0.0), dict(sorted(weights.items()))


def _scored(bias: float, weights: dict[int, float]):
    kept = np.array(sorted(weights), np.int64)
    values = np.array([weights[k] for k in kept.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tokens = np.zeros(1 << BITS), _Tokens()
        table[kept] = values
        for batch in batches:
            scores = []
            for x in batch.column("text"):
                places = features(x.as_py(), tokens)
                hit = np.unique(places[table[places] != 0])
                scores.append(float(1 / (1 + np.exp(-np.clip(bias + table[hit].sum(), -35, 35)))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], ["id", "score"])

    return run


def score(docs: DataFrame, model: tuple[float, dict[int, float]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scored(*model), f"id {kind}, score double").withColumnRenamed("id", id_col)
