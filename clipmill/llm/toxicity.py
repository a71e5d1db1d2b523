"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, word pairs and pairs with one word between, hashed to 2^22 coordinates.
The learner keeps z and n per coordinate: the rate of a coordinate falls with the gradients it has seen, and L1 keeps
a weight at zero until its evidence exceeds ``l1``, so a few thousand weights remain. They are sent to the tasks (at most 2^22).

The model is fitted on at most ``TRAIN_ROWS`` labelled documents (those with the smallest hashes of seed and id), which bounds the
one task that learns in order; everything else covers all documents. Whole texts are used in both.

Null and empty texts have no features and get the score of the bias alone. Rows without a label, or with a null one, are not learnt from;
of several labels of an id the largest counts. Repeated rows are scored each for itself; a row with a null id is not
held out. Without any training row all scores are 0. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmill.llm.words import MARKS, mix, pieces, words
from clipmill.session import stored

BITS, TRAIN_ROWS, FOLDS, EPOCHS = 22, 20_000, 5, 4
BIAS = 0


@dataclass
class Ftrl:
    """FTRL-proximal with per-coordinate rates; coordinate ``BIAS`` carries the intercept and is free of L1."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0

    def __post_init__(self):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at) -> np.ndarray:
        z, free = self.z[at], np.asarray(at) == BIAS
        over = np.abs(z) - np.where(free, 0.0, self.l1)
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + np.where(free, 0.0, self.l2)
        return np.where(over > 0, -np.sign(z) * over / rate, 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One document: ``at`` are its distinct coordinates."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def features(column) -> tuple[np.ndarray, np.ndarray, int]:
    """(coordinate, text) of every word, pair and skip pair of a piece of a batch, repeats included."""
    w = words(column, lower=True, blank=MARKS)
    h, doc, n = w.hashes(), w.doc.astype(np.uint32), len(w.counts)
    out, owner = [mix(h + np.uint64(1))], [doc]
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap] if len(h) > gap else np.zeros(0, bool)
        if len(same):
            out.append(mix(h[:-gap][same] * np.uint64(0x9E3779B97F4A7C15) + h[gap:][same] + np.uint64(gap)))
            owner.append(doc[:-gap][same])
    at = np.concatenate(out) >> np.uint64(64 - BITS)
    return np.maximum(at, 1).astype(np.int64), np.concatenate(owner), n


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, seed: str) -> DataFrame:
    """(place, label, text) of the sample, at most ``rows``."""
    known = labels.select(F.col("doc_id").alias("of"), F.col(label_col).cast("int").alias("label")).filter("label is not null and of is not null")
    known = known.groupBy("of").agg(F.max("label").alias("label")).filter(~held_out(F.col("of")))
    chosen = known.withColumn("place", F.xxhash64(F.lit(seed), "of")).orderBy("place", "of").limit(rows)
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("place", "label", "text")


def train(sample: DataFrame, epochs: int = EPOCHS, **params) -> DataFrame:
    """(coordinate, weight) of all weights that are not zero; ``sample`` is bounded, one task learns from it in order."""

    def to_features(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                at, owner, n = features(part.column(2))
                key = np.unique(owner.astype(np.int64) << BITS | at)
                sizes = np.bincount(key >> BITS, minlength=n)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array((key & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["place", "label", "at"])

    def learn(batches):
        model, rows = Ftrl(**params), []
        for batch in batches:
            lists = batch.column(2)
            rows += [(y, lists[k].values.to_numpy()) for k, y in enumerate(batch.column(1).to_pylist())]
        for _ in range(epochs):
            for label, at in rows:
                model.learn(np.append(at, BIAS), label)
        used = np.flatnonzero(model.z)
        w = model.weights(used)
        yield pa.RecordBatch.from_arrays([pa.array(used[w != 0].astype(np.int32)), pa.array(w[w != 0])], names=["at", "weight"])

    made = sample.mapInArrow(to_features, "place long, label int, at array<int>")
    return made.repartition(1).sortWithinPartitions("place").mapInArrow(learn, "at int, weight double")


def score(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with their scores: doc_id, score."""
    rows = weights.toPandas()
    sent = docs.sparkSession.sparkContext.broadcast((rows["at"].to_numpy(np.int64), rows["weight"].to_numpy(np.float64)))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        at, weight = sent.value
        table = np.zeros(1 << BITS)
        table[at] = weight
        used, bias = table != 0, table[BIAS]
        trained = len(at) > 0
        for batch in batches:
            for part in pieces(batch, "text"):
                found, owner, n = features(part.column(1))
                hit = np.flatnonzero(used[found])
                key = np.unique(owner[hit].astype(np.int64) << BITS | found[hit])
                total = np.bincount(key >> BITS, table[key & ((1 << BITS) - 1)], minlength=n) + bias
                value = 1 / (1 + np.exp(-np.clip(total, -30, 30))) if trained else np.zeros(n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def score_with_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      label_col: str = "toxic", rows: int = TRAIN_ROWS, seed: str = "toxicity", **params) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    weights = stored(train(training_rows(plain, labels, label_col, rows, seed), **params), "toxicity-weights")
    return score(plain, weights).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
