"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, table, tidy
from .textcols import chain, text_chunks, tokens

#: Labelled rows used for training at most, those with the smallest hash of doc_id; the bound of the only sample taken.
MAX_TRAIN = 12_000
BITS = 18
ORDERS = (1, 2)
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.001, 0.1
SCORE = "quality_score"


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # 2 ** BITS values and the bias

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        z = self.weights[index] @ value + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def features(column: pa.Array, bits: int = BITS, orders=ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A sparse unit vector for each text: slots and log counts. A text without words gives an empty one."""
    for at, end, buf, offsets in text_chunks(column):
        words, bounds = tokens(buf, offsets, lower=False, split_punct=True)
        for i in range(end - at):
            own = words[bounds[i] : bounds[i + 1]]
            slots = np.concatenate([chain(own, n) for n in orders]) >> np.uint64(64 - bits)
            index, count = np.unique(slots.astype(np.int64), return_counts=True)
            value = np.log1p(count)
            norm = np.sqrt(value @ value)
            yield index, value / norm if norm else value


def ftrl(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Per-coordinate FTRL-proximal with L1 and L2; the bias is an input that is always 1."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def solve(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for (index, value), y in zip(examples, labels, strict=True):
            index, value = np.append(index, size - 1), np.append(value, 1.0)
            zi, ni = z[index], n[index]
            w = solve(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - y) * value
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[index] = ni + g * g
    return solve(z, n)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fits on labelled rows whose crc32(doc_id) mod 3 is not 1.

    Labels other than 0 and 1 and null ids are ignored; of several labels
    of a document the lowest counts. Without labelled rows every weight
    is 0 and every score one half. At most max_train documents are
    used, of rows that share an id the one with the smallest text: their ids are picked first, so only their texts move, to one task.
    """
    ids = (
        labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(crc_mod(F.col("doc_id"), 3) != 1)
        .groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")

    def fit(batches):
        examples, targets = [], []
        for b in batches:
            examples += [(i.astype(np.int32), v.astype(np.float32)) for i, v in features(b.column("text"))]
            targets.append(b.column("label").to_numpy())
        if examples:
            yield pa.RecordBatch.from_pydict({"weights": pa.array([ftrl(examples, np.concatenate(targets)).tobytes()], pa.binary())})

    got = rows.select("text", "label").mapInArrow(tidy(fit), "weights binary").collect()
    return Model(np.frombuffer(got[0]["weights"]) if got else np.zeros((1 << BITS) + 1))


def classify(docs: DataFrame, model: Model, least: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (or only its columns `keep`) plus quality_score in [0, 1]; with `least`, only rows that reach it.

    Every row is scored from its own text alone: repeated rows agree, null
    and empty texts get the bias, an empty table stays empty, and a
    column of that name is replaced. The weights sent to executors have a fixed size.
    """
    docs = docs.drop(SCORE)
    keep = docs.columns if keep is None else keep
    docs = docs.select(*dict.fromkeys([*keep, "text"]))
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(SCORE, T.DoubleType())])

    def score(batches):
        m = Model(shared.value)
        for b in batches:
            s = np.fromiter((m.score(i, v) for i, v in features(b.column("text"))), float, b.num_rows)
            out = b.select(keep).append_column(SCORE, pa.array(s))
            yield out if least is None else out.filter(pa.array(s >= least))

    return docs.mapInArrow(tidy(score), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = classify(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= 0.5).cast("int").alias("predicted"))
