"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of neighbouring pairs
and of pairs with one word between, words being letters, digits and anything
beyond ASCII, A-Z lower-cased. Training visits a bounded sample of labelled
documents in one task, with a learning rate per coordinate; the L1 term leaves
few weights other than 0, and those go to every scoring task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import blocks as B
from graphloom.runtime import prepare

BITS = 20
#: Labelled documents that training visits at most; the least hashes of doc_id are taken.
MAX_TRAIN = 16_000
#: Features in fewer examples get no weight; they would only memorise a text.
MIN_DF = 4
#: Examples visited in all; every example is visited 4 to 20 times.
VISITS = 64_000
ALPHA = 5.0
BETA = 1.0
L1 = 6.0
L2 = 0.0
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """Weights other than 0 by feature, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.weight
        return out


def features(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a block's texts, and the text of each; repeats included."""
    w = B.words(block, inside=B.ALNUM, fold=B.FOLD)
    h, doc = w.hash, w.doc
    parts, docs = [h], [doc]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            near = doc[:-gap] == doc[gap:]
            parts.append(B.mix(h[:-gap][near] * B.U(salt) + h[gap:][near]))
            docs.append(doc[:-gap][near])
    return (np.concatenate(parts) >> B.U(64 - BITS)).astype(np.int64), np.concatenate(docs)


def _fit(examples: list[tuple[np.ndarray, int]]) -> Model:
    size = 1 << BITS
    seen = np.zeros(size, np.int64)
    for index, _ in examples:
        seen[index] += 1
    examples = [(index[seen[index] >= MIN_DF], y) for index, y in examples]
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    bias = np.array([size])

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        l1 = np.where(i == size, 0.0, L1)
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(min(20, max(4, VISITS // max(1, len(examples))))):
        for index, y in examples:
            i = np.concatenate([index, bias])
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    keep = np.flatnonzero(w[:size])
    return Model(keep, w[keep].astype(np.float32), float(w[size]))


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Fit on labelled documents for which ``usable`` holds.

    Null labels and labels without a document are passed over. A ``doc_id`` is
    one example however often it stands in either table: of several labels the
    least counts, of several texts the least, so at most ``max_train`` texts
    reach the one training task. Examples are visited in the order of a hash of
    their ids. Null and empty texts are examples without features; long texts
    are taken whole. Without examples the model scores 0.5 for every text.
    Columns of any other name are not read.
    """
    prepare(docs.sparkSession)
    chosen = labels.where(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_y"))
    chosen = chosen.groupBy("doc_id").agg(F.min("_y").alias("_y")).withColumn("_o", F.xxhash64("doc_id")).orderBy("_o", "doc_id").limit(max_train)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, np.ndarray]] = []
        for batch in batches:
            order, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for block in B.blocks(batch.column(2)):
                f, d = features(block)
                pair = np.unique(d * (1 << BITS) + f)
                cut = np.searchsorted(pair >> BITS, np.arange(block.n + 1))
                for k in range(block.n):
                    at = block.row + k
                    rows.append((order[at], y[at], (pair[cut[k] : cut[k + 1]] & ((1 << BITS) - 1)).astype(np.int32)))
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        model = _fit([(f.astype(np.int64), y) for _, y, f in rows])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(model.index, -1).astype(np.int64)), pa.array(np.append(model.weight, model.bias).astype(np.float64))], ["i", "w"]
        )

    # at most max_train rows of two numbers
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_o", "_y").agg(F.min("text").alias("text")).select("_o", "_y", "text")
    got = sample.repartition(1).mapInArrow(fit, "i long, w double").toArrow()
    i, w = got["i"].to_numpy(), got["w"].to_numpy()
    own = i >= 0
    return Model(i[own], w[own].astype(np.float32), float(w[~own].sum()))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs``; null texts score as empty ones."""
    prepare(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for batch in batches:
            total = [np.zeros(0)]
            for block in B.blocks(batch.column(1)):
                f, d = features(block)
                hit = dense[f] != 0
                pair = np.unique(d[hit] * (1 << BITS) + f[hit])
                total.append(np.bincount(pair >> BITS, weights=dense[pair & ((1 << BITS) - 1)], minlength=block.n))
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(total) + model.bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, score double, predicted int")


def held_out() -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Scores of all documents by a model that never saw the labels of the held-out third.

    One row for each row of ``docs``, repeated ones alike; an empty table gives
    none, and empty labels a score of 0.5 throughout. A null ``doc_id`` is not
    held out, and has no label.
    """
    model = train(docs, labels, ~held_out(), max_train=max_train)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
