"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import give_back, kept, stored

#: Hash buckets as a power of two: weights and two sums for each, whatever the corpus.
BUCKETS = 20

#: Labelled rows that the model is fitted on, at most; those with the smallest hash.
TRAIN_ROWS = 16_000


@dataclass(frozen=True)
class Ftrl:
    """Per-coordinate rates ``alpha / (beta + sqrt(n))``; ``l1`` sets rare weights to zero."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.0
    epochs: int = 4


class Hasher:
    """Feature numbers of a text: words, stems, neighbouring and skipping pairs of words."""

    def __init__(self, bits: int = BUCKETS, room: int = 200_000):
        import re

        import xxhash

        self.word = re.compile(r"\w+")
        self.digest, self.bits, self.room = xxhash.xxh3_64_intdigest, bits, room
        self.known: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str) -> np.ndarray:
        known = self.known
        words = self.word.findall(text.lower())
        if len(known) > self.room:
            known.clear()
        for w in set(words).difference(known):
            known[w] = (self.digest(w), self.digest("stem " + w[:5]) if len(w) > 5 else self.digest(w))
        if not words:
            return np.zeros(0, dtype=np.int64)
        both = np.array([known[w] for w in words], dtype=np.uint64)
        one, stem = both[:, 0], both[:, 1]
        with np.errstate(over="ignore"):
            pair = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
            skip = one[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + one[2:]
            mixed = np.concatenate([one, stem, pair, skip]) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique(mixed >> np.uint64(64 - self.bits)).astype(np.int64)


def ftrl_weights(examples: list[tuple[np.ndarray, int]], bits: int, params: Ftrl) -> np.ndarray:
    """Weights after all epochs; the last entry is the bias, which has no penalty."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, params.l1)
    l1[size] = 0.0

    def current(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= l1[at], 0.0, (np.sign(own) * l1[at] - own) / (
            (params.beta + np.sqrt(n[at])) / params.alpha + params.l2))

    for _ in range(params.epochs):
        for features, label in examples:
            at = np.append(features.astype(np.int64), size)
            w = current(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            rise = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / params.alpha
            z[at] += g - rise * w
            n[at] += g * g
    return current(np.arange(size + 1))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        bits: int = BUCKETS, rows: int = TRAIN_ROWS, params: Ftrl = Ftrl()) -> np.ndarray:
    """Weights learnt from at most ``rows`` labelled documents that are not held out.

    Ids with a null label are left out; of repeated labels the larger counts. Features are
    made where the documents lie; one task then runs through the bounded sample in order
    of a hash, so reruns agree. Without labels all weights are 0.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(
        "_y is not null and _id is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = known.where(~held_out(F.col("_id"))).withColumn("_h", F.xxhash64("_id", F.lit(5))).orderBy("_h").limit(rows)
    met = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_t")).join(F.broadcast(chosen), "_id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = kept(("features", bits), lambda: Hasher(bits))
        for b in batches:
            made = [hasher(t.as_py()).astype("<u4").tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["h", "y", "f"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for b in batches:
            examples += [(np.frombuffer(f.as_py(), dtype="<u4"), y) for y, f in zip(b.column(1).to_pylist(), b.column(2))]
        w = ftrl_weights(examples, bits, params) if examples else np.zeros((1 << bits) + 1)
        at = np.flatnonzero(w)
        del examples
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<u4").tobytes()]), pa.array([w[at].tobytes()])], ["at", "w"])
        give_back()

    made = stored(met.select("_h", "_y", "_t").mapInArrow(featurise, "h long, y int, f binary"))
    got = made.repartition(1).sortWithinPartitions("h", "y", "f").mapInArrow(train, "at binary, w binary").collect()
    weights = np.zeros((1 << bits) + 1)
    for row in got:
        weights[np.frombuffer(row["at"], dtype="<u4")] = np.frombuffer(row["w"])
    return weights


def toxicity(spark, weights: np.ndarray, text: Column, bits: int = BUCKETS) -> Column:
    """Score of a text, 0 to 1; null and empty texts get the score of the bias alone."""
    held = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher, w = kept(("features", bits), lambda: Hasher(bits)), held.value
        for part in texts:
            sums = np.array([w[hasher(t or "")].sum() for t in part], dtype=np.float64) + w[-1]
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -35, 35))))
        give_back()

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, whole texts; ids may repeat or be null.

    Only the text enters a score. A null id counts as held out. Empty tables give no rows.
    """
    weights = fit(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                         toxicity(docs.sparkSession, weights, F.col(text_col).cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
