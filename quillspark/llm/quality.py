"""Quality by nearest neighbours in a latent-semantic space.

Labelled texts become vectors of hashed byte 2-grams and 3-grams and of word repetition (log counts
times inverse document frequency), a truncated singular value decomposition maps them to DIMS dimensions, and those unit
vectors are broadcast with their labels: LABELLED rows at most, whatever the corpus holds, chosen
by a hash of the id. Every document is mapped the same way; its cosines with all labelled vectors
are computed as exact blocked matrix products, and the NEIGHBOURS largest vote with weights
that grow with the cosine. A score is the weighted share of label 1.

Defined results: null and empty texts have no vector and get the labels' mean; texts that equal a
labelled one are scored like any other; of repeated label rows of a document the largest counts; an empty label table
gives 0.5 to everything; other columns are kept, clashing `score` and `predicted` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from .features import ngram_counts, pack, unit, unpack
from .shared import crc_of, documents, map_texts, text_batches

#: Labelled rows that are learnt from at most; bounds the broadcast to LABELLED * DIMS floats.
LABELLED = 4096
BITS, DIMS, NEIGHBOURS, SHARPNESS = 12, 64, 15, 20.0
SIZES = (2, 3)
REPEATS = 16
TERMS = (1 << BITS) + REPEATS
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0


def held_out(doc_id: Column) -> Column:
    return crc_of(doc_id) % FOLDS == HELD_OUT


def counts(text: str) -> np.ndarray:
    """n-gram counts, then REPEATS terms for the share of words that repeat the word before them:
    the k-th is there if the share is k / REPEATS or more."""
    words = text.split()
    same = sum(map(eq, words, words[1:])) / len(words) if words else 0
    repeats = np.where(np.arange(1, REPEATS + 1) <= same * REPEATS, np.float32(1000), np.float32(0))
    return np.concatenate([ngram_counts(text.encode(), SIZES, BITS), repeats])


@dataclass
class Space:
    idf: np.ndarray
    basis: np.ndarray  # [TERMS, DIMS]
    vectors: np.ndarray  # [labelled, DIMS]
    labels: np.ndarray

    def place(self, tf: np.ndarray) -> np.ndarray:
        return unit(unit(np.log1p(tf) * self.idf) @ self.basis)

    def vote(self, tf: np.ndarray) -> np.ndarray:
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(tf), prior)
        near = self.place(tf) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.exp(SHARPNESS * (np.take_along_axis(near, top, 1) - 1)).astype(np.float64)
        score = (weight * self.labels[top]).sum(1) / weight.sum(1)
        return np.where(tf.any(axis=1), score, prior)


def fit(tf: np.ndarray, labels: np.ndarray) -> Space:
    if not len(labels):
        return Space(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels.astype(np.float64))
    df = (tf > 0).sum(0)
    idf = np.log((1 + len(tf)) / (1 + df)).astype(np.float32) + np.float32(0.1)
    x = unit(np.log1p(tf) * idf)
    dims = min(DIMS, *x.shape)
    # Randomised range finder with a fixed seed, then the small decomposition.
    q = x.T @ np.random.default_rng(7).standard_normal((len(x), min(dims + 16, len(x)))).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(q)[0]
        q = x.T @ (x @ q)
    q = np.linalg.qr(q)[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    basis = np.ascontiguousarray((q @ vt.T)[:, :dims]).astype(np.float32)
    space = Space(idf, basis, np.zeros((0, dims), np.float32), labels.astype(np.float64))
    space.vectors = space.place(tf)
    return space


def gather(texts: DataFrame, label: str) -> tuple[np.ndarray, list]:
    """Counts of few texts, made on the executors, and their labels."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, strings in text_batches(batches):
            made = [pack(counts(t)) for t in strings]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), piece.column(1)], names=["counts", "label"])

    kinds = StructType([StructField("counts", BinaryType()), StructField("label", texts.schema[label].dataType)])
    rows = map_texts(texts.select("text", F.col(label).alias("label")), step, kinds).collect()
    rows.sort(key=lambda r: (r[1], bytes(r[0])))  # tasks end in any order
    return unpack([bytes(r[0]) for r in rows], TERMS), [r[1] for r in rows]


def train(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Space:
    """Learns from `limit` labelled documents at most; give it training folds only."""
    picked = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = picked.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(limit)
    # A repeated doc_id gives its first text in order, so that reruns learn from the same rows.
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    data, marks = gather(texts.select("text", "quality"), "quality")
    return fit(data, np.array(marks, dtype=np.float64))


def score_quality(docs: DataFrame, space: Space, threshold: float = THRESHOLD, column: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds the score and the prediction under `names`."""
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for piece, texts in text_batches(batches, column):
            score = np.concatenate([space.vote(np.stack([counts(t) for t in texts[i : i + 256]])) for i in range(0, len(texts), 256)])
            columns = [*piece.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names, *names])

    return map_texts(docs, step, StructType([*docs.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], IntegerType())]))


def quality_space(spark: SparkSession, sf_dir: str) -> Space:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train(documents(spark, sf_dir), labels.filter(~held_out(F.col("doc_id"))))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return score_quality(docs, quality_space(spark, sf_dir)).drop("text")
