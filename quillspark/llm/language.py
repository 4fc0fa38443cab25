"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. For each bit a linear classifier over hashed byte n-grams
(square roots of relative counts of the lower-cased text without punctuation and digits) learns by
regularised least squares whether a text's language has that bit set. A text's bit margins are
compared with every codeword by the summed hinge loss; the nearest codeword wins, the score is its
share in a softmax over negative losses, and a lead under AMBIGUOUS marks the text as ambiguous.

Codewords: all distinct splits of the languages for up to EXHAUSTIVE languages, else the best of
TRIES seeded random codes by least distance, whose length grows with the logarithm of the number of
languages. Every language is learnt: from LEARNT texts at most, or ALL / languages where that is
fewer, but from one in any case, those with the smallest hash of id and text, plus short pieces of
them. So what reaches the driver is bounded by ALL, or by one text for each language.

Defined results: texts that are null or have no letter are `und` with score 0; ties go to the
language first in order; with one learned language every other text is that one; with none all are
`und`; other columns are kept, clashing output columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window as W

from .features import ngram_counts, pack, unit, unpack
from .shared import crc_of, documents, map_texts, materialize, text_batches

#: Texts of each language that are learnt from at most, and of all (but one of each language in any case).
LEARNT, ALL = 150, 4000
BITS, SIZES = 12, (1, 2, 3, 4)
EXHAUSTIVE, TRIES = 7, 200
#: Characters of the short pieces of each learnt text that are learnt from as well.
PIECES = (20, 60, 200)
RIDGE, STEEP, AMBIGUOUS = 0.003, 6.0, 0.2
#: Numbers that decoding holds at once.
MOST = 1 << 22
FOLDS, HELD_OUT = 4, 2

_LETTER = regex.compile(r"\p{L}")
_DROP = bytes(range(33, 65)) + bytes(range(91, 97)) + bytes(range(123, 128))
_BLANK = bytes.maketrans(bytes(range(33)), b" " * 33)


def held_out(doc_id: Column) -> Column:
    return crc_of(doc_id) % FOLDS == HELD_OUT


def counts(text: str) -> np.ndarray:
    return ngram_counts(b" " + text.lower().encode().translate(_BLANK, _DROP) + b" ", SIZES, BITS)


def vector(tf: np.ndarray) -> np.ndarray:
    return unit(np.sqrt(tf))


def codewords(languages: int) -> np.ndarray:
    """A row of -1 and 1 for each language; columns are distinct splits, none constant."""
    if languages < 2:
        return np.ones((languages, 1), np.float32)
    if languages <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (languages - 1))
        rows = [np.ones(len(splits), int), *((splits >> k & 1) ^ 1 for k in range(languages - 1))]
        return (2 * np.array(rows) - 1).astype(np.float32)
    rng, best, far = np.random.default_rng(11), None, -1
    for _ in range(TRIES if languages <= 500 else 1):  # long codes are far apart by themselves
        code = rng.choice(np.array([-1, 1], np.float32), (languages, int(np.ceil(12 * np.log2(languages)))))
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(languages) * code.shape[1]
        if apart.min() > far:
            best, far = code, apart.min()
    return best


@dataclass
class Codes:
    names: list[str]
    words: np.ndarray  # [languages, bits]
    weights: np.ndarray  # [buckets, bits]
    bias: np.ndarray

    def decode(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, score and lead over the next one."""
        margin = vector(tf) @ self.weights + self.bias
        loss = np.empty((len(tf), len(self.words)), np.float32)
        step = max(1, MOST // max(1, margin.size))  # codewords at a time
        for k in range(0, len(self.words), step):
            loss[:, k : k + step] = np.maximum(0, 1 - margin[:, None, :] * self.words[None, k : k + step]).mean(axis=2)
        chance = np.exp(-STEEP * (loss - loss.min(axis=1, keepdims=True)))
        chance /= chance.sum(axis=1, keepdims=True)
        ordered = np.sort(chance, axis=1)
        lead = ordered[:, -1] - (ordered[:, -2] if ordered.shape[1] > 1 else 0)
        return loss.argmin(axis=1), np.clip(ordered[:, -1].astype(np.float64), 0, 1), lead


def fit(tf: np.ndarray, names: list[str]) -> Codes:
    known = sorted(set(names))
    words = codewords(len(known))
    if not known:
        return Codes([], words, np.zeros((1 << BITS, 1), np.float32), np.zeros(1, np.float32))
    y = words[np.searchsorted(known, names)].astype(np.float64)
    weight = np.sqrt(len(names) / len(known) / np.array([names.count(n) for n in known]))[np.searchsorted(known, names)][:, None]
    x = vector(tf)
    middle, bias = (weight.T**2 @ x)[0] / (weight**2).sum(), (y * weight**2).sum(0) / (weight**2).sum()
    x, y = ((x - middle) * weight).astype(np.float32), (y - bias) * weight
    if len(x) <= x.shape[1]:
        w = x.T @ np.linalg.solve(x @ x.T + RIDGE * len(x) / len(known) * np.eye(len(x)), y)
    else:
        w = np.linalg.solve(x.T @ x + RIDGE * len(x) / len(known) * np.eye(x.shape[1]), x.T @ y)
    return Codes(known, words, w.astype(np.float32), (bias - middle @ w).astype(np.float32))


def pieces(text: str) -> list[str]:
    """The text and some of its short parts."""
    found = [text]
    for k, size in enumerate(PIECES):
        if len(text) > 2 * size:
            at = (len(text) - size) * (k + 1) // (len(PIECES) + 1)
            found.append(text[at : at + size])
    return [t for t in found if _LETTER.search(t)]


def train(docs: DataFrame, limit: int = LEARNT) -> Codes:
    """Learns from text and lang of the rows given, by a bounded sample of each language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # One row for each language.
    sizes = materialize(known.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n")), "languages")
    limit = max(1, min(limit, ALL // max(1, sizes.count())))
    # By id and text: ids may be null or stand for many rows.
    name = F.concat(F.lit("lang:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.xxhash64("text").cast("string"))
    # Enough hash range for the limit, so that the window sees few rows of a hot language; where
    # a language is small, all its rows are looked at.
    share = F.when(F.col("n") > 30 * limit, 3.0 * limit / F.col("n")).otherwise(1.0)
    few = known.withColumn("place", F.crc32(name.cast("binary"))).join(sizes, F.col("lang") == F.col("of")).filter(F.col("place") < share * (1 << 32))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("place", "doc_id", F.xxhash64("text")))
    few = few.select("lang", "text", nth.alias("nth")).filter(F.col("nth") <= limit)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_batches(batches):
            made = [(lang, pack(counts(t))) for lang, text in zip(piece.column(0).to_pylist(), texts, strict=True) for t in pieces(text)]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.binary())], names=["lang", "counts"])

    kinds = StructType([StructField("lang", StringType()), StructField("counts", BinaryType())])
    rows = map_texts(few.select("lang", "text"), step, kinds).collect()
    rows = sorted((r[0], bytes(r[1])) for r in rows)
    return fit(unpack([r[1] for r in rows], 1 << BITS), [r[0] for r in rows])


def identify(docs: DataFrame, codes: Codes, column: str = "text") -> DataFrame:
    """Adds lang_pred, score and ambiguous."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        for piece, texts in text_batches(batches, column):
            names, scores, doubts = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
            full = [i for i, t in enumerate(texts) if _LETTER.search(t)] if codes.names else []
            for k in range(0, len(full), 256):
                part = full[k : k + 256]
                best, score, lead = codes.decode(np.stack([counts(texts[i]) for i in part]))
                for i, b, s, x in zip(part, best.tolist(), score.tolist(), lead.tolist(), strict=True):
                    names[i], scores[i], doubts[i] = codes.names[b], s, x < AMBIGUOUS
            columns = [*piece.columns, pa.array(names), pa.array(scores), pa.array(doubts)]
            yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names, "lang_pred", "score", "ambiguous"])

    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())]
    return map_texts(docs, step, StructType([*docs.schema.fields, *added]))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    codes = train(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text"))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), codes).drop("text")
