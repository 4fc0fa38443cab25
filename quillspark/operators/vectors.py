"""Approximate nearest neighbours by cells, with recall that is measured.

Centroids are learnt on a bounded sample (SAMPLE vectors with the smallest hash of their id); every
vector of the corpus belongs to the cell of its nearest centroid and is kept there as one signed byte
for each dimension, beside the vector. A query looks into the `beam` cells whose centroids are nearest to it.
Codes of those cells are scored; what their rounding (whose length each row keeps) leaves open is
scored with the vectors themselves in the same task, and the best k are its result. The exact way is
retrieval.dense_top_k; with as many cells in the beam as there are, the two agree.

A cell of more than BLOCK vectors is cut into blocks by hash, so that one that holds a third of the corpus is
many tasks' work. A block's codes and the queries that look into it meet by a shuffle on (cell,
block), codes first: a task holds one block and streams queries past it, and what it emits is a
few candidates for each query, however many are nearly alike. Nothing but centroids (cells * dimensions numbers, CELLS at most) is
broadcast, and the queries may be as many as the corpus.

Defined results: null vectors are in no index and ask nothing; a vector without length scores 0;
equal scores are in order of ids; an empty index gives no rows; fewer vectors than k give them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from .retrieval import ranked
from .storage import saved

#: Vectors that centroids are learnt from, and cells, at most; rounds of learning.
SAMPLE, CELLS, ROUNDS = 65_536, 2048, 12
#: Vectors of a block, candidates of a block that are kept for each result, scores held at once, and
#: what single precision may add to a score.
BLOCK, RERANK, SCORES, SLACK = 8192, 8, 1 << 21, 1e-4


def units(x: np.ndarray) -> np.ndarray:
    return _directions(x).astype(np.float32)


def _directions(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


@dataclass
class Cells:
    centroids: np.ndarray
    scale: float  # of a code's unit

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centroids.T, axis=1) if len(self.centroids) else np.zeros(len(x), int)

    def probes(self, x: np.ndarray, beam: int) -> np.ndarray:
        """The cells that each row looks into, nearest first; ties by number."""
        return np.argsort(-(x @ self.centroids.T), axis=1, kind="stable")[:, :beam]

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.round(x / self.scale), -127, 127).astype(np.int8)


def learn(sample: np.ndarray, cells: int, seed: int = 1) -> Cells:
    """Spherical k-means; cells that lose all their vectors take the ones that fit worst."""
    x = units(sample)
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(x)))
    centroids = x[rng.choice(len(x), cells, replace=False)] if len(x) else np.zeros((0, 1), np.float32)
    for _ in range(ROUNDS if len(x) else 0):
        near = x @ centroids.T
        of, fit = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        empty = np.flatnonzero(np.bincount(of, minlength=cells) == 0)
        sums[empty] = x[np.argsort(fit, kind="stable")[: len(empty)]]
        centroids = units(sums)
    return Cells(centroids, float(np.abs(x).max(initial=0.0)) / 127 or 1.0)


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


@dataclass
class VectorIndex:
    cells: Cells
    codes: DataFrame  # id, cell, block, code, off (length of what the code leaves out), own (the vector)
    sizes: DataFrame  # cell, vectors, blocks


def build(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 1) -> VectorIndex:
    """vectors: id, vector. The number of cells follows the root of the corpus, up to CELLS."""
    spark = vectors.sparkSession
    held = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).filter(F.col("vector").isNotNull())
    picked = held.select(F.col("vector").cast("array<float>").alias("vector"), F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(sample).select("vector").collect()
    wanted = cells or min(CELLS, max(1, int(held.count() ** 0.5)))
    known = learn(np.array([r["vector"] for r in picked], np.float32) if picked else np.zeros((0, 1), np.float32), wanted, seed)
    shared = spark.sparkContext.broadcast(known)
    kinds = StructType([vectors.schema["id"], StructField("cell", IntegerType()), StructField("code", BinaryType()), StructField("off", DoubleType()), StructField("own", ArrayType(DoubleType()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = units(matrix(b.column(1), b.num_rows))
                codes = shared.value.codes(x)
                off = np.linalg.norm(x - codes.astype(np.float64) * shared.value.scale, axis=1)
                columns = [b.column(0), pa.array(shared.value.nearest(x), pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), b.column(1)]
                yield pa.RecordBatch.from_arrays(columns, names=kinds.names)

    placed = saved(held.mapInArrow(place, kinds), "vector-codes")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("vectors")).withColumn("blocks", F.ceil(F.col("vectors") / BLOCK).cast("int"))
    sizes = saved(sizes, "vector-cells")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    return VectorIndex(known, saved(placed.join(sizes.select("cell", "blocks"), "cell").select("id", "cell", block.alias("block"), "code", "off", "own"), "vector-index"), sizes)


def probed(queries: DataFrame, index: VectorIndex, beam: int) -> DataFrame:
    """query_id, vector (of length one), cell: a row for each cell that a query looks into."""
    shared = queries.sparkSession.sparkContext.broadcast(index.cells)
    kinds = StructType([queries.schema["query_id"], StructField("vector", ArrayType(DoubleType())), StructField("cell", IntegerType())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and len(shared.value.centroids):
                x = _directions(matrix(b.column(1), b.num_rows))
                cells = shared.value.probes(x.astype(np.float32), beam)
                times = pa.array(np.repeat(np.arange(b.num_rows), cells.shape[1]))
                unit = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(times), unit.take(times), pa.array(cells.ravel(), pa.int32())], names=kinds.names)

    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).filter(F.col("vector").isNotNull())
    return asked.mapInArrow(choose, kinds)


def candidates(queries: DataFrame, index: VectorIndex, beam: int, keep: int) -> DataFrame:
    """query_id, id, near: of each block that a query looks into the `keep` best, ties by id. A code's
    score is off by its row's `off` at most, so rows that cannot be among them are passed over by
    their codes; the others are scored in full."""
    scale = index.cells.scale
    rows = index.codes.select("cell", "block", F.lit(0).alias("turn"), "id", "code", "off", "own")
    asking = probed(queries, index, beam).join(index.sizes.select("cell", "blocks"), "cell")
    asking = asking.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("turn"), "query_id", "vector")
    both = rows.unionByName(asking, allowMissingColumns=True).repartition("cell", "block").sortWithinPartitions("cell", "block", "turn", "id")
    kinds = StructType([StructField("query_id", both.schema["query_id"].dataType), StructField("id", both.schema["id"].dataType), StructField("near", DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kinds)
        of, ids, held, codes, off, own = None, [], [], None, None, None
        for b in batches:
            keys = np.stack([b.column(k).to_numpy() for k in range(3)], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), b.num_rows]
            for a, z in zip(starts, starts[1:], strict=False):
                if a == z:
                    continue
                cell, block, turn = keys[a].tolist()
                part = b.slice(a, z - a)
                if turn == 0:
                    if of != (cell, block):
                        of, ids, held = (cell, block), [], []
                    ids.append(part.column(3))
                    code = np.frombuffer(b"".join(x.as_py() for x in part.column(4)), np.int8).reshape(part.num_rows, -1)
                    held.append((code, part.column(5).to_numpy(), _directions(matrix(part.column(6), part.num_rows))))
                    codes = None
                elif of == (cell, block):
                    if codes is None:
                        codes, off, own = (np.concatenate(x) for x in zip(*held, strict=True))
                        codes, ids = codes.astype(np.float32) * scale, [pa.concat_arrays(ids)]
                    step = max(1, SCORES // len(codes))
                    for at in range(0, part.num_rows, step):
                        few = part.slice(at, step)
                        nth, place, near = best_of(matrix(few.column(8), few.num_rows), codes, off, own, keep)
                        yield pa.RecordBatch.from_arrays([few.column(7).take(pa.array(nth)), ids[0].take(pa.array(place)), pa.array(near)], schema=arrow)

    return both.select("cell", "block", "turn", "id", "code", "off", "own", "query_id", "vector").mapInArrow(score, kinds)


def best_of(asked: np.ndarray, codes: np.ndarray, off: np.ndarray, own: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the query, place and score of the `keep` best rows of each, earlier places first
    among equal ones."""
    rough = asked.astype(np.float32) @ codes.T
    n = min(keep, rough.shape[1])
    least = np.partition(rough - off, rough.shape[1] - n, axis=1)[:, rough.shape[1] - n][:, None]
    nth, place = np.nonzero(rough + off >= least - 2 * SLACK)
    near = np.empty(len(nth))
    for at in range(0, len(nth), 1 << 16):
        some = slice(at, at + (1 << 16))
        near[some] = (asked[nth[some]] * own[place[some]]).sum(axis=1)
    order = np.lexsort((place, -np.round(near, 9), nth))
    nth, place, near = nth[order], place[order], near[order]
    first = np.arange(len(nth)) - np.searchsorted(nth, nth) < n
    return nth[first], place[first], near[first]


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of equal length; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def search(queries: DataFrame, vectors: DataFrame, index: VectorIndex, k: int, beam: int, rerank: int = RERANK) -> DataFrame:
    """query_id, id, score, rank; vectors are those the index was built from."""
    some = candidates(queries, index, beam, rerank * k)
    order = [F.desc(F.round("near", 9)), F.asc("id")]
    few = ranked(some.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(32))), ["query_id", "part"], order, rerank * k).drop("rank", "part")
    best = saved(ranked(few, ["query_id"], order, rerank * k).select("query_id", "id"), "vector-candidates")
    double = lambda c: F.col(c).cast("array<double>")
    rows = best.join(vectors.select("id", double("vector").alias("own")), "id").join(queries.select("query_id", double("vector").alias("asked")), "query_id")
    scored = rows.select("query_id", "id", cosine(F.col("asked"), F.col("own")).alias("score"))
    return ranked(scored, ["query_id"], [F.desc(F.round("score", 9)), F.asc("id")], k)


def scored_share(queries: DataFrame, index: VectorIndex, beam: int) -> DataFrame:
    """query_id, scored: how many codes a query is compared with."""
    return probed(queries, index, beam).join(index.sizes, "cell").groupBy("query_id").agg(F.sum("vectors").alias("scored"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of the exact result that was found."""
    hits = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
