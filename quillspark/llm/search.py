"""Exact BM25 top-k over sharded inverted indexes with block-max pruning.

Each task cuts its documents into shards of bounded size and writes an inverted index for each:
sorted terms, postings with document places and frequencies, lengths. Inside a shard like
documents stand together, by the common terms they hold and then by length, so that blocks of BLOCK
neighbours have similar impacts and whole blocks fall to the bound. A search takes
the stated queries in blocks of bounded size; for a block, document frequencies are summed over
all shards, so that scores use global statistics everywhere, and each task runs the block's
queries over its shards, keeping its best k so far for each query as the threshold. The first shards
of all tasks are searched before the others, whose threshold is the k-th best score of those.

Postings of rare terms are few and are summed first, for all documents at once. Common terms (in DENSE
of the shard's documents and COMMON of them or more) are the many; they have rows by block, and
pruning is by block maxima: a block of documents whose best sum of rare terms, with the query's
maxima of common terms in it, stays below the threshold is skipped whole. The best blocks go first
while a query has no threshold yet. What stays is a product of queries with the block's rows.

These sums are in single precision, whose error is bounded by a share of them. Documents that reach the
threshold within that error, a few of each shard, are scored again from their own postings in double
precision. Results are exact: equal to scoring each document. Partial results are merged by query.

Scores are rounded to PLACES decimals before they are compared, and the threshold leaves as much
room, so that equal documents score the same in whatever shard they stand and the order of sums
decides nothing.

score = sum over the query's distinct terms of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (K1 + 1)
/ (tf + K1 * (1 - B + B * length / mean length)). Terms: runs without ASCII blanks and punctuation,
A-Z as a-z. Equal scores are ordered by doc_id (nulls first).

Work grows with queries times documents, whatever the index: a query set that is a share of the
corpus makes it quadratic. Defined results: null, empty and term-free texts are indexed with
length 0 and match nothing; a query without terms has no rows; repeated rows of one doc_id and
text are one query, and as documents hits of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import documents, map_texts, materialize, text_batches
from .shingles import word_hashes

K1, B, TOP = 1.2, 0.75, 10
#: Documents and words of a shard, documents of a block, queries are stated by EVERY.
SHARD, SHARD_WORDS, BLOCK, EVERY = 8192, 1 << 22, 64, 100
#: Terms in more than this share of a shard's documents, and in so many, have their impacts as rows.
DENSE, COMMON = 0.06, 64
#: Blocks that are scored first, queries that a shard takes together; decimals of a score.
FIRST, TOGETHER, PLACES = 4, 256, 9
#: Principal components by whose signs a shard's documents are arranged.
COMPONENTS = 3
#: Terms of a block of queries; bounds the broadcast to some 16 bytes each.
QUERY_TERMS = 1 << 22

#: Bytes of what separates terms as blanks, A-Z as a-z.
_PLAIN = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
_HITS = ["query_id", "query_md5", "doc_id", "score"]
_INDEX = "lead boolean, docs int, words long, ids binary, named binary, lengths binary, terms binary, offsets binary, places binary, counts binary"


def terms_of(text: str) -> np.ndarray:
    return word_hashes(text, table=_PLAIN)


def arranged(term: np.ndarray, doc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """An order of a shard's documents that brings like ones together: by the signs of the first
    principal components of which common terms they hold, then by length."""
    often = np.bincount(term) > max(COMMON, len(lengths) * DENSE)
    mine = often[term]
    x = np.zeros((len(lengths), int(often.sum())), np.float32)
    x[doc[mine], (np.cumsum(often) - 1)[term[mine]]] = 1
    side = np.zeros(len(lengths), np.int64)
    if min(x.shape) > COMPONENTS:
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        x -= x.mean(axis=0)
        basis = np.random.default_rng(1).standard_normal((x.shape[1], COMPONENTS)).astype(np.float32)
        for _ in range(4):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        side = ((x @ basis > 0) << np.arange(COMPONENTS)).sum(axis=1)
    return np.lexsort((lengths, side))


def build_index(docs: DataFrame) -> DataFrame:
    """One row for each shard; arrays as bytes. lead: the first one of its task."""

    def shard(ids: list, words: list[np.ndarray], lead: bool) -> pa.RecordBatch:
        lengths = np.array([len(w) for w in words], np.int32)
        place = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
        terms, nth = np.unique(np.concatenate(words), return_inverse=True)
        pair, counts = np.unique(nth * SHARD + place, return_counts=True)
        term, doc = pair // SHARD, pair % SHARD
        order = arranged(term, doc, lengths)
        stands = np.empty(len(order), np.int64)
        stands[order] = np.arange(len(order))
        pair = term * SHARD + stands[doc]
        inside = np.argsort(pair)
        pair, counts = pair[inside], counts[inside]
        offsets = np.searchsorted(pair, np.arange(len(terms) + 1) * SHARD)
        arrays = [
            np.array([ids[i] or 0 for i in order], np.int64), np.array([ids[i] is not None for i in order], np.uint8), lengths[order], terms,
            offsets.astype(np.int32), (pair % SHARD).astype(np.uint16), counts.astype(np.int32),
        ]
        values = [pa.array([lead]), pa.array([len(ids)], pa.int32()), pa.array([int(lengths.sum())], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]]
        return pa.RecordBatch.from_arrays(values, names=[x.split()[0] for x in _INDEX.split(", ")])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, size, lead = [], [], 0, True
        for piece, texts in text_batches(batches):
            for i, t in zip(piece.column(0).to_pylist(), texts, strict=True):
                w = terms_of(t)
                if ids and (len(ids) == SHARD or size + len(w) > SHARD_WORDS):
                    yield shard(ids, words, lead)
                    ids, words, size, lead = [], [], 0, False
                ids.append(i)
                words.append(w)
                size += len(w)
        if ids:
            yield shard(ids, words, lead)

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, _INDEX)


class Shard:
    def __init__(self, row: dict, mean: float, weight: np.ndarray | None = None) -> None:
        """weight: of each term, 1 by default; it goes into the impacts of its postings."""
        read = lambda k, t: np.frombuffer(row[k], t)
        self.ids, self.named, self.terms = read("ids", np.int64), read("named", np.uint8), read("terms", np.uint64)
        self.offsets, places = read("offsets", np.int32), read("places", np.uint16)
        tf, length = read("counts", np.int32).astype(np.float64), read("lengths", np.int32)[places]
        many = np.diff(self.offsets)
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        if weight is not None:
            impact *= np.repeat(weight, many)
        # Postings as pairs (place, impact in single precision): one copy of a run takes both.
        pairs = np.empty((len(places), 2), np.uint32)
        pairs[:, 0], pairs.view(np.float32)[:, 1] = places, impact
        self.pairs, self.ends = memoryview(pairs).cast("B") if len(places) else memoryview(b""), self.offsets.astype(np.int64) * pairs.itemsize * 2
        # The same by document: what it scores exactly.
        order = np.argsort(places, kind="stable")
        self.first = np.searchsorted(places[order], np.arange(len(self.ids) + 1))
        self.owner, self.exact = np.repeat(np.arange(len(self.terms), dtype=np.int32), many)[order], impact[order]
        self.mark = np.zeros(len(self.terms), np.float32)
        # Terms in many of the documents: their impacts as rows, so that a block's part of a query
        # is one product instead of a sum over postings.
        common = np.flatnonzero(many > max(len(self.ids) * DENSE, COMMON))
        self.row_of = np.full(len(self.terms), -1)
        self.row_of[common] = np.arange(len(common))
        blocks = -(-len(self.ids) // BLOCK)
        # [block, term, document]: what a block needs stands together; and the blocks' maxima.
        self.rows = np.zeros((blocks, len(common), BLOCK), np.float32)
        mine = _ranges(self.offsets[common], many[common])
        at = places[mine].astype(np.int64)
        self.rows[at // BLOCK, np.repeat(np.arange(len(common)), many[common]), at % BLOCK] = impact[mine]
        self.row_tops = self.rows.max(axis=2).T if len(common) else np.zeros((0, blocks), np.float32)
        # Of each block the common terms that it holds, and their rows.
        self.held = [np.flatnonzero(self.row_tops[:, b]) for b in range(blocks)]
        self.held_rows = [self.rows[b, held] for b, held in enumerate(self.held)]

    def search(self, asked: list[tuple[np.ndarray, np.ndarray | None]], least: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of some queries the places and scores of the documents that can be among its
        best k. asked: places of the query's terms here, and how often each counts (None: once);
        least: the scores of the k-th best so far."""
        blocks, least = len(self.rows), least.copy()
        weights, scores = np.zeros((len(asked), len(self.row_tops)), np.float32), np.zeros((len(asked), blocks * BLOCK), np.float32)
        for i, (at, times) in enumerate(asked):
            row = self.row_of[at]
            rare = row < 0
            weights[i, row[~rare]] = 1 if times is None else times[~rare]
            at = at[rare]
            if len(at):
                runs = zip(self.ends[at].tolist(), self.ends[at + 1].tolist(), strict=True)
                pairs = np.frombuffer(b"".join([self.pairs[a:b] for a, b in runs]), np.uint32).reshape(-1, 2)
                part = pairs.view(np.float32)[:, 1]
                part = part if times is None else part * np.repeat(times[rare], self.offsets[at + 1] - self.offsets[at])
                scores[i] = np.bincount(pairs[:, 0], part, scores.shape[1])
        # Sums in single precision are off by a smaller share than this.
        off, slack = (len(self.row_tops) + 4) * 2.0**-23, 2 * 10.0**-PLACES
        bound = (scores.reshape(len(asked), blocks, BLOCK).max(axis=2) + weights @ self.row_tops) * (1 + off)
        left = bound > 0
        new = np.flatnonzero(least <= 0)
        if len(new) and scores.shape[1] >= k:  # the best blocks raise the threshold for the rest
            early = np.zeros(bound.shape, bool)
            early[new[:, None], np.argsort(-bound[new], axis=1, kind="stable")[:, :FIRST]] = True
            early &= left
            self._add(scores, weights, early)
            left &= ~early
            least[new] = np.maximum(0, np.partition(scores[new], scores.shape[1] - k, axis=1)[:, scores.shape[1] - k].astype(float) * (1 - off) - slack)
        self._add(scores, weights, left & (bound + slack >= least[:, None]))
        bar = np.maximum((least - slack) / (1 + off) ** 2, 1e-30).astype(np.float32)
        out = []
        for i, hit in enumerate(scores >= bar[:, None]):
            found = np.flatnonzero(hit)
            if len(found) > k:
                some = scores[i, found].astype(float)
                found = found[some * (1 + off) + slack >= float(np.partition(some, len(some) - k)[len(some) - k]) * (1 - off)]
            at, times = asked[i]
            self.mark[at] = 1 if times is None else times
            ends = zip(self.first[found].tolist(), self.first[found + 1].tolist(), strict=True)
            value = np.round(np.array([self.mark[self.owner[a:b]] @ self.exact[a:b] for a, b in ends], float), PLACES)
            self.mark[at] = 0
            out.append((found[value > 0], value[value > 0]))
        return out

    def _add(self, scores: np.ndarray, weights: np.ndarray, pick: np.ndarray) -> None:
        """The common terms' part of the scores, for the picked queries of each block."""
        for b in np.flatnonzero(pick.any(axis=0)).tolist():
            q = np.flatnonzero(pick[:, b])
            scores[q, b * BLOCK : (b + 1) * BLOCK] += weights[q[:, None], self.held[b]] @ self.held_rows[b]


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... many[0] of them, then those of first[1], and so on."""
    many = many.astype(np.int64)
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - many), many)


def _best(named: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, named, -scores))[:k]


def query_blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    """(doc_id, hash, sorted distinct terms) of the queries, as many as QUERY_TERMS allows at once;
    the driver holds one block at a time."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_batches(batches):
            sets = [np.unique(terms_of(t)).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(sets, pa.binary())], names=["doc_id", "hash", "terms"])

    made = materialize(map_texts(queries, step, "doc_id long, hash string, terms binary").filter("length(terms) > 0"), "queries")
    block, size = [], 0
    for r in made.toLocalIterator():
        terms = np.frombuffer(bytes(r[2]), np.uint64)
        if block and size + len(terms) > QUERY_TERMS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1], terms))
        size += len(terms)
    if block:
        yield block


def search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, query_md5 (of its text), rank, doc_id, score; queries: doc_id and text."""
    spark = docs.sparkSession
    index = materialize(build_index(docs), "index")
    total, words = index.agg(F.sum("docs"), F.sum("words")).first()
    asked = queries.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("hash"), "text").dropDuplicates(["doc_id", "hash"])
    parts = []
    for block in query_blocks(asked) if total else ():
        wanted = np.unique(np.concatenate([b[2] for b in block]))
        shared = spark.sparkContext.broadcast(wanted)

        def frequencies(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            df = np.zeros(len(shared.value), np.int64)
            for b in batches:
                for row in b.to_pylist():
                    terms = np.frombuffer(row["terms"], np.uint64)
                    at = np.minimum(np.searchsorted(terms, shared.value), max(0, len(terms) - 1))
                    here = terms[at] == shared.value if len(terms) else np.zeros(len(df), bool)
                    df[here] += np.diff(np.frombuffer(row["offsets"], np.int32))[at[here]]
            full = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(df[full])], names=["at", "df"])

        counted = index.select("terms", "offsets").mapInArrow(frequencies, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toPandas()
        df = np.zeros(len(wanted))
        df[counted["at"].to_numpy()] = counted["df"].to_numpy()
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
        asks = spark.sparkContext.broadcast((wanted, idf, [np.searchsorted(wanted, b[2]).astype(np.int32) for b in block], [b[:2] for b in block], words / total))

        def run(batches: Iterator[pa.RecordBatch], floor, asks=asks) -> Iterator[pa.RecordBatch]:
            wanted, idf, sets, names, mean = asks.value
            known = floor.value if floor else np.zeros(len(sets))
            best: list = [(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0))] * len(sets)
            for b in batches:
                for row in b.to_pylist():
                    held = np.frombuffer(row["terms"], np.uint64)
                    if not len(held):
                        continue
                    at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                    here = held[at] == wanted
                    weight = np.zeros(len(held))
                    weight[at[here]] = idf[here]
                    shard = Shard(row, mean, weight)
                    for start in range(0, len(sets), TOGETHER):
                        some = [terms[here[terms]] for terms in sets[start : start + TOGETHER]]
                        least = np.array([max(low, x[2][-1]) if len(x[2]) >= k else low for low, x in zip(known[start:].tolist(), best[start : start + TOGETHER])])
                        found = shard.search([(at[mine], None) for mine in some], least, k)
                        for q, (places, scores) in enumerate(found, start):
                            if len(places):
                                merged = [np.concatenate(x) for x in zip(best[q], (shard.named[places], shard.ids[places], scores), strict=True)]
                                top = _best(*merged, k)
                                best[q] = tuple(m[top] for m in merged)
            column = lambda j: np.concatenate([x[j] for x in best])
            owner = np.repeat(np.arange(len(best), dtype=np.int32), [len(x[1]) for x in best])
            ids = pa.array(column(1), pa.int64(), mask=column(0) == 0)
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array([names[i][0] for i in owner], pa.int64()), pa.array([names[i][1] for i in owner], pa.string()), ids, pa.array(column(2))], names=["nth", *_HITS])

        schema = "nth int, query_id long, query_md5 string, doc_id long, score double"
        # The leading shards first: their k-th best scores are what a document of the others must reach.
        led = materialize(index.filter("lead").mapInArrow(lambda batches, run=run: run(batches, None), schema), "hits")
        least = led.groupBy("nth").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).filter(F.size("s") >= k).select("nth", F.element_at("s", k).alias("score")).toPandas()
        floor = np.zeros(len(block))
        floor[least["nth"].to_numpy()] = least["score"].to_numpy()
        shared_floor = spark.sparkContext.broadcast(floor)
        rest = index.filter("not lead").mapInArrow(lambda batches, run=run, floor=shared_floor: run(batches, floor), schema)
        parts += [led.select(*_HITS), rest.select(*_HITS)]
    if not parts:
        return spark.createDataFrame([], "query_id long, query_md5 string, rank int, doc_id long, score double")
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    by_score = W.partitionBy("query_id", "query_md5").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return hits.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "query_md5", "rank", "doc_id", "score")


def op6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    hits = search(docs, docs.filter(F.col("doc_id") % EVERY == 0))
    return hits.select("query_id", "query_md5", "rank", "doc_id", F.round("score", 4).alias("score"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, md5(text) AS query_md5, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), t AS (
  SELECT doc_id, query_md5, len(words) AS length, unnest(words) AS term FROM d
), f AS (
  SELECT doc_id, query_md5, term, any_value(length) AS length, count(*) AS tf FROM t GROUP BY ALL
), n AS (
  SELECT count(*) AS total, sum(coalesce(len(words), 0)) / count(*) AS mean FROM d
), i AS (
  SELECT term, ln(1 + (any_value(total) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM f, n GROUP BY term
), s AS (
  SELECT q.doc_id AS query_id, q.query_md5, f.doc_id, sum(i.idf * f.tf * 2.2::DOUBLE / (f.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * f.length / n.mean))) AS score
  FROM f q JOIN i ON q.term = i.term JOIN f ON f.term = q.term, n WHERE q.doc_id % 100 = 0 GROUP BY ALL
)
SELECT query_id, query_md5, rank::INT AS rank, doc_id, round(score, 4) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""
