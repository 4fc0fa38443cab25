"""Importance resampling towards a target distribution of hashed n-grams.

Features of a text are its runs of 1 to GRAMS words; each falls into the bucket of its CRC-32. A
bucket's gain is the log ratio of its smoothed shares in the target and in the corpus, and the
documents with the largest weight (sum of gains) plus seeded Gumbel noise are drawn, which is
sampling without replacement by importance.

Inverted postings: a first pass adds up each bucket's features of both corpora (one row for each
task and part of the buckets). A second one turns blocks of documents into postings (bucket,
document, count), which are shuffled by part of the buckets; PARTS of those times a number of salts
by block, so that frequent buckets spread however many documents hold them. Each part and salt
gets the totals of both corpora with its postings, totals first: the task computes the gains of its
buckets, streams the postings past them and emits what each document gains there; sums by document
follow. A task holds the gains of one part and one block of postings at a time.

CRCs of runs come from those of single words: the CRC of a, b is that of a shifted by the length of
b (a linear map, tabled by length) xor that of b. Long texts are read in pieces of PIECE bytes that
hand their last words on.

The ranks come from a range partition by (score, doc_id), fixed in the checkpoint folder: only row
counts of partitions reach the driver.

Defined results: null and empty texts, and those without words, have no features, weight 0, and
the noise alone as score; rows with null doc_id hash the empty string and lose ties; repeated rows
are drawn each; an empty target gives every bucket t = T = 0; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, map_texts, materialize, partitions, shared_folder, text_batches

BUCKETS, GRAMS = 10_000, 3
SEED = "42"
#: Documents with so many words can be drawn, and so many of 100 of them are.
LEAST_WORDS, PERCENT = 20, 5
#: Parts of the buckets (bucket modulo PARTS); a document's weight is the sum of so many numbers.
PARTS = 16
WIDTH = -(-BUCKETS // PARTS)
#: Bytes of a text that are taken apart at once.
PIECE = 4 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Longer words are shifted one by one.
_TABLED = 64


def _shifts() -> np.ndarray:
    """[length, byte's place, byte]: what that byte of a CRC becomes when `length` zero bytes follow."""
    one = np.array([crc32(bytes([b])) ^ crc32(b"\0") for b in range(256)], np.uint32)
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out = np.zeros((_TABLED + 1, 4, 256), np.uint32)
    for length in range(_TABLED + 1):
        for place in range(4):
            for bit in range(8):
                out[length, place, np.arange(256) >> bit & 1 == 1] ^= bits[8 * place + bit]
        bits = one[bits & 255] ^ bits >> np.uint32(8)
    return out


_SHIFTS = _shifts().reshape(-1)
_SPACE = crc32(b" ")


def followed(crc: np.ndarray, length: np.ndarray, tail: np.ndarray, words: list[bytes]) -> np.ndarray:
    """CRCs of what `crc` stands for, a space and a word; length: that of space and word, tail: their CRC."""
    at = np.minimum(length, _TABLED).astype(np.int64) * 1024
    out = tail.copy()
    for place in range(4):
        out ^= _SHIFTS[at + (256 * place) + (crc >> np.uint32(8 * place) & np.uint32(255))]
    for i in np.flatnonzero(length > _TABLED):
        out[i] = crc32(words[i], crc32(b" ", int(crc[i])))
    return out


def pieces(data: bytes, limit: int = PIECE) -> Iterator[bytes]:
    """The folded text in pieces that end between words."""
    data, start = data.translate(_FOLD), 0
    while len(data) - start > limit:
        end = data.find(b" ", start + limit)
        if end < 0:
            break
        yield data[start:end]
        start = end
    yield data[start:] if start else data


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of several texts, piece by piece: buckets of features, the places of their texts, and the
    number of words of each text in the piece."""
    words: list[bytes] = []
    ends: list[tuple[int, int]] = []  # text, number of words so far
    held = 0
    last = (0, 0, 0)  # of the text that the piece goes on with: words before it (2 at most), CRCs of the last run of 1 and 2

    def flush(last: tuple[int, int, int]):
        n = len(words)
        at = np.repeat([t for t, _ in ends], np.diff([0, *(e for _, e in ends)]))
        counts = np.bincount(at, minlength=len(texts))
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), counts, last
        one = np.fromiter(map(crc32, words), np.uint32, n)
        length = np.fromiter(map(len, words), np.int64, n)
        tail = followed(np.full(n, _SPACE, np.uint32), length, one, words) if length.max() <= _TABLED else np.array([crc32(w, _SPACE) for w in words], np.uint32)
        place = np.arange(n) - np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])[np.cumsum(np.concatenate([[0], np.diff(at) != 0]))]
        place[at == at[0]] += last[0]
        two = followed(np.concatenate([[np.uint32(last[1])], one[:-1]]), length + 1, tail, words)
        three = followed(np.concatenate([[np.uint32(last[2])], two[:-1]]), length + 1, tail, words)
        runs = np.concatenate([one, two[place >= 1], three[place >= 2]])
        where = np.concatenate([at, at[place >= 1], at[place >= 2]])
        return (runs % np.uint32(BUCKETS)).astype(np.int64), where, counts, (min(int(place[-1]) + 1, GRAMS - 1), int(one[-1]), int(two[-1]))

    for t, text in enumerate(texts):
        for k, piece in enumerate(pieces(text.encode())):
            if k and words:  # what came before of this text goes first, and hands its last words on
                *out, last = flush(last)
                yield tuple(out)
                words, ends, held = [], [], 0
            elif k == 0 and not words:
                last = (0, 0, 0)
            words += piece.split()
            ends.append((t, len(words)))
            held += len(piece)
        if held >= PIECE:
            *out, last = flush(last)
            yield tuple(out)
            words, ends, held, last = [], [], 0, (0, 0, 0)
    if ends:
        *out, last = flush(last)
        yield tuple(out)


def totals(corpus: DataFrame, name: str) -> DataFrame:
    """corpus, part, nth (place inside the part), n: features by bucket, summed."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(PARTS * WIDTH, np.int64)
        for _, texts in text_batches(batches):
            for buckets, _, _ in features(texts):
                n += np.bincount(buckets % PARTS * WIDTH + buckets // PARTS, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array((at // WIDTH).astype(np.int32)), pa.array((at % WIDTH).astype(np.int32)), pa.array(n[at])], names=["part", "nth", "n"])

    rows = map_texts(corpus.select("text"), step, "part int, nth int, n long")
    return rows.groupBy("part", "nth").agg(F.sum("n").alias("n")).withColumn("corpus", F.lit(name))


_POSTINGS = "part int, salt int, rank int, block long, at array<int>, nth array<smallint>, n array<int>, ids array<long>, many array<long>"


def postings(docs: DataFrame, salts: int) -> DataFrame:
    """Blocks of documents as rows: for each part their postings (rank 2: document's place `at`,
    bucket's place `nth`, count), and one row with their ids and numbers of features and words (rank 1)."""
    schema = pa.schema([("part", pa.int32()), ("salt", pa.int32()), ("rank", pa.int32()), ("block", pa.int64()), ("at", pa.list_(pa.int32())), ("nth", pa.list_(pa.int16())), ("n", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("many", pa.list_(pa.int64()))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for rows, texts in text_batches(batches):
            salt, wide = block * 0x9E3779B1 >> 7 & 0x7FFFFFFF, len(texts) * WIDTH
            many, words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for buckets, where, counts in features(texts):
                many += np.bincount(where, minlength=len(texts))
                words += counts
                key, n = np.unique(buckets % PARTS * wide + where * WIDTH + buckets // PARTS, return_counts=True)
                cuts = np.searchsorted(key, wide * np.arange(PARTS + 1))
                for part in range(PARTS):
                    a, b = cuts[part], cuts[part + 1]
                    if a < b:
                        own = key[a:b] - part * wide
                        values = [[part], [salt % salts], [2], [block], [(own // WIDTH).astype(np.int32)], [(own % WIDTH).astype(np.int16)], [n[a:b].astype(np.int32)], [None], [None]]
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)
            values = [[0], [salt % salts], [1], [block], [None], [None], [None], [rows.column(0)], [np.concatenate([many, words])]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)
            block += 1

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), step, _POSTINGS)


def gains(own: np.ndarray, target: np.ndarray, every: int, wanted: int) -> np.ndarray:
    """Whole thousandths of log ratios."""
    ratio = (target + 1.0) * (every + float(BUCKETS)) / ((own + 1.0) * (wanted + float(BUCKETS)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In order of part, salt and rank: totals (rank 0), then what is weighed by their gains."""
    names = ["block", "at", "doc_id", "n_features", "n_words", "weight"]
    part, gain = None, None
    for b in batches:
        of, ranks, blocks = (b.column(k).to_pylist() for k in (0, 2, 3))
        for i in range(b.num_rows):
            values = lambda k: b.column(k)[i].values  # noqa: E731,B023
            if ranks[i] == 0:
                x = values(8).to_numpy()  # totals of the corpus, of the target, and both sums
                part, gain = of[i], gains(x[:WIDTH], x[WIDTH : 2 * WIDTH], int(x[-2]), int(x[-1]))
            elif ranks[i] == 1:
                ids, many = values(7), values(8)
                n = len(ids)
                columns = [pa.array(np.full(n, blocks[i])), pa.array(np.arange(n, dtype=np.int32)), ids, many.slice(0, n), many.slice(n, n), pa.array(np.zeros(n, np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            else:
                assert part == of[i]
                at = values(4).to_numpy()
                found = np.bincount(at, gain[values(5).to_numpy()] * values(6).to_numpy().astype(np.float64))
                held = np.unique(at)
                none = pa.nulls(len(held), pa.int64())
                columns = [pa.array(np.full(len(held), blocks[i])), pa.array(held.astype(np.int32)), none, none, none, pa.array(found[held].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def weigh(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, n_words, weight of every document."""
    spark = docs.sparkSession
    salts = max(8, -(-4 * partitions(spark) // PARTS))
    both = materialize(totals(docs, "own").unionByName(totals(target, "target")), "bucket-totals")
    # BUCKETS rows for each corpus at most: by part they are two arrays of WIDTH numbers.
    sums = both.groupBy().agg(*[F.coalesce(F.sum(F.when(F.col("corpus") == c, F.col("n"))), F.lit(0)).alias(c) for c in ("own", "target")]).first()
    each = spark.range(PARTS).select(F.col("id").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("nth"))
    pick = lambda c: F.coalesce(F.sum(F.when(F.col("corpus") == c, F.col("n"))), F.lit(0))
    filled = each.join(both, ["part", "nth"], "left").groupBy("part", "nth").agg(pick("own").alias("own"), pick("target").alias("target"))
    held = F.array_sort(F.collect_list(F.struct("nth", "own", "target")))
    by_part = filled.groupBy("part").agg(held.alias("x"))
    every = F.concat(F.transform("x", lambda x: x["own"]), F.transform("x", lambda x: x["target"]), F.array(F.lit(sums["own"]).cast("long"), F.lit(sums["target"]).cast("long")))
    heads = by_part.select("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("rank"), every.alias("many"))
    rows = postings(docs, salts).unionByName(heads, allowMissingColumns=True)
    rows = rows.repartition(partitions(spark), "part", "salt").sortWithinPartitions("part", "salt", "rank")
    found = map_texts(rows, contributions, "block long, at int, doc_id long, n_features long, n_words long, weight long")
    return found.groupBy("block", "at").agg(F.max("doc_id").alias("doc_id"), F.max("n_features").alias("n_features"), F.max("n_words").alias("n_words"), F.sum("weight").alias("weight")).drop("block", "at")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight, score, rank (null: not drawn)."""
    spark = docs.sparkSession
    shared_folder(spark)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    chance = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000) * F.log(-F.log(chance))).cast("long")
    scored = materialize(weigh(docs, target).withColumn("score", F.col("weight") + noise).withColumn("out", F.col("n_words") < least_words), "weights")
    drawn = scored.filter(~F.col("out")).count() * percent // 100
    order = [F.col("out"), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    fixed = scored.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).checkpoint().withColumn("part", F.spark_partition_id())
    counts = dict(fixed.groupBy("part").count().collect())
    starts = [0, *accumulate(counts.get(p, 0) for p in range(max(counts, default=0)))]
    nth = F.monotonically_increasing_id() - F.call_function("shiftleft", F.col("part").cast("long"), F.lit(33))
    rank = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("part") + 1) + nth + 1
    ranked = fixed.withColumn("rank", rank)
    return ranked.select("doc_id", "n_features", "n_words", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("n_words")


ORACLE_SQL = r"""
WITH RECURSIVE k AS (
  SELECT 0 AS step, range AS b, range::BIGINT AS v FROM range(256)
  UNION ALL
  SELECT step + 1, b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM k WHERE step < 8
), tab AS (
  SELECT b, v FROM k WHERE step = 8
), d AS (
  SELECT 0 AS kind, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), w AS (
  SELECT kind, r, doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM d
), u AS (
  SELECT kind, r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w
), g AS (
  SELECT kind, r, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY kind, r ORDER BY i)
), f AS (
  SELECT kind, r, a AS x FROM g
  UNION ALL SELECT kind, r, a || ' ' || b FROM g WHERE b IS NOT NULL
  UNION ALL SELECT kind, r, a || ' ' || b || ' ' || c FROM g WHERE c IS NOT NULL
), n AS (
  SELECT kind, r, x, count(*) AS n FROM f GROUP BY ALL
), x AS (
  SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT x FROM n)
), s AS (
  SELECT x, h, 1 AS pos, 4294967295::BIGINT AS crc FROM x
  UNION ALL
  SELECT x, h, pos + 2, xor(v, crc >> 8) FROM s JOIN tab ON b = xor(crc, ('0x' || substr(h, pos, 2))::BIGINT) & 255 WHERE pos < length(h)
), c AS (
  SELECT x, xor(crc, 4294967295) % 10000 AS bucket FROM s WHERE pos > length(h)
), p AS (
  SELECT kind, r, bucket, sum(n)::BIGINT AS n FROM n JOIN c USING (x) GROUP BY ALL
), b AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS t FROM p GROUP BY bucket
), z AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM b) + 10000) / ((s + 1) * ((SELECT sum(t) FROM b) + 10000))))::BIGINT AS gain FROM b
), q AS (
  SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM p JOIN z USING (bucket) WHERE kind = 0 GROUP BY r
), v AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN q USING (r) WHERE kind = 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY n_words < 20 ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) FILTER (n_words >= 20) OVER () AS many FROM v
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= many * 5 // 100 THEN k END AS rank FROM o
"""
