"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merging one pre-token of n bytes: its parts form a linked list over byte positions. Each adjacent
pair with a rank is a candidate, put into the bucket of that rank. Ranks that occur get a bit in a
bitmap of 256-bit words, and every word that is not zero a bit in the level above, so that the
lowest rank present is found by one find-first-set per level, whatever the number of candidates.
A bucket keeps its positions in a heap, which yields the leftmost one first, as merge order asks.
Merging does not search for the neighbours' old candidates: an entry is stale, and skipped, if its
position has been merged away or its pair no longer has the bucket's rank. The cost grows with n
and not with its square, so pre-tokens of megabytes do no harm.

Texts are cut by the pattern first. Each worker keeps the ids of short pre-tokens in a bounded
cache, since a corpus repeats few thousand of them; every entry was made by the queue.

Defined results: null and empty texts have no ids; lone special-token strings are ordinary text;
repeated rows get equal results; all columns but those named are kept, and a clashing output
column is replaced. Encoding and decoding are per row, so no key can be hot.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .shared import documents, map_texts, slices, text_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries of the per-worker cache, and the longest pre-token that it holds.
CACHE, CACHED_CHARS = 300_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    rank_of = ranks.get
    whole = rank_of(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n))  # where the part to the left starts
    pair = [rank_of(piece[i : i + 2]) for i in range(n - 1)]  # rank of this part with the next one; None: no pair
    pair += (None, None)
    buckets: dict[int, list[int]] = {}  # rank -> heap of positions
    words: dict[int, int] = {}  # rank >> 8 -> which of its 256 ranks have entries
    top = 0  # which words aren't zero
    for i, rank in enumerate(pair):
        if rank is not None:
            if rank in buckets:
                buckets[rank].append(i)  # positions come in order, and an ordered list is a heap
            else:
                buckets[rank] = [i]
                word = rank >> 8
                words[word] = words.get(word, 0) | 1 << (rank & 255)
                top |= 1 << word
    while top:
        word = (top & -top).bit_length() - 1
        bits = words[word]
        low = bits & -bits
        rank = word << 8 | low.bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            words[word] = bits = bits ^ low
            if not bits:
                top ^= 1 << word
        if pair[i] != rank:
            continue  # a stale entry
        gone = after[i]
        end = after[i] = after[gone]
        before[end] = i
        pair[gone] = None
        left = before[i]
        for at, rank in ((i, rank_of(piece[i : after[end]]) if end < n else None), (left, rank_of(piece[left:end]) if left >= 0 else None)):
            pair[at] = rank  # at -1 is the spare place at the end
            if rank is not None:
                if rank in buckets:
                    heappush(buckets[rank], at)
                else:
                    buckets[rank] = [at]
                    word = rank >> 8
                    words[word] = words.get(word, 0) | 1 << (rank & 255)
                    top |= 1 << word
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Encoder(dict):
    """Pre-token -> its ids as little-endian 32-bit integers. It fills itself: entries not used
    since the last turnover leave at the next, so there are never more than twice `most`."""

    def __init__(self, path: str, pattern: str, most: int = CACHE) -> None:
        super().__init__()
        self.most = most
        self.old: dict[str, bytes] = {}
        self.ranks = encoder_ranks(path)
        self.split = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


@lru_cache(maxsize=1)
def encoder_ranks(path: str) -> dict[bytes, int]:
    return read_ranks(path)


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str, most: int = CACHE) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path, pattern, most)


@lru_cache(maxsize=1)
def tokens(path: str) -> dict[int, bytes]:
    return {i: t for t, i in encoder_ranks(path).items()}


def _with(piece: pa.RecordBatch, added: dict[str, list]) -> pa.RecordBatch:
    values = [pa.array(x, pa.binary()) for x in added.values()]
    return pa.RecordBatch.from_arrays([*piece.columns, *values], names=[*piece.schema.names, *added])


def _mapped(df: DataFrame, names: list[str], step) -> DataFrame:
    df = df.drop(*names)
    return map_texts(df, step, StructType([*df.schema.fields, *[StructField(name, BinaryType()) for name in names]]))


def _decoded(ids: bytes | None, of: dict[int, bytes]) -> bytes:
    return b"".join(map(of.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def encode(df: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, column: str = "text", out: str = "ids") -> DataFrame:
    """Adds `out`: the ids as little-endian unsigned 32-bit integers. vocabulary: a rank file that
    executors can open; by default the installed one, looked up by each executor itself."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(vocabulary or public_tokenizers.path(VOCABULARY), pattern)
        for piece, texts in text_batches(batches, column):
            yield _with(piece, {out: [of.encode(t) for t in texts]})

    return _mapped(df, [out], step)


def decode(df: DataFrame, vocabulary: str | None = None, column: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds `out`: the bytes that the ids stand for."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokens(vocabulary or public_tokenizers.path(VOCABULARY))
        for piece in (p for b in batches for p in slices(b, b.schema.get_field_index(column))):
            ids = piece.column(piece.schema.get_field_index(column))
            yield _with(piece, {out: [_decoded(x.as_py(), of) for x in ids]})

    return _mapped(df, [out], step)


def encode_and_decode(df: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, column: str = "text", out: str = "ids", back: str = "decoded", cache: int = CACHE) -> DataFrame:
    """encode() and decode() in one worker a task, which holds one vocabulary for both. A worker keeps
    its `cache` as long as it lives: fewer entries take less memory and more time."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or public_tokenizers.path(VOCABULARY)
        there, again = encoder(path, pattern, cache), tokens(path)
        for piece, texts in text_batches(batches, column):
            ids = [there.encode(t) for t in texts]
            yield _with(piece, {out: ids, back: [_decoded(x, again) for x in ids]})

    return _mapped(df, [out, back], step)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded and again decoded texts."""
    done = encode_and_decode(docs.select("doc_id", "text"))
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
