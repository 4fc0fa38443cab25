"""Line dedup by pairwise alignment.

Two distinct texts that share a line are an overlapping pair. A pair is aligned by patience diff
over the whole line sequences of both: unique common lines in longest increasing order are anchors,
then come the gaps between them. Runs of aligned lines are the common blocks of the pair, and a
block of `min_words` words or more is deleted from the later document. A line goes if any earlier
document gives it such a block: the result is that of aligning every overlapping pair, one by one.

That result is reached without making all pairs. Lines are counted exactly, and only those that two
texts hold (rare in any corpus) name pairs. First, each shared line of a document names its first
holder. What of the document's lines isn't deleted by those pairs names further holders, GROWTH times
as many in each round, until every line that is left has been tried with every earlier holder.
Holders that align alike are tried once: lines that one text alone holds can't be aligned, so a
holder is only its sequence of shared lines with the gaps between them (its outline), and of
holders with equal outlines the first stands for all. A hot line of one licence in a million texts has
few outlines; on real and planted corpora about one pair for each shared line of a document is
aligned. The worst case is a line that many different outlines hold and none of them aligns
(repeated more often than in any of them): it is tried with all of these.

Order counts: a line that both hold but that stands in another order than its neighbours, or once
more than in the earlier document, is not aligned by that pair. Lines that are blank neither start nor break a block; those between deleted lines go with them,
and all of them where no other line is left. "Later" is by (doc_id, text hash), null ids first.
Copies of a whole text are not aligned: the first one stands for all, and the others count as
aligned from end to end.

Defined results: null and empty texts are returned as they are; a document whose every line is
deleted has an empty text; rows equal in doc_id and text are one document and get equal results
(the first copy rule is about ids); an empty table gives an empty result. All columns of the input
are kept; `n_lines`, `removed` and `removed_words` replace clashing ones. Lines are compared by a
64-bit hash, outlines by two.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BLANK, documents, map_texts, materialize

#: Least words of a block that is deleted: 1 deletes every aligned line that is not blank.
MIN_WORDS = 1
#: Holders that a line is tried with in the second round, and by how much that grows in each further one.
GROWTH = 16

_KEY = ["doc_id", "t1", "t2"]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b) of two sequences, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        many, mine = Counter(a[i0:i1]), Counter(b[j0:j1])
        once = any(many[x] == 1 and n == 1 for x, n in mine.items())
        seen: Counter = Counter()
        at: dict = {}
        for i in range(i0, i1):
            x = a[i]
            if not once or (many[x] == 1 and mine[x] == 1):
                at[x, seen[x]] = i
                seen[x] += 1
        seen.clear()
        pairs = []
        for j in range(j0, j1):
            x = b[j]
            if (i := at.get((x, seen[x]))) is not None:
                pairs.append((i, j))
            seen[x] += 1
        anchors = increasing(pairs)
        if not anchors:
            continue
        out += anchors
        if once:  # without unique lines the anchors are all that is aligned here
            ends = [(i0 - 1, j0 - 1), *anchors, (i1, j1)]
            todo += [(p + 1, i, q + 1, j) for (p, q), (i, j) in zip(ends, ends[1:], strict=False) if i > p + 1 and j > q + 1]
    return sorted(out)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given in order of the second, that increases in the first; of
    equally long ones, from the end on, the one with the smallest first."""
    tails: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (i, _) in enumerate(pairs):
        at = bisect_left(tails, i)
        back.append(last[at - 1] if at else -1)
        if at == len(tails):
            tails.append(i)
            last.append(k)
        else:
            tails[at], last[at] = i, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def sequence(nth: list[int], lines: list[int], size: int, gap: str) -> tuple[list, list[int]]:
    """The shared lines of a text (their places among its lines with words, of which there are
    `size`) with `gap` where others stand, and the place of each."""
    out: list = []
    at: list[int] = []
    last = -1
    for n, x in zip(nth, lines, strict=True):
        if n > last + 1:
            out.append(gap)
            at.append(-1)
        out.append(x)
        at.append(n)
        last = n
    if size > last + 1:
        out.append(gap)
        at.append(-1)
    return out, at


def blocks(places: list[int], words: list[int], least: int) -> list[int]:
    """Of aligned places, in order, those in runs of `least` words or more."""
    out, run = [], []
    for at in [*places, None]:
        if run and at != run[-1] + 1:
            if least <= 1 or sum(words[j] for j in run) >= least:
                out += run
            run = []
        run.append(at)
    return out


def to_delete(words: list[int], gone: set[int]) -> list[int]:
    """Places of a document's lines that go, if of its lines with words those in `gone` do: blank
    lines (0 words) between what goes go too, and all if nothing else is left."""
    full = [j for j, n in enumerate(words) if n]
    if len(gone) == len(full):
        return list(range(len(words))) if gone else []
    out, blank, open_, k = [], [], False, 0
    for j, n in enumerate(words):
        if not n:
            blank.append(j)
            continue
        goes = k in gone
        out += [*(blank if open_ and goes else []), *([j] if goes else [])]
        blank, open_, k = [], goes, k + 1
    return out


def shared_lines(texts: DataFrame) -> DataFrame:
    """of, seq: array<nth, line, first holder> of the shared lines of each text in order, size (lines
    with words), words (of each), and the outline's hashes o1 and o2."""
    full = texts.select("of", F.filter("lines", lambda x: x.isNotNull()).alias("lines"), F.filter("words", lambda n: n > 0).alias("words"))
    held = full.select("of", F.posexplode("lines").alias("nth", "line"))
    shared = held.groupBy("line").agg(F.min("of").alias("first"), F.max("of").alias("last")).filter("first != last").select("line", "first")
    shared = materialize(shared, "shared")  # the join below then splits a hot line
    seqs = held.join(shared, "line").groupBy("of").agg(F.array_sort(F.collect_list(F.struct("nth", "line", "first"))).alias("seq"))
    seqs = materialize(seqs, "sequences")
    own = full.select("of", F.size("lines").alias("size"), "words")
    gap = lambda x, i: x["nth"] - F.coalesce(F.get("seq", i - 1)["nth"], F.lit(-1)) > 1
    outline = F.transform("seq", lambda x, i: F.struct(x["line"].alias("line"), gap(x, i).alias("gap")))
    ends = F.element_at("seq", -1)["nth"] + 1 < F.col("size")
    rows = seqs.join(own, "of").select("of", "seq", "size", "words", F.xxhash64(outline, ends).alias("o1"), F.xxhash64(F.lit("second"), outline, ends).alias("o2"))
    return materialize(rows, "outlines")


def align(pairs: DataFrame, seqs: DataFrame, least: int) -> DataFrame:
    """of, gone (places among the lines with words) of each pair (of, other)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for mine, size, theirs, other_size, words in zip(*(b.column(k).to_pylist() for k in range(3, 8)), strict=True):
                later, at = sequence([x["nth"] for x in mine], [x["line"] for x in mine], size, "a")
                earlier, _ = sequence([x["nth"] for x in theirs], [x["line"] for x in theirs], other_size, "b")
                found.append(blocks([at[j] for _, j in patience(earlier, later)], words, least))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.list_(pa.int32()))], names=[*_KEY, "gone"])

    slim = lambda seq: F.transform(seq, lambda x: F.struct(x["nth"].alias("nth"), x["line"].alias("line")))
    theirs = seqs.select(F.col("of").alias("other"), slim("seq").alias("theirs"), F.col("size").alias("other_size"))
    mine = seqs.select("of", slim("seq").alias("mine"), "size", "words")
    rows = pairs.join(theirs, "other").join(mine, "of").select("of.*", "mine", "size", "theirs", "other_size", "words")
    found = map_texts(rows, step, "doc_id long, t1 long, t2 long, gone array<int>")
    return found.filter(F.size("gone") > 0).select(F.struct(*_KEY).alias("of"), "gone")


def lines_left(seqs: DataFrame, gone: DataFrame) -> DataFrame:
    """of, line: what earlier texts hold and no pair has deleted yet."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, lines = [], []
            for i, (seq, found) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                went = {n for x in found or [] for n in x}
                left = list({x["line"] for x in seq if x["nth"] not in went})
                keys += [i] * len(left)
                lines += left
            picked = pa.array(keys, pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(picked) for c in b.columns[:3]), pa.array(lines, pa.int64())], names=[*_KEY, "line"])

    later = F.filter("seq", lambda x: x["first"] < F.col("of"))
    seqs = seqs.select("of", F.transform(later, lambda x: F.struct(x["nth"].alias("nth"), x["line"].alias("line"))).alias("seq")).filter(F.size("seq") > 0)
    rows = seqs.join(gone.groupBy("of").agg(F.collect_list("gone").alias("gone")), "of", "left").select("of.*", "seq", "gone")
    return map_texts(rows, step, "doc_id long, t1 long, t2 long, line long").select(F.struct(*_KEY).alias("of"), "line")


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text), removed (places of lines), removed_words: one row for
    each document that loses lines."""
    lines = F.split("text", "\n")
    slim = materialize(
        docs.filter(F.col("text").isNotNull()).select(
            "doc_id", *_hashes(),
            F.transform(lines, lambda x: F.when(x.rlike(f"[^{BLANK}]"), F.xxhash64(x))).alias("lines"),
            F.transform(lines, lambda x: F.regexp_count(x, F.lit(f"[^{BLANK}]+"))).alias("words"),
        ).dropDuplicates(_KEY),
        "lines",
    )
    first = slim.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    first = materialize(first, "first-copies")  # the join below then splits a hot text
    known = slim.join(first, ["t1", "t2"]).withColumn("copy", F.when(F.col("unnamed"), F.col("doc_id").isNotNull()).otherwise(F.col("doc_id") > F.col("first")))
    known = materialize(known.select(*_KEY, "copy", "lines", "words"), "texts")
    seqs = shared_lines(known.filter(~F.col("copy")).select(F.struct(*_KEY).alias("of"), "lines", "words"))

    # Each document with the first holder of each of its lines.
    pairs = seqs.select("of", F.explode(F.array_distinct(F.transform("seq", lambda x: x["first"]))).alias("other")).filter("other < of")
    gone = materialize(align(pairs, seqs, min_words), "aligned")
    left = materialize(lines_left(seqs, gone), "left")
    # What is left, with further holders of other outlines: those whose hash lies below a share
    # of the hashes that grows from round to round, by how many a line has.
    asked = left.select("line").distinct()
    held = seqs.select("of", "o1", "o2", F.explode(F.array_distinct(F.transform("seq", lambda x: F.struct(x["line"].alias("line"), x["first"].alias("first"))))).alias("x"))
    held = held.select("of", "o1", "o2", "x.line", "x.first").join(asked, "line", "left_semi").groupBy("line", "o1", "o2", "first").agg(F.min("of").alias("other")).filter("other != first")
    held = materialize(held.select("line", "o1", "other"), "holders")
    many = held.groupBy("line").agg(F.count("*").alias("many"))
    held = materialize(held.join(many, "line").withColumn("share", (F.col("o1") / F.lit(2.0**63) + 1) / 2 * F.col("many")), "holders-shares")
    tried, every = 0.0, held.agg(F.max("many")).first()[0] or 0
    all_gone = gone
    while tried < every:
        bound = GROWTH if not tried else tried * GROWTH
        upto = F.lit(True) if bound >= every else F.col("share") < bound
        some = held.filter((F.col("share") >= tried) & upto).select("line", "other")
        pairs = left.join(some, "line").filter("other < of").select("of", "other").distinct()
        gone = materialize(align(pairs, seqs, min_words), "aligned")
        all_gone, tried = all_gone.unionByName(gone), bound
        left = materialize(lines_left(seqs.join(left.select("of").distinct(), "of", "left_semi"), all_gone), "left")
    covered = all_gone.groupBy("of").agg(F.collect_list("gone").alias("gone"))
    losing = known.withColumn("of", F.struct(*_KEY)).join(covered, "of", "left").filter(F.col("copy") | F.col("gone").isNotNull())

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, total = [], []
            for copy, words, found in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                every = set(range(sum(n > 0 for n in words))) if copy else {n for x in found for n in x}
                removed.append(to_delete(words, every))
                total.append(sum(words[j] for j in removed[-1]))
            columns = [*b.columns[:3], pa.array(removed, pa.list_(pa.int32())), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*_KEY, "removed", "removed_words"])

    ready = losing.select(*_KEY, "copy", "words", "gone")
    done = map_texts(ready, decide, "doc_id long, t1 long, t2 long, removed array<int>, removed_words long")
    return materialize(done.filter(F.size("removed") > 0), "deletions")


def _hashes():
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, names: tuple[str, str, str] = ("n_lines", "removed", "removed_words")) -> DataFrame:
    """The documents with `text` without the deleted lines, and under `names` the number of lines
    before, the places of those deleted, and their words."""
    gone = deletions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_words)
    gone = gone.select(F.col("doc_id").alias("__d"), F.col("t1").alias("__g1"), F.col("t2").alias("__g2"), F.col("removed").alias("__removed"), F.col("removed_words").alias("__words"))
    docs = docs.drop(*names)
    t1, t2 = _hashes()
    rows = docs.withColumns({"__t1": t1, "__t2": t2})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("__t1") == F.col("__g1")) & (F.col("__t2") == F.col("__g2"))
    # A sort-merge join at every size: the deletions grow with the corpus and are never broadcast.
    rows = rows.join(gone.hint("merge"), same, "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__removed", i)), "\n")
    return rows.select(
        *[F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias(names[0]),
        F.coalesce("__removed", F.array().cast("array<int>")).alias(names[1]),
        F.coalesce("__words", F.lit(0)).cast("long").alias(names[2]),
    )


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
