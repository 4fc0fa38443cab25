"""Exact n-gram Jaccard self-join with a token-group matrix.

Texts with equal shingle sets are one class. Two classes link if 100 |intersection| >= 75 |union|;
each then shares ceil(0.75 n) of its n tokens with the other. In steps:

1. Support. Of every class the first half of its tokens, in hash order, is counted: how many of
   them another class holds. A class that misses more than n - ceil(0.75 n) links with nothing and
   is done. Counts are exact and take in every text; tokens that a task holds twice are counted
   there, so a passage that very many documents share travels once from each task.
2. Partition. What is left gets min-hash signatures. Classes whose signatures look alike to the
   least class of a min-hash value, a star and never all pairs, make families: similar documents.
   This only decides who is compared with whom cheaply; no link rests on it.
3. Inside a family all classes are compared by token-group matrices (links.Block): families are
   dealt into blocks, a block meets those of fitting size, and a task opens only the groups whose
   token union can hold enough of a set's tokens. A large family first gets a core, the tokens
   that most of some of its sets hold, and its sets are given by their differences from it
   (links). Pairs near enough to the core link for certain; they are counted by running sums over
   distances, without pairs. Only sets that can have other links go to blocks, and of these only
   the differences. The core decides who is compared, not who links.
4. Across families the matrix is a table. Support is counted again, by tokens that another family
   holds, first over half of the tokens, then over all; few classes stay. Their tokens are
   ordered by the exact number of holders, rarest first, and of a set that has s of its n
   tokens in other families the first s - ceil(0.75 n) + 1 must hold one of any partner's. Rows
   (token, group) hold the unions of those tokens by group, with the sizes in it; a class counts
   its hits by group, from the smaller family to the larger, and opens the groups whose bound
   reaches the needed overlap. Opened groups go to tasks as in step 3, whole sets and all.
5. Links are counted by class; components over them get the smallest doc_id in them.

Every pair of linked sets is in one family (3) or in two (4); no cap is set on groups, partners or
candidates. Hot keys: equal texts are reduced to a class first; a family of very many near copies
is dealt in blocks; tables are written before they are joined, so that skewed joins split.

Defined results: null, empty and blank texts have no shingles and are components of themselves;
rows that repeat a doc_id are rows of their own, each with its result; null doc_ids lose to others
as the smallest; an empty table gives an empty result; other columns are not read. Tokens are
64-bit hashes of shingles, classes 64-bit digests of sets, rows are told apart by doc_id and a
64-bit hash of the text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .links import GROUP, SIMILAR, apart, count_links, limit
from .shared import documents, forget, map_texts, materialize, text_batches
from .shingles import digest, shingle_set

#: Min-hash values of a signature, those that classes meet by, and equal ones that look alike.
SIGNATURE, MEET, ALIKE = 24, 8, 10
#: Tokens that a task counts at once, and tokens of a range of hashes that one task sums.
COUNTED, RANGE = 1 << 21, 1 << 20
#: Classes of a block while a family has no more than FEW blocks of a size, and tokens of a block.
MEMBERS, FEW, TOKENS = 256, 16, 1 << 20
#: Members of a block at most, and sets, about, that make the core of a family of over MEMBERS.
WIDE, CORE = 1 << 14, 64
#: Classes that ask one opened group in one task.
ASKING = 4096
#: A table of ids is broadcast up to this many (16 bytes each), else it is shuffled.
FEW_IDS = 1 << 20

_FACTORS = np.random.default_rng(77).integers(0, 1 << 64, SIGNATURE, np.uint64) | np.uint64(1)
_SUPPORT = "bucket int, flush long, classes array<long>, families array<long>, counts array<int>, sizes array<int>, tokens binary, many binary"


def signature(tokens: np.ndarray) -> np.ndarray:
    return np.array([int((tokens * f >> np.uint64(33)).min()) for f in _FACTORS], np.int32)


def _lists(arrays: list[np.ndarray], kind=np.int64) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(flat).view(kind)))


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), class, n_shingles."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_batches(batches):
            sets = [shingle_set(t) for t in texts]
            columns = [piece.column(0), piece.column(1), pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "class", "n_shingles"])

    return map_texts(docs.select("doc_id", "mark", "text"), step, "doc_id long, mark long, class long, n_shingles long")


#: (class, family, tokens) each; class -> family, size, first tokens.
Sets = Iterator[tuple[int, int, np.ndarray]]
Pool = dict[int, tuple[int, int, np.ndarray]]


def _runs(tokens: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)


def _counted(pool: Pool, flush: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows for the sets of a pool. One for each range of hashes: tokens that the task can't settle
    by itself, `counts` of them for each class, and in `many` the tokens that are shared here
    already, once each. And one, without tokens, with the sizes and what each class shares here."""
    classes, families = np.array(list(pool), np.int64), np.array([f for f, _, _ in pool.values()], np.int64)
    tokens = np.concatenate([t for _, _, t in pool.values()])
    owner = np.repeat(np.arange(len(classes), dtype=np.int32), [len(t) for _, _, t in pool.values()])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    start = _runs(tokens)
    shared = np.minimum.reduceat(families[owner], start) != np.maximum.reduceat(families[owner], start)
    each = np.repeat(shared, np.diff(np.append(start, len(tokens))))
    settled = np.bincount(owner[each], minlength=len(classes))
    yield _row(flush % buckets, flush, classes, None, settled, [n for _, n, _ in pool.values()], None, None)
    bucket = lambda t: ((t & np.uint64(0xFFFFFF)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)
    short = lambda t: (t >> np.uint64(24)).astype(np.uint32)
    many, rest, mine = tokens[start[shared]], tokens[~each], owner[~each]
    to, at = bucket(rest), bucket(many)
    order = np.lexsort((mine, to))
    rest, mine, to = short(rest[order]), mine[order], to[order]
    order = np.argsort(at, kind="stable")
    many, at = short(many[order]), at[order]
    edges, marks = np.searchsorted(to, np.arange(buckets + 1)), np.searchsorted(at, np.arange(buckets + 1))
    for b in np.flatnonzero((np.diff(edges) > 0) | (np.diff(marks) > 0)).tolist():
        here = mine[edges[b] : edges[b + 1]]
        first = _runs(here)
        who = here[first]
        yield _row(b, flush, classes[who], families[who], np.diff(np.append(first, len(here))), None, rest[edges[b] : edges[b + 1]].tobytes(), many[marks[b] : marks[b + 1]].tobytes())


def _row(bucket, flush, classes, families, counts, sizes, tokens, many) -> pa.RecordBatch:
    lists = lambda x, kind: pa.nulls(1, pa.list_(kind)) if x is None else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
    columns = [
        pa.array([bucket], pa.int32()), pa.array([flush], pa.int64()), lists(classes, pa.int64()), lists(families, pa.int64()),
        lists(counts, pa.int32()), lists(sizes, pa.int32()), pa.array([tokens], pa.binary()), pa.array([many], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SUPPORT.split(", ")])


def _arrays(table: pa.Table, *names: str) -> Iterator[tuple]:
    """flush and some list columns of each row, as numpy arrays; None for nulls."""
    for b in table.to_batches():
        columns = [b.column(name) for name in names]
        for i in range(b.num_rows):
            yield b.column("flush")[i].as_py(), *[c[i].values.to_numpy().astype(np.int64) if c[i].is_valid else None for c in columns]


def _summed(table: pa.Table) -> pa.Table:
    """One row for each row of a range of hashes: of a pool's tokens in it, those that two
    families hold, by class. Rows without tokens pass."""
    rows = list(_arrays(table, "classes", "families", "counts", "sizes"))
    told = [(flush, classes, counts, sizes) for flush, classes, _, counts, sizes in rows if sizes is not None]
    own = [i for i, r in enumerate(rows) if r[4] is None]
    if own:
        raw = lambda name: [np.frombuffer(table[name][i].as_buffer(), np.uint32) for i in own]
        tokens, many = np.concatenate(raw("tokens")), np.unique(np.concatenate(raw("many")))
        family = np.concatenate([rows[i][2] for i in own])
        owner = np.repeat(np.arange(len(family)), np.concatenate([rows[i][3] for i in own]))
        found = np.zeros(len(family), np.int64)
        if len(tokens):
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            start = _runs(tokens)
            shared = np.minimum.reduceat(family[owner], start) != np.maximum.reduceat(family[owner], start)
            if len(many):
                at = np.minimum(np.searchsorted(many, tokens[start]), len(many) - 1)
                shared |= many[at] == tokens[start]
            found = np.bincount(owner[np.repeat(shared, np.diff(np.append(start, len(tokens))))], minlength=len(family))
        end = 0
        for i in own:
            flush, classes, *_ = rows[i]
            here = found[end : end + len(classes)]
            end += len(classes)
            told.append((flush, classes[here > 0], here[here > 0], np.zeros((here > 0).sum(), np.int64)))
    return pa.table({"flush": pa.array([t[0] for t in told], pa.int64()), "classes": _lists([t[1] for t in told]), "shared": _lists([t[2] for t in told]), "sizes": _lists([t[3] for t in told])})


def _settled(table: pa.Table) -> pa.Table:
    """class: those of a pool that have enough shared tokens among their first ones."""
    parts = [p[1:] for p in _arrays(table, "classes", "shared", "sizes")]
    classes, shared, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    classes, at = np.unique(classes, return_inverse=True)
    n = np.zeros(len(classes), np.int64)
    np.maximum.at(n, at, sizes)
    held = np.bincount(at, shared, len(classes)).astype(np.int64)
    return pa.table({"class": classes[held >= (n + 1) // 2 - (n - -(-SIMILAR * n // 100))]})


def supported(df: DataFrame, read: Callable[[Iterator[pa.RecordBatch]], Sets], total: int) -> DataFrame:
    """class: those of which other families hold enough of the first half of their tokens to link.
    `read` makes (class, family, sorted tokens) of a task's rows; total: tokens of all of them.
    Copies of a class in several tasks are counted each by itself."""
    buckets = min(1 << 24, max(1, math.ceil(total / 2 / RANGE)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: Pool = {}
        size, flush = 0, TaskContext.get().partitionId() << 32
        for name, family, tokens in read(batches):
            if not len(tokens) or name in pool:
                continue
            first = tokens[: (len(tokens) + 1) // 2].copy()  # a view would hold the whole set
            pool[name] = family, len(tokens), first
            size += len(first)
            if size >= COUNTED:
                yield from _counted(pool, flush, buckets)
                pool.clear()
                size, flush = 0, flush + 1
        if pool:
            yield from _counted(pool, flush, buckets)

    rows = map_texts(df, step, _SUPPORT)
    counts = rows.groupBy("bucket").applyInArrow(lambda t: _summed(t), "flush long, classes array<long>, shared array<long>, sizes array<long>")
    return counts.groupBy("flush").applyInArrow(lambda t: _settled(t), "class long").distinct()


def _least_common(n: Column) -> Column:
    """Tokens of a set of n that a linked one holds."""
    return F.ceil(F.lit(SIMILAR) * n / 100)


def _needed(n: Column, m: Column) -> Column:
    return F.ceil(F.lit(SIMILAR) * (n + m) / (100 + SIMILAR))


def _texts(batches: Iterator[pa.RecordBatch]) -> Sets:
    for _, texts in text_batches(batches):
        for t in texts:
            s = shingle_set(t)
            yield (d := digest(s)), d, s


def _stored(batches: Iterator[pa.RecordBatch]) -> Sets:
    for b in batches:
        for i in range(b.num_rows):
            yield b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].values.to_numpy().view(np.uint64)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, sign, tokens (whole sets) of the wanted rows (doc_id, mark, class)."""
    n = wanted.count()
    wanted = wanted.select(F.col("doc_id").alias("want"), F.col("mark").alias("like"), F.col("class").alias("of"))
    wanted = F.broadcast(wanted) if n <= FEW_IDS else wanted
    same = docs["doc_id"].eqNullSafe(F.col("want")) & (docs["mark"] == F.col("like"))
    rows = docs.select("doc_id", "mark", "text").join(wanted, same).select("of", "text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_batches(batches):
            sets = [shingle_set(t) for t in texts]
            if sets:
                yield pa.RecordBatch.from_arrays([piece.column(0), _lists([signature(s) for s in sets], np.int32), _lists(sets)], names=["class", "sign", "tokens"])

    return map_texts(rows, step, "class long, sign array<int>, tokens array<long>").dropDuplicates(["class"])


def alike(classes: DataFrame) -> DataFrame:
    """Pairs (a, b): classes and the least class that has one of their min-hash values, where the
    signatures look alike."""
    met = classes.select("class", "sign", F.posexplode(F.slice("sign", 1, MEET)).alias("nth", "value"))
    least = met.groupBy("nth", "value").agg(F.min(F.struct("class", "sign")).alias("least"), F.count("*").alias("n")).filter("n > 1")
    near = met.join(materialize(least.select("nth", "value", "least"), "least"), ["nth", "value"]).filter(F.col("class") != F.col("least.class"))
    same = F.aggregate(F.zip_with("sign", "least.sign", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return near.filter(same >= ALIKE).select(F.col("class").alias("a"), F.col("least.class").alias("b")).distinct()


_LINKS = "class long, links long, documents long, root long"


def _hinted(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= FEW_IDS else df


def cored(large: DataFrame) -> DataFrame:
    """Sets of large families by what differs from their family's core: family, class, class_size,
    n, core (its number of tokens), lost, apart, tokens, given (how many)."""
    chosen = large.filter(F.pmod(F.xxhash64("class"), F.ceil(F.col("members") / CORE)) == 0).select("family", "tokens")
    number = chosen.groupBy("family").agg(F.count("*").alias("chosen"))
    held = chosen.select("family", F.explode("tokens").alias("token")).groupBy("family", "token").agg(F.count("*").alias("held"))
    most = held.join(number, "family").filter("2 * held > chosen")
    cores = materialize(most.groupBy("family").agg(F.collect_list("token").alias("most")), "cores")
    tokens = cores.agg(F.sum(F.size("most"))).first()[0] or 0
    near = large.join(_hinted(cores, tokens), "family", "left").withColumn("most", F.coalesce("most", F.array().cast("array<long>")))
    near = near.withColumn("gone", F.array_except("most", "tokens")).withColumn("own", F.array_except("tokens", "most"))
    counts = [F.size(c).cast("long").alias(name) for c, name in (("most", "core"), ("gone", "lost"))]
    near = near.select("family", "class", "class_size", "n", *counts, F.concat("gone", "own").alias("tokens"))
    return materialize(near.withColumn("apart", apart(F.col("n"), F.col("lost"))).withColumn("given", F.size("tokens").cast("long")), "cored")


def certain(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links that the core alone makes, as count_links gives them, and the sets (slim) that can have
    others. Who is no more apart than what the limit leaves is counted by running sums over the
    distances of a family; there are no more of these than lengths and losses make."""
    bound = limit(F.col("core"))
    sums = near.groupBy("family", "core", "apart").agg(F.count("*").alias("sets"), F.sum("class_size").alias("rows"), F.min("class").alias("class"))
    sums = materialize(sums, "distances")
    ends = sums.groupBy("family").agg(F.min(F.struct("apart", "class")).alias("least"), F.max("apart").alias("most"))
    ends = ends.select("family", F.col("least.apart").alias("nearest"), F.col("least.class").alias("root"), "most")
    there = sums.select("family", F.col("apart").alias("place"), F.lit(0).alias("asks"), "apart", "sets", "rows")
    asked = sums.select("family", (bound - F.col("apart")).alias("place"), F.lit(1).alias("asks"), "apart", F.lit(0).alias("sets"), F.lit(0).alias("rows"))
    order = Window.partitionBy("family").orderBy("place", "asks").rowsBetween(Window.unboundedPreceding, 0)
    reach = there.unionByName(asked).select("family", "asks", "apart", F.sum("sets").over(order).alias("near"), F.sum("rows").over(order).alias("met"))
    reach = materialize(reach.filter("asks = 1").drop("asks").join(ends, "family"), "reach")
    found = near.drop("tokens").join(_hinted(reach, reach.count()), ["family", "apart"])
    itself = (2 * F.col("apart") <= bound).cast("long")
    sure = found.select("class", (F.col("near") - itself).alias("links"), (F.col("met") - itself * F.col("class_size")).cast("long").alias("documents"), "root").filter("links > 0")
    open_ = (F.col("apart") + F.col("most") > bound) & (F.col("given") > 0) & (limit(F.col("given")) >= F.col("apart") + F.col("nearest") - bound)
    return sure, found.filter(open_).select("family", "class", "class_size", "n", "core", "lost", F.col("given").alias("weight"))


def inside(known: DataFrame) -> DataFrame:
    """Links between classes of one family, as count_links gives them; known: class, class_size, n,
    family, members (of it), tokens."""
    near = cored(known.filter(F.col("members") > MEMBERS))
    sure, unsure = certain(near)
    plain = known.filter((F.col("members") > 1) & (F.col("members") <= MEMBERS))
    slim = plain.select("family", "class", "class_size", "n", F.lit(0).alias("core"), F.lit(0).alias("lost"), F.col("n").alias("weight"))
    several = slim.unionByName(unsure)
    # Sets that link lie in the same range of sizes or in neighbouring ones.
    ranged = materialize(several.withColumn("range", F.floor(F.log(F.col("n")) / (math.log(100 / SIMILAR) * 1.0001)).cast("int")), "ranged")
    sums = ranged.groupBy("family", "range").agg(F.count("*").alias("held"), F.sum("weight").alias("weight"))
    blocks = F.greatest(F.least(F.lit(FEW), F.ceil(F.col("held") / MEMBERS)), F.ceil(F.col("held") / WIDE), F.ceil(F.col("weight") / TOKENS)).cast("int")
    sums = sums.select("family", F.struct(F.col("range"), blocks.alias("blocks"), F.col("held"), F.col("weight")).alias("part")).groupBy("family").agg(F.collect_list("part").alias("parts"))
    total = lambda field: F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p[field])
    # A small family is one block, whatever its sizes.
    plan = sums.withColumn("small", (total("held") <= MEMBERS) & (total("weight") <= TOKENS))
    ranged = ranged.join(materialize(plan, "family-blocks"), "family")
    own = F.get(F.filter("parts", lambda p: p["range"] == F.col("range")), F.lit(0))["blocks"]
    block = F.struct(F.col("range").alias("range"), F.pmod(F.xxhash64("class"), own).cast("int").alias("nth"))
    zero = F.struct(F.lit(0).alias("range"), F.lit(0).alias("nth"))
    ranged = ranged.withColumn("block", F.when(F.col("small"), zero).otherwise(block))
    fitting = F.filter("parts", lambda p: F.abs(p["range"] - F.col("range")) <= 1)
    others = F.flatten(F.transform(fitting, lambda p: F.transform(F.sequence(F.lit(0), p["blocks"] - 1), lambda j: F.struct(p["range"].alias("range"), j.alias("nth")))))
    # A block meets those, itself too; a pair of blocks is one task's.
    dealt = ranged.withColumn("with", F.explode(F.when(F.col("small"), F.array(zero)).otherwise(others)))
    low, high = F.least("block", "with"), F.greatest("block", "with")
    places = ["family", low.alias("low"), high.alias("high")]
    dealt = materialize(dealt.select(*places, "class", "class_size", "n", "core", "lost", (F.col("block") == low).alias("asks"), (F.col("block") == high).alias("member")), "dealt")
    sets = plain.select("class", "tokens").unionByName(near.select("class", "tokens"))
    return sure.unionByName(dealt.join(sets, "class").groupBy("family", "low", "high").applyInArrow(lambda t: count_links(t), _LINKS))


def across(known: DataFrame, total: int) -> DataFrame:
    """Links between classes of different families; known: the columns of both of these."""
    half = materialize(supported(known.select("class", "family", "tokens"), _stored, total), "across-half")
    few = materialize(known.join(F.broadcast(half) if half.count() <= FEW_IDS else half, "class"), "across-sets")
    rows = few.select("class", "family", F.explode("tokens").alias("token"))
    held = rows.groupBy("token").agg(F.count("*").alias("holders"), F.min("family").alias("low"), F.max("family").alias("high")).filter("low != high").select("token", "holders")
    shared = rows.join(materialize(held, "across-tokens"), "token").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("holders", "token"))).alias("shared"))
    group = F.pmod(F.xxhash64("class"), F.ceil(F.col("members") / GROUP)).alias("group")
    kept = few.select("class", "family", "members", "n", group).join(shared, "class").filter(F.size("shared") >= _least_common(F.col("n")))
    first = F.slice("shared", F.lit(1), F.size("shared") - _least_common(F.col("n")).cast("int") + 1)
    kept = materialize(kept.select("class", "family", "members", "group", "n", first.alias("first")), "across-first")
    places = materialize(kept.select("class", "family", "members", "group", "n", F.explode("first.token").alias("token")), "across-places")

    # The matrix: tokens by group, with the sizes of the group's members; and who opens what.
    sizes = kept.groupBy("family", "group").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    union = places.select("token", "family", "members", "group").distinct().join(sizes, ["family", "group"])
    matrix = materialize(union.select("token", F.col("family").alias("other"), F.col("members").alias("size"), F.col("group").alias("opened"), "least", "most"), "matrix")
    n, most = F.col("n"), F.col("most")
    fits = (F.col("least") * SIMILAR <= n * 100) & (n * SIMILAR <= most * 100)
    hits = places.join(matrix, "token").filter((F.struct("members", "family") < F.struct(F.col("size").alias("members"), F.col("other").alias("family"))) & fits)
    hits = hits.groupBy("class", "other", "opened", "n", "least", "most").agg(F.count("*").alias("c"))
    # Of two sets the one whose first tokens end first, in the common order, has only its rest to
    # match besides those that both have among the first.
    smallest = F.greatest(F.col("least"), F.ceil(n * SIMILAR / 100))
    bound = F.col("c") + F.greatest(_least_common(n), _least_common(most)) - 1 >= _needed(n, smallest)
    opened = materialize(hits.filter(bound).select("class", F.col("other").alias("family"), F.col("opened").alias("group")), "opened")

    salts = opened.groupBy("family", "group").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("salts"))
    asking = opened.join(salts, ["family", "group"]).withColumn("salt", F.pmod(F.xxhash64("class"), F.col("salts")).cast("int")).drop("salts")
    sets = few.select("class", "class_size", "n", F.lit(0).alias("core"), F.lit(0).alias("lost"), "tokens")
    cells = ["family", "group", "salt", "class", "class_size", "n", "core", "lost", "tokens"]
    asking = asking.join(sets, "class").select(*cells, F.lit(True).alias("asks"), F.lit(False).alias("member"))
    member = kept.select("class", "family", "group").join(salts, ["family", "group"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    member = member.join(sets, "class").select(*cells, F.lit(False).alias("asks"), F.lit(True).alias("member"))
    return asking.unionByName(member).groupBy("family", "group", "salt").applyInArrow(lambda t: count_links(t), _LINKS)


def similar_rows(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n_shingles, class, class_size, component (a class), component_id, links,
    linked_rows for each row; class and component are null for empty sets."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    rows = materialize(describe(docs), "described")
    full = rows.filter("n_shingles > 0")
    total = full.agg(F.sum("n_shingles")).first()[0] or 0
    classes = full.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "mark")).alias("row"), F.count("*").alias("class_size"), F.first("n_shingles").alias("n"))
    classes = materialize(classes, "classes")
    left = materialize(supported(docs.select("doc_id", "text"), _texts, total), "supported")
    wanted = classes.join(left, "class").select("row.doc_id", "row.mark", "class")
    sets = materialize(sets_of(docs, wanted), "sets")
    near = components(alike(sets), "families").select(F.col("node").alias("class"), "root")
    named = classes.join(left, "class").join(near, "class", "left").select("class", "class_size", "n", F.coalesce("root", "class").alias("family"))
    members = named.groupBy("family").agg(F.count("*").alias("members"))
    named = materialize(named.join(members, "family"), "named")
    known = materialize(named.join(sets.drop("sign"), "class"), "known")
    forget(sets)
    links = materialize(inside(known).unionByName(across(known, named.agg(F.sum("n")).first()[0] or 0)), "links")
    roots = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")), "linked").select(F.col("node").alias("class"), F.col("root").alias("component"))
    counts = links.groupBy("class").agg(F.sum("links").alias("links"), F.sum("documents").alias("documents"))
    linked = classes.select("class", "doc_id").join(roots, "class").join(counts, "class")
    ids = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = linked.join(ids, "component").select("class", "component", "component_id", "links", "documents")
    # One row a class, then one a document: copies meet a table that has been written.
    found = materialize(classes.select("class", "class_size", F.col("doc_id").alias("alone")).join(linked, "class", "left"), "found")
    out = rows.join(found, "class", "left")
    none = F.col("n_shingles") == 0
    return out.select(
        "doc_id", "mark", "n_shingles", F.when(~none, F.col("class")).alias("class"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.when(~none, F.coalesce("component", "class")).alias("component"), F.when(none, F.col("doc_id")).otherwise(F.coalesce("component_id", "alone")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.when(none, 0).otherwise(F.col("class_size") - 1 + F.coalesce("documents", F.lit(0))).cast("long").alias("linked_rows"),
    )


def similar_links(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class, class_size, component, component_id; `links`, the number of other
    classes that a row's class links with, and `linked_rows`, the number of other rows: its copies
    and those classes' rows. Rows of one class have equal shingle sets and link with each other;
    the class of rows without shingles is null, and they link with nothing."""
    return similar_rows(docs).drop("mark")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id (nulls last); all without
    shingles. Of rows equal in doc_id and text one stays; of different texts under one id, the one
    with the least hash."""
    found = materialize(similar_rows(docs), "components-of-rows").filter("n_shingles > 0")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.col("mark").alias("mark"))).alias("first"))
    first = materialize(first.select("component", F.col("first.doc_id").alias("stays"), F.col("first.mark").alias("as")), "first-of-components")
    stays = F.col("doc_id").eqNullSafe(F.col("stays")) & (F.col("mark") == F.col("as"))
    known = found.join(first, "component").groupBy("doc_id", "mark").agg(F.max(stays).alias("stays"), F.count("*").alias("rows"))
    known = materialize(known.filter("not stays or rows > 1").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "stays"), "leaving")
    tagged = docs.withColumn("__own", F.xxhash64("text"))
    same = tagged["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (tagged["__own"] == F.col("__mark"))
    n = known.count()
    single = tagged.join(_hinted(known, n), same, "left_anti")
    # Rows that stand more than once and stay: one of them.
    again = tagged.join(_hinted(known.filter("stays"), n), same, "left_semi").dropDuplicates(["doc_id", "__own"])
    return single.unionByName(again).drop("__own")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_links(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "class_size", F.col("class").alias("class_id"), "links", "linked_rows")
