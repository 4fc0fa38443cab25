"""Relevance judgments: quotes in texts, graded metrics, rankings against labels."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window as W

#: Words of an anchor; quotes, and their characters, that one automaton holds at most.
ANCHOR, QUOTES, CHARACTERS = 3, 65_536, 1 << 20


def containment(texts: DataFrame, quotes: DataFrame, text: str = "body", quote: str = "quote") -> DataFrame:
    """Pairs of rows whose (folded) text contains the (folded) quote. A quote's inner words are
    whole words of any text that contains it, so texts and quotes of enough words meet by the
    hash of one inner run of words, an equi-join that scales with texts and quotes. Shorter quotes
    have no such run: one pass over the texts looks for all of them at once, however many words
    they have; so it is for all quotes if one automaton holds them."""
    words = lambda c: F.split(c, " ")
    run = lambda w, i: F.xxhash64(F.array_join(F.slice(w, i, ANCHOR), " "))
    quotes = quotes.filter(F.col(quote) != "")
    brief = F.size(words(F.col(quote))) < ANCHOR + 2
    n, size, short_n, short_size = quotes.agg(*[F.coalesce(F.sum(F.when(c, x)), F.lit(0)) for c in (F.lit(True), brief) for x in (F.lit(1), F.length(quote))]).first()
    if n <= QUOTES and size <= CHARACTERS:
        return searched(texts, quotes, text, quote, 1)
    marked = quotes.filter(~brief).withColumn("_w", words(F.col(quote)))
    middle = F.greatest(F.lit(2), F.floor(F.size("_w") / 2).cast("int"))
    anchors = marked.withColumn("_anchor", run(F.col("_w"), F.least(middle, F.size("_w") - ANCHOR))).drop("_w")
    # The words are bound once: as a column they would be split again for every run.
    every = lambda w: F.when(F.size(w) >= ANCHOR, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - ANCHOR + 1), lambda i: run(w, i))))
    runs = F.transform(F.array(words(F.col(text))), every)[0]
    # Hashes meet first, without the texts: a text has as many rows here as it has words.
    own = F.xxhash64(text).alias("_h")
    met = texts.select(own, F.explode(runs).alias("_anchor")).join(anchors.select("_anchor").distinct(), "_anchor", "left_semi").distinct()
    pairs = texts.select("*", own).join(met.join(anchors, "_anchor").drop("_anchor"), "_h").drop("_h")
    long = pairs.filter(F.contains(F.col(text), F.col(quote)))
    blocks = max(-(-short_n // QUOTES), -(-short_size // CHARACTERS))
    return long.unionByName(searched(texts, quotes.filter(brief), text, quote, blocks)) if blocks else long


def searched(texts: DataFrame, quotes: DataFrame, text: str, quote: str, blocks: int) -> DataFrame:
    """Pairs of rows whose text contains the quote, by automata of many quotes (Aho and Corasick):
    a pass over the texts for each of `blocks` hash ranges of quotes, whose cost doesn't depend on
    how many there are. Distinct quotes of a block are broadcast; rows of quotes join afterwards."""
    spark, found = texts.sparkSession, []
    kinds = StructType([*texts.schema.fields, StructField("_quote", StringType())])
    at = texts.columns.index(text)
    for i in range(blocks):
        some = quotes.filter(F.pmod(F.xxhash64(quote), F.lit(blocks)) == i) if blocks > 1 else quotes
        shared = spark.sparkContext.broadcast([r[0] for r in some.select(quote).distinct().collect()])

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for known in shared.value:
                automaton.add_word(known, known)
            automaton.make_automaton()
            for batch in batches:
                rows, seen = [], []
                for k, value in enumerate(batch.column(at).to_pylist() if shared.value else ()):
                    held = {q for _, q in automaton.iter(value)} if value else ()
                    rows += [k] * len(held)
                    seen += held
                if rows:
                    taken = batch.take(pa.array(rows, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(seen, pa.string())], names=kinds.names)

        found.append(texts.mapInArrow(find, kinds).join(some, F.col("_quote") == F.col(quote)).drop("_quote"))
    return reduce(DataFrame.unionByName, found)


def without(quotes: DataFrame, found: DataFrame, id: str) -> DataFrame:
    """Quotes that no text holds."""
    return quotes.join(found.select(id).distinct(), id, "left_anti")


def sharing(figures: DataFrame, id: str, figure: str) -> DataFrame:
    """id, others: for each id of distinct (id, figure) rows, how many other ids have one of its
    figures; ids that share none have no row. Ids with the same shared figures are one class with
    its size. A class of one figure needs the figure's count only, and the others meet by class, so
    that a figure which very many ids have makes rows by its distinct sets and not by its ids."""
    held = figures.groupBy(figure).agg(F.count("*").alias("n")).filter("n > 1")
    sets = figures.join(held.select(figure), figure).groupBy(id).agg(F.array_sort(F.collect_list(figure)).alias("_set"))
    classes = sets.groupBy("_set").agg(F.count("*").alias("_size")).withColumn("_class", F.xxhash64("_set"))
    parts = classes.select("_class", "_size", F.size("_set").alias("_many"), F.explode("_set").alias(figure))
    single = parts.filter("_many = 1").join(held, figure).select("_class", (F.col("n") - 1).alias("others"))
    near = parts.filter("_many > 1").select("_class", figure).join(parts.select(F.col("_class").alias("_other"), "_size", figure), figure)
    several = near.select("_class", "_other", "_size").distinct().groupBy("_class").agg((F.sum("_size") - 1).alias("others"))
    counts = single.unionByName(several)
    return sets.select(id, F.xxhash64("_set").alias("_class")).join(counts, "_class").select(id, "others")


# --- metrics over arrays of gains in rank order

def hit_rate(gains: Column) -> Column:
    return F.exists(gains, lambda g: g > 0).cast("double")


def precision(gains: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.filter(gains, lambda g: g > 0)), F.size(gains)), F.lit(0.0))


def reciprocal_rank(gains: Column) -> Column:
    first = F.array_position(F.transform(gains, lambda g: g > 0), True)
    return F.coalesce(F.try_divide(F.lit(1.0), first), F.lit(0.0))


def _discounted(gains: Column, value) -> Column:
    parts = F.transform(gains, lambda g, i: value(g) / F.log2(i.cast("double") + 2))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def dcg(gains: Column) -> Column:
    return _discounted(gains, lambda g: F.pow(F.lit(2.0), g) - 1)


def ndcg(gains: Column, ideal: Column) -> Column:
    best = dcg(ideal)
    return F.when(best > 0, dcg(gains) / best).otherwise(0.0)


def recall(covered: Column, expected: Column) -> Column:
    return F.when(expected > 0, covered / expected).otherwise(0.0)


def ndcg_cut(grades: Column, ideal: Column, k: int) -> Column:
    """Linear gains over the first k; both arrays in order, ideal holds all positive grades."""
    linear = lambda g: F.when(g > 0, g.cast("double")).otherwise(0.0)
    best = _discounted(F.slice(ideal, 1, k), linear)
    return F.when(best > 0, _discounted(F.slice(grades, 1, k), linear) / best).otherwise(0.0)


def score_rankings(queries: DataFrame, ranking: DataFrame, grades: DataFrame, k: int, depth: int) -> DataFrame:
    """query_id, ndcg, recall for every declared query; one without rows scores 0. ranking:
    query_id, document, rank; grades: query_id, document, grade."""
    judged = ranking.filter(F.col("rank") <= max(k, depth)).join(grades, ["query_id", "document"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    got = judged.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "grade"))), lambda x: x["grade"]).alias("grades"), F.count_if((F.col("rank") <= depth) & (F.col("grade") > 0)).alias("found"))
    ideal = grades.filter("grade > 0").groupBy("query_id").agg(F.sort_array(F.collect_list("grade"), asc=False).alias("ideal"))
    rows = queries.join(got, "query_id", "left").join(ideal, "query_id", "left")
    none = F.array().cast("array<int>")
    grades_, ideal_ = F.coalesce("grades", none), F.coalesce("ideal", none)
    return rows.select("query_id", ndcg_cut(grades_, ideal_, k).alias("ndcg"), recall(F.coalesce("found", F.lit(0)), F.size(ideal_)).alias("recall"))


def credit_once(hits: DataFrame) -> DataFrame:
    """query_id, rank, spans (array<struct<grade, span>> that the chunk holds) -> with `gain`: each
    chunk in rank order earns the best span that none before it has claimed. The walk over a
    query's list is one aggregate over its array."""
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "spans"))).alias("rows"))
    zero = F.struct(F.array().cast("array<int>").alias("claimed"), F.array().cast("array<struct<rank:int,gain:int,span:int>>").alias("out"))

    def step(state: Column, row: Column) -> Column:
        free = F.filter(row["spans"], lambda s: ~F.array_contains(state["claimed"], s["span"]))
        best = F.array_max(free)
        gain = F.coalesce(best["grade"], F.lit(0))
        claimed = F.when(best.isNull(), state["claimed"]).otherwise(F.array_append(state["claimed"], best["span"]))
        return F.struct(claimed.alias("claimed"), F.array_append(state["out"], F.struct(row["rank"].alias("rank"), gain.alias("gain"), best["span"].alias("span"))).alias("out"))

    walked = rows.select("query_id", F.explode(F.aggregate("rows", zero, step, lambda s: s["out"])).alias("x"))
    return walked.select("query_id", "x.rank", "x.gain", "x.span")


def recall_at(hits: DataFrame, depths: list[int], expected: DataFrame) -> DataFrame:
    """query_id, depth, recall: spans covered by the first ranks; hits: query_id, rank, span."""
    first = hits.filter(F.col("span").isNotNull()).groupBy("query_id", "span").agg(F.min("rank").alias("rank"))
    each = expected.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths])))
    joined = each.join(first, "query_id", "left").groupBy("query_id", "expected", "depth").agg(F.count_if(F.col("rank") <= F.col("depth")).alias("covered"))
    return joined.select("query_id", "depth", recall(F.col("covered"), F.col("expected")).alias("recall"))


def latest(rows: DataFrame, by: list[str], order: Column, value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.max_by(value, order).alias(value))


def numbered(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
