"""Quality rules whose cutoffs come from the corpus itself; DataFrame functions only.

Every document has a few whole-number measures (MEASURES): symbols and repeated words for each
thousand words, repeated lines for each thousand lines, and the mean length of a word in
hundredths. For each language and source, a quantile sketch of each measure is built: counts by
bucket, a bucket being all values that share their leading SIGNIFICANT bits, so that a quantile read
from it is low by less than one part in 2^(SIGNIFICANT - 1) and exact below 2^SIGNIFICANT. Sketches are
merged by adding counts: those of a language's sources give the language's, and those of all
languages the corpus's, so no value is looked at twice and no order of merging matters. A cell of
fewer than LEAST documents takes the limits of its language, and a language of fewer those of all.

The limits are q75 + FENCE * (q75 - q25) + slack above and, for word lengths, q25 - FENCE *
(q75 - q25) - slack below; the slack of a measure keeps a cell without any spread from rejecting
what barely differs. Fixed base rules come first (fewer than 50 words, or more than half of
the words in repeated windows): what fails those is neither kept nor sketched. The limits are joined
to the documents by language and source.

Only slim rows (no texts) are written and shuffled; the partial counts of a hot source are added
up before the shuffle, and the join reads a written table, so that a hot side can be split.

Defined results: a null text has no words and fails the base rules; null languages and sources are cells
of their own; repeated rows count each; an empty table gives an empty result. Other columns are not
read. Windows of words are compared by a 64-bit hash inside one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .secrets import bound
from .shared import BLANK, documents, materialize, text_of

WORD = f"[^{BLANK}]+"
SYMBOL = "[#*$%&|<>]"
#: Words of a window, least words, and the most of 100 words that may lie in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 3, 50, 50
#: Documents that a cell has at least if its own limits are used.
LEAST = 100
SIGNIFICANT, FENCE = 7, 3
#: Each measure with its slack, and whether small values are suspect too.
MEASURES = {"symbols": (100, False), "lines": (350, False), "repeats": (350, False), "length": (100, True)}


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of WINDOW words that the array holds twice or more."""
    n = F.size(words) - (WINDOW - 1)
    windows = F.arrays_zip(*[F.slice(words, k + 1, F.greatest(n, F.lit(0))).alias(f"w{k}") for k in range(WINDOW)])
    hashes = F.transform(windows, lambda w: F.xxhash64(*[w[f"w{k}"] for k in range(WINDOW)]))

    def covered(hashes: Column) -> Column:
        # In the order of hashes, those that equal a neighbour; then their places in order.
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
        places = bound(order, lambda s: F.transform(F.filter(beside(s), lambda x: (x["one"]["hash"] == x["before"]["hash"]) | (x["one"]["hash"] == x["after"]["hash"])), lambda x: x["one"]["at"]))
        lengths = lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(bound(F.sort_array(places), lengths), F.lit(0), lambda total, x: total + x)

    twice = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
    return F.when(n < 2, F.lit(0)).otherwise(bound(hashes, twice))


def beside(values: Column) -> Column:
    """Each element with the one before and the one after it."""
    none = F.slice(F.transform(values, lambda x: F.when(F.lit(False), x)), 1, 1)
    before = F.concat(none, F.slice(values, F.lit(1), F.size(values) - 1))
    return F.arrays_zip(values.alias("one"), before.alias("before"), F.slice(values, F.lit(2), F.size(values)).alias("after"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, and the base counts of each document."""
    text = text_of()
    rows = docs.select("doc_id", "lang", "source", text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{BLANK}]")))
    long = lambda c: c.cast("long")
    rows = rows.select(
        "doc_id", "lang", "source", long(F.size("words")).alias("n_words"), long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(F.regexp_count("text", F.lit(SYMBOL))).alias("n_symbols"), long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), long(repeated_words(F.col("words"))).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def measures() -> dict[str, Column]:
    """Whole numbers; only for documents that have words."""
    share = lambda part, whole, by: F.floor(F.col(part) * by / F.col(whole)).cast("long")
    return {
        "symbols": share("n_symbols", "n_words", 1000), "lines": share("n_dup_lines", "n_lines", 1000),
        "repeats": share("n_repeat_words", "n_words", 1000), "length": share("word_chars", "n_words", 100),
    }


def bucket(value: Column) -> Column:
    """The value with all bits but its leading SIGNIFICANT ones cleared."""
    spare = F.greatest(F.length(F.bin(value)) - SIGNIFICANT, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, spare), spare)


def sketches(rows: DataFrame) -> DataFrame:
    """level (0: language and source, 1: language, 3: all), lang, source, measure, bucket, n."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(value).alias("bucket")) for m, value in measures().items()]))
    cells = rows.filter(~F.col("base_failed")).select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))
    cells = materialize(cells.select("lang", "source", "measure", "bucket", "n"), "quality-sketches")
    keys = [F.col("measure"), F.col("bucket")]
    merged = cells.groupingSets([[*keys, "lang", "source"], [*keys, "lang"], keys], *keys, "lang", "source")
    return merged.agg(F.sum("n").alias("n"), F.grouping_id().alias("level")).withColumn("level", F.col("level") % 4)


def limits(found: DataFrame, least: int = LEAST, fence: int = FENCE) -> DataFrame:
    """of_lang, of_source and, for each measure, the least and most value of a document that is kept."""
    cell = ["level", "lang", "source"]
    upto = W.partitionBy(*cell, "measure").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = found.withColumn("until", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(W.partitionBy(*cell, "measure")))
    at = lambda quarter: F.min(F.when(4 * F.col("until") >= quarter * F.col("all"), F.col("bucket")))
    quarters = run.groupBy(*cell, "measure").agg(F.first("all").alias("all"), at(1).alias("low"), at(3).alias("high"))
    spread, slack = fence * (F.col("high") - F.col("low")), F.create_map(*[F.lit(x) for m, (s, _) in MEASURES.items() for x in (m, s)])[F.col("measure")]
    below = F.when(F.col("measure").isin([m for m, (_, small) in MEASURES.items() if small]), F.col("low") - spread - slack).otherwise(F.lit(0))
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    ends = quarters.withColumn("least", below).withColumn("most", F.col("high") + spread + slack)
    ends = ends.groupBy(*cell).agg(F.max("all").alias("all"), F.struct(*[pick(m, c).alias(f"{c}_{m}") for m in MEASURES for c in ("least", "most")]).alias("own"))
    ends = materialize(ends, "quality-limits")
    of = lambda level, name: ends.filter(F.col("level") == level).select(F.col("lang").alias(f"{name}_lang"), F.struct("all", "own").alias(name))
    cells = ends.filter("level = 0").select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), F.struct("all", "own").alias("cell"))
    rows = cells.join(of(1, "language"), F.col("of_lang").eqNullSafe(F.col("language_lang")))
    # The one row of the corpus, under each language.
    whole = ends.filter("level = 3").select("own").scalar()
    enough = lambda name: F.when(F.col(f"{name}.all") >= least, F.col(f"{name}.own"))
    return rows.select("of_lang", "of_source", F.coalesce(enough("cell"), enough("language"), whole).alias("own")).select("of_lang", "of_source", "own.*")


def judge_documents(docs: DataFrame, least: int = LEAST, fence: int = FENCE) -> DataFrame:
    """The rows of measured() with `kept`, and what each measure's limits were."""
    rows = materialize(measured(docs), "quality-measures")
    known = materialize(limits(sketches(rows), least, fence), "quality-cells")
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    inside = F.lit(True)
    for m, value in measures().items():
        inside = inside & value.between(F.col(f"least_{m}"), F.col(f"most_{m}"))
    out = rows.join(known, same, "left").withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(inside))
    return out.drop("of_lang", "of_source")


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_documents(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), p AS (
  SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d
), t AS (
  SELECT r, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY r ORDER BY i)
), two AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM t WHERE c IS NOT NULL) WHERE k > 1
), rep AS (
  SELECT r, count(DISTINCT i + j)::BIGINT AS k FROM two, range(3) g(j) GROUP BY r
), m AS (
  SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.k, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), v AS (
  SELECT r, lang, source, unnest(['symbols', 'lines', 'repeats', 'length']) AS measure,
         unnest([1000 * n_symbols // n_words, 1000 * n_dup_lines // n_lines, 1000 * n_repeat_words // n_words, 100 * word_chars // n_words]) AS x
  FROM f WHERE NOT base_failed
), b AS (
  SELECT lang, source, measure, x >> greatest(length(bin(x)) - 7, 0) << greatest(length(bin(x)) - 7, 0) AS bucket FROM v
), s AS (
  SELECT grouping(lang, source) AS level, lang, source, measure, bucket, count(*) AS n FROM b
  GROUP BY GROUPING SETS ((measure, bucket, lang, source), (measure, bucket, lang), (measure, bucket))
), u AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS until, sum(n) OVER (PARTITION BY level, lang, source, measure) AS everything FROM s
), q AS (
  SELECT level, lang, source, measure, max(everything) AS everything, min(bucket) FILTER (4 * until >= everything) AS lo, min(bucket) FILTER (4 * until >= 3 * everything) AS hi
  FROM u GROUP BY ALL
), e AS (
  SELECT level, lang, source, measure, everything, CASE WHEN measure = 'length' THEN lo - 3 * (hi - lo) - 100 ELSE 0 END AS least,
         hi + 3 * (hi - lo) + CASE measure WHEN 'lines' THEN 350 WHEN 'repeats' THEN 350 ELSE 100 END AS most
  FROM q
), j AS (
  SELECT v.r, bool_and(x BETWEEN CASE WHEN c.everything >= 100 THEN c.least WHEN l.everything >= 100 THEN l.least ELSE a.least END
                     AND CASE WHEN c.everything >= 100 THEN c.most WHEN l.everything >= 100 THEN l.most ELSE a.most END) AS inside
  FROM v
  JOIN e c ON c.level = 0 AND c.measure = v.measure AND c.lang IS NOT DISTINCT FROM v.lang AND c.source IS NOT DISTINCT FROM v.source
  JOIN e l ON l.level = 1 AND l.measure = v.measure AND l.lang IS NOT DISTINCT FROM v.lang
  JOIN e a ON a.level = 3 AND a.measure = v.measure
  GROUP BY v.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, false) AS kept
FROM f LEFT JOIN j USING (r)
"""
