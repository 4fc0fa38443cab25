"""Sample sets: authored samples assembled, several composed into one, plants checked, scores compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .evaluation import violations
from .judging import containment


def _distinct_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def assembled(sources: DataFrame, splits: DataFrame, fresh: list[str], drafted_with: str, drafted_on: str) -> DataFrame:
    """Authored samples with all that follows from them. sources: id, query, family, behavior,
    answer, spans, docs, companies, tags (arrays) and parts (array<struct<label, answer, available,
    spans, docs>>); null arrays are empty. splits: company, split. A company without a split is in
    `unknown`; companies of several splits, or none at all, are `mixed`. fresh: companies that
    are new entities."""
    none = F.array().cast("array<string>")
    parts = F.coalesce(F.col("parts"), F.filter("parts", lambda p: F.lit(False)))
    given = lambda name: F.coalesce(F.col(name), none)
    of_parts = lambda name: F.coalesce(F.flatten(F.transform(parts, lambda p: F.coalesce(p[name], none))), none)
    docs = F.concat(given("docs"), F.array_except(of_parts("docs"), given("docs")))
    made = sources.withColumn("expected_doc_ids", docs)
    tickers = F.transform("expected_doc_ids", lambda d: F.substring_index(d, "_", 1))
    made = made.withColumn("companies", _distinct_sorted(F.concat(given("companies"), tickers)))
    found = made.select("id", F.explode("companies").alias("company")).join(splits, "company", "left")
    found = found.groupBy("id").agg(F.collect_set(F.coalesce("split", F.lit("unknown"))).alias("in"))
    made = made.join(found, "id", "left")
    has_parts = F.coalesce(F.size("parts") > 0, F.lit(False))
    return made.select(
        "id",
        "query",
        "expected_doc_ids",
        F.when(has_parts, of_parts("spans")).otherwise(given("spans")).alias("expected_spans"),
        F.col("answer").alias("expected_answer"),
        F.when(F.col("behavior") == "refuse", "refusal").otherwise("fresh").alias("tier"),
        F.col("family").alias("kind"),
        "family",
        given("tags").alias("tags"),
        "behavior",
        "companies",
        F.array_join("companies", "+").alias("group"),
        F.when(F.size("in") == 1, F.get("in", F.lit(0))).otherwise("mixed").alias("split"),
        F.when(F.arrays_overlap("companies", F.array(*map(F.lit, fresh)).cast("array<string>")), "new_entity").otherwise("fresh_fact").alias("transfer"),
        "parts",
        F.lit(drafted_with).alias("drafted_with"),
        F.lit(drafted_on).alias("drafted_on"),
        F.lit("pending").alias("verdict"),
    )


def composed(spec: DataFrame, sources: DataFrame) -> DataFrame:
    """Samples of several parts. spec: id, kind, query, conclusion, parts (array<struct<source,
    label, answer, spans>>): a part with spans stands by itself (its document is the source's name
    before ::), others take spans, documents and, where they state none, the answer of the source
    sample (id, expected_spans, expected_doc_ids, expected_answer). Fails on a source that is not
    there or has no spans or answer."""
    parts = spec.select("id", "kind", "query", "conclusion", F.posexplode("parts").alias("nth", "part"))
    theirs = sources.select(F.col("id").alias("source"), "expected_spans", "expected_doc_ids", "expected_answer")
    met = parts.withColumn("source", F.col("part.source")).join(theirs, "source", "left")
    own = F.col("part.spans").isNotNull()
    usable = F.coalesce((F.size("expected_spans") > 0) & (F.col("expected_answer") != ""), F.lit(False))
    told = F.concat(F.col("id"), F.lit(": no usable source sample "), F.coalesce("source", F.lit("")))
    spans = F.when(own, F.col("part.spans")).when(usable, F.col("expected_spans")).otherwise(F.raise_error(told).cast("array<string>"))
    docs = F.when(own, F.array(F.substring_index("source", "::", 1))).otherwise(F.col("expected_doc_ids"))
    answer = F.when(own, F.col("part.answer")).otherwise(F.coalesce(F.nullif("part.answer", F.lit("")), "expected_answer"))
    row = F.struct("nth", F.col("part.label").alias("label"), answer.alias("answer"), spans.alias("spans"), F.col("source").alias("source_id"), docs.alias("docs"))
    whole = met.groupBy("id", "kind", "query", "conclusion").agg(F.array_sort(F.collect_list(row)).alias("parts"))
    answers = F.array_join(F.transform("parts", lambda p: F.concat(p["label"], F.lit(": "), p["answer"])), "; ")
    end = F.when(F.col("conclusion") != "", F.concat(F.lit(". Conclusion: "), F.col("conclusion"))).otherwise("")
    return whole.select(
        "id",
        "kind",
        "query",
        F.lit("multihop").alias("tier"),
        F.flatten(F.transform("parts", lambda p: p["spans"])).alias("expected_spans"),
        _distinct_sorted(F.flatten(F.transform("parts", lambda p: p["docs"]))).alias("expected_doc_ids"),
        F.concat(answers, end).alias("expected_answer"),
        F.transform("parts", lambda p: F.struct(*[p[n].alias(n) for n in ("label", "answer", "spans", "source_id")])).alias("parts"),
        "conclusion",
    )


def in_scope(scope: Column, metadata: Column) -> Column:
    """Whether metadata has one of the values that a scope (map of field to values) allows, for
    every field of it; an empty or null scope allows all."""
    allowed = lambda e: F.coalesce(F.array_contains(e["value"], F.get(F.filter(F.map_entries(metadata), lambda m: m["key"] == e["key"]), F.lit(0))["value"]), F.lit(False))
    return F.coalesce(F.forall(F.map_entries(scope), allowed), F.lit(True))


def plant_problems(cases: DataFrame, docs: DataFrame) -> DataFrame:
    """case_id, problems of planted cases. cases: case_id, attack, target_document, off_scope_ticker,
    scope (map<string,array<string>>), canary, false_figure, text, header_suffix; docs: document_id,
    text, metadata (map<string,string>). Texts are searched by their words, not case by case."""
    named = docs.withColumn("metadata", F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit("document_id"), "document_id")))
    slim = named.select("document_id", "metadata")
    some = lambda name: F.col(name).isNotNull() & (F.col(name) != "")

    canaries = cases.filter(some("canary")).select("case_id", F.lower("canary").alias("quote"))
    bare = docs.select("document_id", F.lower("text").alias("body"))
    seen = containment(bare, canaries).select("case_id").distinct().withColumn("canary_seen", F.lit(True))

    padded = lambda c: F.concat(F.lit(" "), T.normalize_answer(c), F.lit(" "))
    figures = cases.filter(some("false_figure") & (T.normalize_answer(F.col("false_figure")) != "")).select("case_id", "scope", padded(F.col("false_figure")).alias("quote"))
    holders = containment(docs.select("document_id", padded(F.col("text")).alias("body")), figures).join(slim, "document_id")
    true = holders.filter(in_scope(F.col("scope"), F.col("metadata"))).select("case_id").distinct().withColumn("figure_seen", F.lit(True))

    tickers = slim.select(F.col("metadata")["ticker"].alias("off_scope_ticker")).filter("off_scope_ticker is not null").distinct().withColumn("ticker_known", F.lit(True))
    targets = slim.select(F.col("document_id").alias("target_document"), F.col("metadata").alias("target"))
    met = cases.join(targets, "target_document", "left").join(tickers, "off_scope_ticker", "left").join(seen, "case_id", "left").join(true, "case_id", "left")
    ticker = F.create_map(F.lit("ticker"), F.col("off_scope_ticker"))
    plant = F.concat(F.coalesce("text", F.lit("")), F.coalesce("header_suffix", F.lit("")))
    problems = violations({
        "target_not_in_corpus": F.col("target").isNull(),
        "off_scope_ticker_not_in_corpus": some("off_scope_ticker") & F.col("ticker_known").isNull(),
        "target_out_of_scope": F.col("target").isNull() | ~in_scope(F.col("scope"), F.col("target")),
        "canary_in_corpus": F.col("canary_seen").isNotNull(),
        "false_figure_in_scope": F.col("figure_seen").isNotNull(),
        "off_scope_ticker_in_scope": some("off_scope_ticker") & in_scope(F.col("scope"), ticker),
        "empty_plant": (F.col("attack") != "control") & (T.normalize_answer(plant) == ""),
    })
    return met.select("case_id", problems.alias("problems"))


def parity(ours: DataFrame, theirs: DataFrame, places: int = 4) -> DataFrame:
    """metric, compared, worst: the largest difference between rounded scores and another scorer's
    (query_id, metric, value; means as query `all`). Fails on a query that only the other has."""
    met = theirs.withColumnRenamed("value", "their").join(ours.withColumnRenamed("value", "own"), ["query_id", "metric"], "left")
    told = F.concat(F.lit("unknown query "), F.col("query_id"))
    apart = F.when(F.col("own").isNull(), F.raise_error(told).cast("double")).otherwise(F.abs(F.round("own", places) - F.col("their")))
    return met.groupBy("metric").agg(F.count("*").alias("compared"), F.max(apart).alias("worst"))
