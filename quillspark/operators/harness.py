"""The evaluation harness: samples, runs, attempts, stored outputs, tool results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import Z95

#: Fixed value: characters of a passage that a tool result shows.
SHOWN = 200


def matching_mode(stated: Column, spans: Column) -> Column:
    return F.coalesce(stated, F.when(F.size(spans) > 0, "span").otherwise("document"))


def rubric(tier: Column) -> Column:
    return F.when(tier == "refusal", "refusal").otherwise("answer")


def evidence_status(spans: Column, missing: Column) -> Column:
    """Null without spans, else whether none is missing."""
    return F.when(spans > 0, missing == 0)


def passed(judged: Column, failed: Column) -> Column:
    """A generation that failed is false without a judgment; else the judgment, which may be null."""
    return F.when(failed, False).otherwise(judged)


def evidence_recall(total: Column, missing: Column) -> Column:
    return F.coalesce(F.try_divide(total - missing, total), F.lit(1.0))


def tool_entry(rank: Column, score: Column, text: Column, start: Column) -> Column:
    """rank, rounded score, shortened text, offsets, and whether more can be read."""
    shown = F.when(F.length(text) > SHOWN, F.concat(F.substring(text, 1, SHOWN), F.lit("..."))).otherwise(text)
    return F.struct(rank.alias("rank"), F.round(score, 4).alias("score"), shown.alias("text"), start.alias("start"), (start + F.least(F.length(text), F.lit(SHOWN))).alias("end"), (F.length(text) > SHOWN).alias("more"))


def passage_name(document: Column, version: Column, start: Column, end: Column) -> Column:
    return F.concat(document, F.lit("@"), version, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def is_window(chunk: Column) -> Column:
    """Whether a passage was read as a window and not found by a search."""
    return F.startswith(chunk, F.lit("read:"))


def characters_read(calls: Column) -> Column:
    """Over array<struct<tool, status, start, end>>: the lengths of the reads that ran."""
    ran = F.filter(calls, lambda c: (c["tool"] == "read") & (c["status"] == "ok"))
    return F.aggregate(ran, F.lit(0).cast("long"), lambda n, c: n + c["end"] - c["start"])


def resumable(runs: DataFrame, identity: list[str]) -> DataFrame:
    """The newest unfinished run of each identity."""
    return runs.filter("status = 'running'").groupBy(*identity).agg(F.max_by("run_id", F.struct("started", "run_id")).alias("run_id"))


def completeness(expected: DataFrame, got: DataFrame, id: str) -> DataFrame:
    """id, problem: ids that a run repeats, lacks or has too many."""
    counts = got.groupBy(id).agg(F.count("*").alias("n"))
    both = expected.select(id, F.lit(True).alias("wanted")).join(counts, id, "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("n") > 1, "repeated")
    return both.select(id, problem.alias("problem")).filter("problem is not null")


def heading_paths(lines: DataFrame, by: str, order: str, line: str) -> DataFrame:
    """Lines with `path`: the open headings above each, the document's own title left out. The
    last heading of each level counts unless a shallower one came after it."""
    upto = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    mark = F.regexp_extract(line, r"^(#{1,6}) \S", 1)
    rows = lines.withColumn("_level", F.nullif(F.length(mark), F.lit(0))).withColumn("_title", F.regexp_extract(line, r"^#{1,6} (.*\S)", 1))
    at = lambda k: F.max(F.when(F.col("_level") == k, F.struct(F.col(order).alias("o"), F.col("_title").alias("t")))).over(upto)
    for k in range(1, 7):
        rows = rows.withColumn(f"_h{k}", at(k))
    parts = []
    for k in range(1, 7):
        open_ = F.col(f"_h{k}").isNotNull()
        for j in range(1, k):
            open_ = open_ & (F.col(f"_h{j}").isNull() | (F.col(f"_h{j}.o") < F.col(f"_h{k}.o")))
        if k == 1:  # a title on the first line is not part of paths
            open_ = open_ & (F.col("_h1.o") > 0)
        parts.append(F.when(open_, F.col(f"_h{k}.t")))
    path = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), " > ")
    return rows.withColumn("path", path).drop("_level", "_title", *[f"_h{k}" for k in range(1, 7)])


def filled_right(cells: DataFrame, by: list[str], order: str, label: str) -> DataFrame:
    """Empty header cells take the label to their left."""
    upto = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return cells.withColumn("filled", F.last(F.when(F.col(label) != "", F.col(label)), ignorenulls=True).over(upto))


def bonferroni(groups: int) -> float:
    """The quantile that keeps 95 % over several comparisons."""
    from statistics import NormalDist

    return Z95 if groups == 1 else NormalDist().inv_cdf(1 - 0.05 / groups / 2)
