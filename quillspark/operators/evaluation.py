"""Comparing runs and checking samples."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import sign_test, z_for
from . import judging as J

#: The depths that recall at 100 and nDCG at 10 need.
STAGE_ONE_DEPTH, FINAL_DEPTH = 100, 10


def check_depths(stage_one: int, final: int) -> None:
    """Raises where headline metrics would be capped without a word."""
    for what, depth, least in (("stage 1", stage_one, STAGE_ONE_DEPTH), ("the final ranking", final, FINAL_DEPTH)):
        if depth < least:
            raise ValueError(f"{what} keeps {depth} results, its metric needs {least}")


def retrieval_scores(samples: DataFrame, hits: DataFrame, gold: DataFrame, depth: int) -> DataFrame:
    """samples (query_id and any labels) with hit, precision, rr and recall of their hits (query_id,
    id, rank) down to a depth against gold (query_id, id). A sample without hits scores 0."""
    judged = hits.filter(F.col("rank") <= depth).join(gold.select("query_id", "id", F.lit(1).alias("gain")), ["query_id", "id"], "left").na.fill(0, ["gain"])
    got = judged.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gain"))), lambda x: x["gain"]).alias("gains"))
    expected = gold.groupBy("query_id").agg(F.count_distinct("id").alias("expected"))
    rows = samples.join(got, "query_id", "left").join(expected, "query_id", "left")
    gains, wanted = F.coalesce("gains", F.array().cast("array<int>")), F.coalesce("expected", F.lit(0))
    found = F.aggregate(gains, F.lit(0), lambda s, g: s + g)
    return rows.select(*samples.columns, J.hit_rate(gains).alias("hit"), J.precision(gains).alias("precision"), J.reciprocal_rank(gains).alias("rr"), J.recall(found, wanted).alias("recall"))


def retrieval_report(scores: DataFrame, kind: str) -> DataFrame:
    """Means of retrieval_scores by kind and over all (`all`), with the number of samples."""
    means = [F.avg(m).alias(m) for m in ("hit", "precision", "rr", "recall")]
    return scores.rollup(kind).agg(F.count("*").alias("n"), *means, F.grouping(kind).alias("_all")).withColumn(kind, F.when(F.col("_all") == 1, "all").otherwise(F.col(kind))).drop("_all")


def pick_attempt(attempts: DataFrame, references: str, outputs: str, ref: str | None = None) -> str:
    """The ref of the one complete attempt (ref, status, references, outputs) that judged these
    references and outputs; raises if there is none, if there are several and none is named, or if
    the named one is another's. A run has few attempts."""
    rows = attempts.collect()
    fitting = [r["ref"] for r in rows if (r["status"], r["references"], r["outputs"]) == ("complete", references, outputs)]
    if ref is not None:
        if ref not in fitting:
            known = {r["ref"]: r for r in rows}
            why = "is unknown" if ref not in known else "isn't complete" if known[ref]["status"] != "complete" else "judged other references or outputs"
            raise ValueError(f"attempt {ref} {why}")
        return ref
    if len(fitting) != 1:
        others = any(r["status"] == "complete" for r in rows)
        raise ValueError(f"several attempts fit, name one: {fitting}" if fitting else "all complete attempts judged other references" if others else "there is no complete attempt")
    return fitting[0]


#: Paths of a run's record that must be equal for two runs to be compared, and the reason if not.
COMPARED = {
    "stage": "different stages", "dataset.selection": "different samples", "scores.dataset": "different labels", "scores.scorer": "different scorers",
    "scores.judge": "different judges", "scores.settings": "different scoring settings", "index.corpus": "different corpora",
}


def check_pair(base: Mapping, cand: Mapping, declared: Collection[str] = ()) -> list[str]:
    """Confounders of two runs' records: settings, code and builds that differ and are not declared
    as the treatment. Raises with every reason why the two can't be compared."""
    from .manifest import flattened

    a, b = flattened(base), flattened(cand)
    under = lambda path, top: path == top or path.startswith(f"{top}.")
    free = lambda path: any(under(path, d) for d in declared)
    differ = sorted(p for p in a.keys() | b.keys() if a.get(p) != b.get(p) and not free(p))
    if reasons := [why for top, why in COMPARED.items() if any(under(p, top) for p in differ)]:
        raise ValueError("the runs can't be compared: " + "; ".join(reasons))
    return [f"{p}: {a.get(p)!r} -> {b.get(p)!r}" for p in differ if any(under(p, top) for top in ("config", "code", "index", "filters"))]


def first_reason(checks: dict[str, Column]) -> Column:
    """The name of the first check that holds, null if none does."""
    return F.coalesce(*[F.when(hold, F.lit(name)) for name, hold in checks.items()])


def violations(checks: dict[str, Column]) -> Column:
    """The names of all checks that hold."""
    return F.filter(F.array(*[F.when(hold, F.lit(name)) for name, hold in checks.items()]), lambda x: x.isNotNull())


def pair_by_id(base: DataFrame, cand: DataFrame, ids: list[str], value: str = "value") -> DataFrame:
    """ids, base, cand of two runs; raises when a sample is in one run only."""
    a = base.select(*ids, F.col(value).alias("base"), F.lit(True).alias("_a"))
    b = cand.select(*ids, F.col(value).alias("cand"), F.lit(True).alias("_b"))
    both = a.join(b, ids, "full")
    whole = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    checked = F.when(whole, F.col("base")).otherwise(F.raise_error(F.lit("the runs do not hold the same samples")).cast("double"))
    return both.withColumn("base", checked).select(*ids, "base", "cand")


def paired(pairs: DataFrame, base: str, cand: str, group: str, confidence: float = 0.95) -> DataFrame:
    """One row: mean difference, its interval, wins, losses, sign-test p, and the half width that
    allows for groups. Sums by group carry all that the cluster-robust variance needs, so the rows
    are read once: sum((s - m n)^2) = sum(s^2) - 2 m sum(s n) + m^2 sum(n^2)."""
    d = (F.col(cand) - F.col(base)).cast("double")
    by_group = pairs.groupBy(group).agg(
        F.sum(d).alias("s"), F.sum(d * d).alias("q"), F.count("*").alias("c"),
        F.count_if(d > 0).alias("w"), F.count_if(d < 0).alias("l"),
    )
    total = by_group.agg(
        F.sum("c").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("w").alias("wins"), F.sum("l").alias("losses"), F.count("*").alias("groups"),
        F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("c")).alias("sc"), F.sum(F.col("c") * F.col("c")).alias("cc"),
    )
    n, z = F.col("n"), z_for(confidence)
    mean = F.col("s") / n
    half = F.when(n > 1, z * F.sqrt((F.col("q") - n * mean * mean) / F.nullif(n - 1, F.lit(0)) / n)).otherwise(F.lit(float("inf")))
    squares = F.col("ss") - 2 * mean * F.col("sc") + mean * mean * F.col("cc")
    wide = F.when(F.col("groups") > 1, z * F.sqrt(F.col("groups") / F.nullif(F.col("groups") - 1, F.lit(0)) * squares / (n * n))).otherwise(F.lit(float("inf")))
    return total.select("n", mean.alias("mean_diff"), (mean - half).alias("ci_low"), (mean + half).alias("ci_high"), "wins", "losses", sign_test(F.col("wins"), F.col("losses")).alias("p"), wide.alias("grouped_half"))
