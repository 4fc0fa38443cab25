"""What an index was built with, and the guards before extending or querying it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import differences
from .evaluation import violations


def flattened(tree: Mapping, prefix: str = "") -> dict[str, object]:
    """Dotted path -> leaf."""
    out: dict[str, object] = {}
    for key, value in tree.items():
        path = f"{prefix}{key}"
        out |= flattened(value, f"{path}.") if isinstance(value, Mapping) else {path: value}
    return out


def overridden(tree: Mapping, path: str, value: object) -> dict:
    """A copy with one leaf replaced; an unknown path raises."""
    key, dot, rest = path.partition(".")
    if key not in tree:
        raise KeyError(path)
    return {**tree, key: overridden(tree[key], rest, value) if dot else value}


def fingerprint(tree: Mapping, without: Iterable[str] = ()) -> str:
    """16 digits over the sorted leaves, those under `without` left out."""
    drop = tuple(without)
    leaves = {k: v for k, v in flattened(tree).items() if not any(k == d or k.startswith(f"{d}.") for d in drop)}
    return hashlib.sha256(json.dumps(leaves, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]


def legacy_digest(value: object) -> str:
    """16 digits over a value's JSON with the separators and escapes that old records used."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:16]


def judge_identity(judge: Mapping, stage: str, rubric: object, parser: str, references: Iterable[Mapping]) -> dict:
    """What a verdict depends on besides the answer, and its fingerprint."""
    whole = {"judge": dict(judge), "stage": stage, "rubric": rubric, "parser": parser, "references": legacy_digest(sorted(references, key=lambda r: str(r["id"])))}
    return {**whole, "hash": legacy_digest(whole)}


def table(spark: SparkSession, tree: Mapping) -> DataFrame:
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in flattened(tree).items()], "key string, value string")


def mismatches(spark: SparkSession, built: Mapping, now: Mapping, sections: Iterable[str]) -> list[str]:
    """Paths under the sections whose values differ."""
    rows = differences(table(spark, built), table(spark, now)).filter(F.col("key").rlike("^(?:" + "|".join(sections) + r")\."))
    return sorted(r["key"] for r in rows.collect())


def check_extend(spark: SparkSession, built: Mapping | None, now: Mapping, reset: bool = False) -> None:
    """Raises if an index built otherwise would be extended; a reset may always start anew."""
    if built is not None and not reset and (wrong := mismatches(spark, built, now, ("chunk", "embed", "index"))):
        raise ValueError(f"the index was built with other settings: {wrong}")


def check_query(spark: SparkSession, built: Mapping, now: Mapping) -> None:
    """Raises if vectors of another model would be compared."""
    if wrong := mismatches(spark, built, now, ("embed",)):
        raise ValueError(f"the index holds other vectors: {wrong}")


def build_record(before: Mapping | None, digest: str) -> dict:
    """Keeps the build's id if nothing changed."""
    if before and before.get("digest") == digest:
        return {**before, "status": "complete"}
    return {"id": digest[:12], "digest": digest, "status": "complete"}


def readiness(labels: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Rows with the names of the checks that they break; an empty result means ready."""
    return labels.withColumn("problems", violations(dict(checks))).filter(F.size("problems") > 0)
