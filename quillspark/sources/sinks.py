"""Sinks: run files, JSON lines, revisions that are written once, fan-out of a stream's batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_hash


def write_run(hits: DataFrame, path: str, tag: str) -> None:
    """query Q0 document rank score tag; ids with blanks are refused."""
    broken = F.col("query_id").cast("string").rlike(r"\s") | F.col("document").cast("string").rlike(r"\s")
    line = F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("Q0"), F.col("document").cast("string"), F.col("rank").cast("string"), F.col("score").cast("double").cast("string"), F.lit(tag))
    hits.select(F.when(broken, F.raise_error(F.lit("an id has blanks")).cast("string")).otherwise(line).alias("value")).write.text(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """Evaluation samples as one indented JSON array, in order of id; a set is small by nature, and
    one text is what its readers take."""
    rows = samples.select(F.struct(*[c for c in samples.columns]).alias("s"))
    text = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col("s.id").alias("id"), "s"))), lambda x: x["s"]), {"pretty": "true"})
    rows.agg(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_qrels_run(rankings: Mapping[str, DataFrame], scores: Mapping[str, DataFrame], folder: str, tag: str, settings: Mapping) -> None:
    """A run file for each stage, and under `scores` its scores by query with the settings."""
    for stage, hits in rankings.items():
        write_run(hits, f"{folder.rstrip('/')}/{stage}.trec", tag)
    told = F.lit(json.dumps(dict(settings), sort_keys=True, default=str))
    for stage, rows in scores.items():
        rows.withColumn("settings", told).write.mode("overwrite").json(f"{folder.rstrip('/')}/scores/stage={stage}")


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_once(rows: DataFrame, folder: str, name: str) -> str:
    """Under a name that its content decides; what is there already stays."""
    path = f"{folder.rstrip('/')}/{name}"
    rows.write.mode("ignore").parquet(path)
    return path


def revision(rows: DataFrame, *keys: str) -> str:
    """A content name: order-free over the rows' hashes."""
    number = F.conv(F.substring(F.sha2(F.to_json(F.struct(*keys)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(short_hash(F.concat_ws(":", F.count("*").cast("string"), F.sum(number).cast("string")))).first()[0]


def fan_out(sinks: Sequence[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: every sink gets every batch; the first failure is raised after all ran."""

    def write(batch: DataFrame, number: int) -> None:
        failed = None
        batch = batch.persist()
        try:
            for sink in sinks:
                try:
                    sink(batch, number)
                except Exception as e:  # noqa: BLE001
                    failed = failed or e
        finally:
            batch.unpersist()
        if failed:
            raise failed

    return write
