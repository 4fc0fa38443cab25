"""The turn log as a stream: windows with watermarks, and totals kept by merging batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.storage import shared_folder


def windowed(events: DataFrame, width: str) -> DataFrame:
    """window_start, event_type, n, total; on a table or a stream."""
    groups = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", width).alias("w"), "event_type")
    return groups.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def read(spark: SparkSession, path: str, schema: StructType, files: int = 4) -> DataFrame:
    """The files at `path` (a pattern) as a stream; times without zone are read as UTC."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_windowed(spark: SparkSession, path: str, schema: StructType, width: str, late: str = "40 days") -> DataFrame:
    """All windows of the files at `path`. Each batch writes its state of the windows it touched
    under its number, so that a repeated batch replaces its own rows; the last state counts."""
    root = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    stream = windowed(read(spark, path, schema).withWatermark("ts", late), width)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    job = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    rows = spark.read.parquet(f"{root}/rows")
    return rows.groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))


def run_totals(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Totals by user: each batch adds its partial sums under its number, idempotently, and the
    reader adds them up."""
    root = f"{shared_folder(spark)}/totals-{uuid.uuid4().hex}"

    def add(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("user_id").agg(F.count("*").alias("turns"), F.sum("value").alias("total"), F.max("value").alias("most"))
        sums.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    job = read(spark, path, schema).writeStream.foreachBatch(add).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{root}/rows").groupBy("user_id").agg(F.sum("turns").alias("turns"), F.sum("total").alias("total"), F.max("most").alias("most"))
