"""Contiguous shards of nearly equal bytes from global prefix sums.

Documents stand in one global order: doc_id, then the text's CRC and size, then their place in
the input. Slim rows (no texts) are range-partitioned by that order and checkpointed, which fixes
the partitions for good: a lost executor cannot change them between the passes. Three passes
follow: the size and row count of each partition; from the running totals of those, the first row
of each shard; and the final numbers. Only one row per partition, then one per shard and
partition, reach the driver. A row belongs to the shard in which its middle byte falls when the
total is cut into equal targets, so a shard misses its target by less than the largest document.

Defined results: a null text has size 16 (the fixed cost) and CRC 0; equal rows and repeated
doc_ids keep their input order; rows with null doc_id come first; an empty table gives an empty
result; shards can be empty when there are fewer documents than shards or one document spans
several targets. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .shared import crc_of, documents, partitions, shared_folder, text_of

SHARDS = 40
#: Bytes that a document costs besides its text.
OVERHEAD = 16

_ROW = StructType([StructField("doc_id", LongType()), StructField("size", LongType()), StructField("text_crc32", LongType()), StructField("shard", IntegerType()), StructField("row", LongType())])


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (place inside the shard, from 0)."""
    spark = docs.sparkSession
    shared_folder(spark)
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_of()) + overhead).cast("long").alias("size"),
        crc_of(F.col("text")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("nth"),
    )
    order = ["doc_id", "text_crc32", "size", "nth"]
    fixed = (
        slim.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
        .drop("nth").checkpoint().withColumn("part", F.spark_partition_id())
    )
    totals = sorted(fixed.groupBy("part").agg(F.sum("size"), F.count("*")).collect())
    sizes, counts = ([0, *accumulate(r[k] for r in totals)] for k in (1, 2))
    starts = {r[0]: (sizes[i], counts[i]) for i, r in enumerate(totals)}
    total = sizes[-1]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = row = None
        for b in batches:
            if not b.num_rows:
                continue
            if size is None:
                size, row = starts[b.column(3)[0].as_py()]
            sizes = b.column(1).to_numpy()
            ends = size + sizes.cumsum()
            middle = ends - sizes / 2
            shard = np.minimum(shards - 1, (middle * (shards / total)).astype(np.int64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(shard), pa.array(np.arange(row, row + b.num_rows))], names=_ROW.names)
            size, row = int(ends[-1]), row + b.num_rows

    rows = fixed.select("doc_id", "size", "text_crc32", "part").mapInArrow(number, _ROW)
    first = {r[0]: r[1] for r in rows.groupBy("shard").agg(F.min("row")).collect()}
    if not first:
        return rows.select("doc_id", "size", "text_crc32", "shard", F.col("row").alias("slot"))
    begins = F.element_at(F.array(*[F.lit(int(first.get(s, 0))).cast("long") for s in range(shards)]), F.col("shard") + 1)
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("row") - begins).alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
