"""Scans of corpora, evaluation files and logs as DataFrames.

Every reader goes through Spark's own readers, so paths may lie in any store that Spark reads.
A guard that the data must meet (unique ids, grades that are whole numbers) is an expression that
raises when a row breaks it, checked where the rows are used.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType
from pyspark.sql.window import Window as W

from ..functions.text import extension_kind, passage_text

DOCUMENT = StructType([StructField(n, StringType()) for n in ("id", "text", "source", "doc_type")] + [StructField("metadata", MapType(StringType(), StringType())), StructField("error", StringType())])
_FRONT = re.compile(r"\A---\n(.*?\n)---\n?", re.S)


def typed(value: str) -> str:
    """A front matter value as text: dates become YYYYMMDD numbers, quotes go, lists are JSON,
    truth values and nulls are spelled one way."""
    value = value.strip()
    if value[:1] == "[" and value[-1:] == "]":
        return json.dumps([typed(x) for x in re.findall(r"""\s*("[^"]*"|'[^']*'|[^,]+)""", value[1:-1])])
    if value.lower() in ("true", "yes", "on", "false", "no", "off"):
        return "true" if value.lower() in ("true", "yes", "on") else "false"
    if value in ("~", "null", "Null", "NULL"):
        return ""
    if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
        return value[1:-1]
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        return datetime.date.fromisoformat(value).strftime("%Y%m%d")
    return value


def split_front_matter(text: str) -> tuple[dict[str, str], str]:
    """The leading block of `key: value` lines and what follows it."""
    if not text.startswith("---\n"):
        return {}, text
    found = _FRONT.match(text)
    if not found:
        raise ValueError("front matter is not closed")
    fields, items, last = {}, {}, None
    for line in found[1].splitlines():
        if (item := re.match(r"\s*-\s+(.*)", line)) and last is not None and not fields[last]:
            items.setdefault(last, []).append(typed(item[1]))
        elif line.strip() and not line.lstrip().startswith("#"):
            key, colon, value = line.partition(":")
            if not colon or not key.strip() or line[0] in " -[":
                raise ValueError(f"front matter is no mapping: {line!r}")
            last = key.strip()
            fields[last] = typed(value)
    return {**fields, **{k: json.dumps(v) for k, v in items.items()}}, text[found.end() :]


def _read_file(path: str, kind: str, content: bytes) -> Iterator[tuple]:
    """(id suffix, text, metadata) of one file."""
    name = path.rsplit("/", 1)[-1]
    stem = name.rsplit(".", 1)[0]
    if kind == "pdf":
        try:
            import io

            from pypdf import PdfReader
        except ImportError as e:
            raise ValueError("no PDF reader is installed") from e
        reader = PdfReader(io.BytesIO(content))
        pages, title = reader.pages, (reader.metadata.title if reader.metadata else None) or stem
        for n, page in enumerate(pages, 1):
            yield f"#page={n}", page.extract_text() or "", {"title": title, "page": str(n), "page_count": str(len(pages))}
        return
    text = content.decode("utf-8", errors="replace")
    if kind == "markdown":
        fields, body = split_front_matter(text)
        heading = next((line.lstrip("# \t").strip() for line in body.split("\n") if line.lstrip().startswith("#")), stem)
        yield "", body, {"title": heading or stem, **fields}
    elif kind == "text":
        yield "", text, {"title": stem}
    else:
        for line in text.splitlines():
            if line.strip():
                row = json.loads(line)
                title = row.get("title") or ""
                yield row["_id"], f"{title} {row['text']}" if title else row["text"], {"title": title}


def corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All readable files under a folder as documents, and the failed ones as (source, error).
    Dot files and unknown extensions are passed over."""
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.withColumn("kind", extension_kind(F.col("path"))).filter(F.col("kind").isNotNull() & ~F.col("path").rlike(r"/\.[^/]*$"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = root.split("://")[-1].rstrip("/") + "/"
        for b in batches:
            rows = []
            for path, kind, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                relative = path.split(tail, 1)[-1]
                try:
                    for suffix, text, meta in _read_file(path, kind, content):
                        rows.append((suffix if kind == "passages" else relative + suffix, text, relative, kind, list(meta.items()), None))
                except (ValueError, KeyError) as e:
                    rows.append((None, None, relative, kind, [], f"{type(e).__name__}: {e}"))
            kinds = [pa.string()] * 4 + [pa.map_(pa.string(), pa.string()), pa.string()]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True)], names=DOCUMENT.names)

    rows = files.select("path", "kind", "content").mapInArrow(step, DOCUMENT)
    return rows.filter("error is null").drop("error"), rows.filter("error is not null").select("source", "error")


def fingerprint(spark: SparkSession, *folders: str) -> str:
    """16 digits over path, size and time of change of every file; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f.rstrip("/") for f in folders])
    row = F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    number = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return files.select(number.alias("n")).agg(F.substring(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum("n").cast("string")), 256), 1, 16)).first()[0]


def cached_corpus(spark: SparkSession, folder: str, cache: str) -> DataFrame:
    """The documents of a folder, parsed once: kept under the files' fingerprint, read again when
    any file is new, gone or changed."""
    path = f"{cache.rstrip('/')}/{fingerprint(spark, folder)}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        corpus(spark, folder)[0].write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def musique_samples(rows: DataFrame) -> DataFrame:
    """Multi-hop questions (id, question, answer, answer_aliases, paragraphs, question_decomposition)
    as samples with a part for each step; raises where steps, hops and supporting paragraphs
    disagree. A paragraph's id is the hash of its passage."""
    steps, paragraphs = F.col("question_decomposition"), F.col("paragraphs")
    passage = lambda p: passage_text(F.coalesce(p["title"], F.lit("")), p["paragraph_text"])
    name = lambda p: F.substring(F.sha2(passage(p), 256), 1, 16)
    held = F.transform(F.filter(paragraphs, lambda p: p["is_supporting"]), lambda p: F.struct(p["idx"].alias("idx"), passage(p).alias("text"), name(p).alias("source_id")))
    rows = rows.withColumn("_held", held).withColumn("hops", F.substring("id", 1, 1).cast("int"))
    own = lambda s: F.get(F.filter("_held", lambda p: p["idx"] == s["paragraph_support_idx"]), F.lit(0))
    parts = F.transform(steps, lambda s: F.struct(s["question"].alias("label"), s["answer"].alias("answer"), own(s)["text"].alias("span"), own(s)["source_id"].alias("source_id")))
    rows = rows.withColumn("parts", parts)
    ids = F.array_sort(F.array_distinct(F.transform("parts", lambda p: p["source_id"])))
    wrong = (
        F.when(F.size(steps) != F.col("hops"), "the steps are not the hops")
        .when(F.exists("parts", lambda p: p["source_id"].isNull()), "a step has no supporting paragraph")
        .when(ids != F.array_sort(F.array_distinct(F.transform("_held", lambda p: p["source_id"]))), "steps and supporting paragraphs disagree")
    )
    id = F.when(wrong.isNotNull(), F.raise_error(F.concat_ws(": ", "id", wrong)).cast("string")).otherwise(F.col("id"))
    spans = F.array_distinct(F.transform("parts", lambda p: p["span"]))
    return rows.select(
        id.alias("id"), F.col("question").alias("query"), F.col("answer").alias("expected_answer"), "answer_aliases", "hops",
        F.concat(F.col("hops").cast("string"), F.lit("hop")).alias("kind"), F.substring_index("id", "__", 1).alias("hop_type"), ids.alias("documents"), spans.alias("spans"), "parts",
    )


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table with fewer splits than there are cores (one small file, one row group),
    dealt to all of them; a table of more splits as it is. Reading is cheap, parsing texts isn't."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def guarded(df: DataFrame, column: str, broken, message: str) -> DataFrame:
    """df with an error for rows where `broken` holds."""
    kind = df.schema[column].dataType
    return df.withColumn(column, F.when(broken, F.raise_error(F.lit(message)).cast(kind)).otherwise(F.col(column)))


def passages(spark: SparkSession, path: str) -> DataFrame:
    """_id, title, text lines as id, text; a missing or repeated _id raises."""
    rows = spark.read.schema("_id string, title string, text string").json(path, mode="FAILFAST")
    rows = guarded(rows, "_id", F.col("_id").isNull() | F.col("text").isNull(), "a passage lacks _id or text")
    rows = guarded(rows, "_id", F.count("*").over(W.partitionBy("_id")) > 1, "a passage id is repeated")
    return rows.select(F.col("_id").alias("id"), passage_text(F.coalesce("title", F.lit("")), F.col("text")).alias("text"))


def queries(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("_id string, text string").json(path, mode="FAILFAST")
    rows = guarded(rows, "_id", F.count("*").over(W.partitionBy("_id")) > 1, "a query id is repeated")
    return rows.select(F.col("_id").alias("query_id"), "text")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, document, grade of a tab-separated file with the header query-id, corpus-id, score."""
    rows = spark.read.csv(path, sep="\t", header=True, enforceSchema=False, schema="`query-id` string, `corpus-id` string, score string", mode="FAILFAST")
    rows = guarded(rows, "score", ~F.col("score").rlike(r"^\d+$"), "a grade is no whole number")
    rows = guarded(rows, "score", F.count("*").over(W.partitionBy("query-id", "corpus-id")) > 1, "a judged pair is repeated")
    return rows.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("document"), F.col("score").cast("int").alias("grade"))


def run_file(spark: SparkSession, path: str) -> DataFrame:
    """query_id, document, score, rank of a run file; its rank column is ignored."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter("trim(value) <> ''").select(parts.alias("p"))
    rows = guarded(rows, "p", F.size("p") != 6, "a run line has not six fields")
    rows = rows.select(F.col("p")[0].alias("query_id"), F.col("p")[2].alias("document"), F.col("p")[4].cast("double").alias("score"))
    rows = guarded(rows, "score", F.count("*").over(W.partitionBy("query_id", "document")) > 1, "a document is ranked twice")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("document"))))


SAMPLE = "id string, query string, expected_answer string, tier string, matching_mode string, expected_spans array<variant>, expected_doc_ids array<variant>"


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation samples of one JSON array: spans and documents with grades, and the mode that
    a sample states or implies."""
    rows = spark.read.option("multiLine", True).schema(SAMPLE).json(path)
    text = lambda v, f: F.coalesce(F.try_variant_get(v, f"$.{f}", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    grade = lambda v: F.coalesce(F.try_variant_get(v, "$.grade", "int"), F.lit(1))
    none = F.array().cast("array<string>")
    spans = F.transform("expected_spans", lambda v: F.struct(text(v, "text").alias("text"), grade(v).alias("grade"), F.coalesce(F.try_variant_get(v, "$.alternatives", "array<string>"), none).alias("alternatives")))
    ids = F.transform("expected_doc_ids", lambda v: F.struct(text(v, "id").alias("id"), grade(v).alias("grade")))
    mode = F.coalesce("matching_mode", F.when(F.size("expected_spans") > 0, "span").otherwise("document"))
    return rows.select("id", "query", "expected_answer", "tier", mode.alias("mode"), spans.alias("spans"), ids.alias("documents"))


def turn_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Readable lines, and the texts of those that are not JSON."""
    rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.filter("_broken is null").drop("_broken"), rows.filter("_broken is not null").select("_broken")


def last_by_key(spark: SparkSession, path: str, key: str = "key", value: str = "context") -> DataFrame:
    """A cache of JSON lines: the last write of each key counts, torn lines are ignored. Lines are
    ordered by their place in the file."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("nth"), F.try_parse_json("value").alias("v")).filter("v is not null")
    rows = rows.select("nth", F.try_variant_get("v", f"$.{key}", "string").alias(key), F.try_variant_get("v", f"$.{value}", "string").alias(value)).filter(F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.max_by(value, "nth").alias(value))
