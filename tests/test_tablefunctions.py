"""Table functions of SQL against the DataFrame operators."""

from __future__ import annotations

import pytest

from quillspark.operators import chunking as C
from quillspark.operators import drafts as D
from quillspark.operators import tablefunctions as TF

TEXTS = [(1, "## A\n\nalpha beta. gamma delta epsilon.\n\n| h |\n|---|\n| 1 |\n| 2 |"), (2, None), (3, ""), (4, "word " * 120), (5, "Item 2. Management's Discussion of x. Item 3. Quantitative")]


@pytest.fixture(scope="module")
def docs(spark):
    TF.register(spark)
    df = spark.createDataFrame(TEXTS, "id long, text string")
    df.createOrReplaceTempView("texts")
    return df


def test_equal_to_operators(spark, docs):
    key = lambda rows: sorted(tuple(r) for r in rows)
    got = spark.sql("SELECT string(d.id), c.chunk_index, c.char_start, c.char_end, c.text FROM texts d, LATERAL fixed_chunks(d.text, 60, 20) c").collect()
    assert key(got) == key(C.fixed_chunks(docs, "id", "text", 60, 20).select("document_id", "chunk_index", "char_start", "char_end", "text").collect())
    got = spark.sql("SELECT string(d.id), c.* FROM texts d, LATERAL structured_chunks(d.text, 9, 2, 3, 'words') c").collect()
    want = C.structured_chunks(docs, "id", "text", 9, 2, least=3, length=TF.MEASURES["words"])
    assert key(got) == key(want.select("document_id", "chunk_index", "char_start", "char_end", "text", "section_path", "block_types").collect()) and len(got) > 12
    got = spark.sql("SELECT d.id, c.char_start, c.char_end FROM texts d, LATERAL section_candidates(d.text) c").collect()
    assert key(got) == key([(i, a, b) for i, t in TEXTS for a, b in D.section_candidates(t or "")]) and got


def test_partitions(spark, docs):
    got = spark.sql("SELECT nth, line FROM numbered_lines(TABLE(texts) PARTITION BY id) WHERE line <> ''").collect()
    assert sorted(tuple(r) for r in got) == sorted((n, x) for _, t in TEXTS for n, x in enumerate((t or "").split("\n")) if x)


@pytest.mark.parametrize(
    ("call", "message"),
    [("fixed_chunks(d.text, 10, 10)", "smaller than the size"), ("fixed_chunks(d.text, int(d.id), 1)", "constant"), ("structured_chunks(d.text, 9, 2, 3, 'miles')", "must be one of"), ("structured_chunks(d.text, 9, 2, 30, 'words')", "smaller than the size")],
)
def test_checked_when_planned(spark, docs, call, message):
    with pytest.raises(Exception, match=message):
        spark.sql(f"SELECT c.* FROM texts d, LATERAL {call} c")
