"""Answer turns over conversations and documents, by generators that SQL can follow."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import answering as A
from ..operators import retrieval as R
from .registry import Tables, query
from .retrieval import _bm25_sql

K = 4


def _digit(prompt: str) -> int:
    return int(hashlib.md5(prompt.encode()).hexdigest()[0], 16)


def _condense(prompts: list[str]) -> list[str]:
    """The follow-up's first six words."""
    return [" ".join(p.rsplit("\nFollow-up: ", 1)[1].split(" ")[:6]) for p in prompts]


def _grade(prompts: list[str]) -> list[str]:
    return ["Yes." if _digit(p) < 3 else "NO" for p in prompts]


def _rewrite(prompts: list[str]) -> list[str]:
    """Without the first word."""
    return [p.removeprefix("Rewrite: ").partition(" ")[2] for p in prompts]


def _generate(prompts: list[str]) -> list[str]:
    if any(_digit(p) == 0 for p in prompts):
        raise ValueError("the stub fails")
    return ["Answer " + hashlib.md5(p.encode()).hexdigest()[:8] for p in prompts]


def _check(prompts: list[str]) -> list[str]:
    return ["UNGROUNDED" if _digit(p) < 6 else "GROUNDED" for p in prompts]


STEPS = A.Steps(_condense, _grade, _rewrite, _generate, _check)
_TURN = "conv_id * 10000 + turn"
_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+(?:''[a-z]+)?')"
# The keyword ranking of each turn's queries: its first six words (a first turn's whole text), and
# those without the first one.
_ASKED = f"""u AS (SELECT {_TURN} AS turn_id, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN text ELSE array_to_string(string_split(text, ' ')[1:6], ' ') END AS query, role FROM conversations),
a AS (SELECT turn_id, 1 AS nth, query FROM u WHERE role = 'user' UNION ALL SELECT turn_id, 2, array_to_string(string_split(query, ' ')[2:], ' ') FROM u WHERE role = 'user'),
q AS (SELECT turn_id * 2 + nth AS query_id, token, count(*) AS times FROM (SELECT turn_id, nth, unnest({_TOKENS.format('query')}) AS token FROM a) GROUP BY ALL),
"""
_RANKED = re.sub(r"(?s)q AS \(.*?\n(?=s AS)", lambda _: _ASKED, _bm25_sql(k=K))
_SQL = _RANKED + f""",
h AS (SELECT a.turn_id, a.nth, a.query, k.rank, k.id, x.text, md5('Question: ' || a.query || chr(10) || 'Passage: ' || coalesce(x.text, '')) < '3' AS good FROM a JOIN k ON k.query_id = a.turn_id * 2 + a.nth JOIN documents x ON x.doc_id = k.id),
l AS (SELECT turn_id, nth, count(*) AS found, count(*) FILTER (good) AS kept FROM h GROUP BY ALL),
t AS (SELECT a.turn_id, coalesce(x.found, 0) AS found1, coalesce(x.kept, 0) AS kept1, coalesce(y.found, 0) AS found2, coalesce(y.kept, 0) AS kept2, a.query AS query1, b.query AS query2, trim(b.query) <> '' AS again
  FROM a JOIN a b ON b.turn_id = a.turn_id AND b.nth = 2 LEFT JOIN l x ON x.turn_id = a.turn_id AND x.nth = 1 LEFT JOIN l y ON y.turn_id = a.turn_id AND y.nth = 2 WHERE a.nth = 1),
v AS (SELECT *, CASE WHEN kept1 > 0 THEN 1 WHEN again AND kept2 > 0 THEN 2 END AS used, CASE WHEN kept1 = 0 AND again THEN 2 ELSE 1 END AS attempts FROM t),
c AS (SELECT turn_id, nth, query, '[' || row_number() OVER (PARTITION BY turn_id, nth ORDER BY rank) || '] ' || coalesce(text, '') AS line, rank FROM h WHERE good),
j AS (SELECT turn_id, nth, any_value(query) AS query, string_agg(line, chr(10) ORDER BY rank) AS passages FROM c GROUP BY ALL),
g AS (SELECT v.turn_id, md5('Question: ' || j.query || chr(10) || chr(10) || passages) AS one, md5('Question: ' || j.query || chr(10) || chr(10) || passages || chr(10) || 'The last answer went beyond the passages.') AS two, passages FROM v JOIN j ON j.turn_id = v.turn_id AND j.nth = v.used),
w AS (SELECT *, one < '1' AS fail1, two < '1' AS fail2, md5('Answer: Answer ' || substr(one, 1, 8) || chr(10) || chr(10) || passages) < '6' AS bad1, md5('Answer: Answer ' || substr(two, 1, 8) || chr(10) || chr(10) || passages) < '6' AS bad2 FROM g)
SELECT v.turn_id, v.attempts::INT AS attempts, CASE WHEN w.turn_id IS NULL THEN 0 WHEN fail1 OR NOT bad1 THEN 1 ELSE 2 END::INT AS generations,
  CASE WHEN w.turn_id IS NULL THEN CASE WHEN found1 > 0 OR (attempts = 2 AND found2 > 0) THEN 'graded_out' ELSE 'nothing_found' END
       WHEN fail1 OR (bad1 AND fail2) THEN 'failed' WHEN NOT bad1 OR NOT bad2 THEN 'answered' ELSE 'ungrounded' END AS outcome,
  CASE WHEN w.turn_id IS NULL OR fail1 OR (bad1 AND fail2) THEN NULL WHEN NOT bad1 THEN 'Answer ' || substr(one, 1, 8) ELSE 'Answer ' || substr(two, 1, 8) END AS answer
FROM v LEFT JOIN w USING (turn_id)"""

@query(_SQL)
def answered_turns(t: Tables) -> DataFrame:
    """Rows 287, 297-300, 399, 400, 407: every user turn condensed, retrieved for, graded, rewritten,
    answered, checked and answered again, with failures as rows."""
    index = R.keyword_index(t.documents, "doc_id", "text")
    texts = t.documents.select(F.col("doc_id").alias("id"), "text")

    def retrieve(asked: DataFrame) -> DataFrame:
        return R.keyword_top_k(asked, index, K).select("query_id", "id", "rank").join(texts, "id")

    earlier = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-4, -1)
    rows = t.conversations.withColumn("history", F.collect_list(F.struct("role", "text")).over(earlier)).filter("role = 'user'")
    turns = rows.select((F.col("conv_id") * 10_000 + F.col("turn")).alias("turn_id"), F.col("text").alias("question"), "history")
    out = A.answer_turns(turns, retrieve, STEPS)
    return out.select("turn_id", F.size("attempts").alias("attempts"), "generations", "outcome", "answer")
