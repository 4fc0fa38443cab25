"""Operators around models. Models are functions handed in; those here are deterministic stubs,
marked as such, that stand in where no model can run."""

from __future__ import annotations

import ast
import difflib
import hashlib
import math
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from ..functions.text import first_word, tokenize

DIMS = 64


def stub_embed(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """Signed feature hashing of words, unit length. A stub: it knows no meaning."""
    out = np.zeros((len(texts), dims), np.float32)
    for row, text in enumerate(texts):
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[row, h % dims] += 1 - 2 * (h >> 63)
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1)


def embedded(df: DataFrame, text: str = "text", out: str = "vector", embed: Callable[[list[str]], np.ndarray] = stub_embed, prefix: str = "") -> DataFrame:
    """Adds vectors, batch by batch; a query's instruction goes before each text."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(embed([prefix + (x or "") for x in b])))

    return df.withColumn(out, run(F.col(text)))


def stub_overlap(query: Column, passage: Column) -> Column:
    """A stub scorer: the share of the query's words that a passage has, as a logit."""
    q, p = F.array_distinct(tokenize(query)), tokenize(passage)
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(q, p)), F.size(q)), F.lit(0.0))
    return 8 * share - 4


def reranked(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """Hits re-scored by the sigmoid of a logit; ties keep the order they had."""
    from .retrieval import ranked

    again = hits.withColumnRenamed("rank", "was").withColumn("score", 1 / (1 + F.exp(-score)))
    return ranked(again, ["query_id"], [F.desc(F.round("score", 9)), F.asc("was")], k).drop("was")


def greedy_distinct(hits: DataFrame, most: float) -> DataFrame:
    """Per query, best first, keeps a hit if its cosine to every kept one is at most `most`. The
    lists are ranked result lists, short by construction, so a query's list is one group."""

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        kept: list[np.ndarray] = []
        mark = []
        for v in rows["vector"]:
            v = np.asarray(v, float)
            n = np.linalg.norm(v)
            near = any(n and np.linalg.norm(w) and float(v @ w) / (n * np.linalg.norm(w)) > most for w in kept)
            mark.append(not near)
            if not near:
                kept.append(v)
        return rows[mark]

    return hits.groupBy("query_id").applyInPandas(keep, hits.schema)


def graded(hits: DataFrame, reply: Column) -> DataFrame:
    """Passages whose one-word grade is not NO; what cannot be read stays."""
    return hits.withColumn("grade", first_word(reply)).filter("grade <> 'NO'")


def near_names(names: DataFrame, wanted: str, known: list[str], count: int = 3, ratio: float = 0.6) -> DataFrame:
    """Up to three known names similar to each unknown one."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda x: difflib.get_close_matches(x or "", known, count, ratio))

    return names.withColumn("near", run(F.col(wanted)))


# --- arithmetic on expressions

LONGEST, DEEPEST, LARGEST = 500, 64, 1e100
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
_CALLS = {"abs": abs, "round": round, "min": min, "max": max}


def calculate(expression: str) -> tuple[str | None, str | None]:
    """(result, error) of an arithmetic expression: numbers, + - * / // % **, abs, round, min, max."""

    def value(node: ast.AST):
        match node:
            case ast.Constant(value=bool()):
                raise ValueError("only numbers")
            case ast.Constant(value=int() | float() as x):
                return x
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -value(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return value(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                a, b = value(a), value(b)
                if isinstance(op, ast.Pow) and abs(b) > DEEPEST:
                    raise ValueError("exponent too large")
                out = _BINARY[type(op)](a, b)
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _CALLS:
                out = _CALLS[name](*map(value, args))
            case _:
                raise ValueError("unsupported expression")
        if isinstance(out, complex) or not math.isfinite(out) or abs(out) > LARGEST:
            raise ValueError("result too large")
        return out

    try:
        if len(expression) > LONGEST:
            raise ValueError("expression too long")
        out = value(ast.parse(expression.strip(), mode="eval").body)
    except (ValueError, SyntaxError, ArithmeticError, TypeError, RecursionError) as e:
        return None, str(e) or type(e).__name__
    return (str(out) if isinstance(out, int) else f"{out:.12g}"), None


def calculated(df: DataFrame, expression: str) -> DataFrame:
    """Adds `result` and `error`."""
    kind = StructType([StructField("result", StringType()), StructField("error", StringType())])

    @F.pandas_udf(kind)
    def run(b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([calculate(x or "") for x in b], columns=["result", "error"])

    return df.withColumn("_c", run(F.col(expression))).withColumns({"result": F.col("_c.result"), "error": F.col("_c.error")}).drop("_c")


def corrected(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], good: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], retries: int = 1) -> DataFrame:
    """Bounded correction: attempts until a query has surviving hits, rewriting those without.
    queries: query_id, text; the result says in which attempt each hit was found."""
    out = None
    for attempt in range(retries + 1):
        kept = good(retrieve(queries)).withColumn("attempt", F.lit(attempt))
        out = kept if out is None else out.unionByName(kept)
        queries = rewrite(queries.join(kept.select("query_id").distinct(), "query_id", "left_anti"))
    return out
