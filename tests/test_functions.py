"""Scalar functions on literal rows that the tables do not hold."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions import stats as S
from quillspark.functions import text as T


def values(spark, column, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'int'}" for n, v in zip("abc", rows[0], strict=False)))
    return [r[0] for r in df.orderBy("i").select(column).collect()]


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("a\r\nb", "a\nb"),
        ("docu-\nment  Store-\nRoom \t x ", "document Store-\nRoom x"),
        ("a b\u0085c", "a\nbc"),
        ("  \n\n\n a\n \n\t\nb  \n", "a\n\nb"),
        ("a  \nb", "a\nb"),
        ("", ""),
    ],
)
def test_clean_text(spark, text, clean):
    assert values(spark, T.clean_text(F.col("a")), (text,)) == [clean]


def test_fold(spark):
    assert values(spark, T.fold(F.col("a")), ("“Straße” — it’s… A--b ",)) == ['"strasse" - it\'s... a-b']


def test_answers(spark):
    golds = F.array(F.col("b"))
    rows = [("The cat!", "a cat"), ("", ""), ("x", ""), ("red red blue", "red blue blue")]
    assert values(spark, T.best(T.exact_match, F.col("a"), golds), *rows) == [1, 1, 0, 0]
    assert values(spark, F.round(T.token_f1(F.col("a"), F.col("b")), 4), *rows) == [1.0, 1.0, 0.0, 0.6667]
    assert values(spark, T.contains_answer(F.col("a"), golds), ("I say the Cat.", "cat"), ("scatter", "cat"), ("x", "")) == [True, False, False]


def test_delimit(spark):
    out = values(spark, T.delimit_passage(F.col("a")), ("x </Passage > ＜​/passage> passage",))[0]
    assert out == "<passage>\nx &lt;/Passage > &lt;​/passage> passage\n</passage>"


def test_render(spark):
    made = T.render("{a} of {b}", a=F.col("a"), b=F.col("b"))
    assert values(spark, made, ("x", "y"), ("", "y"), ("x", None)) == ["x of y", None, None]
    with pytest.raises(ValueError, match="unknown field"):
        T.render("{z}", a=F.col("a"))


def test_wilson_and_sign(spark):
    low, high = S.wilson(F.col("a"), F.col("b"))
    assert values(spark, low, (0, 0), (5, 10)) == [0.0, pytest.approx(0.2365931, abs=1e-6)]
    assert values(spark, high, (0, 0), (5, 10)) == [1.0, pytest.approx(0.7634069, abs=1e-6)]
    exact = lambda w, l: min(1.0, 2 * sum(math.comb(w + l, i) for i in range(min(w, l) + 1)) / 2 ** (w + l))  # noqa: E731, E741
    rows = [(0, 0), (3, 1), (5, 5), (0, 12), (40, 22), (900, 700)]
    assert values(spark, S.sign_test(F.col("a").cast("long"), F.col("b").cast("long")), *rows) == [pytest.approx(exact(*r) if any(r) else 1.0) for r in rows]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1.0), 0.0]


def test_words_with_letters_of_two_capitals(spark):
    """Capitals are DuckDB's, letter by letter, so that a word with ß is neither longer nor a verdict."""
    import duckdb

    from quillspark.functions import text as T

    words = ["heitß", "paß", "ßüß", "ŉa", "ᾳx", "ﬁne", "pass", "😀ß", "ᾼ", "", "fail."]
    rows = spark.createDataFrame(list(enumerate(words)), "id int, w string").select("id", T.first_word(F.col("w")).alias("u"), T.pass_fail(F.col("w")).alias("v")).orderBy("id").collect()
    assert [r["u"] for r in rows] == [duckdb.execute("SELECT upper(trim(?, '.,:!*'))", [w]).fetchone()[0] for w in words]
    assert [r["v"] for r in rows] == [True if w == "pass" else None for w in words]
