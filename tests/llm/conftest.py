"""Small corpora with the odd rows that every operator must take."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeghilmnorst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, copies."""
    rng = random.Random(5)
    long_word, long_text = "x" * 300_000, sentence(rng, 30_000)
    block = "\n".join(sentence(rng, 12) for _ in range(3))
    base = sentence(rng, 80)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 4), (None, "no id " + sentence(rng, 30), "en", "b", 1),
        (4, long_word, "en", "b", 1), (5, long_text, "de", "a", 1), (6, block + "\n" + sentence(rng, 20), "en", "a", 1),
        (7, sentence(rng, 9) + "\n" + block + "\n" + sentence(rng, 9), "fr", "c", 1), (7, "same id, other text " + sentence(rng, 40), "fr", "c", 1),
        (8, base, "en", "c", 1), (9, base, "en", "c", 1), (9, base, "en", "c", 1), (10, base + " tail", "en", None, 1), (11, base.upper(), "en", "d", 1),
        (12, "one two three", "en", "a", 1), (13, "One two  three", "en", "a", 1), (14, "éß漢🙂 ​ 's 12", "en", "a", 1), (-5, "negative id", "en", "z", 1),
    ]
    near = base.split()
    for i in range(20):
        words = near[:]
        words[(7 * i) % 80] = f"w{i}"
        rows.append((100 + i, " ".join(words), "en", "hot", 1))
    rows += [(200 + i, sentence(rng, 5 + 3 * i), ["en", "fr", "de"][i % 3], "hot", 1) for i in range(30)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3, "n_chars")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return odd_rows()
