"""Places and order statistics against sorted lists; hot groups, hot values, infinities."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillspark.operators import corpus as C
from quillspark.operators import order as O


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    inf = float("inf")
    out = [("hot", rng.gauss(0, 1)) for _ in range(3000)] + [("hot", 0.25)] * 900 + [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(700)]
    out += [("same", 4.0)] * 400 + [("one", 9.5), ("ends", inf), ("ends", -inf), ("ends", -inf), ("ends", 3.0), ("ends", 3.0), (None, 1.0), (None, 2.0), ("none", None), ("huge", 1.7e308), ("huge", -1.7e308), ("huge", 5.0)]
    return out


def groups(rows):
    out: dict = {}
    for k, v in rows:
        if v is not None:
            out.setdefault(k, []).append(v)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("few", [30, 10_000])
def test_values_at(spark, rows, few):
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    known = groups(rows)
    asked = [(g, p) for g, v in known.items() for p in sorted({1, 2, len(v) // 3 + 1, len(v) // 2, len(v), len(v) + 1, 0})] + [("absent", 1), ("none", 1)]
    got = O.values_at(df, ["g"], "v", spark.createDataFrame(asked, "g string, place long"), few=few).collect()
    want = {(g, p): known[g][p - 1] for g, p in asked if g in known and 0 < p <= len(known[g])}
    assert {(r["g"], r["place"]): r["value"] for r in got} == want and len(got) == len(want)


def test_quantiles(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[0] in ("hot", "same", "one", None)], "g string, v double")
    known = groups(rows)
    got = {r["g"]: (r["p50"], r["p95"]) for r in O.quantiles(df, ["g"], "v", {"p50": (F.col("n") + 1) / 2, "p95": 19 * (F.col("n") + 1) / 20}).collect()}
    assert set(got) == {"hot", "same", "one", None}
    for g, (p50, p95) in got.items():
        assert p50 == pytest.approx(statistics.median(known[g]))
        if len(known[g]) > 1:
            assert p95 == pytest.approx(statistics.quantiles(known[g], n=20)[-1])
    assert got["one"] == (9.5, 9.5) and O.quantiles(df.limit(0), ["g"], "v", {"x": F.lit(1)}).count() == 0


def test_smallest(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aab"), float(rng.choice([1, 2, 2, 2, 3, rng.random()]))) for i in range(600)] + [(700, None, 1.0), (701, "c", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    wanted = {"a": 150, "b": 500, "c": 3, None: 1, "absent": 2}
    n = spark.createDataFrame(list(wanted.items()), "g string, n long")
    got = sorted(r["id"] for r in O.smallest(df, ["g"], F.col("v"), n, "id").collect())
    want = [x for g, k in wanted.items() for x in [i for _, i in sorted((v, i) for i, h, v in rows if h == g and v is not None)][:k]]
    assert got == sorted(want)


def test_placed(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 5, None])) for i in range(500)]
    got = O.placed(spark.createDataFrame(rows, "id long, v long").repartition(7), F.col("v").desc_nulls_last(), "id", name="at").collect()
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [r["id"] for r in sorted(got, key=lambda r: r["at"])] == [i for i, _ in order] and sorted(r["at"] for r in got) == list(range(500))
    assert O.placed(spark.createDataFrame([], "id long"), "id").count() == 0


def test_samples(spark):
    """Quotas and turns over a group that holds most rows, by the draw's order."""
    rows = [(i, "big" if i % 10 else f"g{i % 3}") for i in range(900)]
    df = spark.createDataFrame(rows, "id long, g string")
    draw = {r["id"]: r["d"] for r in df.select("id", C.draw(F.col("id"), "s").alias("d")).collect()}
    by = {g: sorted((draw[i], i) for i, h in rows if h == g) for g in {h for _, h in rows}}
    taken = C.stratified(df, "g", "id", "s", 50).collect()
    assert len(taken) == 50
    for g, ordered in by.items():
        own = sorted(r["id"] for r in taken if r["g"] == g)
        assert own == sorted(i for _, i in ordered[: len(own)])
    turns = [(r["g"], r["id"]) for r in C.round_robin(df, "g", "id", "s", 9).collect()]
    assert sorted(turns) == sorted((g, ordered[k][1]) for g, ordered in by.items() for k in range(3) if (g, ordered[k][1]) in turns) and len(turns) == 9
