"""Quality rules, importance resampling and distinct counts, against plain Python over all rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import distinct, importance, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def base_counts(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(repeated)


def leading(x: int) -> int:
    spare = max(x.bit_length() - rules.SIGNIFICANT, 0)
    return x >> spare << spare


def brute_rules(rows: list[tuple], least: int) -> Counter:
    """Limits from all values of a cell, sorted, instead of sketches that are merged."""
    known = []
    for d, text, lang, source, *_ in rows:
        n, chars, symbols, lines, dup, rep = base_counts(text)
        failed = n < 50 or 100 * rep > 50 * n
        values = None if failed else [1000 * symbols // n, 1000 * dup // lines, 1000 * rep // n, 100 * chars // n]
        known.append((d, lang, source, (n, chars, symbols, dup, rep), failed, values))
    cells = defaultdict(list)
    for _, lang, source, _, _, values in known:
        if values:
            for key in ((lang, source), (lang,), ()):
                cells[key].append(values)

    def inside(lang, source, values) -> bool:
        cell = next(c for key in ((lang, source), (lang,), ()) if len(c := cells[key]) >= least or not key)
        for k, (x, (slack, small)) in enumerate(zip(values, rules.MEASURES.values(), strict=True)):
            ordered = sorted(leading(v[k]) for v in cell)
            low, high = (ordered[-(-q * len(ordered) // 4) - 1] for q in (1, 3))
            if x > high + rules.FENCE * (high - low) + slack or small and x < low - rules.FENCE * (high - low) - slack:
                return False
        return True

    return Counter((d, *counts, failed, not failed and inside(lang, source, values)) for d, lang, source, counts, failed, values in known)


@pytest.mark.parametrize("least", [3, 100])
def test_rules(odd, rows, least):
    junk = [(600 + i, "a b c " * 40, "en", "hot", 1) for i in range(2)] + [(610 + i, " ".join(f"w{i}x{k} ###" for k in range(60)), "en", None, 1) for i in range(3)]
    docs = odd.unionByName(odd.sparkSession.createDataFrame(junk, odd.schema)).withColumn("kept", F.lit("clash")).withColumn("most_length", F.lit(0))
    got = rules.judge_documents(docs, least).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = brute_rules([*rows, *junk], least)
    assert Counter(map(tuple, got)) == want
    assert {x[-1] for x in want} == {True, False}


def test_rules_none(none):
    assert rules.judge_documents(none).count() == 0


def test_rules_keep_clean(spark):
    """No document marked as good is turned away but by the base rules, and no other one stays."""
    kept = rules.op11_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("not base_failed")
    found = {(r["quality"], r["kept"]): r["count"] for r in kept.groupBy("quality", "kept").count().collect()}
    assert found.get((1, False), 0) <= 0.01 * found[1, True] and found.get((0, True), 0) <= 0.05 * found[0, False]


def runs(text: str | None) -> tuple[Counter, int]:
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)), len(w)


def brute_weights(rows: list[tuple], target: list) -> Counter:
    known = [(r[0], *runs(r[1])) for r in rows]
    own, wanted = sum((c for _, c, _ in known), Counter()), sum((runs(t)[0] for t in target), Counter())
    total, goal = own.total(), wanted.total()
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (total + 10000) / ((own[b] + 1) * (goal + 10000))))
    out = []
    for d, c, n in known:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(k * gain(b) for b, k in c.items())
        out.append((d, c.total(), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((i for i, x in enumerate(out) if x[2] >= 20), key=lambda i: (-out[i][4], out[i][0] is None, out[i][0] or 0))
    place = {i: k + 1 for k, i in enumerate(order[: 5 * len(order) // 100])}
    return Counter((*x, place.get(i)) for i, x in enumerate(out))


def test_resample(odd, rows, spark):
    target = ["one two three", None, "", "éß漢🙂 12", " ".join(rows[9][1].split()[:30])]
    docs = odd.withColumn("score", F.lit("clash")).withColumn("block", F.lit(1))
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert Counter(map(tuple, got)) == brute_weights(rows, target)


def test_resample_none(none, odd, rows, spark):
    empty = spark.createDataFrame([], "text string")
    assert importance.resample(none, empty).count() == 0
    assert Counter(map(tuple, importance.resample(odd, empty).collect())) == brute_weights(rows, [])


@pytest.mark.parametrize("piece", [30, 200, 4 << 20])
def test_features(monkeypatch, piece):
    """Pieces of long texts hand their last words on; words longer than the shift tables hold."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(importance, "PIECE", piece)
    monkeypatch.setattr(importance.pieces, "__defaults__", (piece,))
    pool = ["Abc", "déjà", "x" * 90, "y" * 64, "1,2", "🙂a", "-", "\n"]
    texts = [" ".join(rng.choice(pool, n)) for n in (0, 1, 2, 3, 50, 0, 300, 7)]
    found, words = [Counter() for _ in texts], [0] * len(texts)
    for buckets, where, counts in importance.features(texts):
        for b, at in zip(buckets.tolist(), where.tolist(), strict=True):
            found[at][b] += 1
        words = [a + int(b) for a, b in zip(words, counts, strict=True)]
    assert list(zip(found, words, strict=True)) == [runs(t) for t in texts]


def brute_pairs(rows: list[tuple], days: int = 7, lag: int = 1) -> dict:
    held = defaultdict(set)
    for ts, client, kind in rows:
        if None not in (ts, client, kind):
            held[kind, ts.date()].add(client)
    kinds, dates = {k for k, _ in held}, {d for _, d in held}
    within = lambda kind, end: set().union(*(held.get((kind, end - timedelta(i)), ()) for i in range(days)))
    out = {}
    for d in dates:
        for a in kinds:
            for b in kinds:
                x, y = within(a, d), within(b, d - timedelta(lag))
                out[(d - date(1970, 1, 1)).days, a, b] = (len(x | y), len(x & y), len(x - y))
    return out


def check_pairs(got: list, want: dict, lg_k: int = 9) -> None:
    assert {(r["day"], r["kind_a"], r["kind_b"]): (r["n_union"], r["n_both"], r["n_only_a"]) for r in got} == want and len(got) == len(want)
    near = Counter()
    for r in got:
        for c in ("union", "both", "only_a"):
            est, err = r[f"est_{c}"], r[f"err_{c}"]
            assert est >= 0 and 0 <= err <= 8 * r["est_union"] / math.sqrt(1 << lg_k) + 3
            near[c] += abs(est - r[f"n_{c}"]) <= err
        assert r["est_both"] <= r["est_union"] and r["est_only_a"] <= r["est_union"]
    assert all(n >= 0.9 * len(got) for n in near.values())


def test_distinct(spark):
    rng = np.random.default_rng(3)
    start = datetime(1969, 12, 20)
    rows = [(start + timedelta(days=int(d), hours=int(h)), int(c), k) for d, h, c, k in zip(rng.choice([0, 1, 2, 9, 10, 25, 26, 60], 1500), rng.integers(0, 24, 1500), rng.integers(-50, 400, 1500), rng.choice(["a", "b", "", "é"], 1500), strict=True)]
    rows += [(None, 1, "a"), (start + timedelta(days=40), None, "a"), (start + timedelta(days=41), 3, None), *rows[:20], *[(start + timedelta(days=i), 7, "hot") for i in range(30)]]
    events = spark.createDataFrame(rows, "t timestamp_ntz, c long, k string").withColumn("day", F.lit("clash")).withColumn("id", F.lit(0)).repartition(5)
    check_pairs(distinct.distinct_algebra(events, "c", "k", "t").collect(), brute_pairs(rows))
    other = distinct.distinct_algebra(events, "c", "k", "t", days=3, lag=4).collect()
    check_pairs(other, brute_pairs(rows, 3, 4))
    assert distinct.distinct_algebra(events.limit(0), "c", "k", "t").count() == 0


def test_distinct_clicks(spark):
    rows = duckdb.sql(f"SELECT ts, client_id, kind FROM '{SMALL}/clicks.parquet'").fetchall()
    check_pairs(distinct.op13_distinct(spark, SMALL).collect(), brute_pairs(rows))
