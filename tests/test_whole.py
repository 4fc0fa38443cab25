"""Queries over whole tables, against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict
from datetime import datetime, timedelta
from math import comb

import pytest

from quillspark import plans

QUERIES, _ = plans.load()
DAY = datetime(1995, 1, 1)
EVENTS = [(i * 37, DAY + timedelta(hours=i % 60), i * 11 % 140, "abc"[i % 3], float(i * 29 % 101)) for i in range(300)]
DOCUMENTS = [(i, f"text {i}", "en", f"s{i % 3}", 10 * i) for i in range(1, 8)]
LABELS = [(i, 1, 0) for i in range(95, 110)]
BENCHMARK = [(i, "x") for i in [0, 1, 2, 6, 12, 36, 42, 97, 105, 300]]
ORDERS = [(i, i * 7 % 120, "F", 1.0, DAY + timedelta(days=i * 13 % 400), f"{i % 3 + 1}-X") for i in range(1, 121)]
COLUMNS = {
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
}


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    for name, columns in COLUMNS.items():
        spark.createDataFrame(globals()[name.upper()], columns).write.parquet(f"{folder}/{name}.parquet")
    return lambda name, *columns: sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(folder)).collect())


def test_sign_test(run):
    want = []
    for kind in "abc":
        w, l = (sum(e[3] == kind and ok(e[4]) for e in EVENTS) for ok in (lambda v: v > 60, lambda v: v <= 20))
        want.append((kind, w, l, round(min(1, 2 * sum(comb(w + l, i) for i in range(min(w, l) + 1)) / 2 ** (w + l)), 6)))
    assert run("sign_test", "event_type", "wins", "losses", "p") == [(k, w, l, pytest.approx(p, abs=2e-6)) for k, w, l, p in want]


def test_run_resume(run):
    best: dict = {}
    for id, ts, user, _, value in EVENTS:
        if value > 50:
            best[user % 30] = max(best.get(user % 30, (ts, id)), (ts, id))
    assert max(id for _, id in best.values()) >= 2000
    assert run("run_resume", "identity", "run_id") == sorted((k, id) for k, (_, id) in best.items())


def test_run_completeness(run):
    n = Counter(e[2] for e in EVENTS if e[4] > 97)
    want = sorted((u, "missing" if u not in n else "repeated") for u in {e[2] for e in EVENTS} if n[u] != 1)
    assert max(want)[0] >= 120 and run("run_completeness", "id", "problem") == want


def test_vector_records(run):
    want = [(d, f'{{"lang":"{g}","source":"{s}"}}', round(1 - n / 100000, 6), f"query: {s}", f"{g}: {n}") for d, _, g, s, n in DOCUMENTS]
    assert run("vector_records", "doc_id", "flat", "score", "asked", "passage") == want


def test_referential_checks(run):
    items, judged = {b[0] for b in BENCHMARK}, {r[0] for r in LABELS}
    want = sorted([(i, "document") for i in items - judged] + [(d, "query") for d in judged - items])
    assert (109, "query") in want and run("referential_checks", "judged", "missing") == want


def test_label_filter(run):
    day = lambda d: int(d.strftime("%Y%m%d"))
    rows = [(o[1] % 50, o[5].split("-")[0], day(o[4])) for o in ORDERS]
    groups = defaultdict(list)
    for s, ticker, d in rows:
        groups[s].append((ticker, d))
    want = {s: sum(t in {x for x, _ in g} and min(d for _, d in g) <= at <= max(d for _, d in g) for _, t, at in rows) for s, g in groups.items()}
    assert run("label_filter", "sample", "eligible") == sorted(want.items())


def test_document_router(run):
    want = []
    for q, _ in BENCHMARK:
        keyword = [((q * 3 + j) % 11, 10 - (j // 2 if q % 4 == 0 else j)) for j in range(5)]
        dense = [(q * (3 if q % 3 == 0 else 2) + j) % 11 for j in range(5)]
        if keyword[0][0] == dense[0] and keyword[0][1] > keyword[1][1]:
            want.append(q)
    got = run("document_router", "query_id", "rank", "id")
    assert max(want) >= 40 and sorted({q for q, *_ in got}) == want and len(got) == 3 * len(want)
    assert all(id == q * 3 % 11 for q, rank, id in got if rank == 1)
