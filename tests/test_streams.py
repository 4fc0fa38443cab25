"""The turn log as a stream, over several batches and starts, against the same in plain Python."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd

from quillspark.streaming import log as S

ROWS = "kind string, id long, turn_id long, key string, at long, rating double, written long"
HOUR = 3_600_000_000
START = int(datetime(2024, 3, 8, tzinfo=timezone.utc).timestamp()) * 1_000_000


def append(spark, folder, rows, files=2):
    S.write_log(spark.createDataFrame(rows, ROWS), folder, "written", files)


def turn(id, hour, key="k"):
    at = START + int(hour * HOUR)
    return ("turn", id, None, key, at, None, at)


def feedback(id, of, hour, rating, delay=0):
    at = START + int(hour * HOUR)
    return ("feedback", id, of, None, at, rating, at + int(delay * HOUR))


def test_ratings(spark):
    folder, root = S.fresh_root(spark, "log"), S.fresh_root(spark, "ratings")
    append(spark, folder, [turn(1, 0), turn(2, 1), turn(3, 2), turn(4, 30), feedback(10, 1, 1, 0.5), feedback(11, 1, 3, 0.75), feedback(12, 77, 3, 1.0), feedback(11, 1, 3, 0.75)], 3)
    with open(f"{folder.removeprefix('file://')}/broken.txt", "w") as f:
        f.write('{"kind": "turn", "id": 9\n\n{"kind": "other", "id": 5, "at": 1}\n{"kind": "turn", "at": 3}\n')
    run = lambda: {r["turn_id"]: r["rating"] for r in S.run_rated(spark, folder, "10 HOURS", "5 hours", root).collect()}
    first = run()
    # 2 and 3 have none yet, and still may get some: nothing newer than both kinds' lines is known.
    assert first == {1: 0.75}
    append(spark, folder, [turn(5, 31), feedback(13, 2, 9, 0.25, delay=21), feedback(14, 4, 32, 0.1), feedback(15, 5, 60, 0.9)])
    append(spark, folder, [turn(6, 100), feedback(16, 6, 101, 0.3)], 1)
    append(spark, folder, [turn(7, 200), feedback(17, 3, 11, 1.0, delay=190), feedback(18, 99, 201, 0.0)], 1)
    second = run()
    # Started again on its state: 13 came late, but in time; 15 was given too late for 5, and 17 came
    # too late; 7 may still get feedback.
    assert second == {1: 0.75, 2: 0.25, 3: None, 4: 0.1, 5: None, 6: 0.3}


def brute_budget(rows, limit, zone):
    out, used = [], Counter()
    for _, id, _, key, at, _, _ in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[4], r[1])):
        day = str(datetime.fromtimestamp(at / 1e6, ZoneInfo(zone)).date())
        used[key, day] += 1
        out.append((key, id, day, used[key, day], used[key, day] <= limit))
    return sorted(out)


def test_budget(spark):
    """Several batches and two starts; days of 23 hours; hot and missing keys; equal times."""
    rng = random.Random(4)
    rows = [turn(i, round(rng.uniform(0, 96), 2), rng.choice(["hot"] * 5 + ["a", "b", None])) for i in range(240)] + [turn(500 + i, 40, "tie") for i in range(9)]
    rows.sort(key=lambda r: r[-1])
    folder, root = S.fresh_root(spark, "log"), S.fresh_root(spark, "budgets")
    append(spark, folder, rows[:130], 3)
    run = lambda: sorted((r["key"], r["id"], r["day"], r["used"], r["allowed"]) for r in S.run_budgeted(spark, folder, 3, "America/Los_Angeles", "1 hour", root).collect())
    assert run() == brute_budget(rows[:130], 3, "America/Los_Angeles")
    append(spark, folder, rows[130:], 2)
    assert run() == brute_budget(rows, 3, "America/Los_Angeles")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != S._ROCKS


class Held:
    """What a processor needs of Spark's state."""

    def __init__(self):
        self.days, self.timers = {}, []

    def getMapState(self, *_):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def getValue(self, key):
        return self.days[key]

    def containsKey(self, key):
        return key in self.days

    def updateValue(self, key, value):
        self.days[key] = value

    def keys(self):
        return list(self.days)

    def removeKey(self, key):
        del self.days[key]


def test_timer():
    """A day's counter goes at its midnight in the zone, and those of later days stay."""
    held, budget = Held(), S.Budget(2, "America/Los_Angeles")
    budget.init(held)
    zone = ZoneInfo("America/Los_Angeles")
    at = lambda *x: int(datetime(2024, 3, *x, tzinfo=zone).timestamp() * 1e6)
    rows = pd.DataFrame({"micros": [at(10, 1), at(9, 23), at(10, 23), at(11, 0)], "id": [2, 1, 3, 4]})
    (out,) = budget.handleInputRows(("k",), iter([rows]), None)
    assert out[["id", "day", "used"]].values.tolist() == [[1, "2024-03-09", 1], [2, "2024-03-10", 1], [3, "2024-03-10", 2], [4, "2024-03-11", 1]]
    ends = [datetime(2024, 3, 10, tzinfo=zone), datetime(2024, 3, 11, tzinfo=zone), datetime(2024, 3, 12, tzinfo=zone)]
    assert sorted(held.timers) == [int(e.timestamp() * 1000) for e in ends] and ends[1].astimezone(timezone.utc) - ends[0].astimezone(timezone.utc) == timedelta(hours=23)

    class Over:
        def getExpiryTimeInMs(self):
            return sorted(held.timers)[1]

    assert list(budget.handleExpiredTimer(("k",), None, Over())) == [] and held.keys() == [("2024-03-11",)]


class Listed:
    """What the processor of many keys needs of Spark's state, with a count of its calls."""

    def __init__(self):
        self.entries, self.timers, self.calls = [], [], 0

    def getListState(self, *_):
        return self

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def get(self):
        self.calls += 1
        return iter(self.entries)

    def put(self, entries):
        self.calls += 1
        self.entries = entries

    def clear(self):
        self.entries = []


def test_budget_of_many_keys():
    """Many keys of a part count each for itself, over batches and days, and the calls of the state
    follow the days, not the keys."""
    held, budget = Listed(), S.Budgets(2, "America/Los_Angeles")
    budget.init(held)
    rng = random.Random(5)
    rows = sorted((turn(i, round(rng.uniform(0, 60), 1), f"k{rng.randrange(90)}") for i in range(900)), key=lambda r: (r[4], r[1]))
    got = []
    for batch in (rows[:400], rows[400:]):
        frame = pd.DataFrame({"key": [r[3] for r in batch], "id": [r[1] for r in batch], "micros": [r[4] for r in batch]}).sample(frac=1, random_state=1)
        (out,) = budget.handleInputRows((7,), iter([frame[:100], frame[100:]]), None)
        got += [tuple(r) for r in out[["key", "id", "day", "used", "allowed"]].values.tolist()]
    assert sorted(got) == brute_budget(rows, 2, "America/Los_Angeles")
    assert len(held.timers) == len(set(held.timers)) == len(held.entries) == 4 and held.calls == 4 + 2 * 2

    class Over:
        def getExpiryTimeInMs(self):
            return sorted(held.timers)[-2]

    assert list(budget.handleExpiredTimer((7,), None, Over())) == [] and [e[0] for e in held.entries] == ["2024-03-10"]


def test_log_makes_its_rows_once(spark):
    """A log of many files doesn't compute its rows for each of them."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def touch(x):
        seen.add(1)
        return x

    rows = [turn(i, i) for i in range(40)]
    table = spark.createDataFrame(rows, ROWS).withColumn("written", F.udf(touch, "long").asNondeterministic()("written"))
    folder = S.fresh_root(spark, "log")
    S.write_log(table, folder, "written", 8)
    assert seen.value <= 3 * len(rows)
    assert sorted(r["id"] for r in S.records(spark.read.text(folder)).collect()) == list(range(40))


def test_log_computes_its_rows_one_time(spark):
    """Bounds and closing lines are read from the rows that were made, not made again."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def touch(x):
        seen.add(1)
        return x

    rows = [turn(i, i) for i in range(40)]
    table = spark.createDataFrame(rows, ROWS).withColumn("at", F.udf(touch, "long").asNondeterministic()("at"))
    last = lambda made: made.agg(F.max("at").alias("at")).select(F.lit("turn").alias("kind"), F.lit(-1).cast("long").alias("id"), F.lit(None).cast("long").alias("turn_id"), F.lit(None).cast("string").alias("key"), "at", F.lit(None).cast("double").alias("rating"))
    folder = S.fresh_root(spark, "log")
    S.write_log(table.withColumn("written", F.col("at")), folder, "written", 4, last)
    assert seen.value == len(rows)
    assert sorted(r["id"] for r in S.records(spark.read.text(folder)).collect()) == list(range(-1, 40))


def test_log_in_parts(spark):
    """Each file of a log is as many parts as a stream takes at a time, an empty stretch of time
    included, so that no batch mixes files; the ratings are those of whole files."""
    import os

    rows = [turn(i, i) for i in range(30)] + [turn(50 + i, 300 + i) for i in range(30)] + [feedback(100 + i, i, i + 1, i / 8, delay=i % 3) for i in range(20)]
    table = spark.createDataFrame(rows, ROWS)
    end = lambda _: spark.createDataFrame([turn(-1, 900), feedback(-2, -1, 900, 0.0)], ROWS)
    got = []
    for parts in (1, 3):
        folder = S.fresh_root(spark, "log")
        S.write_log(table, folder, "written", 5, end, parts)
        names = [n for n in os.listdir(folder.removeprefix("file://")) if n.startswith("part-")]
        assert len(names) >= 5 * parts + 1
        got.append({r["turn_id"]: r["rating"] for r in S.run_rated(spark, folder, "10 HOURS", "5 hours", files=parts).collect() if r["turn_id"] >= 0})
    assert got[0] == got[1] == {r[1]: r[1] / 8 if r[1] < 20 else None for r in rows if r[0] == "turn"}


def test_batches_do_not_grow_with_the_log():
    """Every batch goes over all state, so their number has a bound; parts stay large enough."""
    from quillspark.plans.streams import _MOST_FILES, _cut

    assert _cut(100_000) == (4, 1) and _cut(6_000_000) == (6, 10)
    assert {_cut(n)[0] for n in (36_000_000, 10**9)} == {_MOST_FILES}
