"""The append-only turn log as a stream: lines of two kinds, turns with late feedback, daily budgets.

A line is JSON: `kind` (turn or feedback), `id`, `turn_id` of feedback, `key`, `at` (microseconds),
`rating`. Lines that don't parse, are of another kind or lack an id or time are passed over. Every
function over lines takes a table or a stream. State lives in the checkpoint folder that the
session names, so a stream that is started again goes on where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.storage import saved, shared_folder

LINE = "kind string, id long, turn_id long, key string, at long, rating double"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def lines(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """A folder of log files as a stream of texts, some files at a time, oldest first."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(folder)


def records(texts: DataFrame) -> DataFrame:
    parsed = texts.select(F.from_json("value", LINE).alias("x")).select("x.*")
    ok = F.col("kind").isin("turn", "feedback") & F.col("id").isNotNull() & F.col("at").isNotNull()
    return parsed.filter(ok).withColumn("at", F.timestamp_micros("at"))


# --- turns with their feedback

def rated(texts: DataFrame, within: str, late: str) -> DataFrame:
    """turn_id, at, feedback_id, feedback_at, rating: each turn with each feedback given `within`
    that time after it, and turns without any once none can come any more. Both kinds may be
    `late`: so long after the newest line of its kind a line still counts. Feedback on turns that
    the log doesn't have waits for them as long and is dropped then."""
    all_ = records(texts)
    turns = all_.filter("kind = 'turn'").select(F.col("id").alias("turn_id"), "at").withWatermark("at", late)
    given = all_.filter("kind = 'feedback' and turn_id is not null").select(F.col("turn_id").alias("of"), F.col("id").alias("feedback_id"), F.col("at").alias("feedback_at"), "rating").withWatermark("feedback_at", late)
    near = F.expr(f"turn_id = of AND feedback_at >= at AND feedback_at <= at + INTERVAL {within}")
    return turns.join(given, near, "leftOuter").drop("of")


def last_rating(pairs: DataFrame) -> DataFrame:
    """turn_id, rating: the newest feedback counts, and repeated lines once."""
    newest = F.struct("feedback_at", "feedback_id")
    return pairs.groupBy("turn_id").agg(F.max_by("rating", F.when(F.col("feedback_id").isNotNull(), newest)).alias("rating"))


def kept(stream: DataFrame, root: str) -> DataFrame:
    """All rows of a stream that appends, written once each under `root` with its state beside
    them; run to the end of what there is. Started again on the same root it goes on."""
    job = stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")


def fresh_root(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_rated(spark: SparkSession, folder: str, within: str, late: str, root: str | None = None, files: int = 1) -> DataFrame:
    """turn_id, rating of the turns in the log files of `folder` whose time for feedback is over.
    Only the last batch's state is held in memory; the one before it lies in the checkpoint."""
    with settings(spark, spark__sql__streaming__maxBatchesToRetainInMemory="1"):
        return last_rating(kept(rated(lines(spark, folder, files), within, late), root or fresh_root(spark, "ratings")))


# --- daily budgets

class Budget(StatefulProcessor):
    """The first `limit` requests of a key on a day are allowed. One counter for each open day; a
    timer at the day's end in its zone, moved by what may come late, drops it."""

    def __init__(self, limit: int, zone: str) -> None:
        self.limit, self.zone = limit, zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "day string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """The rows of a batch, in order of time and id."""
        some = pd.concat(list(rows), ignore_index=True)
        micros = some["micros"].to_numpy()
        local = pd.to_datetime(micros, unit="us", utc=True).tz_convert(self.zone)
        some = some.assign(day=local.strftime("%Y-%m-%d")).sort_values(["micros", "id"], kind="stable")
        nth = some.groupby("day").cumcount() + 1
        for day, n in some.groupby("day").size().items():
            before = self.used.getValue((day,))[0] if self.used.containsKey((day,)) else 0
            nth[some["day"] == day] += before
            self.used.updateValue((day,), (int(before + n),))
            if not before:
                end = datetime.fromisoformat(day).replace(tzinfo=ZoneInfo(self.zone)) + timedelta(days=1)
                self.handle.registerTimer(int(end.timestamp() * 1000))
        yield pd.DataFrame({"key": key[0], "id": some["id"].to_numpy(), "day": some["day"].to_numpy(), "used": nth.to_numpy().astype("int32"), "allowed": (nth <= self.limit).to_numpy()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, ZoneInfo(self.zone)).strftime("%Y-%m-%d")
        for (day,) in list(self.used.keys()):
            if day < over:
                self.used.removeKey((day,))
        return iter(())

    def close(self) -> None:
        pass


class Budgets(StatefulProcessor):
    """`Budget` for all keys of a part at once, as a call of Python and of the state for each key
    costs more than its rows. The counters of an open day are one entry of a list; a timer at the
    day's end in its zone drops it."""

    def __init__(self, limit: int, zone: str) -> None:
        self.limit, self.zone = limit, zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getListState("used", "day string, keys array<string>, counts array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """The rows of a batch, in order of time and id."""
        some = pd.concat(list(rows), ignore_index=True)
        dates = pd.to_datetime(some["micros"].to_numpy(), unit="us", utc=True).tz_convert(self.zone).date
        place, days = pd.factorize(dates)
        some = some.assign(day=pd.Index([d.isoformat() for d in days])[place]).sort_values(["micros", "id"], kind="stable")
        open_ = {day: pd.Series(counts, index=keys, dtype="int64") for day, keys, counts in self.used.get()}
        parts = []
        for day, asked in some.groupby("day"):
            before = open_.get(day)
            nth = asked.groupby("key").cumcount() + 1
            if before is None:
                end = datetime.fromisoformat(day).replace(tzinfo=ZoneInfo(self.zone)) + timedelta(days=1)
                self.handle.registerTimer(int(end.timestamp() * 1000))
                before = pd.Series(dtype="int64")
            nth += asked["key"].map(before).fillna(0).astype("int64")
            open_[day] = before.add(asked["key"].value_counts(), fill_value=0).astype("int64")
            parts.append(pd.DataFrame({"key": asked["key"], "id": asked["id"], "day": day, "used": nth.astype("int32"), "allowed": nth <= self.limit}))
        self.used.put([(day, n.index.tolist(), n.tolist()) for day, n in open_.items()])
        yield pd.concat(parts, ignore_index=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, ZoneInfo(self.zone)).strftime("%Y-%m-%d")
        left = [entry for entry in self.used.get() if entry[0] >= over]
        if left:
            self.used.put(left)
        else:
            self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


BUDGETED = "key string, id long, day string, used int, allowed boolean"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session that hold inside only; a stream keeps those it was started with."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def budgeted(texts: DataFrame, limit: int, zone: str, late: str, parts: int = 256) -> DataFrame:
    """key, id, day, used, allowed of each turn: the key's budget of its day in the zone. Turns are
    counted batch by batch, inside one by time. Keys are dealt to `parts`, for good."""
    turns = records(texts).filter("kind = 'turn' and key is not null").select("key", "id", "at", F.unix_micros("at").alias("micros")).withWatermark("at", late)
    dealt = turns.withColumn("part", F.pmod(F.hash("key"), F.lit(parts)))
    return dealt.groupBy("part").transformWithStateInPandas(Budgets(limit, zone), BUDGETED, "Append", "eventTime")


def run_budgeted(spark: SparkSession, folder: str, limit: int, zone: str, late: str, root: str | None = None, files: int = 1) -> DataFrame:
    with settings(spark, spark__sql__streaming__stateStore__providerClass=_ROCKS):
        return kept(budgeted(lines(spark, folder, files), limit, zone, late), root or fresh_root(spark, "budgets"))


# --- a log made of a table

def write_log(rows: DataFrame, folder: str, order: str, files: int, closing: Callable[[DataFrame], DataFrame] | None = None, parts: int = 1) -> None:
    """Rows (of LINE's columns and `order`, when they were written) as a log of some files, one after
    the other, as a stream takes the oldest first. `closing` makes the lines of a last file. The rows
    are made once, dealt to their files; each file then reads its own lines only. With `parts` each
    file is that many, written at once, for a stream that takes as many at a time; an empty line,
    which readers pass over, stands in each, so that none is missing."""
    spark = rows.sparkSession
    rows = saved(rows, "log-rows")
    bounds = rows.agg(F.min(order), F.max(order)).first()
    if bounds[0] is None:
        rows.limit(0).select(F.to_json(F.struct("kind")).alias("value")).write.mode("append").text(folder)
        return
    width = (bounds[1] - bounds[0]) // files + 1
    text = F.to_json(F.struct(*[c.split()[0] for c in LINE.split(", ")])).alias("value")
    staged = fresh_root(spark, "lines")
    nth = F.expr(f"(`{order}` - ({bounds[0]}L)) div {width}L").cast("int").alias("nth")
    part = F.pmod(F.hash("kind", "id", "turn_id"), F.lit(parts)).alias("part")
    rows.select(text, nth, part).filter("nth is not null").repartition(files * parts, "nth", "part").write.partitionBy("nth").parquet(staged)
    dealt = spark.read.schema("value string, part int, nth int").parquet(staged)
    empty = spark.range(parts).select(F.lit("").alias("value"), F.col("id").cast("int").alias("part"))
    for i in range(files):
        own = dealt.filter(F.col("nth") == i).select("value", "part")
        whole = own.coalesce(1) if parts == 1 else own.unionByName(empty).repartitionById(parts, F.col("part"))
        whole.select("value").write.mode("append").text(folder)
    if closing:
        closing(rows).coalesce(1).select(text).write.mode("append").text(folder)
