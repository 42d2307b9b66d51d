"""Counters, windows and the sliding-window limiter on streams of events."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from talus.sources.scratch import fresh_path


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams with state of their own for each key need this provider while they run; the session's setting comes back after it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Limiter(StatefulProcessor):
    """Admits an attempt while fewer than `most` admitted ones lie within `seconds` before it; rejected ones don't count."""

    def __init__(self, most: int, seconds: float):
        self.most, self.span = most, int(seconds * 1_000_000)

    def init(self, handle) -> None:
        self.held = handle.getValueState("admitted", StructType([StructField("us", ArrayType(LongType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.held.get()[0]) if self.held.exists() else []
        all_ = pd.concat(list(rows)).sort_values(["us", "event_id"])
        out = []
        for us, event in zip(all_["us"].tolist(), all_["event_id"].tolist(), strict=True):
            held = [t for t in held if us - t < self.span]
            ok = len(held) < self.most
            if ok:
                held.append(us)
            out.append((key[0], event, ok))
        self.held.update((held,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "admitted"])

    def close(self) -> None:
        pass


class Cache(StatefulProcessor):
    """A value for each key that is loaded when it is asked for and not there, and goes `seconds` after it was loaded.

    Asking doesn't keep a value longer. A timer of event time removes it, so keys that nobody asks for hold no state.
    """

    def __init__(self, seconds: float):
        self.span = int(seconds * 1_000_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.loaded = handle.getValueState("loaded", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one batch's requests for one key, in order of time; a batch is as large as its source's trigger allows
        asked = sorted((us, event) for part in rows for us, event in zip(part["us"].tolist(), part["event_id"].tolist(), strict=True))
        loaded = self.loaded.get()[0] if self.loaded.exists() else None
        out = []
        for us, event in asked:
            hit = loaded is not None and us - loaded < self.span
            if not hit:
                loaded = us
            out.append((key[0], event, "hit" if hit else "load", us - loaded))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.loaded.update((loaded,))
        self.handle.registerTimer((loaded + self.span) // 1000 + 1)
        yield pd.DataFrame(out, columns=["key", "event_id", "outcome", "age_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.loaded.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype="int64"), "event_id": pd.Series([], dtype="int64"), "outcome": pd.Series([], dtype="str"), "age_us": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def cached(events: DataFrame, seconds: float, late: str) -> DataFrame:
    """key, event_id, outcome (hit or load) and age_us of the value given, for a stream of requests (key long, event_id, ts).

    Requests may come late by as much as late says; a key's state goes once that is past its value's end.
    """
    rows = events.withWatermark("ts", late).select("key", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("key").transformWithStateInPandas(Cache(seconds), "key long, event_id long, outcome string, age_us long", "append", "eventTime")


def first_ones(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The stream's first row of each keys: repeats are dropped as long as they come within late, and state is given up after it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def appended(stream: DataFrame, checkpoint: str, out: str) -> None:
    """Appends what a stream's source has now to the table out; a later call with the same checkpoint goes on where this one ended."""
    stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()


def limited(events: DataFrame, most: int, seconds: float) -> DataFrame:
    """user_id, event_id, admitted of a stream of events (user_id, event_id, ts); exact, state is kept for each user."""
    rows = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("user_id").transformWithStateInPandas(Limiter(most, seconds), "user_id long, event_id long, admitted boolean", "append", "none")


def recent_attempts(events: DataFrame, seconds: int) -> DataFrame:
    """For each event how many of its user's lie within the seconds up to it; the batch bound of the limiter."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("recent", F.count("*").over(w))


def views(events: DataFrame, every: str = "1 day", late: str | None = None) -> DataFrame:
    """Events of each kind in each window."""
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def run_once(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over what its source has now, with a checkpoint, into Parquet files of the shared folder; gives their rows.

    A stream in complete mode writes its whole result each time, and the last one counts.
    """
    spark, path = stream.sparkSession, fresh_path(stream.sparkSession, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{path}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")
    last = []

    def whole(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows-{batch}")
        last.append(batch)

    writer.foreachBatch(whole).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows-{max(last)}") if last else spark.createDataFrame([], stream.schema)


def resumed(spark, source: str, glob: str, schema, checkpoint: str, out: str) -> int:
    """Takes what a folder has that earlier runs with this checkpoint did not take, appends it to out; the number of new rows."""
    new = []

    def add(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        new.append(spark.read.parquet(f"{out}/batch={batch}").count())

    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(source)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
    return sum(new)
