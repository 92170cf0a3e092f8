"""Structured Streaming forms of the event operators.

Event time is a timestamp with a watermark. Each function takes a streaming (or batch) table of events
(event_id, ts, user_id, event_type, value) and returns a table; the caller writes it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.ship import ship
from tessera.operators.folds import Tracker


def read(spark: SparkSession, sf_dir: str, per_trigger: int = 1) -> DataFrame:
    """The events table as a stream of files, its times cast to ones a watermark takes."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Rows and span of each user's sessions."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def hourly(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts and values by hour and type."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
        .select(F.unix_micros("w.start").alias("hour_us"), "event_type", "n", "cents")
    )


def first_of_each(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark; later ones and late ones are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_states(events: DataFrame) -> DataFrame:
    """The last state, and counts, of each user (for update or complete output)."""
    return events.groupBy("user_id").agg(
        F.max_by("event_type", "event_id").alias("last_event"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")
    )


def _in_order(batches: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """All of a trigger's rows of a key, in order."""
    return pd.concat(list(batches)).sort_values(by, kind="stable")


def until_terminal(events: DataFrame, terminal: str = "purchase") -> DataFrame:
    """Each user's events up to and with the first terminal one; what comes after is dropped."""
    ship(events.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        over = bool(state.exists and state.get[0])
        pdf, out = _in_order(batches, "event_id"), []
        for i, kind in zip(pdf["event_id"], pdf["event_type"], strict=True):
            if not over:
                out.append((key[0], i, kind))
                over = kind == terminal
        state.update((over,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "event_type"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, event_type string", "over boolean", "append", GroupStateTimeout.NoTimeout)


def tracked(events: DataFrame, similar: float = 10.0, every: int = 3, most: int = 8, late: str = "1 day", idle: timedelta = timedelta(days=365)) -> DataFrame:
    """The state machine of folds.track over each user's values, its state kept between micro-batches.

    A user who is idle for longer than `idle` (event time) is over: the last `done` goes out.
    """
    ship(events.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):
            for _ in batches:
                pass
            return
        machine = Tracker(similar, every, most, tuple(state.get) if state.exists else None)
        if state.hasTimedOut:
            out = [(key[0], o["at"], o["kind"]) for o in machine.flush()]
            state.remove()
        else:
            pdf = _in_order(batches, "event_id")
            out = [(key[0], o["at"], o["kind"]) for i, v in zip(pdf["event_id"], pdf["value"], strict=True) for o in machine.feed(int(i), float(v))]
            state.update(machine.state)
            last = int(pdf["ts"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + int(idle.total_seconds() * 1000))
        yield pd.DataFrame(out, columns=["user_id", "at", "kind"])

    rows = events.withWatermark("ts", late).groupBy("user_id")  # events without a user only move the watermark
    return rows.applyInPandasWithState(step, "user_id long, at long, kind string", "x double, last long, seen long, candidates long", "append", GroupStateTimeout.EventTimeTimeout)


def drain(make: Callable[[DataFrame], DataFrame], spark: SparkSession, sf_dir: str, mode: str, base: str) -> DataFrame:
    """Run a stream over the events that are there now and return its whole result, written under `base`.

    Each micro-batch is written to a folder of its own, so one that is run again replaces itself. In append
    mode the stream then gets one event without a user, years after the last one, so that the watermark
    passes all windows and timeouts and nothing is held back.
    """
    events = read(spark, sf_dir)
    closing = f"{base}/closing"
    spark.createDataFrame([], events.schema).write.parquet(closing)
    both = events.unionByName(spark.readStream.schema(events.schema).parquet(closing))
    out = make(both)

    def put(batch: DataFrame, nth: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/nth={nth}")

    def go() -> None:
        query = out.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    go()
    if mode == "append":
        last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("ts").cast("timestamp").alias("ts"))
        end = last.select(*[(F.expr("ts + interval 3000 days") if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in events.schema])
        end.write.mode("append").parquet(closing)
        go()
        return spark.read.schema(out.schema).parquet(f"{base}/out").select(out.columns)
    written = spark.read.parquet(f"{base}/out")
    return written.join(F.broadcast(written.agg(F.max("nth").alias("nth"))), "nth").select(out.columns)
