"""Structured Streaming twins of the feed, admission and session queries."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events of a folder of JSON lines as they arrive."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_seen(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event id once, with state only as old as the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def poll(events: DataFrame, emitted: str, checkpoint: str, send: Callable[[DataFrame], None], most: int = 5):
    """Micro-batches that send what has not been sent, the oldest few first.

    A batch writes what it sends and what then waits into folders of its own, sends, and only then notes the ids: a
    failed one is done again from the same rows, so everything is sent at least once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession

        def old(folder: str, schema: str) -> DataFrame:
            path = f"{emitted}/{folder}"
            return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)

        done = old("ids", "number int, event_id long").filter(F.col("number") < number).select("event_id")
        waiting = rows.unionByName(old(f"pending/number={number - 1}", EVENT)).dropDuplicates(["event_id"]).join(done, "event_id", "left_anti").select(*rows.columns)
        waiting.write.mode("overwrite").parquet(f"{emitted}/waiting/number={number}")
        waiting = spark.read.schema(EVENT).parquet(f"{emitted}/waiting/number={number}")
        waiting.orderBy("ts", "event_id").limit(most).write.mode("overwrite").parquet(f"{emitted}/batch/number={number}")
        now = spark.read.schema(EVENT).parquet(f"{emitted}/batch/number={number}")
        waiting.join(now.select("event_id"), "event_id", "left_anti").select(*rows.columns).write.mode("overwrite").parquet(f"{emitted}/pending/number={number}")
        send(now)
        now.select("event_id").write.mode("overwrite").parquet(f"{emitted}/ids/number={number}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def limiter(events: DataFrame, cooldown: float, most: int, window: float) -> DataFrame:
    """(event_id, user_id, admitted) by two rules over admitted events only: a cooldown, and at most so many a window."""

    def admit(key, batches: Iterator, state):
        import pandas as pd

        last, times = state.get if state.exists else (float("-inf"), ())
        times = deque(times)
        for rows in batches:
            rows = rows.sort_values(["t", "event_id"])
            ok = []
            for t in rows["t"]:
                while times and t - times[0] >= window:
                    times.popleft()
                good = t - last >= cooldown and len(times) < most
                if good:
                    times.append(t)
                    last = t
                ok.append(good)
            yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "admitted": ok})
        state.update((last, list(times)))

    timed = events.select("event_id", "user_id", (F.unix_micros("ts") / 1e6).alias("t"))
    return timed.groupBy("user_id").applyInPandasWithState(admit, "event_id long, user_id long, admitted boolean", "last double, times array<double>", "append", "NoTimeout")


def sessions(events: DataFrame, idle: str = "12 hours", delay: str = "1 hour") -> DataFrame:
    """Sessions of users that an idle time ends, with their number of events."""
    return events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", idle)).agg(F.count("*").alias("n"))
