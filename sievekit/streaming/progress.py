"""Streaming forms: resumable ingestion, progressive metrics and event windows.

The windows are an addition; the batch operators have no streaming counterpart elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 10) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def once_each(rows: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the delay."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def progressive(rows: DataFrame, *keys: str) -> DataFrame:
    """Running counts and means of results by keys; for update or complete mode."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("avg_value"))


def merging_sink(path: str, *keys: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch in update mode: each batch writes a version of the whole table, its rows in place of older ones of their keys.

    A version is made of the one before its batch, so a batch that is run again after a failure gives the same.
    """

    def merge(changed: DataFrame, batch: int) -> None:
        before = versions(changed.sparkSession, path)
        if before is not None:
            last = before.where(F.col("version") < batch).agg(F.max("version")).first()[0]
            if last is not None:
                old = before.where(F.col("version") == last).drop("version")
                same = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
                changed = changed.unionByName(old.alias("old").join(changed.select(*keys).alias("new"), same, "left_anti").select(*changed.columns))
        changed.write.mode("overwrite").parquet(f"{path}/version={batch}")

    return merge


def versions(spark: SparkSession, path: str) -> DataFrame | None:
    """All versions that a merging sink has written, None before the first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version."""
    every = versions(spark, path)
    if every is None:
        return None
    return every.where(F.col("version") == every.agg(F.max("version")).first()[0]).drop("version")


def progressive_to_end(rows: DataFrame, key: str, path: str, checkpoint: str, *keys: str) -> None:
    """Keep progressive() of rows, each key once, up to date in a table of versions; a later call goes on from the checkpoint.

    The keys seen are kept without end: a repetition counts never, however late.
    """
    running = progressive(rows.dropDuplicates([key]), *keys)
    query = running.writeStream.outputMode("update").foreachBatch(merging_sink(path, *keys)).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


#: What a job's last event says, and the outcome of jobs that say neither in time.
FINAL, TIMED_OUT = ("completed", "failed"), "timed_out"
_OUTCOME = "job string, outcome string, at timestamp, events bigint"


def outcomes(events: DataFrame, wait: str = "24 hours", delay: str = "10 minutes") -> DataFrame:
    """job, outcome, at, events: how each job ends, from events (job, ts, status) as they arrive.

    A job ends with its first event in FINAL, or times out if that is not within the wait after its first event. A row
    comes once no earlier event can come any more, that is once the watermark is past that end; events are those up to
    it. What comes after a job's end is not looked at.
    """
    limit = int(pd.Timedelta(wait).total_seconds() * 1000)
    timed = events.select("job", F.col("ts").alias("ts"), (F.unix_micros("ts")).alias("us"), "status").withWatermark("ts", delay)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # first event; first final one and what it says; numbers of events by time, as only those up to the end count
        first, final, said, seen, over = state.get if state.exists else (None, None, None, [], False)
        if over:
            return
        if not state.hasTimedOut:
            for batch in batches:
                seen = sorted([*seen, *batch["us"].tolist()])
                ends = batch[batch["status"].isin(FINAL)].sort_values(["us", "status"])
                if len(ends) and (final is None or (int(ends["us"].iloc[0]), ends["status"].iloc[0]) < (final, said)):
                    final, said = int(ends["us"].iloc[0]), ends["status"].iloc[0]
            first = seen[0]
            cut = first + limit * 1000
            seen = [u for u in seen if u <= (cut if final is None else min(final, cut))] or seen[:1]
        deadline = first + limit * 1000
        end, outcome = (final, said) if final is not None and final <= deadline else (deadline, TIMED_OUT)
        if state.hasTimedOut:
            state.update((first, final, said, [], True))
            yield pd.DataFrame({"job": [key[0]], "outcome": [outcome], "at": [pd.Timestamp(end, unit="us", tz="UTC")], "events": [sum(u <= end for u in seen)]})
            return
        state.update((first, final, said, seen, False))
        state.setTimeoutTimestamp(max(end // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    return timed.groupBy("job").applyInPandasWithState(
        step, _OUTCOME, "first long, final long, said string, seen array<long>, over boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def outcomes_so_far(events: DataFrame, wait: str = "24 hours", delay: str = "10 minutes") -> DataFrame:
    """outcomes() of a table as a whole: jobs whose end is before its last event less the delay."""
    first = events.groupBy("job").agg(F.min("ts").alias("first"), F.min(F.when(F.col("status").isin(*FINAL), F.struct("ts", "status"))).alias("final"))
    mark = events.agg((F.max("ts") - F.expr(f"INTERVAL {delay}")).alias("mark"))
    deadline = F.col("first") + F.expr(f"INTERVAL {wait}")
    intime = F.coalesce(F.col("final.ts") <= deadline, F.lit(False))
    ended = first.select("job", F.when(intime, F.col("final.status")).otherwise(TIMED_OUT).alias("outcome"), F.when(intime, F.col("final.ts")).otherwise(deadline).alias("at"))
    ended = ended.crossJoin(F.broadcast(mark)).where("at < mark").drop("mark")
    counted = events.select("job", "ts").join(ended.select("job", "at"), "job").where("ts <= at").groupBy("job").agg(F.count("*").alias("events"))
    return ended.join(counted, "job").select("job", "outcome", "at", "events")


def tumbling(rows: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by window and type; late events are dropped."""
    timed = rows.withWatermark("ts", delay) if rows.isStreaming else rows
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


def sessions(rows: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of each user: start, end, events."""
    timed = rows.withWatermark("ts", delay) if rows.isStreaming else rows
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"
    )


def run_to_end(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Append all that is there to Parquet, exactly once; a later call goes on from the checkpoint."""
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
