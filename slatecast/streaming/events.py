"""Structured Streaming over an event table: tumbling sums, sessions, lateness, exactly-once snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Parquet files of a folder whose names match, as a stream with the schema they have now."""
    schema = spark.read.parquet(f"{path}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def tumbling(events: DataFrame, ts: str, keys: list[str], width: str, watermark: str, value: str) -> DataFrame:
    """Counts and exact sums by key and window; rows later than the watermark are left out of a stream."""
    rows = events.withColumn("at_", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("at_", watermark) if events.isStreaming else rows
    out = rows.groupBy(*keys, F.window("at_", width)).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"))
    return out.select(*keys, F.col("window.start").alias("window_start"), "n", "total")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, watermark: str) -> DataFrame:
    rows = events.withColumn("at_", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("at_", watermark) if events.isStreaming else rows
    out = rows.groupBy(*keys, F.session_window("at_", gap)).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def snapshots(events: DataFrame, ts: str, keys: list[str], watermark: str) -> DataFrame:
    """The first row of each key within the watermark; repeats of it are dropped."""
    rows = events.withColumn("at_", F.col(ts).cast("timestamp"))
    if not events.isStreaming:
        return rows.dropDuplicates(keys).drop("at_")
    return rows.withWatermark("at_", watermark).dropDuplicatesWithinWatermark(keys).drop("at_")


def schedule(shows: DataFrame, key: str, start: str, offsets: list[int]) -> DataFrame:
    """One task for each show and offset: due that many minutes before its start."""
    rows = shows.select(key, start, F.explode(F.array(*map(F.lit, offsets))).alias("offset_minutes"))
    return rows.withColumn("due", F.col(start) - F.make_dt_interval(mins=F.col("offset_minutes")))


def observed(tasks: DataFrame, seen: DataFrame, key: str, due: str, at: str, grace_minutes: int, late_seconds: int = 60) -> DataFrame:
    """Tasks joined to observations of their key from ``due`` to ``grace_minutes`` after it, with lateness."""
    right = seen.withColumnRenamed(key, "seen_key_")
    limit = F.col(due) + F.expr(f"INTERVAL {grace_minutes} MINUTES")
    out = tasks.join(right, (F.col(key) == F.col("seen_key_")) & F.col(at).between(F.col(due), limit)).drop("seen_key_")
    lateness = F.unix_timestamp(F.col(at).cast("timestamp")) - F.unix_timestamp(F.col(due).cast("timestamp"))
    return out.withColumn("lateness_seconds", lateness).withColumn("is_late", F.col("lateness_seconds") > late_seconds)


def due_tasks(queue: DataFrame, now: str, limit: int) -> DataFrame:
    """The queued tasks to take next: due ones by time, then higher priority, then id."""
    return queue.where((F.col("status") == "queued") & (F.col("scheduled_for") <= F.lit(now).cast("timestamp_ntz"))).orderBy("scheduled_for", F.desc("priority"), "task_id").limit(limit)


def after_failure(queue: DataFrame, failed: DataFrame, most: int, backoff_seconds: int = 60) -> DataFrame:
    """The queue after the tasks in ``failed`` (task_id) failed: queued again after a pause, or failed for good."""
    hit = queue.join(failed.select("task_id").distinct().withColumn("hit_", F.lit(True)), "task_id", "left")
    attempts = F.col("attempts") + F.col("hit_").isNotNull().cast("int")
    status = F.when(F.col("hit_").isNull(), F.col("status")).when(attempts >= most, "failed").otherwise("queued")
    later = F.when(F.col("hit_").isNotNull() & (attempts < most), F.col("scheduled_for") + F.expr(f"INTERVAL {backoff_seconds} SECONDS")).otherwise(F.col("scheduled_for"))
    return hit.select(*(status.alias(c) if c == "status" else attempts.alias(c) if c == "attempts" else later.alias(c) if c == "scheduled_for" else F.col(c) for c in queue.columns))


def claimed(queue: DataFrame, now: str, limit: int) -> DataFrame:
    """The queue after its next due tasks were claimed: running from ``now``, with one attempt more. One writer is assumed."""
    taken = due_tasks(queue, now, limit).select(F.col("task_id").alias("taken_"))
    hit = queue.join(F.broadcast(taken), F.col("task_id") == F.col("taken_"), "left")  # limit rows at most
    now_, on = F.lit(now).cast("timestamp_ntz"), F.col("taken_").isNotNull()
    new = {"status": F.when(on, "running").otherwise(F.col("status")), "attempts": F.col("attempts") + on.cast("int"), "started_at": F.when(on, now_).otherwise(F.col("started_at"))}
    return hit.select(*(new[c].alias(c) if c in new else F.col(c) for c in queue.columns))


def stale_reset(queue: DataFrame, now: str, minutes: int) -> DataFrame:
    """The queue after tasks that started over ``minutes`` ago and still run were queued again."""
    stale = (F.col("status") == "running") & (F.col("started_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTES"))
    new = {"status": F.when(stale, "queued").otherwise(F.col("status")), "started_at": F.when(~stale, F.col("started_at"))}
    return queue.select(*(new[c].alias(c) if c in new else F.col(c) for c in queue.columns))


def autoscaled(due: Column, late: Column, peak: Column, pressure: Column, base: int, most_under_pressure: int) -> Column:
    """Workers wanted: one for each 80 due tasks, 40 late ones or 220 in the peak; under pressure no more than allowed."""
    wanted = F.greatest(F.lit(base), F.ceil(due / 80), F.ceil(late / 40), F.ceil(peak / 220))
    return F.when(pressure, F.least(wanted, F.lit(most_under_pressure))).otherwise(wanted)


def run_once(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process what there is now and stop; ``each`` gets every micro-batch with its number."""
    df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start().awaitTermination()
