"""A task queue as a stream: one state a task, kept by events in the order of their times, with timers for what nobody reports.

Events of a task may arrive in any order within the watermark; they wait in state until the watermark has passed them and are then
applied by time. A claim takes a task that is due; a failure puts it back after a pause or ends it; a result is taken once, later ones
are repeats. A task that runs for too long is taken from its worker, whether or not another event ever comes: a timer
says so. Every change is one row with a number, so the last number of a task is its state now, and a batch that
is written twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "task_id bigint, number int, at timestamp, change string, status string, attempts int, available timestamp, started timestamp, result bigint"
_STATE = "number int, status string, attempts int, available bigint, started bigint, result bigint, timer bigint"
_EVENT = "at bigint, event_id bigint, kind string"


@dataclass
class Task:
    """What is known of a task; times are microseconds since 1970."""

    number: int = 0
    status: str | None = None
    attempts: int = 0
    available: int | None = None
    started: int | None = None
    result: int | None = None


@dataclass(frozen=True)
class Rules:
    """How often a task is tried, how long it pauses after a failure and how long it may run (microseconds)."""

    most: int = 3
    pause: int = 60_000_000
    stale: int = 300_000_000

    def lost(self, task: Task, now: int) -> int | None:
        """When the task was taken from its worker, if that was before ``now``."""
        return task.started + self.stale if task.status == "running" and task.started + self.stale < now else None

    def put_back(self, task: Task, at: int, pause: int) -> None:
        again = task.attempts < self.most
        task.status, task.started = ("retry" if again else "failed"), None
        task.available = at + pause if again else None

    def apply(self, task: Task, at: int, event_id: int, kind: str) -> str | None:
        """Change the task by one event; the name of the change, or None if the event means nothing now."""
        if task.status is None and kind == "add":
            task.status, task.available = "queued", at
            return "added"
        if kind == "claim" and task.status in ("queued", "retry") and task.available <= at:
            task.status, task.started, task.attempts = "running", at, task.attempts + 1
            return "claimed"
        if kind == "fail" and task.status == "running":
            self.put_back(task, at, self.pause)
            return "failed"
        if kind == "done" and task.status == "running":
            task.status, task.result, task.started = "succeeded", event_id, None
            return "succeeded"
        return None


class _Queue(StatefulProcessor):
    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", _STATE)
        self.waiting = handle.getListState("waiting", _EVENT)

    def _advance(self, key, until: int, new: list[tuple]) -> Iterator[pd.DataFrame]:
        """Apply what the watermark ``until`` has passed, keep the rest, and set the next timer."""
        *held, timer = self.task.get() or (*astuple(Task()), None)
        task, rules, out = Task(*held), self.rules, []
        kept = [(int(a), int(i), k) for a, i, k in self.waiting.get()]
        waiting = sorted({*kept, *new})

        def said(at: int, change: str | None) -> None:
            if change:
                task.number += 1
                when = lambda t: None if t is None else pd.Timestamp(t, unit="us")
                out.append((int(key[0]), task.number, when(at), change, task.status, task.attempts, when(task.available), when(task.started), task.result))

        def lose(now: int) -> None:
            at = rules.lost(task, now)
            if at is not None:
                rules.put_back(task, at, 0)
                said(at, "lost")

        ready = [e for e in waiting if e[0] <= until]
        for at, event_id, kind in ready:
            lose(at)
            said(at, rules.apply(task, at, event_id, kind))
        lose(until)
        later = waiting[len(ready) :]
        if later and later != kept:
            self.waiting.put(later)
        elif kept and not later:
            self.waiting.clear()
        due = [later[0][0]] if later else []
        if task.status == "running":
            due.append(task.started + rules.stale + 1000)
        wanted = max(until // 1000 + 1, -(-min(due) // 1000)) if due else None
        if wanted != timer:
            if timer is not None and timer > until // 1000:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if out or wanted != timer:
            self.task.update((*astuple(task), wanted))
        if out:
            made = pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])
            made["result"] = made["result"].astype("Int64")
            for c in ("at", "available", "started"):
                made[c] = pd.to_datetime(made[c])
            yield made

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(a), int(i), k) for part in rows for a, i, k in zip(part["micros"], part["event_id"], part["kind"], strict=True)]
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000, [])


def queue_changes(events: DataFrame, watermark: str, rules: Rules = Rules()) -> DataFrame:
    """The changes of all tasks from a stream of (task_id, event_id, at, kind), kind one of add, claim, fail, done.

    Rows later than the watermark are left out, as are rows without a task or time; repeated rows count once. Events of one time are
    applied by their ids.
    """
    rows = events.where("task_id IS NOT NULL AND at IS NOT NULL").select("task_id", "event_id", "kind", F.col("at").cast("timestamp").alias("at"))
    rows = rows.withColumn("micros", F.unix_micros("at")).withWatermark("at", watermark)
    return rows.groupBy("task_id").transformWithStateInPandas(_Queue(rules), CHANGES, "Update", "EventTime")


def state_now(changes: DataFrame) -> DataFrame:
    """The last change of each task; changes that were written twice count once."""
    last = Window.partitionBy("task_id").orderBy(F.desc("number"))
    return changes.withColumn("p_", F.row_number().over(last)).where("p_ = 1").drop("p_")


def replay(spark: SparkSession, parts: Sequence[DataFrame], at: str, watermark: str, rules: Rules = Rules()) -> DataFrame:
    """The changes that a queue's events make, read as a stream of ``parts``; each part is its own run, which goes on from the checkpoint.

    ``at`` is a new folder that driver and executors share. A batch replaces what an earlier try of it wrote.
    """
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in parts:
            part.select("task_id", "event_id", "at", "kind").write.mode("append").parquet(f"{at}/events")
            events = spark.readStream.schema("task_id bigint, event_id bigint, at timestamp, kind string").parquet(f"{at}/events")
            changes = queue_changes(events, watermark, rules)
            sink = changes.writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint")
            sink.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/changes/batch={n}")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(CHANGES).parquet(f"{at}/changes")
