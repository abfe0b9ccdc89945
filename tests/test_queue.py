"""The queue as a stream: order, lateness, lost workers, repeats and restarts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from slatecast.streaming.queue import Rules, replay, state_now

START = datetime(2026, 1, 1)
SCHEMA = "task_id bigint, event_id bigint, at timestamp, kind string"


def part(spark, *rows):
    return spark.createDataFrame([(t, i, None if m is None else START + timedelta(minutes=m), k) for t, i, m, k in rows], SCHEMA)


def changes(spark, tmp_path, *parts):
    out = replay(spark, parts, str(tmp_path / "queue"), "10 minutes", Rules(most=2))
    return out, {(r["task_id"], r["number"]): (r["change"], int((r["at"] - START).total_seconds()), r["attempts"]) for r in out.collect()}


def test_order_retry_and_late_rows(spark, tmp_path):
    first = part(
        spark,
        (1, 12, 2, "claim"), (1, 11, 1, "add"), (1, 13, 3, "fail"), (1, 14, 3.5, "claim"), (1, 15, 4, "claim"), (1, 16, 5, "done"), (1, 17, 6, "done"),
        (2, 21, 0, "add"), (2, 22, 1, "claim"), (2, 22, 1, "claim"), (None, 1, 1, "add"), (3, 1, None, "add"), (4, 41, 20, "add"),
    )
    # 20 minutes were seen: what is over ten minutes late is dropped, the rest is sorted in
    second = part(spark, (5, 51, 2, "add"), (4, 42, 15, "claim"), (4, 40, 12, "add"), (2, 23, 12, "claim"), (6, 61, 60, "add"))
    out, got = changes(spark, tmp_path, first, second)
    task = lambda t: [v for (i, _), v in sorted(got.items()) if i == t]
    assert task(1) == [("added", 60, 0), ("claimed", 120, 1), ("failed", 180, 1), ("claimed", 240, 2), ("succeeded", 300, 2)]  # a retry waits a minute; one result
    assert task(2) == [("added", 0, 0), ("claimed", 60, 1), ("lost", 360, 1), ("claimed", 720, 2), ("lost", 1020, 2)]  # nobody reported it twice
    assert task(4) == [("added", 720, 0), ("claimed", 900, 1), ("lost", 1200, 1)] and task(3) == task(5) == task(6) == []
    now = {r["task_id"]: (r["status"], r["result"]) for r in state_now(out.union(out)).collect()}
    assert now == {1: ("succeeded", 16), 2: ("failed", None), 4: ("retry", None)}


def test_one_run_and_many_agree(spark, tmp_path):
    rows = [(k % 5, k, 3 * k, ("add", "claim", "fail", "claim", "done")[(k // 5) % 5]) for k in range(60)]
    end = (99, 99, 9999, "add")
    _, whole = changes(spark, tmp_path / "a", part(spark, *rows, end))
    cut = [part(spark, *rows[i : i + 20]) for i in (0, 20)]
    _, parts = changes(spark, tmp_path / "b", *cut, part(spark, *rows[40:], end))
    assert whole == parts and len(whole) > 20


def test_a_batch_that_is_written_again_changes_nothing(spark, tmp_path):
    out, got = changes(spark, tmp_path, part(spark, (1, 1, 0, "add"), (1, 2, 1, "claim"), (9, 9, 500, "add")))
    assert out.dropDuplicates(["task_id", "number"]).count() == out.count() == len(got)
    assert out.where(F.col("batch").isNull()).isEmpty() if "batch" in out.columns else True
