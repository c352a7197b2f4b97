"""States kept by a stream, against the fold of all events and the batch stages."""

import random

from pyspark.sql import functions as F

from inkveil.operators.tasks import advance_status, stage_gate_identify, stage_gate_parse, stage_gate_render
from inkveil.streaming import task_states as T

SCHEMA = "task_id string, at timestamp, event_id bigint, stage string, error_code string"


def events(count, seed=3):
    rng = random.Random(seed)
    return [
        (f"t{rng.randint(0, 40)}", 1_700_000_000 + rng.randint(0, 5000), i, rng.choice(["parse", "identify", "export", "other"]), rng.choice([None, None, None, "E"]))
        for i in range(count)
    ]


def wanted(rows):
    by_task = {}
    for task, at, event, stage, error in rows:
        by_task.setdefault(task, []).append([at * 1000, event, stage, error is not None])
    return {task: T.folded(T.BEGIN, own) for task, own in by_task.items()}


def run(spark, parts, folder, delay):
    for n, rows in enumerate(parts):
        frame = spark.createDataFrame(rows, SCHEMA.replace("timestamp", "long")).withColumn("at", F.timestamp_seconds("at"))
        frame.coalesce(1).write.parquet(f"{folder}/in/part={n}")
        arriving = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in/*")
        T.stream_task_states(arriving, f"{folder}/out", f"{folder}/checkpoint", delay).awaitTermination()  # a restart each time
    return {r.task_id: (r.status, r.accepted, r.refused) for r in T.latest_states(spark, f"{folder}/out").collect()}


def short(states):
    return {task: (s["status"], s["accepted"], s["refused"]) for task, s in states.items()}


def test_any_order_and_restarts(spark, tmp_path):
    rows = events(600)
    parts = [rows[i::3] for i in range(3)]  # every part reaches over all times
    assert run(spark, parts, str(tmp_path), "1 day") == short(wanted(rows))


def test_events_before_the_watermark_are_settled(spark, tmp_path):
    """Far apart batches: the early events are folded and dropped, and one that comes too late is not taken."""
    early, late = events(200, 5), [(t, at + 1_000_000, i + 1000, s, e) for t, at, i, s, e in events(200, 6)]
    again = [(t, at + 2_000_000, i + 2000, s, e) for t, at, i, s, e in events(100, 7)]
    too_late = [("t1", 1_700_000_001, 9999, "parse", None)]
    assert run(spark, [early, late, too_late + again], str(tmp_path), "1 hour") == short(wanted(early + late + again))


def test_states_agree_with_the_batch_gates(spark):
    """One event on every status: the gates of the table stages let in what ``moved`` lets in."""
    for status in ("uploaded", "parsed", "identified", "completed", "failed"):
        for content in (None, "text"):
            task = spark.createDataFrame([("1", status, content)], "id string, status string, content string")
            for stage, gate, following in (
                ("parse", stage_gate_parse, "parsed"), ("identify", stage_gate_identify, "identified"), ("export", stage_gate_render, "completed"),
            ):
                row = gate(task).withColumn("after", advance_status(F.lit(None), following)).first()
                after = T.moved(status, content is not None, stage, False)
                assert (after is None) == (row["reject_reason"] is not None)
                assert after is None or after[0] == row["after"]
