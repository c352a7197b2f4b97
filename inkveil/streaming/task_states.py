"""States of tasks kept by a stream of their events.

A task begins as ``uploaded``; events (task_id, at, event_id, stage, error_code) of the stages parse, identify
and export move it on under the same gates as the batch stages. They may arrive in any order: the state is
what all events give in the order of (at, event_id). So a task keeps the events that an earlier one may
still precede, and folds those that the watermark has passed into its status, by a timer where nothing else arrives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATES = "task_id string, status string, accepted bigint, refused bigint"

#: Where states are kept: on disk, with one bound on memory for all of an executor's.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def moved(status: str, content: bool, stage: str, failed: bool) -> tuple[str, bool] | None:
    """The task's status and whether it has content after an event; none if a gate refuses it."""
    if stage == "parse" and status == "uploaded":
        return ("failed", content) if failed else ("parsed", True)
    if stage == "identify" and status == "parsed" and content:
        return ("failed" if failed else "identified"), content
    if stage == "export" and content:
        return ("failed" if failed else "completed"), content
    return None


def folded(state: dict, events: list[list]) -> dict:
    """``state`` after events [at, event_id, stage, failed] in their order."""
    status, content, accepted, refused = (state[k] for k in ("status", "content", "accepted", "refused"))
    for _, _, stage, failed in sorted(events):
        after = moved(status, content, stage, failed)
        if after is None:
            refused += 1
        else:
            (status, content), accepted = after, accepted + 1
    return {"status": status, "content": content, "accepted": accepted, "refused": refused}


BEGIN = {"status": "uploaded", "content": False, "accepted": 0, "refused": 0}


def task_states(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """The states (``STATES``) of the tasks that a batch of the stream has events of.

    Events that come ``delay`` later than the newest one are not taken any more.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base, held = json.loads(state.get[0]) if state.exists else (BEGIN, [])
        new = [
            [int(at), int(event), stage, error is not None]
            for batch in batches
            for at, event, stage, error in zip(batch["at_ms"], batch["event_id"], batch["stage"], batch["error_code"])
        ]
        held = sorted(held + new)
        passed = state.getCurrentWatermarkMs()
        settled = [e for e in held if e[0] < passed]
        base, held = folded(base, settled), held[len(settled) :]
        state.update((json.dumps([base, held]),))
        if held:
            state.setTimeoutTimestamp(max(held[0][0], passed) + 1)
        if new:
            now = folded(base, held)
            yield pd.DataFrame({"task_id": [key[0]], **{k: [now[k]] for k in ("status", "accepted", "refused")}})

    timed = events.withWatermark("at", delay).select(
        F.col("task_id").cast("string").alias("task_id"), "at", F.unix_millis("at").alias("at_ms"), "event_id", "stage", "error_code"
    )
    return timed.groupBy("task_id").applyInPandasWithState(run, STATES, "events string", "update", GroupStateTimeout.EventTimeTimeout)


def stream_task_states(events: DataFrame, out_dir: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Write the states of each batch to its own folder below ``out_dir``; a repeated batch overwrites its own."""
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        return (
            task_states(events, delay).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def latest_states(spark: SparkSession, out_dir: str) -> DataFrame:
    """The last state of every task that ``stream_task_states`` has written."""
    rows = spark.read.schema(f"{STATES}, batch_id bigint").parquet(out_dir)
    last = F.max_by(F.struct("status", "accepted", "refused"), "batch_id").alias("s")
    return rows.groupBy("task_id").agg(last).select("task_id", "s.*")
