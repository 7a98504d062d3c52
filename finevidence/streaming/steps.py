"""Live state of runs from a stream of step events.

Each run keeps the newest event of each of its steps in one value, which a trigger reads and writes once; the fold gives the same state for repeated and late events. Events older than the watermark are dropped before they
reach the state. With a time-out, a timer in event time is set after a run's newest event; when the watermark passes
it, the run is reported once more, as stuck if a step still runs, and its state goes. State is kept by RocksDB, so it needn't fit
in memory.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
OUT = "run_id BIGINT, events BIGINT, running STRING, done STRING, stuck BOOLEAN"
#: ``steps``: first and newest event of each step, in microseconds, and what the newest says.
STATES = "run_id BIGINT, events BIGINT, stuck BOOLEAN, steps ARRAY<STRUCT<first: BIGINT, step: STRING, at: BIGINT, event_id: BIGINT, kind: STRING, ok: BOOLEAN>>"
ROCKS_DB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Partitions of a stream's state for each core: each of them writes its store anew in every batch, however little it holds.
STATE_A_CORE = 2


def state_settings(spark: SparkSession) -> dict[str, str]:
    """Where a stream keeps its state, and in how many partitions: as many as the session's shuffles have, or fewer on few cores."""
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), STATE_A_CORE * spark.sparkContext.defaultParallelism)
    return ROCKS_DB | {"spark.sql.shuffle.partitions": str(parts)}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session while a query starts and runs; the old ones come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def step_events(raw: DataFrame, late: str = "1 hour", run: Column | None = None) -> DataFrame:
    """``run_id, step, kind, at, event_id, ok``: deduplicated within the watermark."""
    kind = F.when(F.col("event_id") % 2 == 0, "start").otherwise("end")
    run = F.col("user_id") if run is None else run
    e = raw.where("user_id IS NOT NULL").select(run.cast("bigint").alias("run_id"), F.coalesce("event_type", F.lit("")).alias("step"), kind.alias("kind"), F.col("ts").alias("at"), "event_id", (F.col("event_type") != "error").alias("ok"))
    return e.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def fold(steps: dict[str, list], at: list, step: list, kind: list, event_id: list) -> dict[str, list]:
    """The newest event of each step; order of arrival doesn't matter."""
    for t, s, k, i in zip(at, step, kind, event_id):
        if s not in steps or [t, i] > steps[s][:2]:
            steps[s] = [t, i, k]
    return steps


class RunSteps(StatefulProcessor):
    """State of one run, read and written once a trigger, as every access is a call to the JVM: the number of its events, its timer, and
    its steps with the first event and the newest of each."""

    def __init__(self, silence_ms: int = 0):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "events bigint, due bigint, steps string")

    def _held(self) -> tuple[int, int | None, dict[str, list]]:
        held = self.run.get()
        return (held[0], held[1], json.loads(held[2])) if held is not None else (0, None, {})

    def _snapshot(self, key, n: int, steps: dict[str, list], expired: bool) -> pd.DataFrame:
        rows = [{"first": first, "step": step, "at": at, "event_id": i, "kind": kind, "ok": ok} for step, (first, at, i, kind, ok) in steps.items()]
        return pd.DataFrame({"run_id": [key[0]], "events": [n], "stuck": [expired and any(s["kind"] == "start" for s in rows)], "steps": [rows]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, timer, known = self._held()
        newest = 0
        for f in rows:
            n += len(f)
            for at, step, kind, i, ok in zip(f["at"].astype("datetime64[us]").astype("int64").tolist(), f["step"].tolist(), f["kind"].tolist(), f["event_id"].tolist(), f["ok"].tolist()):
                newest = max(newest, at)
                old = known.get(step)
                first = at if old is None else min(old[0], at)
                last = [at, i, kind, None if ok is None else bool(ok)]
                known[step] = [first, *(last if old is None or last[:2] > old[1:3] else old[1:])]
        due = None
        if self.silence_ms:
            due = max(newest // 1000 + self.silence_ms, timer or 0)
            if due != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
        self.run.update((n, due, json.dumps(known)))
        yield self._snapshot(key, n, known, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, _, known = self._held()
        yield self._snapshot(key, n, known, True)
        self.run.clear()

    def close(self) -> None:
        pass


def step_states(events: DataFrame, silence_ms: int = 0) -> DataFrame:
    """``run_id, events, stuck, steps``: each run's state after each trigger that touched it, and once more when it
    has been silent for ``silence_ms`` (0: no time-out). A query of it runs with ``ROCKS_DB``."""
    return events.groupBy("run_id").transformWithStateInPandas(RunSteps(silence_ms), STATES, "update", "EventTime" if silence_ms else "None")


def step_updates(events: DataFrame) -> DataFrame:
    """``run_id, step, events, first, last``: a step's number of events, its first one's time and what its newest says, after each trigger that
    touched it; for streams without a time-out. The state is an aggregate of Spark's own, so short runs cost no call each."""
    at = F.unix_micros("at")
    return events.groupBy("run_id", "step").agg(F.count("*").alias("events"), F.min(at).alias("first"), F.max(F.struct(at.alias("at"), "event_id", "kind", "ok")).alias("last"))


def last_states(updates: DataFrame) -> DataFrame:
    """Each run's state (as of ``step_states``) after its last update, from all updates of ``step_updates``."""
    step = updates.groupBy("run_id", "step").agg(F.max("events").alias("n"), F.max_by(F.struct("first", "last"), "events").alias("s"))
    listed = F.collect_list(F.struct("s.first", "step", "s.last.at", "s.last.event_id", "s.last.kind", "s.last.ok"))
    return step.groupBy("run_id").agg(F.sum("n").alias("events"), F.lit(False).alias("stuck"), listed.alias("steps"))


def named(states: DataFrame) -> DataFrame:
    """``run_id, events, running, done, stuck``: names of the steps, by name."""
    names = lambda running: F.array_join(F.array_sort(F.transform(F.filter("steps", lambda s: (s["kind"] == "start") == F.lit(running)), lambda s: s["step"])), ",")
    return states.select("run_id", "events", names(True).alias("running"), names(False).alias("done"), "stuck")


def live_state(events: DataFrame, silence_ms: int = 0) -> DataFrame:
    """``run_id, events, running, done, stuck``: each run's state after each trigger that touched it."""
    return named(step_states(events, silence_ms))


def latest(updates: DataFrame) -> DataFrame:
    """The newest update of each run."""
    return updates.groupBy("run_id").agg(F.max_by(F.struct("running", "done", "stuck"), "events").alias("s"), F.max("events").alias("events")).select("run_id", "events", "s.running", "s.done")


def node_states(states: DataFrame, nodes: DataFrame, phases: int, mocks: tuple[str, ...] = ()) -> DataFrame:
    """``run_id, events, phase, node, status``: every node of a run after each of its updates, a stream joined with the static node
    dimension by phase. nodes: ``nth, node, word, phase, capability``, a few rows.

    A step takes the first node in order whose word its name holds and that no earlier step of the run has taken. A run is
    in the last phase of which a step took a node (the first, if none did): nodes of phases before are ok, failed or skipped, of the run's phase
    also running or, if no step took them, pending, of later phases pending. An ok node whose capability is mocked is simulated."""
    listed = nodes.groupBy().agg(F.array_sort(F.collect_list(F.struct("nth", "node", "word", "phase"))).alias("listed"))
    in_order = F.array_sort("steps")  # by first event
    empty = F.array().cast("array<struct<node:string,phase:int,kind:string,ok:boolean>>")

    def take(acc: Column, s: Column) -> Column:
        free = F.filter("listed", lambda n: F.contains(F.lower(s["step"]), n["word"]) & ~F.exists(acc, lambda a: a["node"] == n["node"]))
        return F.concat(acc, F.transform(F.slice(free, 1, 1), lambda n: F.struct(n["node"].alias("node"), n["phase"].alias("phase"), s["kind"].alias("kind"), s["ok"].alias("ok"))))

    s = states.crossJoin(F.broadcast(listed))  # one row
    s = s.select("run_id", "events", F.aggregate(in_order, empty, take).alias("taken"))
    s = s.withColumn("live", F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform("taken", lambda t: t["phase"])), F.lit(1))))
    by_phase = s.withColumn("phase", F.explode(F.sequence(F.lit(1), F.lit(phases))))
    own = F.get(F.filter("taken", lambda t: t["node"] == F.col("node")), F.lit(0))
    status = (
        F.when(own["kind"] == "start", "running").when(own["kind"].isNotNull() & ~F.coalesce(own["ok"], F.lit(False)), "failed")
        .when(own["kind"].isNotNull(), F.when(F.col("capability").isin(*mocks), "simulated").otherwise("ok"))
        .when(F.col("phase") < F.col("live"), "skipped").otherwise("pending")
    )
    return by_phase.join(F.broadcast(nodes), "phase").select("run_id", "events", "phase", "node", status.alias("status"))


def run_updates(spark: SparkSession, source: str, base: str, plan: Callable[[DataFrame], DataFrame], files_a_batch: int | None = None) -> DataFrame:
    """Run a stateful plan over all event files that have landed in ``source`` since the last call with the same ``base``, and return all
    updates so far, with their ``batch``. A batch that is tried again replaces what it wrote."""
    reader = spark.readStream.schema(EVENTS).option("latestFirst", "false")
    raw = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(source)
    with settings(spark, state_settings(spark)):
        out = plan(raw)

        def write(df: DataFrame, batch: int) -> None:
            df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/updates/batch-{batch}")

        q = out.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()
    schema = ", ".join(f"`{c}` {t}" for c, t in out.dtypes) + ", batch INT"
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/updates")


def replay(spark: SparkSession, sf_dir: str, folder: str, silence_ms: int = 0, files_a_batch: int = 1000) -> DataFrame:
    """Run the stream over the landed event files (one file, or a folder of parts) and return the last state of
    each run. ``folder`` is shared by driver and executors."""
    plan = lambda raw: live_state(step_events(raw), silence_ms)
    return latest(run_updates(spark, f"{sf_dir}/events.parquet*", f"{folder}/{uuid.uuid4().hex}", plan, files_a_batch))
