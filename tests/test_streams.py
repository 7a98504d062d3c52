import datetime as dt

from pyspark.sql import functions as F

from finevidence.plans import streams
from finevidence.streaming import steps, windows

AT = dt.datetime(2024, 1, 1)


def land(spark, folder, rows):
    """rows: (event_id, hours, user, type)."""
    df = spark.createDataFrame([(i, AT + dt.timedelta(hours=h), u, k, 1.0, None) for i, h, u, k in rows], steps.EVENTS)
    df.coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    folder, base = f"{tmp_path}/landed", f"file://{tmp_path}/out"
    each = [
        [(0, 0.5, 1, "a"), (1, 1.5, 1, "a"), (2, 9.0, 1, "b")],
        [(3, 2.2, 2, "a"), (4, 7.5, 2, "a"), (5, 20.0, None, "a")],  # hour 2 was closed at 9 - 3, hour 7 not
        [(6, 16.9, 2, "b"), (7, 17.0, 2, "b"), (8, 0.1, 2, None)],  # hour 16 ends at 17 = 20 - 3: closed
        [(9, 40.0, 2, "a")],
    ]
    for rows in each:
        land(spark, folder, rows)
        raw = spark.readStream.schema(steps.EVENTS).parquet(folder)
        windows.write_closed(windows.closed_windows(raw, "ts", ["event_type"], "1 hour", "3 hours", [F.count("*").alias("n")]), base)
        windows.write_late(raw, base, "ts", "1 hour", "3 hours")
    late = windows.read_late(spark, base, steps.EVENTS).collect()
    assert {(r.event_id, r.batch) for r in late} == {(3, 1), (6, 2), (8, 2)}
    closed = {((r.start - AT).total_seconds() / 3600, r.event_type): r.n for r in spark.read.parquet(f"{base}/windows").collect()}
    assert closed == {(0, "a"): 1, (1, "a"): 1, (9, "b"): 1, (7, "a"): 1, (20, "a"): 1, (17, "b"): 1}
    assert len(late) + sum(closed.values()) == sum(map(len, each)) - 1  # the last window is open


def test_stuck_run_expires_and_starts_anew(spark, tmp_path):
    """Runs 1 and 3 fall silent, 1 with a step that runs; run 1 comes back with a state of its own."""
    folder, base = f"{tmp_path}/landed", f"file://{tmp_path}/out"
    plan = lambda raw: steps.live_state(steps.step_events(raw, "1 hour"), 5 * 3_600_000)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for rows in ([(0, 0, 1, "load"), (3, 0.5, 3, "load"), (2, 1, 2, "load")], [(5, 6.5, 2, "load"), (4, 6.6, 2, "rank")], [(7, 8, 1, "rank")], [(9, 30, 2, "rank")]):
        land(spark, folder, rows)
        got = steps.run_updates(spark, folder, base, plan)
    rows = sorted(((r.batch, r.run_id, r.events, r.running, r.done, r.stuck) for r in got.collect()), key=lambda r: (r[1], r[0], r[5]))
    of = lambda run: [r[2:] for r in rows if r[1] == run]
    assert of(1)[:2] == [(1, "load", "", False), (1, "load", "", True)] and of(1)[2:] == [(1, "", "rank", False), (1, "", "rank", False)]
    assert of(3) == [(1, "", "load", False), (1, "", "load", False)]  # silent with nothing that runs: not stuck
    assert of(2)[-1] == (4, "", "load,rank", False)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_all_six_node_states(spark, sf_dir):
    got = streams.m10_live_nodes(spark, sf_dir)
    assert {r.status for r in got.select("status").distinct().collect()} == {"ok", "failed", "simulated", "running", "skipped", "pending"}
    assert got.count() == got.select("run_id", "node").distinct().count()


def test_node_states_without_steps(spark):
    nodes = spark.createDataFrame([(0, "a", "x", 1, "c"), (1, "b", "y", 2, "d")], "nth int, node string, word string, phase int, capability string")
    states = spark.createDataFrame([(1, 2, False, []), (2, 1, False, [(0, "Y!", 0, 1, "end", None)]), (3, 1, False, [(5, "xy", 5, 1, "end", True), (1, "x", 1, 0, "start", True)])], steps.STATES)
    got = {(r.run_id, r.node): r.status for r in steps.node_states(states, nodes, 2, ("d",)).collect()}
    assert got == {(1, "a"): "pending", (1, "b"): "pending", (2, "a"): "skipped", (2, "b"): "failed", (3, "a"): "running", (3, "b"): "simulated"}
