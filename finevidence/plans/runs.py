"""Queries on run traces."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from finevidence.operators import reports
from finevidence.operators import runs as R
from finevidence.sources import adapters as A
from finevidence.sources.adapters import shared_folder

r = lambda c, n=6: F.round(c, n).alias(c)
NODES = [("intake", "sign"), ("reader", "e"), ("buyer", "purchase"), ("viewer", "view"), ("rest", "c")]


def _costed(spark, sf_dir):
    return R.with_cost(A.trace(spark, sf_dir), R.tariff(spark))


def m01_step_cost(spark, sf_dir):
    c = _costed(spark, sf_dir)
    return c.select(F.col("step_ord.event_id").alias("event_id"), "run_id", "step", r("cost", 9), "cost_real", R.step_kind(c).alias("kind"))


def m03_step_stats(spark, sf_dir):
    s = R.step_stats(_costed(spark, sf_dir))
    return s.select("step", "model", r("mean_seconds"), r("max_seconds"), r("mean_cost"), r("mean_tokens_in"), r("mean_tokens_out"), "runs_ok", "runs_failed")


def m04_run_summary(spark, sf_dir):
    s = R.run_summary(R.run_totals(_costed(spark, sf_dir)))
    return s.select("runs", *(r(c) for c in s.columns[1:]))


def m05_components(spark, sf_dir):
    return R.components(R.step_stats(_costed(spark, sf_dir)), [("STT", "signup"), ("TTS", "speech"), ("Image", "purchase"), ("Embeddings", "view")]).select(A.clean("nth").alias("nth"), "component", "ran", r("mean_seconds"), r("mean_cost"))


def m06_cost_origin(spark, sf_dir):
    return R.cost_origin(R.run_totals(_costed(spark, sf_dir))).select("run_id", r("cost", 10), "origin")


def m07_retries(spark, sf_dir):
    return R.retries(_costed(spark, sf_dir)).select("run_id", "step", "attempts", "tokens_in", "tokens_out", r("cost", 10), "cost_real", "ok")


def m08_run_kpis(spark, sf_dir):
    return R.run_totals(_costed(spark, sf_dir)).select("run_id", "steps", "models", r("total_seconds"), r("cost", 10))


def m11_outcomes(spark, sf_dir):
    return R.outcomes(A.trace(spark, sf_dir), ("signup",))


def m12_service_levels(spark, sf_dir):
    return R.service_levels(R.run_totals(_costed(spark, sf_dir)))


def m13_cost_shares(spark, sf_dir):
    return R.cost_shares(R.step_stats(_costed(spark, sf_dir))).select("step", r("mean_cost"), r("share"), "slowest")


def m14_plan_margins(spark, sf_dir):
    s = R.plan_margins(R.run_summary(R.run_totals(_costed(spark, sf_dir))))
    return s.select("plan", *(r(c) for c in s.columns[1:]))


def m14_scale_table(spark, sf_dir):
    s = R.scale_table(R.run_summary(R.run_totals(_costed(spark, sf_dir))))
    return s.select(A.clean("runs").alias("runs"), r("monthly"))


def m11_outcome_messages(spark, sf_dir):
    """Runs of one step are bare."""
    t = A.trace(spark, sf_dir)
    return R.outcome_messages(t, ("signup",), t.groupBy("run_id").agg(F.count("*").alias("n")).where("n = 1"))


def m15_trace_rows(spark, sf_dir):
    return R.trace_rows(_costed(spark, sf_dir)).select(F.col("step_ord.event_id").alias("event_id"), "run_id", "line")


def u03_warnings(spark, sf_dir):
    """Failed steps, then targets missed, then costs that were estimated."""
    c = _costed(spark, sf_dir)
    totals = R.run_totals(c)
    failed = c.where("NOT ok").select("run_id", F.concat(F.lit("failed: "), "step").alias("warning"))
    slow = R.service_levels(totals).where("NOT all_ok").select("run_id", F.lit("slow").alias("warning"))
    guess = R.cost_origin(totals).where("origin = 'estimated'").select("run_id", F.lit("cost estimated").alias("warning"))
    return reports.warnings_union([failed, slow, guess], "run_id").select("run_id", F.array_join("warnings", "; ").alias("warnings"))


def m15_report_rows(spark, sf_dir):
    return R.report_rows(R.step_stats(_costed(spark, sf_dir)))


def m10_node_status(spark, sf_dir):
    return R.node_status(A.trace(spark, sf_dir), NODES)


def s13_report_sink(spark, sf_dir):
    """Step statistics written out and read again."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    R.write_report(m03_step_stats(spark, sf_dir), path)
    return spark.read.schema("step STRING, model STRING, mean_seconds DOUBLE, runs_ok BIGINT, runs_failed BIGINT").json(path)


def a13_steps_by_model(spark, sf_dir):
    return R.steps_by_model(A.trace(spark, sf_dir))


def w12_timeline(spark, sf_dir):
    return R.timeline(A.trace(spark, sf_dir)).select("run_id", F.col("step_ord.event_id").alias("event_id"), "step", "parallel", r("started"), r("ended"))


def j10_step_nodes(spark, sf_dir):
    return R.node_of_step(A.trace(spark, sf_dir), NODES)


def u01_phase_union(spark, sf_dir):
    """Traces of two phases keep their order in one."""
    t = A.trace(spark, sf_dir)
    first, second = t.where("not parallel").withColumn("phase", F.lit(1)), t.where("parallel").withColumn("phase", F.lit(2))
    both = first.unionByName(second)
    return both.groupBy("run_id", "phase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_ord", "step"))), lambda x: x["step"]), ",").alias("steps")).withColumn("phase", A.clean("phase"))


def _events(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("step"), F.col("ts").alias("at"), "event_id", F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("kind"))


def z02_latest_state(spark, sf_dir):
    return R.latest_state(_events(spark, sf_dir))


QUERIES = {f.__name__: f for f in (m01_step_cost, m03_step_stats, m04_run_summary, m05_components, m06_cost_origin, m07_retries, m08_run_kpis, m11_outcomes, m12_service_levels, m13_cost_shares, m14_plan_margins, m14_scale_table, m11_outcome_messages, m15_trace_rows, u03_warnings, m15_report_rows, m10_node_status, s13_report_sink, a13_steps_by_model, w12_timeline, j10_step_nodes, u01_phase_union, z02_latest_state)}

_TRACE = """tr AS (
  SELECT user_id AS run_id, ts, event_id, row_number() OVER (ORDER BY ts, event_id) AS nth, event_type AS step, concat('m', k % 3) AS model, value / 100 AS seconds,
         event_type <> 'error' AS ok, k % 2 = 0 AS parallel, k AS tokens_in, k % 7 AS tokens_out, CASE WHEN k % 5 = 0 THEN NULL ELSE value / 1000 END AS cost_usd
  FROM (SELECT *, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events WHERE user_id IS NOT NULL)),
costed AS (
  SELECT *, coalesce(cost_usd, CASE WHEN step = 'purchase' THEN 0.04 WHEN step = 'signup' THEN seconds / 60 * 0.006 WHEN step = 'view' THEN tokens_in / 1e6 * 0.02
                                    ELSE (tokens_in * 3.0 + tokens_out * 15.0) / 1e6 END) AS cost, cost_usd IS NOT NULL AS cost_real FROM tr),
stats AS (
  SELECT step, coalesce(arg_min(model, run_id * 1000000000 + nth) FILTER (ok), '-') AS model, coalesce(avg(seconds) FILTER (ok), avg(seconds)) AS mean_seconds,
         coalesce(max(seconds) FILTER (ok), max(seconds)) AS max_seconds, coalesce(avg(cost) FILTER (ok), avg(cost)) AS mean_cost,
         coalesce(avg(tokens_in) FILTER (ok), avg(tokens_in)) AS mean_tokens_in, coalesce(avg(tokens_out) FILTER (ok), avg(tokens_out)) AS mean_tokens_out,
         count(*) FILTER (ok) AS runs_ok, count(*) FILTER (NOT ok) AS runs_failed FROM costed GROUP BY step),
totals AS (
  SELECT run_id, count(*) AS steps, count(DISTINCT model) AS models, coalesce(sum(seconds) FILTER (step <> 'purchase'), 0) AS report_seconds, sum(seconds) AS total_seconds,
         sum(cost) AS cost, coalesce(sum(cost) FILTER (cost_real), 0) AS cost_reported FROM costed GROUP BY run_id)"""
_half_up = lambda c: f"round(CAST({c} AS DECIMAL(18, 9)), 2)"
_r = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)

# Steps in order, each with the first node that its name holds and no earlier step of its run has.
_TAKEN = "tr AS (" + _TRACE.split("tr AS (", 1)[1].split("),\ncosted", 1)[0] + f"""),
st AS (SELECT run_id, step, row_number() OVER (PARTITION BY run_id ORDER BY first) AS i, ok FROM (SELECT run_id, lower(step) AS step, min(nth) AS first, bool_and(ok) AS ok FROM tr GROUP BY 1, 2)),
taken AS (
  SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS held, CAST(NULL AS VARCHAR) AS node, CAST(NULL AS VARCHAR) AS step, true AS ok FROM st
  UNION ALL SELECT run_id, i, CASE WHEN node IS NULL THEN held ELSE list_append(held, node) END, node, step, ok FROM (
    SELECT st.run_id, st.i, held, st.step, st.ok, list_filter([{', '.join(f"{{'node': '{n}', 'word': '{w}'}}" for n, w in NODES)}], lambda x: contains(st.step, x.word) AND NOT list_contains(held, x.node))[1].node AS node
    FROM taken JOIN st ON st.run_id = taken.run_id AND st.i = taken.i + 1))"""

ORACLE_SQL = {
    "j10_step_nodes": f"WITH RECURSIVE {_TAKEN} SELECT run_id, node, step FROM taken WHERE node IS NOT NULL",
    "m10_node_status": f"""WITH RECURSIVE {_TAKEN} SELECT r.run_id, n.node, CASE WHEN t.ok IS NULL THEN 'skipped' WHEN t.ok THEN 'ok' ELSE 'failed' END AS status
      FROM (SELECT DISTINCT run_id FROM tr) r CROSS JOIN (SELECT unnest([{', '.join(f"'{n}'" for n, _ in NODES)}]) AS node) n LEFT JOIN (SELECT * FROM taken WHERE node IS NOT NULL) t ON t.run_id = r.run_id AND t.node = n.node""",
    "m15_report_rows": f"WITH {_TRACE} SELECT step, printf('%-12s %8.2f s  max %8.2f s  %10.6f USD  %d ok  %d failed', step, {_half_up('mean_seconds')}, {_half_up('max_seconds')}, mean_cost, runs_ok, runs_failed) AS line FROM stats",
    "m15_trace_rows": f"WITH {_TRACE} SELECT event_id, run_id, printf('%s %-12s %8.2f s  %6d in  %6d out  %s', CASE WHEN parallel THEN '||' ELSE '  ' END, step, {_half_up('seconds')}, tokens_in, tokens_out, CASE WHEN ok THEN 'ok' ELSE 'failed' END) AS line FROM costed",
    "m14_scale_table": f"WITH {_TRACE}, m AS (SELECT avg(cost) AS c FROM totals) SELECT runs, round(runs * c + 12, 6) AS monthly FROM m, (SELECT unnest([100, 1000, 10000])::BIGINT AS runs)",
    "m11_outcome_messages": f"""WITH {_TRACE}, g AS (SELECT run_id, arg_min(step, nth) FILTER (NOT ok AND step = 'signup') AS broken, string_agg(DISTINCT step, ', ' ORDER BY step) FILTER (NOT ok AND step <> 'signup') AS warned, count(*) = 1 AS bare FROM tr GROUP BY 1)
      SELECT run_id, CASE WHEN broken IS NOT NULL OR bare THEN 'failed' WHEN warned IS NOT NULL THEN 'degraded' ELSE 'ok' END AS outcome,
        CASE WHEN broken IS NOT NULL THEN 'step failed: ' || broken WHEN bare THEN 'no data for the ticker' WHEN warned IS NOT NULL THEN 'without: ' || warned END AS message FROM g""",
    "u03_warnings": f"""WITH {_TRACE}, w AS (SELECT DISTINCT run_id, 0 AS nth, 'failed: ' || step AS warning FROM costed WHERE NOT ok UNION ALL SELECT run_id, 1, 'slow' FROM totals WHERE total_seconds > 60
        UNION ALL SELECT run_id, 2, 'cost estimated' FROM totals WHERE cost > 0 AND cost_reported / cost <= 0.005)
      SELECT run_id, string_agg(warning, '; ' ORDER BY nth, warning) AS warnings FROM w GROUP BY 1""",
    "m01_step_cost": f"WITH {_TRACE} SELECT event_id, run_id, step, round(cost, 9) AS cost, cost_real, CASE WHEN NOT ok THEN 'failed' WHEN cost = 0 AND tokens_in = 0 AND model = 'm0' THEN 'local' ELSE 'model' END AS kind FROM costed",
    "m03_step_stats": f"WITH {_TRACE} SELECT step, model, {_r('mean_seconds', 'max_seconds', 'mean_cost', 'mean_tokens_in', 'mean_tokens_out')}, runs_ok, runs_failed FROM stats",
    "m04_run_summary": f"""WITH {_TRACE} SELECT count(*) AS runs, round(avg(report_seconds), 6) AS mean_report_seconds, round(max(report_seconds), 6) AS max_report_seconds, round(avg(total_seconds), 6) AS mean_total_seconds,
      round(max(total_seconds), 6) AS max_total_seconds, round(avg(cost), 6) AS mean_cost, round(CASE WHEN sum(cost) > 0 THEN sum(cost_reported) / sum(cost) ELSE 0 END, 6) AS real_cost_share FROM totals""",
    "m05_components": f"""WITH {_TRACE} SELECT 0 AS nth, 'LLM' AS component, count(*) > 0 AS ran, round(coalesce(sum(mean_seconds), 0), 6) AS mean_seconds, round(coalesce(sum(mean_cost), 0), 6) AS mean_cost
      FROM stats WHERE mean_tokens_in > 0 OR mean_tokens_out > 0
      UNION ALL SELECT nth, component, step IS NOT NULL, round(coalesce(mean_seconds, 0), 6), round(coalesce(mean_cost, 0), 6)
      FROM (VALUES (1, 'STT', 'signup'), (2, 'TTS', 'speech'), (3, 'Image', 'purchase'), (4, 'Embeddings', 'view')) AS k(nth, component, name) LEFT JOIN stats ON step = name""",
    "m06_cost_origin": f"""WITH {_TRACE} SELECT run_id, round(cost, 10) AS cost, CASE WHEN cost <= 0 THEN 'none' WHEN cost_reported / cost >= 0.995 THEN 'reported' WHEN cost_reported / cost <= 0.005 THEN 'estimated' ELSE 'mixed' END AS origin FROM totals""",
    "m07_retries": f"WITH {_TRACE} SELECT run_id, step, count(*) AS attempts, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum(cost), 10) AS cost, bool_and(cost_real) AS cost_real, arg_max(ok, nth) AS ok FROM costed GROUP BY 1, 2",
    "m08_run_kpis": f"WITH {_TRACE} SELECT run_id, steps, models, round(total_seconds, 6) AS total_seconds, round(cost, 10) AS cost FROM totals",
    "m11_outcomes": f"WITH {_TRACE} SELECT run_id, CASE WHEN bool_or(NOT ok AND step = 'signup') THEN 'failed' WHEN bool_or(NOT ok AND step <> 'signup') THEN 'degraded' ELSE 'ok' END AS outcome, count(*) FILTER (NOT ok) AS failed_steps FROM tr GROUP BY 1",
    "m12_service_levels": f"WITH {_TRACE} SELECT run_id, report_seconds <= 30 AS report_ok, total_seconds <= 60 AS all_ok FROM totals",
    "m13_cost_shares": f"WITH {_TRACE} SELECT step, round(mean_cost, 6) AS mean_cost, round(mean_cost / sum(mean_cost) OVER (), 6) AS share, mean_seconds = max(mean_seconds) OVER () AS slowest FROM stats",
    "m14_plan_margins": f"""WITH {_TRACE}, m AS (SELECT avg(cost) AS c FROM totals) SELECT plan, round(quota * c, 6) AS cost_at_quota, round(1 - quota * c / price, 6) AS margin, round(1 - 2 * quota * c / price, 6) AS margin_at_double, round(quota * c + 12, 6) AS monthly
      FROM m, (VALUES ('basic', 9.0, 100), ('team', 49.0, 1000), ('desk', 199.0, 10000)) AS p(plan, price, quota)""",
    "a13_steps_by_model": f"WITH {_TRACE} SELECT model, string_agg(step, ',' ORDER BY first) AS steps FROM (SELECT model, step, min(nth) AS first FROM tr GROUP BY 1, 2) GROUP BY 1",
    "w12_timeline": f"""WITH {_TRACE}, b AS (SELECT *, sum(opens) OVER (PARTITION BY run_id ORDER BY nth ROWS UNBOUNDED PRECEDING) AS block FROM (
        SELECT *, CASE WHEN parallel AND coalesce(lag(parallel) OVER (PARTITION BY run_id ORDER BY nth), false) THEN 0 ELSE 1 END AS opens FROM tr)),
      i AS (SELECT *, sum(seconds) OVER (PARTITION BY run_id, block, step ORDER BY nth ROWS UNBOUNDED PRECEDING) AS in_block FROM b),
      t AS (SELECT run_id, block, sum(lasts) OVER (PARTITION BY run_id ORDER BY block ROWS UNBOUNDED PRECEDING) - lasts AS t0 FROM (SELECT run_id, block, max(in_block) AS lasts FROM i GROUP BY 1, 2))
      SELECT run_id, event_id, step, parallel, round(t0 + in_block - seconds, 6) AS started, round(t0 + in_block, 6) AS ended FROM i JOIN t USING (run_id, block)""",
    "s13_report_sink": f"WITH {_TRACE} SELECT step, model, round(mean_seconds, 6) AS mean_seconds, runs_ok, runs_failed FROM stats",
    "u01_phase_union": f"WITH {_TRACE} SELECT run_id, CAST(CASE WHEN parallel THEN 2 ELSE 1 END AS BIGINT) AS phase, string_agg(step, ',' ORDER BY nth) AS steps FROM tr GROUP BY 1, 2",
    "z02_latest_state": "SELECT user_id AS run_id, event_type AS step, CASE WHEN arg_max(event_id, nth) % 2 = 0 THEN 'running' ELSE 'done' END AS state FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS nth FROM events) GROUP BY 1, 2",
}
