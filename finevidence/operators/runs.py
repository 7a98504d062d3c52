"""Run cost, latency and service levels over a trace table.

A trace row is one step of one run: ``run_id, step_ord, step, model, seconds, ok, parallel, tokens_in,
tokens_out, cost_usd`` (null: not reported), ``modality`` (text, speech_to_text, speech, image or embedding) and
``chars`` (spoken characters). Everything is a groupBy of sums, so the map side combines
first and a step or run with a third of all rows is no hot spot; only per-run order uses windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Prices in USD (per million tokens, per minute, per million characters, per image) and targets in seconds.
TARIFF = {"llm_in": 3.0, "llm_out": 15.0, "stt_minute": 0.006, "tts_mchar": 15.0, "tts_hosted_mchar": 0.65, "image": 0.04, "embed": 0.02}
TARGETS = {"report": 30.0, "all": 60.0}
PLANS = [("basic", 9.0, 100), ("team", 49.0, 1000), ("desk", 199.0, 10000)]
#: The backend of hosted voices, by name.
HOSTED = "openrouter"
FIXED_MONTHLY, MONTHLY_RUNS = 12.0, (100, 1000, 10000)


def tariff(spark: SparkSession, tts_mchar: float | None = None) -> DataFrame:
    """One row of prices; speech may be priced by backend."""
    prices = TARIFF | ({} if tts_mchar is None else {"tts_mchar": tts_mchar})
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in prices.items()))


def speech_price(backend: Column, demo: Column, has_key: Column) -> Column:
    """Price a million spoken characters of a run by its backend: that of the hosted voices where the run asks for them or for any,
    has a key for them and is no demonstration, else the configured one."""
    hosted = ~F.coalesce(demo, F.lit(False)) & F.lower(F.trim(backend)).isin("auto", HOSTED) & F.coalesce(has_key, F.lit(False))
    return F.when(F.coalesce(hosted, F.lit(False)), TARIFF["tts_hosted_mchar"]).otherwise(TARIFF["tts_mchar"])


def with_cost(trace: DataFrame, prices: DataFrame) -> DataFrame:
    """``cost``: as reported, else by tariff and modality; ``cost_real``: whether it was reported."""
    estimate = (
        F.when(F.col("modality") == "image", F.col("image"))
        .when(F.col("modality") == "speech_to_text", F.col("seconds") / 60 * F.col("stt_minute"))
        .when(F.col("modality") == "speech", F.coalesce("chars", F.lit(0)) / 1e6 * F.col("tts_mchar"))
        .when(F.col("modality") == "embedding", F.col("tokens_in") / 1e6 * F.col("embed"))
        .otherwise((F.col("tokens_in") * F.col("llm_in") + F.col("tokens_out") * F.col("llm_out")) / 1e6)
    )
    out = trace.crossJoin(F.broadcast(prices))  # one row
    return out.withColumn("cost", F.coalesce("cost_usd", estimate)).withColumn("cost_real", F.col("cost_usd").isNotNull()).drop(*prices.columns)


def step_stats(costed: DataFrame) -> DataFrame:
    """Per step over all runs: means over successful rows, or over all if none succeeded."""
    def mean(c: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col("ok"), F.col(c))), F.avg(c)).alias(f"mean_{c}")

    return costed.groupBy("step").agg(
        F.coalesce(F.min_by("model", F.when(F.col("ok"), F.struct("run_id", "step_ord"))), F.lit("-")).alias("model"),
        mean("seconds"), F.coalesce(F.max(F.when(F.col("ok"), F.col("seconds"))), F.max("seconds")).alias("max_seconds"),
        mean("cost"), mean("tokens_in"), mean("tokens_out"),
        F.count(F.when(F.col("ok"), 1)).alias("runs_ok"), F.count(F.when(~F.col("ok"), 1)).alias("runs_failed"),
    )


def run_totals(costed: DataFrame, media: tuple[str, ...] = ("image", "speech")) -> DataFrame:
    """Per run: seconds to the report (all steps but media) and in all, cost, its reported part, models, steps."""
    report = ~F.coalesce(F.col("modality").isin(*media), F.lit(False))
    return costed.groupBy("run_id").agg(
        F.count("*").alias("steps"), F.countDistinct(F.when(F.col("model") != "-", F.col("model"))).alias("models"),
        F.coalesce(F.sum(F.when(report, F.col("seconds"))), F.lit(0.0)).alias("report_seconds"), F.sum("seconds").alias("total_seconds"),
        F.sum("cost").alias("cost"), F.coalesce(F.sum(F.when(F.col("cost_real"), F.col("cost"))), F.lit(0.0)).alias("cost_reported"),
    )


def run_summary(totals: DataFrame) -> DataFrame:
    """One row over all runs."""
    return totals.agg(
        F.count("*").alias("runs"), F.avg("report_seconds").alias("mean_report_seconds"), F.max("report_seconds").alias("max_report_seconds"),
        F.avg("total_seconds").alias("mean_total_seconds"), F.max("total_seconds").alias("max_total_seconds"), F.avg("cost").alias("mean_cost"),
        F.when(F.sum("cost") > 0, F.sum("cost_reported") / F.sum("cost")).otherwise(0.0).alias("real_cost_share"),
    )


def cost_origin(totals: DataFrame) -> DataFrame:
    """Per run where its cost figure comes from."""
    share = F.when(F.col("cost") > 0, F.col("cost_reported") / F.col("cost"))
    label = F.when(share.isNull(), "none").when(share >= 0.995, "reported").when(share <= 0.005, "estimated").otherwise("mixed")
    return totals.select("run_id", "cost", label.alias("origin"))


def components(stats: DataFrame, listed: list[tuple[str, str]]) -> DataFrame:
    """Listed components (name, step), whether they ran or not, after the language model as a whole."""
    known = stats.sparkSession.createDataFrame([(c, s, i) for i, (c, s) in enumerate(listed, 1)], "component string, step string, nth int")
    single = F.broadcast(known).join(stats, "step", "left").select("nth", "component", F.col("runs_ok").isNotNull().alias("ran"), F.coalesce("mean_seconds", F.lit(0.0)).alias("mean_seconds"), F.coalesce("mean_cost", F.lit(0.0)).alias("mean_cost"))
    llm = stats.where((F.col("mean_tokens_in") > 0) | (F.col("mean_tokens_out") > 0)).agg(F.lit(0).alias("nth"), F.lit("LLM").alias("component"), (F.count("*") > 0).alias("ran"), F.coalesce(F.sum("mean_seconds"), F.lit(0.0)).alias("mean_seconds"), F.coalesce(F.sum("mean_cost"), F.lit(0.0)).alias("mean_cost"))
    return llm.unionByName(single)


def retries(trace: DataFrame) -> DataFrame:
    """Attempts of a step within a run as one row; its cost is real if every attempt's was reported."""
    return trace.groupBy("run_id", "step").agg(
        F.count("*").alias("attempts"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost").alias("cost"), F.every(F.col("cost_real")).alias("cost_real"), F.max_by("ok", "step_ord").alias("ok"),
    )


def step_kind(costed: DataFrame) -> Column:
    local = (F.col("cost") == 0) & (F.col("tokens_in") == 0) & F.col("model").rlike("^(m0|-)$")
    return F.when(~F.col("ok"), "failed").when(local, "local").otherwise("model")


def outcomes(trace: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Per run: failed if a required step failed, degraded if another did."""
    need = F.col("step").isin(*required)
    broken, warned = F.bool_or(~F.col("ok") & need), F.bool_or(~F.col("ok") & ~need)
    return trace.groupBy("run_id").agg(F.when(broken, "failed").when(warned, "degraded").otherwise("ok").alias("outcome"), F.count(F.when(~F.col("ok"), 1)).alias("failed_steps"))


def outcome_messages(trace: DataFrame, required: tuple[str, ...], bare: DataFrame | None = None) -> DataFrame:
    """``run_id, outcome, message``: a run fails by its first required step that failed, or if it has nothing but a ticker
    and no data came for it (run ids in ``bare``); other failed steps are named as warnings, each once, by name."""
    need = F.col("step").isin(*required)
    t = trace.groupBy("run_id").agg(F.min_by("step", F.when(~F.col("ok") & need, F.col("step_ord"))).alias("broken"), F.sort_array(F.collect_set(F.when(~F.col("ok") & ~need, F.col("step")))).alias("warned"))
    empty = F.col("bare") if bare is not None else F.lit(False)
    t = t.join(bare.select("run_id", F.lit(True).alias("bare")).distinct(), "run_id", "left") if bare is not None else t
    outcome = F.when(F.col("broken").isNotNull() | empty, "failed").when(F.size("warned") > 0, "degraded").otherwise("ok")
    message = F.when(F.col("broken").isNotNull(), F.concat(F.lit("step failed: "), "broken")).when(empty, "no data for the ticker").when(F.size("warned") > 0, F.concat(F.lit("without: "), F.array_join("warned", ", ")))
    return t.select("run_id", outcome.alias("outcome"), message.alias("message"))


def service_levels(totals: DataFrame) -> DataFrame:
    return totals.select("run_id", (F.col("report_seconds") <= TARGETS["report"]).alias("report_ok"), (F.col("total_seconds") <= TARGETS["all"]).alias("all_ok"))


def cost_shares(stats: DataFrame) -> DataFrame:
    """Each step's share of the mean cost, and whether it is the slowest. Steps are few: one row each."""
    every = Window.partitionBy(F.lit(1))
    share = F.when(F.sum("mean_cost").over(every) > 0, F.col("mean_cost") / F.sum("mean_cost").over(every)).otherwise(0.0)
    return stats.select("step", "mean_cost", share.alias("share"), (F.col("mean_seconds") == F.max("mean_seconds").over(every)).alias("slowest"))


def plan_margins(summary: DataFrame) -> DataFrame:
    """Cost at full quota, margin, and margin at twice the cost, a plan; monthly cost at its number of runs."""
    plans = summary.sparkSession.createDataFrame(PLANS, "plan string, price double, quota int")
    cost = F.col("quota") * F.col("mean_cost")
    return summary.select("mean_cost").crossJoin(F.broadcast(plans)).select(
        "plan", cost.alias("cost_at_quota"), (1 - cost / F.col("price")).alias("margin"), (1 - 2 * cost / F.col("price")).alias("margin_at_double"), (cost + FIXED_MONTHLY).alias("monthly"),
    )


def scale_table(summary: DataFrame) -> DataFrame:
    """``runs, monthly``: cost of a month at some numbers of runs, with the fixed part."""
    sizes = F.explode(F.array(*map(F.lit, MONTHLY_RUNS)))
    return summary.select("mean_cost", sizes.alias("runs")).select("runs", (F.col("runs") * F.col("mean_cost") + FIXED_MONTHLY).alias("monthly"))


def steps_by_model(trace: DataFrame) -> DataFrame:
    """Per model its distinct steps, in the order they were first seen."""
    first = trace.groupBy("model", "step").agg(F.min("step_ord").alias("first"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first", "step"))), lambda x: x["step"])
    return first.groupBy("model").agg(F.array_join(listed, ",").alias("steps"))


def timeline(trace: DataFrame, branch: Column | None = None) -> DataFrame:
    """Start and end of each step: serial steps follow each other; neighbouring parallel steps form a block
    in which each branch has its own clock, and which lasts as long as its slowest branch."""
    run = Window.partitionBy("run_id").orderBy("step_ord")
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(F.col("parallel") & F.coalesce(F.lag("parallel").over(run), F.lit(False)), 0).otherwise(1)
    t = trace.withColumn("branch", branch if branch is not None else F.col("step")).withColumn("opens", opens).withColumn("block", F.sum("opens").over(so_far))
    clock = Window.partitionBy("run_id", "block", "branch").orderBy("step_ord").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("in_block", F.sum("seconds").over(clock))
    lasts = t.groupBy("run_id", "block").agg(F.max("in_block").alias("lasts"))
    before = lasts.withColumn("t0", F.sum("lasts").over(Window.partitionBy("run_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("lasts")).select("run_id", "block", "t0")
    out = t.join(before, ["run_id", "block"])
    return out.select("run_id", "step_ord", "step", "parallel", (F.col("t0") + F.col("in_block") - F.col("seconds")).alias("started"), (F.col("t0") + F.col("in_block")).alias("ended"))


def node_of_step(trace: DataFrame, nodes: list[tuple[str, str]]) -> DataFrame:
    """``run_id, node, step``: each step takes the first node in order whose keyword its name holds and that
    no earlier step of the run has taken. A run's steps are folded in order; runs are short."""
    listed = F.array(*(F.struct(F.lit(n).alias("node"), F.lit(k).alias("word")) for n, k in nodes))
    steps = trace.groupBy("run_id", "step").agg(F.min("step_ord").alias("first")).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("first", F.lower("step").alias("step")))).alias("steps"))
    taken = F.aggregate(
        F.transform("steps", lambda s: s["step"]), F.array().cast("array<struct<node:string,step:string>>"),
        lambda acc, s: F.concat(acc, F.transform(F.slice(F.filter(listed, lambda n: F.contains(s, n["word"]) & ~F.exists(acc, lambda a: a["node"] == n["node"])), 1, 1), lambda n: F.struct(n["node"].alias("node"), s.alias("step")))),
    )
    return steps.select("run_id", F.explode(taken).alias("x")).select("run_id", "x.node", "x.step")


def latest_state(events: DataFrame) -> DataFrame:
    """Batch form of the step-event fold: the newest event of a step says whether it runs or is done."""
    return events.groupBy("run_id", "step").agg(F.max_by("kind", F.struct("at", "event_id")).alias("kind")).select("run_id", "step", F.when(F.col("kind") == "start", "running").otherwise("done").alias("state"))


def report_rows(stats: DataFrame) -> DataFrame:
    """``step, line``: a text row a step."""
    return stats.select("step", F.format_string("%-12s %8.2f s  max %8.2f s  %10.6f USD  %d ok  %d failed", "step", "mean_seconds", "max_seconds", "mean_cost", "runs_ok", "runs_failed").alias("line"))


def trace_rows(costed: DataFrame) -> DataFrame:
    """``run_id, step_ord, line``: a row of text a step, with a mark of parallel steps, tokens and status."""
    mark = F.when(F.col("parallel"), "||").otherwise("  ")
    status = F.when(F.col("ok"), "ok").otherwise("failed")
    return costed.select("run_id", "step_ord", F.format_string("%s %-12s %8.2f s  %6d in  %6d out  %s", mark, F.col("step"), F.col("seconds"), F.col("tokens_in"), F.col("tokens_out"), status).alias("line"))


def node_status(trace: DataFrame, nodes: list[tuple[str, str]]) -> DataFrame:
    """``run_id, node, status``: every node of every run; skipped where no step took it."""
    known = F.explode(F.array(*(F.lit(n) for n, _ in nodes)))
    every = trace.select("run_id").distinct().select("run_id", known.alias("node"))
    ok = trace.groupBy("run_id", F.lower("step").alias("step")).agg(F.every("ok").alias("ok"))
    taken = node_of_step(trace, nodes).join(ok, ["run_id", "step"])
    status = F.when(F.col("ok").isNull(), "skipped").when(F.col("ok"), "ok").otherwise("failed")
    return every.join(taken, ["run_id", "node"], "left").select("run_id", "node", status.alias("status"))


def write_report(stats: DataFrame, path: str) -> None:
    """Step statistics as JSON lines, one row a step."""
    stats.write.mode("overwrite").json(path)
