"""Structured reports as text: parsing, validity, questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CITATION = "struct<origin:string,location:string>"
REPORT = f"""struct<summary:string,key_figures:array<struct<name:string,value:string,period:string,citations:array<{CITATION}>>>,
  findings:array<struct<kind:string,statement:string,citations:array<{CITATION}>>>,trend:string,limitations:array<string>,spoken_summary:string>"""
# Where a citation may come from.
ORIGINS = ["document", "chart", "audio", "market", "sec"]
# Bytes a second of compressed audio.
AUDIO_BYTES = 16_000


def parse(texts: DataFrame) -> DataFrame:
    """``id, report, reason``: the outermost JSON object of a text, code fences or prose around it or not;
    a reason where there is none or it breaks a rule. texts: ``id, text``."""
    body = F.regexp_extract(F.coalesce("text", F.lit("")), r"(?s)(\{.*\})", 1)
    t = texts.select("id", F.from_json(body, REPORT).alias("report"), F.try_parse_json(F.when(body != "", body)).isNotNull().alias("is_json"))
    return t.withColumn("reason", F.when(~F.col("is_json"), "not JSON").otherwise(broken_rule(F.col("report")))).drop("is_json")


def broken_rule(r: Column) -> Column:
    """The first rule that a report breaks, or null."""
    cited = lambda x: (F.coalesce(F.size(x["citations"]), F.lit(0)) > 0) & F.forall(x["citations"], lambda c: c["origin"].isin(ORIGINS))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(blank(r["summary"]) | blank(r["spoken_summary"]), "schema: empty summary")
        .when(F.exists(F.coalesce(r["key_figures"], F.array()), lambda x: blank(x["name"]) | blank(x["value"]) | ~cited(x)), "schema: figure")
        .when(F.exists(F.coalesce(r["findings"], F.array()), lambda x: blank(x["statement"]) | ~cited(x)), "schema: finding")
        .when(~F.coalesce(r["trend"], F.lit("undetermined")).isin("up", "down", "sideways", "undetermined"), "schema: trend")
    )


def question(typed: Column, spoken: Column, has_document: Column, market_default: str, default: str) -> Column:
    """The spoken question after the typed one; without either a default for the kind of request."""
    both = F.concat_ws("\n\n", F.nullif(F.trim(typed), F.lit("")), F.nullif(F.trim(spoken), F.lit("")))
    return F.when(both != "", both).when(has_document, default).otherwise(market_default)


def transcript_truncated(reported: Column, real: Column, chars: Column) -> Column:
    """A transcript that covers too little of its audio; unknown length says no."""
    return F.coalesce((reported < 0.8 * real) | ((real >= 5) & (chars < 4 * real)), F.lit(False))


def best_transcript(attempts: DataFrame) -> DataFrame:
    """``audio_id, text, cost, warned``: the first attempt unless truncated, else a complete second, else the longer."""
    t = attempts.withColumn("bad", transcript_truncated(F.col("reported"), F.col("real"), F.length("text")))
    order = F.struct(F.col("bad").cast("int"), F.when(F.col("bad"), -F.length("text")).otherwise(F.lit(0)), "attempt")
    return t.groupBy("audio_id").agg(F.min_by("text", order).alias("text"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"), F.min_by("bad", order).alias("warned"))


def duration_estimate(size: Column) -> Column:
    """Seconds of compressed audio by its size in bytes."""
    return size / AUDIO_BYTES


def warnings_union(branches: list[DataFrame], key: str) -> DataFrame:
    """``key, warnings``: the warnings of all branches (``key, warning``) in the order of the branches, then of the text;
    each once a branch."""
    rows = [b.select(key, F.lit(i).alias("nth"), "warning") for i, b in enumerate(branches)]
    every = reduce(DataFrame.unionByName, rows).where("warning IS NOT NULL")
    return every.groupBy(key).agg(F.transform(F.array_sort(F.collect_set(F.struct("nth", "warning"))), lambda x: x["warning"]).alias("warnings"))
