"""The shared tables in the schemas that the operators read."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(ticks: DataFrame) -> DataFrame:
    """Daily bars from ticks (symbol, day, price, volume, nth); the map side combines each day's ticks."""
    return ticks.groupBy("symbol", "day").agg(
        F.min_by("price", "nth").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "nth").alias("c"), F.sum("volume").alias("v"),
    )


def line_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``symbol, day, o, h, l, c, v``: one symbol a supplier, a tick a line item, its price in whole cents."""
    t = table(spark, sf_dir, "lineitem")
    nth = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return _bars(t.select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("day"), (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100).alias("price"), F.col("l_quantity").alias("volume"), nth.alias("nth")))


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few symbols with long histories: one an order priority."""
    t = table(spark, sf_dir, "orders")
    return _bars(t.select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"), F.col("o_orderkey").alias("nth")))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short histories: one symbol an event type."""
    t = table(spark, sf_dir, "events")
    return _bars(t.select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day"), (F.col("value") + 1).alias("price"), F.lit(1.0).alias("volume"), F.struct("ts", "event_id").alias("nth")))


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a step of a run: runs are users, steps event types, in time order; some types stand for a modality."""
    e = table(spark, sf_dir, "events").where(F.col("user_id").isNotNull())
    k = F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)"), F.lit(0).cast("bigint"))
    return e.select(
        F.col("user_id").alias("run_id"), F.struct("ts", "event_id").alias("step_ord"), F.col("event_type").alias("step"),
        F.concat(F.lit("m"), (k % 3).cast("string")).alias("model"), (F.col("value") / 100).alias("seconds"), (F.col("event_type") != "error").alias("ok"),
        (k % 2 == 0).alias("parallel"), k.alias("tokens_in"), (k % 7).alias("tokens_out"), F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("value") / 1000).cast("double").alias("cost_usd"),
        F.when(F.col("event_type") == "purchase", "image").when(F.col("event_type") == "signup", "speech_to_text").when(F.col("event_type") == "view", "embedding").otherwise("text").alias("modality"),
        F.lit(None).cast("bigint").alias("chars"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, page, text``: each line of a document is a page, from 1."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page", "text"))
    return d.select("doc_id", (F.col("page") + 1).cast("int").alias("page"), "text")


def clean(c: Column | str) -> Column:
    """Ids and numbers of results as BIGINT or DOUBLE, so both engines agree on the type."""
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder for a session on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or "file://" + tempfile.mkdtemp(prefix="shared-", dir=os.environ.get("TMPDIR", "/tmp"))


#: While a table is kept: what was shuffled for it is removed, and Python gets rows of few MB at once.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again: neither a lost executor nor a later job computes it anew. What was shuffled
    for it is removed at once."""
    conf, path = df.sparkSession.conf, f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    before = {k: conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(path)
