"""Payload files as they land: a stream over whole files, good rows to their table, files that give none to quarantine.

Each batch writes both tables by batch, so a batch that is tried again replaces what it wrote, and a later call with
the same folder reads new files only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finevidence.sources import payloads
from finevidence.sources.files import FILES

#: Bytes of a payload file.
MOST = 64 * 1024 * 1024
QUARANTINE = "path STRING, length BIGINT, id STRING, reason STRING, batch INT"


def ingest(spark: SparkSession, source: str, base: str, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], most: int = MOST, bundled: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows and quarantined files (``path, length, id, reason``) of all files that have landed under ``source``, each alone or in
    bundles. ``parse`` gets (id, body) and gives rows and (id, reason) of bodies without any; an id is the name of a file's folder."""
    landed = spark.readStream.format("parquet" if bundled else "binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(source)
    found = landed.select("path", "length", F.regexp_extract("path", r"(?:[^/=]+=)?([^/]+)/[^/]+$", 1).alias("id"), "content")

    def write(df: DataFrame, batch: int) -> None:
        gate = F.when(F.col("length") == 0, "empty").when(F.col("length") > most, "too large")
        df = df.withColumn("gate", gate)
        rows, rejected = parse(df.where("gate IS NULL").select("id", F.col("content").cast("string").alias("body")))
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/rows/batch-{batch}")
        names = df.select("path", "length", "id", "gate")
        bad = names.join(rejected, "id", "left").withColumn("reason", F.coalesce("gate", "reason")).where("reason IS NOT NULL")
        bad.select("path", "length", "id", "reason", F.lit(batch).alias("batch")).write.mode("overwrite").parquet(f"{base}/quarantine/batch-{batch}")

    q = found.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    like, _ = parse(spark.createDataFrame([], "id STRING, body STRING"))
    schema = ", ".join(f"`{c}` {t}" for c, t in like.dtypes) + ", batch INT"
    read = lambda kind, schema: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/{kind}")
    return read("rows", schema), read("quarantine", QUARANTINE)


def equity(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    bars, _, rejected = payloads.equity_bars(bodies)
    return bars, rejected
