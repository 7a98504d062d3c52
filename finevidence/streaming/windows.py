"""Windows over event time in append mode, with late rows in a table of their own.

The watermark is the newest event time of the batches before, less the delay. A window's row is written once, when the
watermark has passed its end; rows whose window has been passed are late: the windowed query drops them, and a second query
over the same files routes them, whole, to a side table. Each batch of that query writes its newest event time, from which later
batches know the watermark; both tables are written by batch, so a batch that is tried again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def closed_windows(raw: DataFrame, time: str, keys: list[str], length: str, delay: str, aggregates: list[Column]) -> DataFrame:
    """``start, end, *keys`` and the aggregates of each window, once it is closed."""
    w = raw.withWatermark(time, delay).groupBy(F.window(time, length).alias("w"), *keys).agg(*aggregates)
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in w.columns if c != "w"])


def write_closed(windows: DataFrame, base: str) -> None:
    """Append the windows that closed to ``{base}/windows``, over all files that have landed."""
    q = windows.writeStream.outputMode("append").format("parquet").option("path", f"{base}/windows").option("checkpointLocation", f"{base}/windows-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def write_late(raw: DataFrame, base: str, time: str, length: str, delay: str) -> None:
    """Write the rows that come after their window was closed to ``{base}/late``, with their ``batch``."""

    def route(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        late = df.limit(0)
        if batch:
            mark = spark.read.schema("batch INT, mark TIMESTAMP").option("recursiveFileLookup", "true").parquet(f"{base}/marks").where(F.col("batch") < batch).agg(F.max("mark")).first()[0]
            if mark is not None:
                late = df.where(F.window(time, length)["end"] <= F.lit(mark) - F.expr(f"INTERVAL {delay}"))
        late.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/late/batch-{batch}")
        df.agg(F.lit(batch).alias("batch"), F.max(time).alias("mark")).write.mode("overwrite").parquet(f"{base}/marks/batch-{batch}")

    q = raw.writeStream.option("checkpointLocation", f"{base}/late-checkpoint").trigger(availableNow=True).foreachBatch(route).start()
    q.awaitTermination()


def read_late(spark: SparkSession, base: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch INT").option("recursiveFileLookup", "true").parquet(f"{base}/late")
