"""Payload files: a file each in a folder, or many in bundles.

A bundle is a Parquet table with a row a file, in the schema of the binaryFile source, so that a small file costs a row
and not a folder, a listing, a rename and an open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def write_files(rows: DataFrame, path: str, *names: str, body: str = "body") -> None:
    """One file for each row, in a folder named by its values of ``names``; for payloads that Spark derives."""
    rows.select(*names, body).write.mode("append").option("lineSep", "\n").partitionBy(*names).text(path)


def write_bundles(rows: DataFrame, path: str, *names: str, body: str = "body") -> None:
    """The files of ``write_files`` with the same contents in bundles; the path of each ends with its values of ``names``."""
    content = F.concat(body, F.lit("\n")).cast("binary")
    place = F.concat_ws("/", F.lit(path), *(F.col(n).cast("string") for n in names))
    rows.select(place.alias("path"), F.current_timestamp().alias("modificationTime"), F.octet_length(content).cast("bigint").alias("length"), content.alias("content")).write.mode("append").parquet(path)


def read_files(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """All files under a folder, or in the bundles there."""
    if bundled:
        return spark.read.schema(FILES).parquet(path)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
