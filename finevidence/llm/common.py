"""What several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key that holds more than this share of all rows is hot; there are fewer than HOT of them, whatever the input.
HOT = 2048
#: Groups of up to so many rows are never hot.
COOL_ROWS = 500
#: Parts that the rows of a hot key are spread over.
SALTS = 64

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, one
    machine may use a temporary folder of its own; a cluster may not."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="checkpoints-", dir=os.environ.get("TMPDIR", "/tmp"))
        found = _own_dirs[app]
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later jobs neither compute it
    again nor need the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*written: DataFrame) -> None:
    """Empty tables that ``materialise`` wrote and nothing reads any more."""
    for df in written:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(df.written_to)


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int, spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to the rows of ``groups``, which has few for each key ``on`` and knows the key's ``size`` among
    ``rows``. Keys that hold more than a HOT-th of all ``total`` rows (and COOL_ROWS) are fewer than HOT, so they can be
    broadcast; their rows are spread over SALTS parts by a hash of the columns ``spread``."""
    is_hot = F.col(size) > max(COOL_ROWS, total // HOT)
    hot = F.broadcast(groups.where(is_hot).select(*on, F.lit(True).alias("_hot")).distinct())
    salted = rows.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    dealt = groups.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(dealt, [*on, "_salt"], how).drop("_salt")


def id_key(col: str | Column) -> Column:
    """The id as text that is never null, for joins; no two ids share it."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def rows_of(docs: DataFrame, keep: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs``, all columns, for each ``id_key, version`` in ``keep``; version is the xxhash64 of the text."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"), id_key(id_col).alias("id_key"), F.xxhash64(whole_text(text_col)).alias("version"))
    found = keyed.join(keep.select("id_key", "version").hint("shuffle_hash"), ["id_key", "version"], "left_semi")
    return found.groupBy("id_key", "version").agg(F.first("row").alias("row")).select("row.*")


def whole_text(col: str | Column) -> Column:
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small, so that a run of very long ones fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for the rows that no model may learn from: crc32 of the id as text falls in ``fold``."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
