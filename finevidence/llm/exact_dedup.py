"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Three levels group by the digest *and* the full text: each map task combines its own rows, salted
groups merge those, and the winners of the salts merge into the winner of the text. A text with very
many copies reaches each level as at most one row a task and salt.
The rows then find their winner by digest alone, unless a digest stands for several texts
(which the last level counts): those rows, and only those, are matched by their text as well.
Digests of large groups are few, and their rows are spread over salts for that, so no task joins a whole group.

A null text counts as empty. Of equal texts the row with the largest id stays; a null id loses to
any other, and if rows repeat both id and text, one of them stays. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finevidence.llm.common import id_key, join_groups, materialise, rows_of, whole_text


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row."""
    salt = F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int")
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), salt.alias("salt"))
    rows = rows.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))

    salted = rows.groupBy("text_sha256", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    texts = salted.repartition("text_sha256").groupBy("text_sha256", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    winners = materialise(texts.groupBy("text_sha256").agg(F.count("*").alias("n_texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))

    total = winners.agg(F.sum("group_size")).first()[0] or 0
    found = join_groups(rows.drop("text", "salt"), winners.where("n_texts = 1").drop("n_texts"), ["text_sha256"], "group_size", total, ["doc_id"])
    if not winners.where("n_texts > 1").isEmpty():
        shared = winners.where("n_texts > 1").select("text_sha256")
        few = texts.join(shared, "text_sha256", "left_semi")
        found = found.unionByName(rows.join(few, ["text_sha256", "text"]).drop("text", "salt"))
    # one of the rows that repeat the winner's id and text
    nth = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("keep_id"))
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (nth == 1)).alias("kept"), "text_sha256")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The row of each text that ``exact_groups`` marks, all columns; of rows that repeat id and text one stays."""
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("version"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).alias("salt"), text.alias("text"))
    salted = rows.groupBy("version", "salt", "text").agg(F.max("doc_id").alias("doc_id"))
    keep = salted.repartition("version").groupBy("version", "text").agg(F.max("doc_id").alias("doc_id"))
    return rows_of(docs, keep.select(id_key("doc_id").alias("id_key"), "version"), id_col, text_col)
