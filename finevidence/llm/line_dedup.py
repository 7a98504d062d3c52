"""Line deduplication over the whole corpus.

Each line's key is hashed; (hash, document) pairs are range-partitioned and sorted by hash, document
and position, and a stream over each partition keeps the lines of the first document of each hash.
The ranges cut between documents, not between hashes, so a very common line spreads over many
partitions. What a partition can't know is whether its first hash began in an earlier one; it returns
those lines apart, with the first document of its last hash, and a small join settles them.
The result is a zlib-compressed bitmap of kept lines for each document, not text. Ids are integers.

A null or empty text is one empty line. Keys under ``min_chars`` code points never go. A null id counts
as the least one. Rows that share id and text get the same bitmap; rows that share only the id count
as one document with separate bitmaps.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finevidence.llm.common import materialise, small_batches, whole_text

#: ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = -(1 << 63)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("doc"),
        whole_text(text_col).alias("text"),
    ).withColumn("version", F.xxhash64("text"))


def _first_occurrences(batches):
    """From rows sorted by hash, doc, place: (kind 0) lines that go, (1) lines of the first document of
    the partition's first hash, which an earlier partition may overrule, (2) the last hash's first document."""
    names = ["kind", "hash", "doc", "version", "place"]
    last = first = None
    opening = True
    for b in batches:
        if not len(b):
            continue
        hashes, doc = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
        begins = np.append(hashes[0].as_py() != last, pc.not_equal(hashes.slice(1), hashes.slice(0, len(b) - 1)).to_numpy(zero_copy_only=False))
        group = np.cumsum(begins)  # 0: goes on from the batch before
        firsts = np.append(first or 0, doc[begins])[group]
        in_opening = (group == (last is None)) & opening
        kinds = np.where(doc != firsts, 0, np.where(in_opening, 1, -1))
        opening = bool(in_opening[-1])
        last, first = hashes[len(b) - 1].as_py(), int(firsts[-1])
        if len(at := np.flatnonzero(kinds >= 0)):
            yield pa.RecordBatch.from_arrays([pa.array(kinds[at].astype(np.int32)), *b.take(pa.array(at)).columns], names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([last], pa.binary()), *(pa.array([x], pa.int64()) for x in (first, 0)), pa.array([0], pa.int32())], names)


def _bitmaps(batches):
    for b in batches:
        maps, dropped = [], []
        for n, gone in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
            keep = np.ones(n, np.uint8)
            keep[np.array(gone or [], np.int64)] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(n - int(keep.sum()))
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "doc", "version", "n_lines", "n_dropped", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``doc_id, doc, version, n_lines, n_dropped, keep_bitmap`` for each distinct (id, text).
    ``doc`` is the id with null as the least number, ``version`` a hash of the text."""
    small_batches(docs.sparkSession, 2000)
    rows = _rows(docs, id_col, text_col)
    key = F.translate(F.btrim(F.col("line"), F.lit(BLANKS)), CAPITALS, SMALL)
    lines = (
        rows.select("doc", "version", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
        .withColumn("line", key).where(F.char_length("line") >= min_chars)
        .select(F.unhex(F.md5("line")).alias("hash"), "doc", "version", "place")
    )
    ordered = lines.repartitionByRange("hash", "doc").sortWithinPartitions("hash", "doc", "place")
    found = materialise(ordered.mapInArrow(_first_occurrences, "kind int, hash binary, doc long, version long, place int"))

    earliest = found.where("kind = 2").groupBy("hash").agg(F.min("doc").alias("earliest"))
    late = found.where("kind = 1").join(earliest, "hash").where("doc > earliest")
    gone = found.where("kind = 0").select("doc", "version", "place").unionByName(late.select("doc", "version", "place"))
    gone = gone.groupBy("doc", "version").agg(F.collect_set("place").alias("gone"))
    sizes = rows.select("doc_id", "doc", "version", (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("n_lines")).distinct()
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, doc long, version long, n_lines long, n_dropped long, keep_bitmap binary"
    return sizes.join(gone, ["doc", "version"], "left").select("doc_id", "doc", "version", "n_lines", "gone").mapInArrow(_bitmaps, schema)


def kept_lines(text: str, n_lines: int, keep_bitmap: bytes) -> str:
    """The lines of ``text`` that its bitmap keeps, joined again."""
    keep = np.unpackbits(np.frombuffer(zlib.decompress(keep_bitmap), np.uint8), count=n_lines)
    return "\n".join(x for x, k in zip(text.split("\n"), keep) if k)


def kept_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` for every row: the bitmaps applied to the texts."""
    maps = keep_bitmaps(docs, id_col, text_col, min_chars).drop("doc_id")
    both = _rows(docs, id_col, text_col).join(maps.hint("shuffle_hash"), ["doc", "version"])

    def digest(batches):
        for b in batches:
            shas = []
            for text, n, dropped, keep in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4))):
                shas.append(hashlib.sha256((kept_lines(text, n, keep) if dropped else text).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(shas, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_lines long, n_dropped long, kept_sha256 string"
    return both.select("doc_id", "text", "n_lines", "n_dropped", "keep_bitmap").mapInArrow(digest, schema)
