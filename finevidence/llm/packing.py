"""Best-fit packing of token sequences by large-item matching.

Pieces of equal length are interchangeable, so the plan is made on the histogram of lengths (at most
``capacity`` numbers, whatever the input): pieces above a third of the capacity are matched greedily,
longest first, each with the longest other one that fits beside it, so at most two share a bin; shorter
ones, longest first, go to the fullest bin they fit. The plan is a list of runs: the t-th piece of a
length, for t in a range, goes to a bin and offset that follow from t. Each piece finds its run by its
rank among the pieces of its length, which is counted in salted buckets, so no task holds a whole common length.

A null text counts as empty; an empty text is one piece that holds only the end id. Repeated rows are
packed once each. Null ids are allowed. Empty tables give an empty result.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finevidence.llm.bpe import codec, default_tokenizer
from finevidence.llm.common import materialise, small_batches, whole_text

#: A bucket of one length holds about this share of all pieces (or LEAST_RANKED), so the pieces of a length
#: that is very common are ranked by many tasks.
BUCKETS = 2048
LEAST_RANKED = 500


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first, n, sequence, offset, per)``: piece ``first + t`` of this length, t < n,
    goes to bin ``sequence + t // per`` at ``offset + (t % per) * length``."""
    left, placed, runs, bins = dict(counts), dict.fromkeys(counts, 0), [], 0
    gaps: dict[int, deque[tuple[int, int]]] = {}

    def put(length: int, n: int, sequence: int, offset: int, per: int = 1) -> None:
        runs.append((length, placed[length], n, sequence, offset, per))
        placed[length] += n
        left[length] -= n

    def open_gap(gap: int, sequence: int, n: int) -> None:
        if gap > 0 and n > 0:
            gaps.setdefault(gap, deque()).append((sequence, n))

    large = sorted((x for x in counts if 3 * x > capacity), reverse=True)
    for at, a in enumerate(large):
        mates = [b for b in large[at:] if a + b <= capacity]
        while left[a] > 0:
            b = next((b for b in mates if left[b] > (b == a)), None)
            if b is None:
                n = left[a]
                put(a, n, bins, 0)
                open_gap(capacity - a, bins, n)
            elif b == a:
                n = left[a] // 2
                put(a, 2 * n, bins, 0, 2)
                open_gap(capacity - 2 * a, bins, n)
            else:
                n = min(left[a], left[b])
                put(a, n, bins, 0)
                put(b, n, bins, a)
                open_gap(capacity - a - b, bins, n)
            bins += n
    for x in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[x] > 0:
            gap = min((g for g in gaps if g >= x), default=None)
            if gap is None:
                gap, sequence, n = capacity, bins, -(-left[x] // (capacity // x))
                bins += n
            else:
                sequence, n = gaps[gap].popleft()
                if not gaps[gap]:
                    del gaps[gap]
            per = gap // x
            full = min(n, left[x] // per)
            if full:
                put(x, full * per, sequence, capacity - gap, per)
                open_gap(gap - per * x, sequence, full)
            if full < n:
                rest, used = left[x], 0
                if rest:
                    put(x, rest, sequence + full, capacity - gap, rest)
                    open_gap(gap - rest * x, sequence + full, 1)
                    used = 1
                open_gap(gap, sequence + full + used, n - full - used)
    return runs


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, tokenizer: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the ids of each text and the end id, in pieces of
    ``capacity`` ids of which the first may be shorter."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            row = 0
            for ids, ends in codec(tokenizer).encode_column(b.column(1)):
                data, at = memoryview(ids.tobytes()), 0
                for stop in ends.tolist():
                    n = stop - at + 1  # with the end id
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                        rows.append(row)
                        piece.append(k)
                        start.append(i)
                        length.append(j - i)
                        crc.append(zlib.crc32(data[4 * (at + i) : 4 * min(at + j, stop)]))
                    crc[-1] = zlib.crc32(end, crc[-1])
                    row, at = row + 1, stop
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row."""
    pieces = materialise(token_pieces(docs, id_col, text_col, capacity, end_id, tokenizer or default_tokenizer()))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    by_length: dict[int, list] = {}
    for r in plan(counts, capacity):
        by_length.setdefault(r[0], []).append(r[1:])
    runs = {k: np.array(sorted(v), np.int64).T for k, v in by_length.items()}

    bucket = max(LEAST_RANKED, sum(counts.values()) // BUCKETS)
    per_length = docs.sparkSession.createDataFrame([(k, -(-n // bucket)) for k, n in counts.items()], "length long, salts int")  # at most `capacity` rows
    salted = pieces.join(F.broadcast(per_length), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int")).drop("salts")
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    )
    ranked = (
        salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
        .join(F.broadcast(before), ["length", "salt"])  # fewer than BUCKETS + capacity rows
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank") - 1).alias("rank"))
    )

    def place(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, _, bin_, start, per = runs[int(x)]
                k = np.searchsorted(first, rank[at], "right") - 1
                t = rank[at] - first[k]
                sequence[at], offset[at] = bin_[k] + t // per[k], start[k] + t % per[k] * x
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
