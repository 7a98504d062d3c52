"""Ranked lexical search: term weights times document impacts as blocked matrix products.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. ``N`` counts
the documents with a term, ``L`` all their terms, ``n`` one document's, ``df`` the documents that hold a term. A term
weighs ``w = floor(1000 ln((2N + 2) / (2df + 1)))``, its impact in a document is
``w * ((1000000000 tf) div (1000 tf + 8 m))`` with ``m = 100 - 75 + ((75 n N) div L)``, and a document's score is the sum
of the impacts of the item's terms, repeats included. All but the logarithm are integers.

Each document is read once: its length and the counts of the items' terms are written (postings by document). A task
then turns its documents into tiles, a column a document. An item tile holds the counts of its terms over its own compact
vocabulary, cut into vocabulary tiles; partial scores are float64 matrix products whose sums stay below 2^52, so they are
exact, and are added up as 64-bit integers. Of each tile only scores that reach an item's k-th best so far go on, with
all ties, and ties are settled by the lesser id. Tasks send at most k rows an item; these meet in two steps.

Items are taken in groups of at most about GROUP_ENTRIES (item, term) entries, each over all documents: a group's terms
are what is broadcast. Documents without a term are counted nowhere and never found. Document ids are integers, null ids
rank after all others of their score, and repeated rows are documents of their own. Items that repeat id and text are one
item; items without a term get no rows. Null texts have no terms.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finevidence.llm.common import materialise, small_batches, whole_text

#: Bytes of a term, A-Z lower-cased; all others part terms. Bytes from 0x80 on belong to characters beyond ASCII.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
GROUP_ENTRIES = 1_000_000
TILE_ITEMS, TILE_TERMS, TILE_DOCS = 256, 2048, 1024
#: Float64 sums below this are exact with a bit to spare.
EXACT = 2.0**52


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def product(counts: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """``counts @ impacts`` (whole numbers in float64) as exact 64-bit integers: columns are halved until no sum can leave EXACT."""
    n = counts.shape[1]
    if not n or float((counts @ impacts.max(axis=1)).max(initial=0)) < EXACT:
        return (counts @ impacts).astype(np.int64)
    if n == 1:
        return counts.astype(np.int64) @ impacts.astype(np.int64)
    return product(counts[:, : n // 2], impacts[: n // 2]) + product(counts[:, n // 2 :], impacts[n // 2 :])


class ItemTile:
    """Counts of the terms of up to TILE_ITEMS items over their own compact vocabulary."""

    def __init__(self, first: int, entries: list[list[tuple[int, int]]]):
        self.first, self.n = first, len(entries)
        self.vocabulary = np.unique(np.array([t for e in entries for t, _ in e], np.int64))
        self.item = np.repeat(np.arange(self.n), [len(e) for e in entries])
        self.at = np.searchsorted(self.vocabulary, [t for e in entries for t, _ in e])
        self.count = np.array([c for e in entries for _, c in e], np.float64)

    def parts(self):
        """(vocabulary tile, counts as items x terms), one after the other."""
        for i in range(0, len(self.vocabulary), TILE_TERMS):
            own = (self.at >= i) & (self.at < i + TILE_TERMS)
            tile = self.vocabulary[i : i + TILE_TERMS]
            q = np.zeros((self.n, len(tile)))
            q[self.item[own], self.at[own] - i] = self.count[own]
            yield tile, q

    def scores(self, parts: list, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> np.ndarray:
        """Items x documents, from the postings of a document tile."""
        out = np.zeros((self.n, n_docs), np.int64)
        for tile, q in parts:
            at = np.minimum(np.searchsorted(tile, term), len(tile) - 1)
            hit = tile[at] == term
            there, row = np.unique(at[hit], return_inverse=True)
            d = np.zeros((len(there), n_docs))
            d[row, doc[hit]] = impact[hit]
            out += product(q[:, there], d)
        return out


class Best:
    """The k best documents of each item of a tile so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.floor = np.ones(n_items, np.int64)
        self.rows = tuple(np.zeros(0, np.int64) for _ in range(4))  # item, minus score, id is null, id

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        least, n = self.floor, scores.shape[1]
        if n > self.k:
            least = np.maximum(least, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
        item, doc = np.nonzero(scores >= least[:, None])
        new = (item, -scores[item, doc], no_id[doc].astype(np.int64), ids[doc])
        rows = [np.concatenate(x) for x in zip(self.rows, new)]
        order = np.lexsort(rows[::-1])
        rows = [x[order] for x in rows]
        first = np.searchsorted(rows[0], rows[0])
        nth = np.arange(len(first)) - first
        self.rows = tuple(x[nth < self.k] for x in rows)
        last = rows[0][nth == self.k - 1]
        self.floor[last] = -rows[1][nth == self.k - 1]


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, terms, counts``: one row for each item with a term."""

    def run(batches):
        for b in batches:
            found = [Counter(terms_of(t)) for t in b.column(1).to_pylist()]
            some = [i for i, c in enumerate(found) if c]
            columns = [b.column(0).take(pa.array(some, pa.int64())), pa.array([list(found[i]) for i in some], pa.list_(pa.binary())), pa.array([list(found[i].values()) for i in some], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "terms", "counts"])

    once = items.select(F.col(id_col).alias("item_id"), whole_text(text_col).cast("binary").alias("text")).distinct()
    kind = once.schema["item_id"].dataType.simpleString()
    return once.mapInArrow(run, f"item_id {kind}, terms array<binary>, counts array<long>")


def postings(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, counts`` of each document with a term; ``terms`` are numbers of those asked for."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches):
        number = sent.value
        for b in batches:
            ids, lengths, ends, terms, counts = [], [], [0], [], []
            for i, t in enumerate(b.column(1)):
                words = terms_of(t.as_py())
                if words:
                    for w, c in Counter(words).items():
                        if (no := number.get(w)) is not None:
                            terms.append(no)
                            counts.append(c)
                    ids.append(i)
                    lengths.append(len(words))
                    ends.append(len(terms))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (counts, pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def rank(items: DataFrame, docs: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` highest-scoring documents with a score above 0."""
    spark = items.sparkSession
    asked = materialise(item_terms(items, item_id, item_text))
    entries = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups = -(-entries // GROUP_ENTRIES)
    kind = asked.schema["item_id"].dataType.simpleString()
    if not groups:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    group = F.pmod(F.xxhash64("terms", "counts"), F.lit(groups))
    found = [rank_group(asked.where(group == g) if groups > 1 else asked, docs, k, doc_id, text_col, kind) for g in range(groups)]
    return reduce(DataFrame.unionByName, found)


def rank_group(asked: DataFrame, docs: DataFrame, k: int, doc_id: str, text_col: str, kind: str) -> DataFrame:
    spark = asked.sparkSession
    group = asked.toArrow()  # at most about GROUP_ENTRIES entries
    terms, counts = group["terms"].to_pylist(), group["counts"].to_pylist()
    number = {t: i for i, t in enumerate(sorted({t for own in terms for t in own}))}
    tiles = [ItemTile(i, [[(number[t], c) for t, c in zip(a, b)] for a, b in zip(terms[i : i + TILE_ITEMS], counts[i : i + TILE_ITEMS])]) for i in range(0, len(terms), TILE_ITEMS)]
    known = materialise(postings(docs, number, doc_id, text_col))
    all_docs = known.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = all_docs["n"], all_docs["terms"] or 1
    weight = np.zeros(len(number), np.int64)
    for r in known.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the group
        weight[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    sent = spark.sparkContext.broadcast((tiles, weight))

    def run(batches):
        tiles, weight = sent.value
        parts = [list(t.parts()) for t in tiles] if len(tiles) == 1 else None  # of several tiles one at a time is dense
        best = [Best(t.n, k) for t in tiles]
        for b in batches:
            for i in range(0, len(b), TILE_DOCS):
                part = b.slice(i, TILE_DOCS)
                length = part.column(1).to_numpy()
                rise = 75 * length * n_docs if 75 * int(length.max(initial=0)) * n_docs < 2**63 else 75 * length.astype(object) * n_docs
                m = 25 + (rise // n_terms).astype(np.int64)
                doc = np.repeat(np.arange(len(part)), np.diff(part.column(2).offsets.to_numpy()))
                term, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                ids, no_id = part.column(0).fill_null(0).to_numpy(), part.column(0).is_null().to_numpy(zero_copy_only=False)
                for j, t in enumerate(tiles):
                    best[j].add(t.scores(parts[j] if parts else t.parts(), term, doc, impact, len(part)), ids, no_id)
        for t, own in zip(tiles, best):
            item, minus, no_id, ids = own.rows
            yield pa.RecordBatch.from_arrays([pa.array(item + t.first), pa.array(ids, mask=no_id.astype(bool)), pa.array(-minus)], ["item_no", "doc_id", "score"])

    each = known.mapInArrow(run, "item_no long, doc_id long, score long").withColumn("task", F.spark_partition_id())
    keep = each
    for part in (["item_no", F.pmod("task", F.lit(64))], ["item_no"]):
        best = Window.partitionBy(*part).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        keep = keep.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = spark.createDataFrame(pa.table({"item_no": pa.array(range(len(terms)), pa.int64()), "item_id": group["item_id"]}), f"item_no long, item_id {kind}")
    return keep.join(names, "item_no").select("item_id", "rank", "doc_id", "score")
