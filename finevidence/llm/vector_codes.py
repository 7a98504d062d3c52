"""Vector code compression: Lloyd's rounds over two trees, one of the vectors' parts and one of the codebook's entries.

Components become integers ``floor(4096 x)``; a vector of d components is cut into PARTS consecutive parts, equal where
PARTS divides d (else part p takes the components from p d div PARTS on). Each part position has a codebook of its own, which starts
as that part of the ENTRIES smallest kept ids. A round assigns every part to the nearest entry (squared distance, ties to
the lower index) and replaces each entry by the floor of its parts' mean; entries without parts stay.

Vectors are written once in blocks. A block has a balanced tree for each part position: rows are halved along
the widest component down to leaves of about LEAF rows, and each node keeps its box, count and component sums. The
entries' tree is built anew each round. Level by level, pairs of a row node and an entry node are bounded by the least and the largest
distance between their boxes: an entry node whose least distance is above another's largest is dropped for all rows of
the node. Where one entry is left, the whole node takes it and its cached sums are added; rows of leaves where several are left
are compared one by one in 64-bit integers. So results equal those of plain rounds. Each round the driver gets one row
an entry, its count and sums, which Spark has added up.

Rows whose vector is null or holds null or non-finite components are dropped. Vectors of each length have
codebooks of their own; an empty vector has empty parts and error 0. Of equal ids the lesser vector counts as smaller, null
ids are the largest; repeated rows each have a row in the result. Components are clamped to 10^27 after scaling;
arithmetic beyond 64 bits falls back to Python's integers, and errors beyond a long are given as the largest long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finevidence.llm.common import id_key, join_groups, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of a tree's leaf, and components of a block (rows times length) at most.
LEAF, BLOCK = 32, 1 << 19
#: Components up to this have squared distances of any part of up to 2048 components within 63 bits.
SAFE = 1 << 25
_LONG = (1 << 63) - 1


def whole(x: np.ndarray) -> np.ndarray:
    """floor(4096 x) as int64, or as Python integers if some component is beyond SAFE."""
    y = np.floor(x.astype(np.float64) * SCALE)
    if not y.size or np.abs(y).max() <= SAFE:
        return y.astype(np.int64)
    return np.array([int(v) for v in np.clip(y, -1e27, 1e27).ravel()], dtype=object).reshape(y.shape)


def cuts(dim: int, parts: int) -> list[int]:
    return [p * dim // parts for p in range(parts + 1)]


class Tree:
    """A balanced tree over rows: level after level, with the rows' order, and each node's first row, box and sums.

    A level has 2^level nodes; node i of a level spans ``edges[level][i]`` to ``edges[level][i + 1]`` of ``order``."""

    def __init__(self, x: np.ndarray, leaf: int, order: np.ndarray | None = None):
        self.order = np.arange(len(x)) if order is None else order
        self.edges = [np.array([0, len(x)])]
        while len(x) > leaf << (len(self.edges) - 1):
            last = self.edges[-1]
            if order is None:
                for a, b in zip(last[:-1].tolist(), last[1:].tolist()):
                    self._sort(x, a, b)
            self.edges.append(np.append(0, np.stack([(last[:-1] + last[1:]) // 2, last[1:]], axis=1).ravel()))
        self.x = x[self.order]
        before = np.concatenate([np.zeros((1, x.shape[1]), x.dtype), np.cumsum(self.x, axis=0)])
        self.sums = [before[e[1:]] - before[e[:-1]] for e in self.edges]
        self.low = [np.minimum.reduceat(self.x, e[:-1], axis=0) for e in self.edges]
        self.high = [np.maximum.reduceat(self.x, e[:-1], axis=0) for e in self.edges]

    def _sort(self, x: np.ndarray, a: int, b: int) -> None:
        """Sort a node's rows along their widest component."""
        if x.shape[1] and b - a > 1:
            rows = x[self.order[a:b]]
            along = rows[:, int((rows.max(0) - rows.min(0)).argmax())]
            self.order[a:b] = self.order[a:b][np.argsort(along, kind="stable")]


def square_bounds(low: np.ndarray, high: np.ndarray, e_low: np.ndarray, e_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance of any two points, rows x entries, of boxes."""
    a, b = low[:, None, :] - e_high[None], e_low[None] - high[:, None, :]
    least, most = np.maximum(np.maximum(a, b), 0), np.maximum(-a, -b)
    return (least * least).sum(2), (most * most).sum(2)


def assign(tree: Tree, entries: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """Nodes (level, node, entry) that take one entry as a whole, and rows (places in the tree's order) with theirs."""
    book = Tree(entries, 1)
    settled, rows, own = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    nodes = np.array([0])
    alive = np.ones((1, len(entries)), bool)  # by place in the entries' tree
    for level, edges in enumerate(tree.edges):
        low, high = tree.low[level][nodes], tree.high[level][nodes]
        reach = None
        for e_level, e_edges in enumerate(book.edges):  # from all entries together to each alone
            least, most = square_bounds(low, high, book.low[e_level], book.high[e_level])
            held = np.add.reduceat(alive, e_edges[:-1], axis=1) > 0
            most = np.where(held, most, most.max(initial=0) + 1).min(1)
            reach = most if reach is None else np.minimum(reach, most)
            alive &= np.repeat(least <= reach[:, None], np.diff(e_edges), axis=1)
        one = alive.sum(1) == 1
        settled += zip([level] * int(one.sum()), nodes[one].tolist(), book.order[alive[one].argmax(1)].tolist())
        nodes, alive = nodes[~one], alive[~one]
        if not len(nodes):
            break
        if level + 1 < len(tree.edges):
            nodes, alive = (nodes[:, None] * 2 + np.array([0, 1])).ravel(), np.repeat(alive, 2, axis=0)
            continue
        at = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in nodes])
        keep = np.repeat(alive, np.diff(edges)[nodes], axis=0)[:, np.argsort(book.order)]
        away = squares(tree.x[at], entries)
        away = np.where(keep, away, away.max(initial=0) + 1)
        rows.append(at)
        own.append(away.argmin(1))
    return settled, np.concatenate(rows), np.concatenate(own)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, rows x entries."""
    out = np.zeros((len(x), len(entries)), np.result_type(x, entries))
    for j in range(x.shape[1]):
        d = x[:, j, None] - entries[None, :, j]
        out += d * d
    return out


def partial_sums(tree: Tree, entries: np.ndarray) -> list[tuple[int, int, list]]:
    """(entry, count, sums) of the entries that get rows of this tree."""
    settled, rows, own = assign(tree, entries)
    count = np.bincount(own, minlength=len(entries)).tolist()
    total = np.zeros(entries.shape, tree.x.dtype)
    np.add.at(total, own, tree.x[rows])
    for level, node, e in settled:
        count[e] += int(tree.edges[level][node + 1] - tree.edges[level][node])
        total[e] += tree.sums[level][node]
    return [(e, n, total[e].tolist()) for e, n in enumerate(count) if n]


def codes(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each row, and its squared distance, in the rows' first order."""
    settled, rows, own = assign(tree, entries)
    of = np.zeros(len(tree.x), np.int64)
    of[rows] = own
    for level, node, e in settled:
        of[tree.edges[level][node] : tree.edges[level][node + 1]] = e
    d = tree.x - entries[of]
    code, error = np.zeros(len(of), np.int64), np.zeros(len(of), d.dtype)
    code[tree.order], error[tree.order] = of, (d * d).sum(1)
    return code, error


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    vec = F.col(vector_col).cast("array<double>")
    usable = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), vec.alias("vec"), F.col(label_col).alias("label"))
    return rows.where(F.coalesce(usable, F.lit(False))).withColumn("dim", F.size("vec"))


def matrix(vec: pa.Array, dim: int) -> np.ndarray:
    return vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), dim)


def blocks(rows: DataFrame, parts: int) -> DataFrame:
    """``dim, ids, labels, vecs, orders``: up to BLOCK components of vectors of one length a row, dealt as the input is, and
    the order of the rows in the tree of each part position."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches):
        held: dict[int, list[pa.RecordBatch]] = {}

        def block(dim: int, size: int):
            t = pa.Table.from_batches(held[dim])
            held[dim] = t.slice(size).to_batches()
            t = t.slice(0, size).combine_chunks()
            at = pa.array([0, len(t)], pa.int32())
            lists = [pa.ListArray.from_arrays(at, c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in (t["vec_id"], t["label"], t["vec"])]
            x, cut = whole(matrix(lists[2].values, dim)), cuts(dim, parts)
            orders = [Tree(x[:, cut[p] : cut[p + 1]], LEAF).order for p in range(parts)]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *lists, pa.array([orders], pa.list_(pa.list_(pa.int32())))], ["dim", "ids", "labels", "vecs", "orders"])

        for b in batches:
            lengths = b.column(3).to_numpy()
            for dim in np.unique(lengths).tolist():
                held.setdefault(dim, []).append(b.filter(pa.array(lengths == dim)))
                size = max(LEAF, BLOCK // max(1, dim))
                while sum(map(len, held[dim])) >= size:
                    yield block(dim, size)
        for dim in held:
            if n := sum(map(len, held[dim])):
                yield block(dim, n)

    return rows.select("vec_id", "label", "vec", "dim").mapInArrow(run, f"dim int, ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, vecs array<array<double>>, orders array<array<int>>")


def trees(b: pa.RecordBatch, i: int, parts: int) -> list[Tree]:
    """The trees of a block's part positions."""
    dim = b.column(0)[i].as_py()
    x, at = whole(matrix(b.column(3)[i].values, dim)), cuts(dim, parts)
    return [Tree(x[:, at[p] : at[p + 1]], LEAF, b.column(4)[i][p].values.to_numpy().astype(np.int64)) for p in range(parts)]


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> dict[int, list[np.ndarray]]:
    """By length: a codebook for each part position, from the smallest ids. Lengths are few: each is one model."""
    out = {}
    for r in rows.select("dim").distinct().orderBy("dim").collect():
        dim = r["dim"]
        some = rows.where(F.col("dim") == dim).orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).collect()
        x, at = whole(np.array([s["vec"] for s in some], np.float64).reshape(len(some), dim)), cuts(dim, parts)
        out[dim] = [x[:, at[p] : at[p + 1]] for p in range(parts)]
    return out


def improved(made: DataFrame, books: dict[int, list[np.ndarray]], parts: int) -> dict[int, list[np.ndarray]]:
    """The codebooks after one round."""
    sent = made.sparkSession.sparkContext.broadcast(books)  # entries only: parts x entries x part length

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                dim = b.column(0)[i].as_py()
                found = [(dim, p, e, n, list(map(str, s))) for p, t in enumerate(trees(b, i, parts)) for e, n, s in partial_sums(t, sent.value[dim][p])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())))], ["dim", "part", "entry", "n", "sums"])

    each = made.mapInArrow(run, "dim int, part int, entry int, n long, sums array<string>")
    by_place = each.select("dim", "part", "entry", "n", F.posexplode_outer("sums").alias("place", "s")).groupBy("dim", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = {dim: [own.copy() for own in book] for dim, book in books.items()}
    for r in by_place.collect():  # parts x entries x part length
        if r["place"] is not None:
            book = out[r["dim"]][r["part"]]
            value = int(r["s"]) // r["n"]
            if abs(value) > SAFE and book.dtype != object:
                book = out[r["dim"]][r["part"]] = book.astype(object)
            book[r["entry"], r["place"]] = value
    return out


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """``vec_id, label, dim, codes, error`` of each kept vector, and the codebooks by length of the vectors."""
    rows = kept(vectors, id_col, vector_col, label_col)
    made = materialise(blocks(rows, parts))
    books = first_codebooks(rows, parts, entries)
    for _ in range(rounds):
        books = improved(made, books, parts)
    sent = made.sparkSession.sparkContext.broadcast(books)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                dim = b.column(0)[i].as_py()
                found = [codes(t, own) for t, own in zip(trees(b, i, parts), sent.value[dim])]
                code = np.stack([c for c, _ in found], axis=1).astype(np.int32)
                error = [min(int(e), _LONG) for e in sum(e for _, e in found)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, parts, dtype=np.int32)), pa.array(code.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(1)[i].values, b.column(2)[i].values, pa.array([dim] * len(code), pa.int32()), lists, pa.array(error, pa.int64())], ["vec_id", "label", "dim", "codes", "error"])

    return made.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, dim int, codes array<int>, error long"), books


def digests(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``; the digest is that of the codebooks of the vector's length."""
    coded, books = compress(vectors)
    coded = materialise(coded)
    key = coded.withColumn("label_key", id_key("label"))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = key.groupBy("label_key").agg(F.least(total, F.lit(_LONG)).cast("long").alias("label_error"), F.count("*").alias("n_rows"))
    joined = join_groups(key, by_label, ["label_key"], "n_rows", coded.count(), ["vec_id", "codes"])
    sha = {dim: hashlib.sha256(",".join(str(v) for book in own for entry in book.tolist() for v in entry).encode()).hexdigest() for dim, own in books.items()}
    names = F.create_map(*[F.lit(x) for pair in sha.items() for x in pair])[F.col("dim")] if sha else F.lit(None).cast("string")
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return joined.select("vec_id", code.alias("code"), "error", "label_error", names.alias("codebooks_sha256"))

