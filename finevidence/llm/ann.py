"""Nearest neighbours by inner product with a hierarchical k-means tree.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm and 0 for queries, so the
nearest vector is the one with the largest inner product. A tree of k-means splits is fitted on a
bounded sample; every vector goes down to a leaf. A query visits leaves best bin first: a priority queue
holds the branches seen so far by their centroids' distance and the nearest is opened next. How many
leaves a query visits is calibrated: for a bounded number of queries the true neighbours are computed over all
vectors, and visits widen until the mean recall reaches ``recall``. The first leaves give each query a bound;
later leaves whose ball (centre and radius) can't reach it are not visited, and candidates below it are not
sent. A search also goes on until enough candidates are met, so a query gets all its neighbours if there are few.

Equal vectors are searched once: of each distinct vector the ``k + 1`` least ids can be among a query's
neighbours, and equal queries share one search. A leaf's rows and its queries are dealt out in blocks,
so no task holds a whole leaf. Scores are inner products of the original vectors in double precision.

Vectors that are null, empty, zero or hold null or non-finite components take no part, neither do null
ids. Vectors of each length are searched among themselves. Ids are integers. Rows that repeat id and vector count
once. Ties go to the lesser id.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finevidence.llm.common import materialise, release

BRANCH = 8
#: Rows and queries of one block, and queries compared at once. A leaf's rows are sent once for each block of its queries.
ROWS, QUERIES, AT_ONCE = 4096, 8192, 256
#: Leaves that a query visits first, for a bound on the scores that it takes from the others.
FIRST = 3


class KMeansTree:
    """Nodes by number: centroids of the children, the children's numbers, or the leaf's number."""

    def __init__(self, sample: np.ndarray, leaf_size: int, most_norm: float, seed: int = 0):
        self.most_norm = most_norm
        self.centres: list[np.ndarray | None] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaf_centres: list[np.ndarray] = []
        self.n_leaves = 0
        self._rng = np.random.default_rng(seed)
        self._split(self.lift(sample), leaf_size)
        del self._rng

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0, self.most_norm**2 - (x * x).sum(1)))[:, None]])

    def _split(self, x: np.ndarray, leaf_size: int) -> int:
        node = len(self.leaf)
        self.centres.append(None)
        self.children.append([])
        self.leaf.append(-1)
        groups = self._kmeans(x) if len(x) > leaf_size else []
        if len(groups) < 2:
            self.leaf[node] = self.n_leaves
            self.leaf_centres.append(x[:, :-1].mean(0) if len(x) else np.zeros(x.shape[1] - 1))
            self.n_leaves += 1
            return node
        self.centres[node] = np.stack([x[g].mean(0) for g in groups])
        self.children[node] = [self._split(x[g], leaf_size) for g in groups]
        return node

    def _kmeans(self, x: np.ndarray, rounds: int = 10) -> list[np.ndarray]:
        centres = x[self._rng.choice(len(x), min(BRANCH, len(x)), replace=False)]
        for _ in range(rounds):
            own = nearest(x, centres)
            centres = np.stack([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        own = nearest(x, centres)
        return [g for c in range(len(centres)) if len(g := np.flatnonzero(own == c))]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf each vector belongs to."""
        x, out, todo = self.lift(x), np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            own = nearest(x[rows], self.centres[node])
            todo += [(child, rows[own == c]) for c, child in enumerate(self.children[node]) if (own == c).any()]
        return out

    def visits(self, query: np.ndarray, n: int, sizes: np.ndarray, enough: int) -> list[int]:
        """Leaves in the order of the search, until there are ``n`` and they hold ``enough`` ids."""
        q, out, held, queue = np.append(query, 0.0), [], 0, [(0.0, 0)]
        while queue and (len(out) < n or held < enough):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                held += sizes[self.leaf[node]]
                continue
            away = ((self.centres[node] - q) ** 2).sum(1)
            for d, child in zip(away.tolist(), self.children[node]):
                heapq.heappush(queue, (d, child))
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


def matrix(column, dim: int) -> np.ndarray:
    """A list column of an Arrow batch or table as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def top(queries: np.ndarray, rows: np.ndarray, least_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best rows: number of the query, number of the row, score; ties to the lesser id."""
    rough = queries @ rows.T
    which, found = [], []
    for i, s in enumerate(rough):
        if len(s) > k:
            floor = np.partition(s, len(s) - k)[len(s) - k]
            at = np.flatnonzero(s >= floor - 1e-9 * (1 + abs(floor)))
        else:
            at = np.arange(len(s))
        which.append(np.full(len(at), i))
        found.append(at)
    which, found = np.concatenate(which), np.concatenate(found)
    score = (queries[which] * rows[found]).sum(1)
    order = np.lexsort((least_id[found], -score, which))
    which, found, score = which[order], found[order], score[order]
    first = np.append(True, which[1:] != which[:-1])
    nth = np.arange(len(which)) - np.maximum.accumulate(np.where(first, np.arange(len(which)), 0))
    return which[nth < k], found[nth < k], score[nth < k]


def usable_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vec, dim`` of the rows that take part."""
    usable = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & F.coalesce(usable, F.lit(False)))
    return rows.select("id", F.transform("vec", lambda x: x + 0.0).alias("vec"), F.size("vec").alias("dim"))  # -0.0 becomes 0.0


def distinct_vectors(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(node, vec, ids) for each distinct vector, with its k + 1 least ids; (id, node) for every row."""
    keyed = materialise(rows.groupBy(F.sha2(F.to_json("vec"), 256).alias("node"), "id").agg(F.any_value("vec").alias("vec")))
    few = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("nth") <= k + 1)
    nodes = few.groupBy("node").agg(F.any_value("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids"))
    return materialise(nodes), keyed.select("id", "node")


def exact(nodes: DataFrame, queries: np.ndarray, dim: int, k: int) -> DataFrame:
    """``query, node, leaf, score``: the k best nodes of each of a bounded number of queries, over all rows."""
    sent = nodes.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        for b in batches:
            if len(b):
                which, at, score = top(sent.value, matrix(b.column(1), dim), b.column(2).to_numpy(zero_copy_only=False), k)
                yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), b.column(0).take(pa.array(at)), b.column(3).take(pa.array(at)), pa.array(score), b.column(2).take(pa.array(at))], ["query", "node", "leaf", "score", "id"])

    each = nodes.select("node", "vec", F.get("ids", F.lit(0)).alias("id"), "leaf").mapInArrow(run, "query int, node string, leaf int, score double, id long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return each.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).drop("nth", "id")


def search(vectors: DataFrame, is_query=None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, recall: float = 0.96, sample: int = 20_000, calibrate: int = 128, leaf_rows: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows for which ``is_query`` (a column over ``id``; default
    all) holds. The tree is fitted on at most ``sample`` distinct vectors of each length (fewer if they are long),
    calibrated on at most ``calibrate`` queries."""
    usable = usable_rows(vectors, id_col, vector_col)
    lengths = [r["dim"] for r in usable.select("dim").distinct().orderBy("dim").collect()]  # lengths of vectors, commonly one
    found = [search_one_length(usable.where(F.col("dim") == d).select("id", "vec"), d, is_query, k, recall, sample, calibrate, leaf_rows) for d in lengths]
    return reduce(DataFrame.unionByName, found) if found else search_one_length(usable.select("id", "vec"), 1, is_query, k, recall, sample, calibrate, leaf_rows)


def search_one_length(vectors: DataFrame, dim: int, is_query, k: int, recall: float, sample: int, calibrate: int, leaf_rows: int) -> DataFrame:
    spark = vectors.sparkSession
    nodes, rows = distinct_vectors(vectors, k)
    asked = materialise(rows.where(is_query if is_query is not None else F.lit(True)))
    facts = nodes.agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("square")).first()
    n = facts["n"]
    limit = max(1, min(sample, 4_000_000 // dim))
    picked = nodes.orderBy(F.xxhash64("node")).limit(limit).select("vec").toArrow()  # at most `limit` rows
    some = matrix(picked["vec"], dim) if n else np.zeros((0, dim))
    tree = KMeansTree(some, max(8, leaf_rows * len(some) // max(1, n)), float(np.sqrt(facts["square"] or 0)))
    sent = spark.sparkContext.broadcast(tree)

    def place(batches):
        centres = np.stack(sent.value.leaf_centres)
        for b in batches:
            x = matrix(b.column(1), dim)
            leaf = sent.value.leaf_of(x)
            away = np.sqrt(((x - centres[leaf]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array(away)], ["node", "vec", "ids", "leaf", "away"])

    index = materialise(nodes.mapInArrow(place, "node string, vec array<double>, ids array<long>, leaf int, away double"))
    release(nodes)
    sizes, radius = np.zeros(tree.n_leaves, np.int64), np.zeros(tree.n_leaves)  # ids and reach of each leaf; at most as many rows as the sample
    blocks, q_nodes = np.ones(tree.n_leaves, np.int64), index.join(asked.select("node").distinct(), "node", "left_semi").select("node", "vec")
    for r in index.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids"), F.max("away").alias("away")).collect():
        sizes[r["leaf"]], blocks[r["leaf"]], radius[r["leaf"]] = r["ids"], -(-r["n"] // ROWS), r["away"]
    q_nodes = materialise(q_nodes)

    test = q_nodes.orderBy(F.xxhash64("node", F.lit(1))).limit(calibrate).select("vec").toArrow()
    wide = 1
    if test.num_rows:
        q = matrix(test["vec"], dim)
        turns = []
        order = [{leaf: i for i, leaf in enumerate(tree.visits(x, tree.n_leaves, sizes, 0))} for x in q]
        for r in exact(index, q, dim, k + 1).select("query", "leaf").collect():  # at most calibrate * (k + 1) rows
            turns.append(order[r["query"]][r["leaf"]])
        wide = int(np.quantile(turns, recall, method="higher")) + 1

    def route(batches):
        centres = np.stack(sent.value.leaf_centres)
        for b in batches:
            at, leaves, turns, most = [], [], [], []
            for i, x in enumerate(matrix(b.column(1), dim)):
                own = sent.value.visits(x, wide, sizes, k + 1)
                at += [i] * len(own)
                leaves += own
                turns += range(len(own))
                reach = centres[own] @ x + np.sqrt(x @ x) * radius[own]  # no inner product in the leaf's ball is larger
                most += (reach + 1e-9 * (1 + np.abs(reach))).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(leaves, pa.int32()), pa.array(turns, pa.int32()), pa.array(most, pa.float64())], ["q_node", "leaf", "turn", "most"])

    routed = materialise(q_nodes.mapInArrow(route, "q_node string, leaf int, turn int, most double"))
    keys = ["leaf", "block", "q_block"]
    row_blocks = spark.createDataFrame([(i, int(x)) for i, x in enumerate(blocks)], "leaf int, blocks int")

    def compare(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("q_node", pa.string()), ("score", pa.float64()), ("ids", pa.list_(pa.int64())))})
        ids, x, q = rows["ids"].combine_chunks(), matrix(rows["vec"], dim), matrix(queries["q_vec"], dim)
        least_id, least = ids.flatten().take(ids.offsets[:-1]).to_numpy(), queries["least"].to_numpy()
        out = []
        for i in range(0, len(q), AT_ONCE):
            which, at, score = top(q[i : i + AT_ONCE], x, least_id, k + 1)
            ok = score >= least[i + which]
            out.append(pa.table({"q_node": queries["q_node"].take(pa.array(i + which[ok])), "score": pa.array(score[ok]), "ids": ids.take(pa.array(at[ok]))}))
        return pa.concat_tables(out)

    def visit(asked_leaves: DataFrame) -> DataFrame:
        """The k + 1 best of each leaf for the queries (``q_node, leaf, least``) that visit it, if they reach ``least``."""
        per_leaf = asked_leaves.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("q_blocks"))
        leaves = F.broadcast(per_leaf.join(row_blocks, "leaf"))  # one row a leaf
        left = index.join(leaves, "leaf").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
        right = asked_leaves.join(q_nodes.withColumnsRenamed({"node": "q_node", "vec": "q_vec"}), "q_node").join(leaves, "leaf")
        right = right.withColumn("q_block", F.pmod(F.xxhash64("q_node"), F.col("q_blocks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        both = left.select(*keys, "vec", "ids").groupBy(*keys).cogroup(right.select(*keys, "q_node", "q_vec", "least").groupBy(*keys))
        return both.applyInArrow(compare, "q_node string, score double, ids array<long>")

    best = Window.partitionBy("q_node").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
    lowest = F.lit(float("-inf"))
    near = visit(routed.where(F.col("turn") < FIRST).select("q_node", "leaf", lowest.alias("least")))
    near = materialise(near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth"))
    least = near.groupBy("q_node").agg(F.when(F.count("*") > k, F.min("score")).otherwise(lowest).alias("least"))
    found = near.unionByName(visit(routed.where(F.col("turn") >= FIRST).join(least, "q_node").where("most >= least").select("q_node", "leaf", "least")))
    kept = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    lists = kept.groupBy("q_node").agg(F.flatten(F.collect_list(F.transform("ids", lambda x: F.struct((-F.col("score")).alias("minus"), x.alias("id"))))).alias("near"))
    own = asked.join(lists, asked["node"] == lists["q_node"]).select("id", F.filter("near", lambda x: x["id"] != F.col("id")).alias("near"))
    ranked = own.select("id", F.posexplode(F.slice(F.array_sort("near"), 1, k)).alias("rank", "hit"))
    return ranked.select(F.col("id").alias("query_id"), (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.minus")).alias("score"))
