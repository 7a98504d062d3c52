"""Near-duplicate classes by order min-hash and banded alignment.

A text is the sequence of its five-word shingles (lower-cased words), each labelled with how often it
has occurred so far. Each of ``SKETCHES`` hash functions picks the ``SAMPLED`` smallest labelled
shingles and keeps their order in the text; texts that share a sketch are candidates. Texts of up to
``SHORT`` shingles have the exact keys of ``end_keys`` besides, as sketches alone would miss 1.2 % of the pairs of
4 and 5; of pairs of more shingles that are just similar and lack some at random, sketches miss 0.012 % at most. They are similar
if an alignment of their shingle sequences keeps ``similarity`` of all shingles of both: with m aligned
of n and k, m / (n + k - m) reaches it. The alignment is the greedy furthest-reaching one, in the band
of diagonals that so many edits can reach, so it is exact. Classes are the connected components.

Equal texts are one node, whatever their number. In each bucket all members are first aligned with
the least member. Where that leaves more than one component in a bucket, the members outside its leader's
component are compared with all others, in blocks of ``BLOCK`` members by ``BLOCK`` or so; members of
one component never are. A pair is aligned unless counts of the shingles' hashes in ``BINS`` bins differ by more
than the edits allowed, which no similar pair's do. Components are found by alternating
large-star and small-star joins on tables in the shared folder.

Null texts count as empty. Texts without words are alone; texts of fewer than five words are one
shingle. Nulls and repeats among ids are allowed: each row gets the class of its text. A class is named by the least id
in it that isn't null. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finevidence.llm.common import id_key, join_groups, materialise, release, rows_of, small_batches, whole_text

SHINGLE, SKETCHES, SAMPLED = 5, 20, 4
#: Members of a bucket compared in one block.
BLOCK = 384
#: Bins that shingles are counted in before an alignment.
BINS = 256
#: Texts of up to so many shingles meet by their exact ends, too.
SHORT = 10
_WORD = re.compile(r"\w+")
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, SKETCHES, np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(words: list[str], known: dict[str, int]) -> np.ndarray:
    """Hash of each shingle in text order."""
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out += h[k : k + n] * _POWERS[k]
    return mix(out)


def labelled(s: np.ndarray) -> np.ndarray:
    """Each shingle's hash together with how often it has occurred before; a first occurrence keeps its hash,
    whether or not others repeat."""
    order = np.argsort(s, kind="stable")
    r = s[order]
    new = np.append(True, r[1:] != r[:-1])
    if new.all():
        return s
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(s)
    out[order] = np.where(new, r, mix(r + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return out


def sketches(s: np.ndarray) -> np.ndarray:
    """Key of each sketch."""
    s, keys = labelled(s), np.empty(SKETCHES, np.uint64)
    k = min(SAMPLED, len(s))
    step = max(1, 4_000_000 // len(s))
    for a in range(0, SKETCHES, step):
        v = mix(s[None, :] ^ _SEEDS[a : a + step, None])
        at = np.argpartition(v, k - 1, axis=1)[:, :k] if k < len(s) else np.broadcast_to(np.arange(k), v.shape)
        chosen = np.sort(at, axis=1)
        key = _SEEDS[a : a + step].copy()
        for j in range(k):
            key = mix(key + s[chosen[:, j]])
        keys[a : a + step] = key
    return keys


def end_keys(s: np.ndarray) -> np.ndarray:
    """Keys of the sequence of a short text, whole and without the shingles at its ends that a text of
    similarity 0.8 can lack; none for longer texts."""
    n = len(s)
    if n > SHORT:
        return np.zeros(0, np.uint64)
    parts = {s[i : n - d + i].tobytes() for d in range(n // 5 + 1) for i in range(d + 1)}
    return np.array([xxhash.xxh64_intdigest(p, SHINGLE) for p in parts], np.uint64)


def edits(n: int | np.ndarray, similarity: float):
    """Insertions and deletions that similar sequences of ``n`` shingles together can need."""
    return (n * (1 - similarity) / (1 + similarity) + 1e-9).astype(int) if isinstance(n, np.ndarray) else int(n * (1 - similarity) / (1 + similarity) + 1e-9)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the alignment of two shingle sequences reaches ``similarity``."""
    most = edits(len(a) + len(b), similarity)
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    x, y = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    n, m = len(x), len(y)
    if not n or not m:
        return n + m <= most
    own, other = set(x), set(y)
    if sum(v not in other for v in x) + sum(v not in own for v in y) > most:
        return False  # shingles that one side lacks are edits in any alignment
    reach = {1: 0}
    for d in range(most + 1):
        for k in range(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2):
            down = k == -d or k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1)
            i = reach[k + 1] if down else reach[k - 1] + 1
            j = i - k
            while i < n and j < m and x[i] == y[j]:
                i += 1
                j += 1
            reach[k] = i
            if i >= n and j >= m:
                return True
    return False


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, version, node, n, keys, sequence`` for every row; node is null for a text without words, version
    a hash of the text."""
    small_batches(docs.sparkSession)

    def run(batches):
        known: dict[str, int] = {}
        for b in batches:
            if len(known) > 500_000:
                known.clear()
            cols: list[list] = [[], [], [], []]
            for text in b.column(2).to_pylist():
                words = _WORD.findall(text.lower())
                if not words:
                    for c in cols:
                        c.append(None)
                    continue
                s = shingles(words, known)
                keys = np.append(sketches(s), end_keys(s))
                for c, v in zip(cols, (hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest(), len(s), keys.view(np.int64), (s >> np.uint64(32)).astype("<u4").tobytes())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary())))], ["doc_id", "version", "node", "n", "keys", "sequence"])

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, version long, node binary, n int, keys array<long>, sequence binary"
    text = whole_text(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text")).mapInArrow(run, schema)


def verify(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose texts are similar. Many pairs may have the same a."""
    texts = nodes.select("node", "sequence")
    sizes = pairs.groupBy("a").agg(F.count("*").alias("size"))
    firsts = sizes.join(texts.withColumnsRenamed({"node": "a", "sequence": "one"}), "a")
    both = join_groups(pairs.join(texts.withColumnsRenamed({"node": "b", "sequence": "two"}), "b"), firsts, ["a"], "size", pairs.count(), ["b"])

    def run(batches):
        for b in batches:
            keep = [aligned(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), similarity) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return both.select("a", "b", "one", "two").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its least node) for all nodes of ``links`` (a, b)."""
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(around).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        held = materialise(large)
        least = held.groupBy("u").agg(F.min("v").alias("m"))
        small = _to_least(held).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
        before, edges = edges, materialise(small)
        release(before, held)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now


def _to_least(edges: DataFrame) -> DataFrame:
    """``u, v, m``: each edge with the least of u and its neighbours; a star's centre may have very many."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")).select("u", F.least("u", "m").alias("m"), "size")
    return join_groups(edges, least, ["u"], "size", edges.count(), ["v"]).drop("size")


def links_across(members: DataFrame, similarity: float) -> DataFrame:
    """``a, b`` within buckets: similar texts of different components, as far as they join components
    that are still apart. members: ``key, node, component, main, n_main, n_rest, n, sequence``, of buckets with more than
    one component; main is the component of the bucket's leader. A block emits fewer rows than it has members."""
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    outside = F.col("component") != F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(outside, blocks("n_rest")).otherwise(blocks("n_main"))).cast("int")
    first = F.lit(0)
    dealt = members.withColumn("outside", outside).withColumn("own", own)
    with_main = dealt.withColumn("other", F.explode(F.sequence(first, F.when(F.col("outside"), blocks("n_main")).otherwise(blocks("n_rest")) - 1)))
    with_main = with_main.select("key", F.lit(False).alias("within"), F.when(F.col("outside"), F.col("other")).otherwise(F.col("own")).alias("i"), F.when(F.col("outside"), F.col("own")).otherwise(F.col("other")).alias("j"), F.col("outside").alias("left"), "node", "component", "n", "sequence")
    rest = dealt.where("outside").withColumn("other", F.explode(F.sequence(first, blocks("n_rest") - 1)))
    rest = rest.select("key", F.lit(True).alias("within"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "node", "component", "n", "sequence")
    ordered = with_main.unionByName(rest).repartition("key", "within", "i", "j").sortWithinPartitions("key", "within", "i", "j")

    def links(rows):
        n = np.array([r[7] for r in rows])
        sequences = [np.frombuffer(r[8], "<u4") for r in rows]
        bins = np.stack([np.bincount(s % BINS, minlength=BINS) for s in sequences]).astype(np.int32)
        numbers: dict[bytes, int] = {}
        root = np.array([numbers.setdefault(r[6], len(numbers)) for r in rows])
        left = np.array([r[4] for r in rows])
        across = not rows[0][1] or rows[0][2] != rows[0][3]
        for x in np.flatnonzero(left).tolist() if across else range(len(rows) - 1):
            at = np.flatnonzero(~left) if across else np.arange(x + 1, len(rows))
            most = edits(n[at] + n[x], similarity)
            at = at[(root[at] != root[x]) & (np.abs(n[at] - n[x]) <= most)]
            if not len(at):
                continue
            at = at[np.abs(bins[at] - bins[x]).sum(1) <= edits(n[at] + n[x], similarity)]
            for y in at.tolist():
                if root[y] != root[x] and aligned(sequences[x], sequences[y], similarity):
                    root[root == root[y]] = root[x]
                    yield rows[x][5], rows[y][5]

    def run(batches):
        group, held = None, []
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if (k := r[:4]) != group:
                    out += links(held) if held else []
                    group, held = k, []
                held.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["a", "b"])
        out = list(links(held)) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["a", "b"])

    return ordered.mapInArrow(run, "a binary, b binary").distinct()


def row_components(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """``doc_id, version, component`` for every row; component is null for a text without words."""
    rows = materialise(sketch(docs, id_col, text_col))
    nodes = rows.where("node is not null").dropDuplicates(["node"])
    buckets = materialise(nodes.select("node", F.explode("keys").alias("key")))
    leaders = buckets.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("size")).where("size > 1")
    shared = materialise(join_groups(buckets, leaders, ["key"], "size", buckets.count(), ["node"]))
    star = materialise(shared.where("node <> a").select("a", F.col("node").alias("b")).distinct())
    candidates = materialise(nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "n", "sequence"))
    links = materialise(verify(star, candidates, similarity))
    found = components(links)

    members = materialise(shared.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"), F.col("node") == F.col("a"), "size").toDF("key", "node", "component", "leads", "size"))
    main = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max(F.when(F.col("leads"), F.col("component"))).alias("main"), F.first("size").alias("size"))
    main = main.where("x <> y").select("key", "main", "size")
    open_ = join_groups(members.drop("size", "leads"), main, ["key"], "size", members.count(), ["node"])
    open_ = materialise(open_.withColumn("outside", (F.col("component") != F.col("main")).cast("int")))
    sizes = open_.groupBy("key").agg(F.sum("outside").alias("n_rest"), F.first("size").alias("size"))
    sizes = sizes.select("key", "n_rest", (F.col("size") - F.col("n_rest")).alias("n_main"), "size")
    dealt = join_groups(open_.drop("size", "outside"), sizes, ["key"], "size", open_.count(), ["node"]).drop("size")
    more = materialise(links_across(dealt.join(candidates, "node"), similarity))
    found = components(links.unionByName(more)) if not more.isEmpty() else found

    of_rows = rows.select("doc_id", "version", "node").join(found, "node", "left")
    out = materialise(of_rows.select("doc_id", "version", F.coalesce("component", "node").alias("component")))
    release(rows, buckets, shared, star, candidates, links, members, open_, more)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """``doc_id, class_id`` for every row: class_id is the least id of the row's class."""
    of_rows = row_components(docs, id_col, text_col, similarity)
    names = of_rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size"))
    named = join_groups(of_rows.where("component is not null"), names, ["component"], "size", of_rows.count(), ["doc_id"]).select("doc_id", "class_id")
    return named.unionByName(of_rows.where("component is null").select("doc_id", F.col("doc_id").alias("class_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row of each class, all columns: the one that names it, or with null ids only any. Of rows that
    repeat id and text one stays. Texts without words are alone and stay."""
    of_rows = row_components(docs, id_col, text_col, similarity)
    best = of_rows.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("best")).select("best.doc_id", "best.version")
    keep = best.unionByName(of_rows.where("component is null").select("doc_id", "version").distinct())
    return rows_of(docs, keep.select(id_key("doc_id").alias("id_key"), "version"), id_col, text_col)
