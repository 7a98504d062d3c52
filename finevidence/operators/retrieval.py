"""Chunks, TF-IDF, vector and hybrid ranking for many queries at once.

Whole rankings (``lexical``, ``semantic``) score every chunk for every query. The best k come without: ``lexical_top`` keeps
posting blocks by impact with their maxima and scores only chunks that can reach a query's k-th score (``word_blocks`` scores all
without a table of postings);
``semantic_top`` and ``candidate_ranks`` meet blocks of queries with blocks of chunks, one plan whatever their
number, and only the best of each block and counts are shuffled. Ranks break ties by chunk order, after
rounding to 12 decimals, so that float noise doesn't reorder equal scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finevidence.functions import text as X
from finevidence.operators import word_blocks as W

# Damping of reciprocal ranks, results, reserved semantic results, transcript limit.
RRF_K, TOP_K, FLOOR, TRANSCRIPT = 60, 8, 3, 8000
MISSING = "(none)"
#: Texts that an embedding model gets at once.
EMBEDDED = 64
#: Queries, and terms of queries, that are broadcast at once; more are joined in slices of about this many.
BROADCAST_QUERIES, BROADCAST_TERMS = 1000, 1_000_000
#: Chunks and queries of a block at most; chunks are sent once for each block of queries, and queries for each of chunks. Small tables get
#: smaller blocks of chunks, down to the last number. Queries whose scores of a block are held at once.
CHUNK_BLOCK, QUERY_BLOCK, LEAST_BLOCK, HELD_QUERIES = 16384, 4096, 1024, 256
#: Postings of a query that give its first bound on the k-th score, a result; blocks of more are taken last.
FIRST_POSTINGS = 64


def page_budget(pages: DataFrame, budget: int | None = X.PAGE_BUDGET) -> DataFrame:
    """``doc_id, page, text, truncated``: normalised pages in order while the budget lasts; the page that
    crosses it is cut, later ones go. Without a budget all pages stay whole."""
    p = pages.select("doc_id", "page", X.one_line(F.coalesce("text", F.lit(""))).alias("text"))
    if budget is None:
        return p.where("text <> ''").withColumn("truncated", F.lit(False))
    before = F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("rest", F.greatest(F.lit(0), budget - F.coalesce(before, F.lit(0))))
    p = p.withColumn("truncated", F.length("text") > F.col("rest")).withColumn("text", F.left("text", F.col("rest").cast("int")))
    return p.where("text <> ''").select("doc_id", "page", "text", "truncated")


def chunk(pages: DataFrame) -> DataFrame:
    """``doc_id, page, chunk_idx, text``: pages packed into chunks with overlap; never across pages."""
    return pages.select("doc_id", "page", F.posexplode(X.chunk_texts("text")).alias("chunk_idx", "text"))


def document_stats(docs: DataFrame, pages: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages, chunks and truncation of each document; documents without any text."""
    n = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.bool_or("truncated").alias("truncated"))
    k = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return n.join(k, "doc_id"), docs.select("doc_id").join(n.select("doc_id"), "doc_id", "left_anti")


def text_by_page(chunks: DataFrame) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))), lambda x: x["text"])
    return chunks.groupBy("doc_id", "page").agg(F.concat_ws(" ", ordered).alias("text"))


def term_counts(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    words = texts.select(*keys, X.words(text).alias("w")).repartition(*keys)  # texts are dealt out, not their terms
    return words.select(*keys, F.explode(X.terms(F.col("w"))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def tf_idf(counts: DataFrame, n: DataFrame, df: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """``*keys, term, weight``: (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), of unit length per key. n and df
    are per ``scope`` (one document, or nothing for the whole corpus). Rows stay partitioned by key."""
    idf = df.join(n, scope) if scope else df.crossJoin(F.broadcast(n))  # one row
    idf = idf.select(*scope, "term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = counts.join(idf, [*scope, "term"]).withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return w.select(*keys, "term", (F.col("w") / norm).alias("weight"))


def wanted_tf_idf(counts: DataFrame, n: DataFrame, df: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Rows of ``tf_idf`` over the whole corpus whose term is in ``wanted`` (term, once each), for scores of queries. Other terms count in a
    key's length, but go to it as numbers only."""
    idf = df.crossJoin(F.broadcast(n)).join(wanted.select("term", F.lit(True).alias("hit")), "term", "left")
    idf = idf.select("term", "hit", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = counts.join(idf, "term").select(*keys, F.when(F.col("hit"), F.col("term")).alias("term"), ((1 + F.ln("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return w.withColumn("weight", F.col("w") / norm).where("term IS NOT NULL").select(*keys, "term", "weight")


def tf_idf_within(texts: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """``tf_idf`` of texts within each ``scope`` (the first of the keys), with one shuffle: texts are dealt out by scope, and what is
    counted stays where it is."""
    placed = texts.select(*keys, X.words("text").alias("w")).repartition(*scope).withColumn("n", F.count("*").over(Window.partitionBy(*scope)))
    counts = placed.select(*keys, "n", F.explode(X.terms(F.col("w"))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    df = F.count("*").over(Window.partitionBy(*scope, "term"))
    w = counts.withColumn("w", (1 + F.ln("tf")) * (F.ln((1 + F.col("n")) / (1 + df)) + 1))
    return w.select(*keys, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))).alias("weight"))


def vocabulary(texts: DataFrame) -> DataFrame:
    """``term``: distinct words of texts, combined before they are shuffled; pairs of words are left out."""
    return texts.select(F.explode(X.words("text")).alias("term")).distinct()


def lexical_scores(chunk_weights: DataFrame, query_weights: DataFrame, keys: list[str]) -> DataFrame:
    """``query_id, *keys, score``: chunks with a positive cosine. The queries' weights are sent to the chunks in
    slices of a counted size, so a frequent term is no hot key, and a chunk's scores are summed where it is."""
    out = []
    for part in slices(query_weights.select("query_id", "term", F.col("weight").alias("qw")), BROADCAST_TERMS):
        out.append(chunk_weights.join(F.broadcast(part), "term").groupBy("query_id", *keys).agg(F.sum(F.col("weight") * F.col("qw")).alias("score")))
    return reduce(DataFrame.unionByName, out)


def slices(rows: DataFrame, most: int) -> list[DataFrame]:
    """``rows`` by query in parts of about ``most`` rows each."""
    n = max(1, -(-rows.count() // most))
    part = F.pmod(F.xxhash64("query_id"), F.lit(n))
    return [rows.where(part == i) for i in range(n)] if n > 1 else [rows]


def lexical(chunk_weights: DataFrame, query_weights: DataFrame, keys: list[str]) -> DataFrame:
    """``query_id, *keys, score, rank``: chunks with a positive cosine, best first."""
    return ranked(lexical_scores(chunk_weights, query_weights, keys), keys)


def posting_blocks(postings: DataFrame, query_weights: DataFrame) -> DataFrame:
    """``query_id, term, level, n, most``: postings of each block (a term's of one level), and the most that one adds to the
    query's score."""
    blocks = postings.groupBy("term", "level").agg(F.count("*").alias("n"), F.max("weight").alias("top"))
    return query_weights.join(blocks, "term").select("query_id", "term", "level", "n", (F.col("weight") * F.col("top")).alias("most"))


def lexical_top(chunk_weights: DataFrame, query_weights: DataFrame, keys: list[str], k: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``query_id, *keys, score, rank``: the k best of ``lexical``, of which far fewer chunks are scored."""
    pairs, postings = lexical_pairs(chunk_weights, query_weights, keys, k, keep)
    return ranked(_pair_scores(pairs, postings, query_weights, keys), keys).where(F.col("rank") <= k)


def lexical_pairs(chunk_weights: DataFrame, query_weights: DataFrame, keys: list[str], k: int, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``query_id, *keys`` of all chunks that can be among a query's k best, and the postings that score them.

    Some postings of highest impact give a query k scores, the least of which bounds the k-th from below. Blocks are then
    closed from the least impact on, as long as the sum over the terms of the most that a closed block adds stays below the bound: a
    chunk all of whose postings are in closed blocks can't reach it. Chunks with a posting in an open block are the
    pairs. Long lists of common terms are closed first, as they add little and hold much. Ranges of impact instead of sorted lists
    need no order within a term, so a common term is no hot key."""
    own_terms = chunk_weights.join(query_weights.select("term").distinct(), "term", "left_semi")
    postings = keep(own_terms.withColumn("level", F.floor(-4 * F.log2("weight")).cast("int")))  # quarters of a power of two
    blocks = keep(posting_blocks(postings, query_weights))
    met = lambda some: postings.join(some.select("query_id", "term", "level"), ["term", "level"]).select("query_id", *keys).distinct()
    most_first = Window.partitionBy("query_id").orderBy(F.col("n") > FIRST_POSTINGS * k, F.desc("most"), "term", "level").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.withColumn("before", F.coalesce(F.sum("n").over(most_first), F.lit(0))).where(F.col("before") < FIRST_POSTINGS * k)
    bound = ranked(_pair_scores(met(first), postings, query_weights, keys), keys).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    own = F.col("most") - F.coalesce(F.lag("most").over(Window.partitionBy("query_id", "term").orderBy("most", "level")), F.lit(0.0))
    length = F.sum("n").over(Window.partitionBy("query_id", "term"))
    least_first = Window.partitionBy("query_id").orderBy(F.col("most") / F.sqrt("length"), "term", "level").rowsBetween(Window.unboundedPreceding, 0)
    spent = blocks.withColumn("own", own).withColumn("length", length).withColumn("spent", F.sum("own").over(least_first)).join(bound, "query_id", "left")
    return keep(met(spent.where(F.col("bound").isNull() | (F.col("spent") > F.col("bound") - 1e-9)))), postings


def _pair_scores(pairs: DataFrame, postings: DataFrame, query_weights: DataFrame, keys: list[str]) -> DataFrame:
    terms = query_weights.select("query_id", "term", F.col("weight").alias("qw"))
    return pairs.join(postings.select(*keys, "term", "weight"), keys).join(terms, ["query_id", "term"]).groupBy("query_id", *keys).agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))


def ranked(scores: DataFrame, keys: list[str]) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), *keys)
    return scores.withColumn("rank", F.row_number().over(best))


def coverage(query_words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``query_id, coverage``: share of a query's distinct words that the vocabulary holds. query_words: (query_id, term or null)."""
    found = query_words.distinct().join(vocabulary.select("term", F.lit(1.0).alias("hit")), "term", "left")
    return found.groupBy("query_id").agg(F.coalesce(F.avg(F.when(F.col("term").isNotNull(), F.coalesce("hit", F.lit(0.0)))), F.lit(0.0)).alias("coverage"))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row; a lambda computes what it mentions anew for each element."""
    return F.transform(F.array(value), body)[0]


def unit(v: str) -> Column:
    """A vector in doubles, of unit length; zero vectors stay."""
    return unit_of(F.transform(v, lambda x: x.cast("double")))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def semantic_scores(corpus: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """``query_id, *keys, score`` of all chunks by cosine. corpus: keys, vector; queries: query_id, vector, sent to
    the chunks in slices of a counted size."""
    sides = corpus.select(*keys, unit("vector").alias("v"))
    own = slices(queries.select("query_id", unit("vector").alias("q")), BROADCAST_QUERIES)
    pairs = reduce(DataFrame.unionByName, [sides.join(F.broadcast(q), F.size("v") == F.size("q")) for q in own])
    return pairs.select("query_id", *keys, _dot("v", "q").alias("score"))


def semantic(corpus: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """``query_id, *keys, score, rank`` of all chunks by cosine, best first."""
    return ranked(semantic_scores(corpus, queries, keys), keys)


def numbered(rows: DataFrame, keys: list[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``*keys, pos`` for each distinct key; ``pos`` rises with the keys."""
    return keep(rows.select(*keys).distinct().orderBy(*keys).withColumn("pos", F.monotonically_increasing_id()))


def _of_vectors(chunks: pa.Table, queries: pa.Table) -> Iterator[np.ndarray]:
    """Scores of all chunks, query after query: one matrix product for some queries of a block."""
    stack = lambda t: np.stack(t["v"].to_numpy()) if len(t) else np.zeros((0, 1))
    if len(chunks) and len(queries):
        left, right = stack(queries), stack(chunks).T
        for at in range(0, len(left), HELD_QUERIES):
            yield from left[at : at + HELD_QUERIES] @ right


def _of_terms(chunks: pa.Table, queries: pa.Table) -> Iterator[np.ndarray]:
    """Scores of the chunks that share a term, minus infinity for others: the block's postings by term, those of a query's terms summed up."""
    flat = lambda t, c: (x := t[c].combine_chunks()).flatten().to_numpy()
    size = np.array([len(x) for x in chunks["terms"]], np.int64)
    term, weight, chunk = flat(chunks, "terms"), flat(chunks, "weights"), np.repeat(np.arange(len(chunks)), size)
    order = np.argsort(term, kind="stable")
    term, weight, chunk = term[order], weight[order], chunk[order]
    for terms, weights in zip(queries["terms"].to_numpy(), queries["weights"].to_numpy()):
        by = np.argsort(terms)
        lo, hi = np.searchsorted(term, terms[by]), np.searchsorted(term, terms[by], "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        s = np.bincount(chunk[at], weight[at] * np.repeat(weights[by], n), len(chunks))
        yield np.where(np.bincount(chunk[at], minlength=len(chunks)) > 0, s, -np.inf)


def mark_arrays(marks: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounded scores and positions of each query's marks, in order of rank."""
    ends, flat = np.cumsum([0, *pc.fill_null(pc.list_value_length(marks), 0).to_numpy()]), marks.flatten()
    s, pos = np.round(flat.field("s").to_numpy(zero_copy_only=False), 12), flat.field("pos").to_numpy(zero_copy_only=False)
    return [(s[a:b], pos[a:b]) for a, b in zip(ends, ends[1:])]


def best_of(s: np.ndarray, pos: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, best first; ties by position."""
    r = np.round(s, 12)
    some = np.flatnonzero(r >= np.partition(r, len(r) - k)[len(r) - k]) if len(r) > k else np.arange(len(r))
    return some[np.lexsort((pos[some], -r[some]))][:k]


def before_marks(r: np.ndarray, pos: np.ndarray, mark_s: np.ndarray, mark_pos: np.ndarray) -> np.ndarray:
    """How many of the others stand before the nth mark and after those before it; r: rounded scores. Those after the last mark don't matter."""
    some = np.flatnonzero(r >= mark_s[-1])
    some = some[~np.isin(pos[some], mark_pos)]
    r, pos = r[some], pos[some]
    nth, to = np.searchsorted(-mark_s, -r), np.searchsorted(-mark_s, -r, "right")
    tied = np.flatnonzero(nth < to)
    if len(tied):  # their positions tell
        values, places = np.concatenate([mark_s, r[tied]]), np.concatenate([mark_pos, pos[tied]])
        order = np.lexsort((places, -values))
        is_mark = order < len(mark_s)
        nth[tied[order[~is_mark] - len(mark_s)]] = np.cumsum(is_mark)[~is_mark]
    return np.bincount(nth, minlength=len(mark_s))[: len(mark_s)]


def _standings(query_ids: pa.Array, parts: list[tuple[np.ndarray, ...]]) -> pa.Table:
    which, at, score, nth, n = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5
    columns = [pa.array(at, pa.int64()), pa.array(score, pa.float64()), pa.array(nth, pa.int32()), pa.array(n, pa.int64())]
    return pa.Table.from_arrays([query_ids.take(pa.array(which, pa.int64())), *columns], ["query_id", "pos", "score", "nth", "n"])


def _split(standings: DataFrame) -> tuple[DataFrame, DataFrame]:
    return standings.where("nth < 0").select("query_id", "pos", "score"), standings.where("nth >= 0").groupBy("query_id", "nth").agg(F.sum("n").alias("n"))


def blocked(chunks: DataFrame, queries: DataFrame, scores: Callable, deep: int, within: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``query_id, pos, score``: the ``deep`` best of each block of chunks for each query, and ``query_id, nth, n``: how many of the other
    chunks stand before a query's nth mark and after those before it.

    chunks: ``pos`` and what ``scores`` reads; queries: ``query_id``, the same, and ``marks``, an array of (s, pos) in order of
    rank. Chunks and queries meet in blocks, so a task holds one block of each; ``within`` names columns that must agree."""
    n_chunks, n_queries = chunks.count(), queries.count()
    size = min(CHUNK_BLOCK, max(LEAST_BLOCK, n_chunks // (2 * chunks.sparkSession.sparkContext.defaultParallelism)))
    of = lambda c, n, most: F.pmod(F.xxhash64(c), F.lit(max(1, -(-n // most)))).cast("int")
    every = lambda n, most: F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // most)) - 1)))
    left = chunks.withColumn("c_block", of("pos", n_chunks, size)).withColumn("q_block", every(n_queries, QUERY_BLOCK))
    right = queries.withColumn("q_block", of("query_id", n_queries, QUERY_BLOCK)).withColumn("c_block", every(n_chunks, size))
    kind = dict(queries.dtypes)["query_id"]

    def run(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        pos, out = chunks["pos"].to_numpy(), []
        marks = mark_arrays(queries["marks"].combine_chunks())
        for i, s in enumerate(scores(chunks, queries)):
            there = np.flatnonzero(s > -np.inf)
            s, own = s[there], pos[there]
            if deep:
                best = best_of(s, own, deep)
                out.append((np.full(len(best), i), own[best], s[best], np.full(len(best), -1), np.zeros(len(best), np.int64)))
            if len(marks[i][0]):
                n = before_marks(np.round(s, 12), own, *marks[i])
                out.append((np.full(len(n), i), np.full(len(n), -1), np.zeros(len(n)), np.arange(len(n)), n))
        return _standings(queries["query_id"].combine_chunks(), out)

    on = ["c_block", "q_block", *(within or [])]
    found = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, f"query_id {kind}, pos long, score double, nth int, n long")
    return _split(found)


def _marks(pairs: DataFrame) -> DataFrame:
    """``query_id, marks`` from ``query_id, pos, score``, in order of rank."""
    in_order = F.array_sort(F.collect_list(F.struct((-F.round("score", 12)).alias("minus"), "pos", F.col("score").alias("s"))))
    return pairs.groupBy("query_id").agg(F.transform(in_order, lambda x: F.struct(x["s"].alias("s"), x["pos"].alias("pos"))).alias("marks"))


def _with_marks(queries: DataFrame, marks: DataFrame | None) -> DataFrame:
    empty = F.array().cast("array<struct<s:double,pos:bigint>>")
    return queries.withColumn("marks", empty) if marks is None else queries.join(marks, "query_id", "left").withColumn("marks", F.coalesce("marks", empty))


def _mark_ranks(marks: DataFrame, counts: DataFrame) -> DataFrame:
    """``query_id, pos, score, rank`` of the marks: those before it, marks and others, and itself."""
    each = marks.select("query_id", F.posexplode("marks").alias("nth", "m")).join(counts, ["query_id", "nth"], "left")
    before = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("query_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    return each.select("query_id", F.col("m.pos").alias("pos"), F.col("m.s").alias("score"), (F.col("nth") + 1 + before).alias("rank"))


def _vectors_of(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("vector").isNotNull()).select(name, unit("vector").alias("v")).withColumn("dim", F.size("v"))


def semantic_top(corpus: DataFrame, queries: DataFrame, keys: list[str], k: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``query_id, *keys, score, rank``: the k best of ``semantic``."""
    names = numbered(corpus, keys, keep)
    top, _ = blocked(keep(_vectors_of(corpus.join(names, keys), "pos")), _with_marks(keep(_vectors_of(queries, "query_id")), None), _of_vectors, k, ["dim"])
    return ranked(top, ["pos"]).where(F.col("rank") <= k).join(names, "pos").select("query_id", *keys, "score", "rank")


def fuse(rankings: list[tuple[DataFrame, Column]], keys: list[str]) -> DataFrame:
    """``query_id, *keys, fused``: weighted reciprocal ranks over all rankings."""
    parts = [r.select("query_id", *keys, (w / (RRF_K + F.col("rank"))).alias("part")) for r, w in rankings]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", *keys).agg(F.sum("part").alias("fused"))


def candidate_ranks(chunk_weights: DataFrame, query_weights: DataFrame, corpus: DataFrame, queries: DataFrame, keys: list[str], keep: Callable[[DataFrame], DataFrame], k: int = TOP_K) -> tuple[DataFrame, DataFrame]:
    """Lexical and semantic ranks of all chunks that can be among the k best of both together.

    The k-th best fused score is at least 1 / (RRF_K + k), as the k semantically best have it (a query without a
    vector has one ranking alone), and weights are at most 1, so a chunk after rank RRF_K + 2k in both rankings
    can't reach it. Those up to it in either are taken, and their ranks in the other are counted exactly: the semantically best
    are found first, the lexical pass finds its own best and counts what stands before those, and a last pass
    over the vectors counts for the lexically best. No ranking is sorted. ``keep`` writes a table that is read again."""
    deep = RRF_K + 2 * k
    names = numbered(chunk_weights.select(*keys).union(corpus.select(*keys)), keys, keep)
    terms = numbered(query_weights, ["term"], keep).withColumnRenamed("pos", "no")
    listed = lambda rows, name: rows.groupBy(name).agg(F.sort_array(F.collect_list(F.struct("no", "weight"))).alias("x")).select(name, F.col("x.no").alias("terms"), F.col("x.weight").alias("weights"))
    postings = chunk_weights.join(terms, "term").join(names, keys)
    texts, asked = keep(listed(postings, "pos")), keep(listed(query_weights.join(terms, "term"), "query_id"))

    def scores_of(pairs: DataFrame) -> DataFrame:
        shared = F.zip_with("terms", "weights", lambda t, w: F.struct(t.alias("no"), w.alias("w")))
        of_query = asked.select("query_id", F.explode(shared).alias("x")).select("query_id", "x.no", F.col("x.w").alias("qw"))
        of_chunk = pairs.join(texts, "pos").select("query_id", "pos", F.explode(shared).alias("x")).select("query_id", "pos", "x.no", F.col("x.w").alias("cw"))
        return of_chunk.join(of_query, ["query_id", "no"]).groupBy("query_id", "pos").agg(F.sum(F.col("cw") * F.col("qw")).alias("score"))

    standings = lambda marks: tuple(keep(x) for x in blocked(texts, _with_marks(asked, marks), _of_terms, deep))
    found = _ranks_of_both(corpus.join(names, keys), queries, scores_of, standings, deep, keep)
    return tuple(r.join(names, "pos").select("query_id", *keys, "score", "rank") for r in found)


def text_ranks(texts: DataFrame, asked: DataFrame, corpus: DataFrame, queries: DataFrame, keys: list[str], keep: Callable[[DataFrame], DataFrame], k: int = TOP_K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``candidate_ranks`` of texts (keys, text) for queries as texts (query_id, text), and the queries' ``coverage``, without a table of
    terms: texts stay in blocks of words, which meet packs of queries in a cross join. A task keeps each of its queries' best and counts
    over all of its blocks, so what is written grows with the queries, not with queries times blocks."""
    deep, kind = RRF_K + 2 * k, dict(texts.dtypes)[keys[0]]
    if len(keys) == 1 and kind in ("tinyint", "smallint", "int", "bigint"):  # such a key is a position
        placed, named = lambda rows: rows.withColumn("pos", F.col(keys[0]).cast("long")), lambda r: r.withColumn(keys[0], F.col("pos").cast(kind))
    else:
        names = numbered(texts.select(*keys).union(corpus.select(*keys)), keys, keep)
        placed, named = lambda rows: rows.join(names, keys), lambda r: r.join(names, "pos")
    blocks, terms = W.weighed(placed(texts).select("pos", "text"), ["pos"], asked, keep)
    kind = dict(terms.dtypes)["query_id"]

    def each_score(block: W.Block, column: Callable, queries: pa.StructArray) -> Iterator[pa.Table]:
        pos = pc.fill_null(column("pos"), np.iinfo(np.int64).min).to_numpy()
        by_pos = np.argsort(pos)
        for i, ((term, factor), wanted) in enumerate(zip(W.query_terms(queries), queries.field("wanted"))):
            wanted = wanted.values.to_numpy()
            at = np.searchsorted(pos, wanted, sorter=by_pos)
            at[at == len(pos)] = 0
            at = by_pos[at[pos[by_pos[at]] == wanted]]
            if len(at):
                s = block.scores_of(at, term, factor)
                at, s = at[s > 0], s[s > 0]
                yield pa.table({"query_id": queries.field("query_id").take(pa.array(np.full(len(at), i))), "pos": pos[at], "score": s})

    def scores_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.where("pos IS NOT NULL").groupBy("query_id").agg(F.collect_list("pos").alias("wanted"))
        return W.met(blocks, keep(W.packed(terms.join(wanted, "query_id"))), lambda: (each_score, tuple), f"query_id {kind}, pos long, score double")

    def standing():
        held = {}

        def meet(block: W.Block, column: Callable, queries: pa.StructArray) -> Iterator[pa.Table]:
            known, pos = column("pos").is_valid().to_numpy(zero_copy_only=False), pc.fill_null(column("pos"), 0).to_numpy()
            marks = mark_arrays(queries.field("marks"))
            for q, m, s in zip(queries.field("query_id").to_pylist(), marks, block.scores(W.query_terms(queries))):
                there = np.flatnonzero((s > -np.inf) & known)
                s, own = s[there], pos[there]
                best_s, best_pos, n = held.get(q, (np.zeros(0), np.zeros(0, np.int64), np.zeros(len(m[0]), np.int64)))
                if len(m[0]):
                    n = n + before_marks(np.round(s, 12), own, *m)
                if len(best_s) == deep:
                    some = s > best_s[-1] - 1e-11
                    s, own = s[some], own[some]
                if len(s):
                    best_s, best_pos = np.concatenate([best_s, s]), np.concatenate([best_pos, own])
                    best = best_of(best_s, best_pos, deep)
                    best_s, best_pos = best_s[best], best_pos[best]
                held[q] = best_s, best_pos, n
            return ()

        def rest() -> Iterator[pa.Table]:
            ids = pa.array(list(held), pa.int64() if kind == "bigint" else None)
            for lo in range(0, len(ids), HELD_QUERIES):
                parts = []
                for i, (s, pos, n) in enumerate(list(held.values())[lo : lo + HELD_QUERIES], lo):
                    parts.append((np.full(len(s) + len(n), i), np.append(pos, np.full(len(n), -1)), np.append(s, np.zeros(len(n))), np.append(np.full(len(s), -1), np.arange(len(n))), np.append(np.zeros(len(s), np.int64), n)))
                yield _standings(ids, parts)

        return meet, rest

    standings = lambda marks: _split(keep(W.met(blocks, keep(W.packed(_with_marks(terms, marks))), standing, f"query_id {kind}, pos long, score double, nth int, n long")))
    cover = coverage(W.hashed_words(asked, ["query_id"]).select("query_id", F.explode_outer("w").alias("term")), terms.select(F.explode("terms").alias("term")).distinct())
    found = _ranks_of_both(placed(corpus), queries, scores_of, standings, deep, keep)
    return *(named(r).select("query_id", *keys, "score", "rank") for r in found), cover


def _ranks_of_both(corpus: DataFrame, queries: DataFrame, scores_of: Callable[[DataFrame], DataFrame], standings: Callable[[DataFrame], tuple[DataFrame, DataFrame]], deep: int, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Lexical and semantic ranks (of positions) of all chunks up to ``deep`` in either. ``scores_of``: lexical scores of pairs ``query_id,
    pos``; ``standings``: the lexically best and the counts before marks, as of ``blocked``."""
    vectors, asked_vectors = keep(_vectors_of(corpus, "pos")), keep(_vectors_of(queries, "query_id"))
    best = lambda top: keep(ranked(top, ["pos"]).where(F.col("rank") <= deep))
    sem = best(blocked(vectors, _with_marks(asked_vectors, None), _of_vectors, deep, ["dim"])[0])
    in_lex = keep(_marks(scores_of(sem.select("query_id", "pos"))))
    top, counts = standings(in_lex)
    lex = best(top)
    late = _mark_ranks(in_lex, counts).join(lex.select("query_id", "pos"), ["query_id", "pos"], "left_anti")
    lex_all = lex.select("query_id", "pos", "score", "rank").unionByName(late)

    pairs = lex.select("query_id", "pos").join(sem, ["query_id", "pos"], "left_anti").join(vectors, "pos").join(asked_vectors.select("query_id", F.col("v").alias("q"), F.col("dim").alias("q_dim")), "query_id").where("dim = q_dim")
    in_sem = keep(_marks(pairs.select("query_id", "pos", _dot("v", "q").alias("score"))))
    _, counts = blocked(vectors, _with_marks(asked_vectors, in_sem), _of_vectors, 0, ["dim"])
    return lex_all, sem.select("query_id", "pos", "score", "rank").unionByName(_mark_ranks(in_sem, counts))


def hybrid(lex: DataFrame, sem: DataFrame, cover: DataFrame, keys: list[str], k: int = TOP_K, floor: int = FLOOR) -> DataFrame:
    """``query_id, *keys, score, rank, mode``: the k best fused chunks with at least ``floor`` of the
    semantically best. Queries without a semantic ranking degrade to their lexical hits. Whole rankings, or those
    of ``candidate_ranks``, which give the same."""
    weighted = lex.join(cover, "query_id")
    fused = fuse([(weighted, F.col("coverage")), (sem, F.lit(1.0))], keys)
    reserved = sem.where(F.col("rank") <= floor).select("query_id", *keys, F.lit(1).alias("reserved"))
    has = sem.select("query_id").distinct().withColumn("mode", F.lit("hybrid"))
    c = fused.join(reserved, ["query_id", *keys], "left").join(has, "query_id", "left").join(lex.select("query_id", *keys, "score"), ["query_id", *keys], "left")
    c = c.withColumn("mode", F.coalesce("mode", F.lit("lexical"))).withColumn("score", F.when(F.col("mode") == "hybrid", F.col("fused")).otherwise(F.col("score")))
    chosen = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("reserved", F.lit(0))), F.desc(F.round("score", 12)), *keys)
    c = c.withColumn("nth", F.row_number().over(chosen)).where(F.col("nth") <= k)
    return ranked(c.select("query_id", *keys, "score", "mode"), keys)


def fallback(queries: DataFrame, hits: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """First k chunks of the query's document, with score 0, for queries without hits. queries: (query_id, doc_id)."""
    missed = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    first = Window.partitionBy("doc_id").orderBy("page", "chunk_idx")
    few = chunks.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k)
    return missed.join(few, "doc_id").select("query_id", "doc_id", "page", "chunk_idx", F.lit(0.0).alias("score"))


def vector_mismatches(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    left = chunks.select(key).join(vectors.select(key), key, "left_anti").withColumn("missing", F.lit("vector"))
    return left.unionByName(vectors.select(key).join(chunks.select(key), key, "left_anti").withColumn("missing", F.lit("chunk")))


def hashed_vectors(texts: DataFrame, key: str, dims: int = 256) -> DataFrame:
    """``key, vector``: signed feature hashing of folded words, of unit length; zero where there are none."""
    w = texts.select(key, F.explode_outer(F.regexp_extract_all(X.fold("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    h = F.crc32(F.col("w").cast("binary"))
    cells = w.select(key, F.pmod(h, F.lit(dims)).cast("int").alias("d"), F.when(F.shiftright(h, 8) % 2 == 1, 1.0).otherwise(-1.0).alias("s")).groupBy(key, "d").agg(F.sum(F.when(F.col("d").isNotNull(), F.col("s"))).alias("x"))
    # cells are dealt out as they are: half-built lists of them would be larger
    met = cells.repartition(key).groupBy(key).agg(F.filter(F.collect_list(F.struct("d", "x")), lambda e: e["d"].isNotNull()).alias("met"))
    others = F.array_except(F.sequence(F.lit(0), F.lit(dims - 1)), F.col("met.d"))
    dense = F.array_sort(F.concat("met", F.transform(others, lambda i: F.struct(i.alias("d"), F.lit(0.0).alias("x")))))["x"]
    return met.select(key, unit_of(dense).alias("vector"))


def unit_of(v: Column) -> Column:
    norm = lambda d: F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return _once(v, lambda d: _once(norm(d), lambda n: F.transform(d, lambda x: x / F.when(n == 0, 1.0).otherwise(n))))


def contexts(hits: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """``query_id, context``: the hits' texts in rank order, each after its place; for queries with hits."""
    block = F.concat(F.lit("[document p."), F.col("page").cast("string"), F.lit("] "), F.col("text"))
    one = hits.join(chunks, keys).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
    return one.select("query_id", F.array_join("blocks", "\n").alias("context"))


def request_contexts(asked: DataFrame, documents: DataFrame, transcripts: DataFrame | None = None, market: DataFrame | None = None, filings: DataFrame | None = None, limit: int = TRANSCRIPT) -> DataFrame:
    """``query_id, context`` for every request: its document block (of ``contexts``) and its transcript up to ``limit``
    characters, which say so where they are missing; market and filing blocks only where there are any. The parts
    are tables ``query_id, text``, one row a query."""
    out = asked.select("query_id").join(documents.withColumnRenamed("context", "document"), "query_id", "left")
    for name, part in (("transcript", transcripts), ("market", market), ("filings", filings)):
        out = out.join(part.select("query_id", F.col("text").alias(name)), "query_id", "left") if part is not None else out.withColumn(name, F.lit(None).cast("string"))
    block = lambda label, c: F.concat(F.lit(f"{label}:\n"), c)
    parts = [block("Document", F.coalesce("document", F.lit(MISSING))), block("Transcript", F.coalesce(F.left("transcript", F.lit(limit)), F.lit(MISSING))), block("Market", F.col("market")), block("Filings", F.col("filings"))]
    return out.select("query_id", F.concat_ws("\n\n", *parts).alias("context"))


def reading_blocks(readings: DataFrame) -> DataFrame:
    """``query_id, block``: the chart readings of a request, each after a label of its origin, own charts first; several
    get a warning that their periods may differ. readings: ``query_id, origin`` (drawn or sent), ``reading`` (a struct)."""
    label = F.when(F.col("origin") == "drawn", "Chart drawn from market data").otherwise("Chart sent with the request")
    line = F.struct((F.col("origin") != "drawn").alias("nth"), F.concat(label, F.lit(": "), F.to_json("reading")).alias("line"))
    one = readings.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("lines"))
    warning = F.when(F.size("lines") > 1, F.array(F.lit("The charts may show different periods."))).otherwise(F.array().cast("array<string>"))
    return one.select("query_id", F.array_join(F.concat("lines", warning), "\n").alias("block"))


def embed(texts: DataFrame, key: str, model: Callable[[list[str]], list[list[float]]], text: str = "text") -> DataFrame:
    """``key, vector`` by a caller's model, which gets EMBEDDED texts at once (null: empty) and must give a vector for
    each, in order. ``hashed_vectors`` needs no model."""
    def run(frames):
        for f in frames:
            for at in range(0, len(f), EMBEDDED):
                some = f.iloc[at : at + EMBEDDED]
                vectors = model([t or "" for t in some["text"]])
                if len(vectors) != len(some):
                    raise ValueError(f"the model gave {len(vectors)} vectors for {len(some)} texts")
                yield some[[key]].assign(vector=[list(map(float, v)) for v in vectors])

    rows = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, vector array<double>")


def asked_context(history: DataFrame, asked: DataFrame) -> DataFrame:
    """``conv_id, context``: all of a conversation (of ``conversation_context``), then the new question after the
    report and the hits that it is about. asked: ``conv_id, question, report, hits``; a question may open a conversation."""
    part = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(MISSING)))
    new = asked.select("conv_id", F.concat_ws("\n", part("Report", F.col("report")), part("Found", F.col("hits")), part("Question", F.col("question"))).alias("new"))
    return new.join(history.select("conv_id", "context"), "conv_id", "left").select("conv_id", F.concat_ws("\n", "context", "new").alias("context"))


def conversation_context(turns: DataFrame) -> DataFrame:
    """``conv_id, turns, context``: all of a conversation's turns in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", F.coalesce("text", F.lit("(none)"))).alias("line")))), lambda x: x["line"])
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(lines, "\n").alias("context"))
