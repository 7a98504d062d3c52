"""Lexical and hybrid rankings from blocks of words: the same rows, without tables or shuffles of all terms."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from finevidence.operators import retrieval
from finevidence.operators import word_blocks as W
from finevidence.plans import search
from finevidence.sources import adapters


def made(spark):
    """Copies, ties, empty and null texts, keys in several rows, a long text, common words."""
    r = random.Random(3)
    some = lambda n: " ".join(r.choice(["red", "Fox", "hen"]) if r.random() < 0.4 else f"w{int(r.random() ** 2 * 60)}" for _ in range(n))
    rows = [(i, i % 3, some(r.choice([1, 4, 12]))) for i in range(150)] + [(i, 7, "red fox red hen") for i in range(40)]
    rows += [(5, 2, some(6)), (5, 2, "fox"), (5, 2, None), (200, 0, None), (201, 0, ""), (202, 0, "de la"), (203, 0, some(3000)), (204, 0, "alone")]
    texts = spark.createDataFrame(rows, "doc_id long, page int, text string")
    queries = spark.createDataFrame([(i, some(8)) for i in range(12)] + [(50, "absent"), (51, None), (52, "red fox"), (53, "alone red")], "query_id long, text string")
    return texts, queries


def weights_of(texts, queries, keys):
    counts = retrieval.term_counts(texts, keys)
    df, n = counts.groupBy("term").agg(F.count("*").alias("df")), texts.agg(F.count("*").alias("n"))
    return retrieval.tf_idf(counts, n, df, keys, []).localCheckpoint(), retrieval.tf_idf(retrieval.term_counts(queries, ["query_id"]), n, df, ["query_id"], []).localCheckpoint(), df


def rows_of(df, keys):
    return sorted((r.query_id, *(r[k] for k in keys), round(r.score, 9), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("words, pack, common", [(1 << 20, 1 << 18, 1 / 16), (40, 20, 0.5)])
def test_best_of_blocks_are_the_best(spark, monkeypatch, words, pack, common):
    monkeypatch.setattr(W, "BLOCK_WORDS", words)
    monkeypatch.setattr(W, "PACK_TERMS", pack)
    texts, queries = made(spark)
    keys = ["doc_id", "page"]
    cw, qw, _ = weights_of(texts, queries, keys)
    blocks, asked = W.weighed(texts, keys, queries, adapters.kept)
    assert (blocks.count() > 20) == (words == 40)
    got = retrieval.ranked(W.best(blocks, keys, asked, 5, adapters.kept), keys).where("rank <= 5")
    assert rows_of(got, keys) == rows_of(retrieval.lexical(cw, qw, keys).where("rank <= 5"), keys) != []
    none, few = W.weighed(texts.limit(0), keys, queries, adapters.kept)
    assert W.best(none, keys, few, 5, adapters.kept).count() == 0


@pytest.mark.parametrize("kind, words", [("long", 1 << 20), ("string", 60)])
def test_ranks_of_texts_equal_whole_rankings(spark, monkeypatch, kind, words):
    monkeypatch.setattr(W, "BLOCK_WORDS", words)
    monkeypatch.setattr(W, "PACK_TERMS", words)
    monkeypatch.setattr(retrieval, "RRF_K", 6)
    texts, queries = made(spark)
    texts, keys, k = texts.select(F.col("doc_id").cast(kind).alias("doc_id"), "text"), ["doc_id"], 3
    cell = lambda i, j: float((i * i * 7 + i * j * 3 + j * j) % 11 - 5)
    corpus = spark.createDataFrame([(i, [cell(i % 50, j) for j in range(4)]) for i in range(0, 206, 2)], "doc_id long, vector array<double>").withColumn("doc_id", F.col("doc_id").cast(kind))
    vectors = spark.createDataFrame([(i, [cell(i, j + 1) for j in range(4)]) for i in [*range(0, 12, 2), 51]], "query_id long, vector array<double>")
    cw, qw, df = weights_of(texts, queries, keys)
    lex, sem, cover = retrieval.text_ranks(texts, queries, corpus, vectors, keys, adapters.kept, k)
    whole = retrieval.lexical(cw, qw, keys), retrieval.semantic(corpus, vectors, keys)
    for a, b in zip((lex, sem), whole):
        got = rows_of(a, keys)
        assert got and set(got) < set(rows_of(b, keys))
    known = retrieval.coverage(queries.select("query_id", F.explode_outer(search.X.words("text")).alias("term")), df)
    assert sorted(map(tuple, cover.collect())) == sorted(map(tuple, known.collect()))
    fused = lambda *r: rows_of(retrieval.hybrid(*r, cover, keys, k, 1), keys)
    assert fused(lex, sem) == fused(*whole) != []


def test_counts_before_marks():
    r = np.random.default_rng(1)
    for _ in range(200):
        s, pos = r.integers(0, 5, 40) / 4.0, r.permutation(60)[:40]
        order = np.lexsort((pos, -s))
        marks = np.sort(r.permutation(40)[: r.integers(1, 9)])
        want = [m - (marks[i - 1] if i else -1) - 1 for i, m in enumerate(marks)]
        assert retrieval.before_marks(s, pos, s[order[marks]], pos[order[marks]]).tolist() == want


@pytest.mark.parametrize("query", [search.r12_r14_hybrid_top, search.r12_rrf, search.r07_r09_lexical_top, search.r18_contexts])
def test_no_table_of_all_terms_is_written(spark, sf_dir, monkeypatch, query):
    """What is written has fewer rows than a tenth of the (text, term) pairs."""
    keys, texts = (["doc_id"], search.A.table(spark, sf_dir, "documents")) if "r12" in query.__name__ else (search.KEYS, search._pages(spark, sf_dir))
    every, sizes, kept = retrieval.term_counts(texts, keys).count(), [], adapters.kept

    def counted(df):
        out = kept(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(adapters, "kept", counted)
    assert query(spark, sf_dir).count() > 0
    assert max(sizes) < every / 10


def test_shuffled_files_go_when_a_table_is_written(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {name for name in (files.getAllFiles().apply(i).getName() for i in range(files.getAllFiles().size())) if name.startswith("shuffle_")}
    before, key = held(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    table = adapters.kept(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count())
    for _ in range(50):
        if left := held() - before:
            time.sleep(0.2)
    assert not left and spark.conf.get(key) == "false" and table.count() == 100
