"""Queries on texts and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from finevidence.functions import text as X
from finevidence.operators import retrieval as Q
from finevidence.operators import reuse
from finevidence.operators import word_blocks as W
from finevidence.sources import adapters as A

KEYS = ["doc_id", "page"]


def _pages(spark, sf_dir):
    """Whole documents: the page budget is a feature of r01 alone."""
    return Q.page_budget(A.pages(spark, sf_dir), None)


def r01_w11_page_budget(spark, sf_dir):
    return Q.page_budget(A.pages(spark, sf_dir), 2000).select("doc_id", A.clean("page").alias("page"), F.md5("text").alias("text_md5"), "truncated")


def r02_chunks(spark, sf_dir):
    return Q.chunk(_pages(spark, sf_dir)).select("doc_id", A.clean("page").alias("page"), A.clean("chunk_idx").alias("chunk_idx"), "text")


def r03_empty_documents(spark, sf_dir):
    p = _pages(spark, sf_dir)
    docs = A.table(spark, sf_dir, "documents").select("doc_id").unionByName(A.table(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("doc_id")))
    return docs.join(p.select("doc_id").distinct(), "doc_id", "left_anti")


def r04_document_stats(spark, sf_dir):
    p = _pages(spark, sf_dir)
    stats, _ = Q.document_stats(A.table(spark, sf_dir, "documents"), p, Q.chunk(p))
    return stats


def a08_text_by_page(spark, sf_dir):
    c = _pages(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), F.col("page").alias("chunk_idx"), "text")
    return Q.text_by_page(c).select("doc_id", F.md5("text").alias("text_md5"))


def r05_tokens(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(X.words("text")).cast("bigint").alias("n_words"), F.md5(F.array_join(X.words("text"), " ")).alias("words_md5"))


def _lexical_best(spark, sf_dir, k):
    """The k best pages of each benchmark item."""
    queries = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    blocks, asked = W.weighed(_pages(spark, sf_dir).select(*KEYS, "text"), KEYS, queries, A.kept)
    return Q.ranked(W.best(blocks, KEYS, asked, k, A.kept), KEYS).where(F.col("rank") <= k)


def r06_tf_idf(spark, sf_dir):
    """Weights within each document, as an index of one document has them."""
    p = _pages(spark, sf_dir)
    w = Q.tf_idf_within(p, KEYS, ["doc_id"])
    return w.groupBy("doc_id", "page").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("top")).withColumn("page", A.clean("page"))


def r07_r09_lexical_top(spark, sf_dir):
    return _lexical_best(spark, sf_dir, Q.TOP_K).select("query_id", "doc_id", A.clean("page").alias("page"), F.round("score", 6).alias("score"), A.clean("rank").alias("rank"))


def r08_coverage(spark, sf_dir):
    queries = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode_outer(X.words("text")).alias("term"))
    return Q.coverage(queries, Q.vocabulary(_pages(spark, sf_dir))).select("query_id", F.round("coverage", 6).alias("coverage"))


def _vectors(spark, sf_dir):
    return A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _queries(spark, sf_dir):
    """Every twentieth document as a query with its whole text, and those of them that have a vector."""
    v = _vectors(spark, sf_dir).where("doc_id % 20 = 0")
    d = A.table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return d, v.select(F.col("doc_id").alias("query_id"), "vector")


def r10_r11_semantic_top(spark, sf_dir):
    _, q = _queries(spark, sf_dir)
    return Q.semantic_top(_vectors(spark, sf_dir), q, ["doc_id"], 50, A.kept).select("query_id", "doc_id", F.round("score", 6).alias("score"), A.clean("rank").alias("rank"))


def _hybrid_parts(spark, sf_dir):
    texts, vectors = _queries(spark, sf_dir)
    lex, sem, cover = Q.text_ranks(A.table(spark, sf_dir, "documents").select("doc_id", "text"), texts, _vectors(spark, sf_dir), vectors, ["doc_id"], A.kept)
    return A.kept(lex), A.kept(sem), cover


def r12_r14_hybrid_top(spark, sf_dir):
    """Queries without a vector degrade to lexical search."""
    return Q.hybrid(*_hybrid_parts(spark, sf_dir), ["doc_id"]).select("query_id", "doc_id", F.round("score", 6).alias("score"), A.clean("rank").alias("rank"), "mode")


def r12_rrf(spark, sf_dir):
    """The best by fused reciprocal ranks alone, of queries that have a vector."""
    lex, sem, cover = _hybrid_parts(spark, sf_dir)
    fused = Q.fuse([(lex.join(cover, "query_id"), F.col("coverage")), (sem, F.lit(1.0))], ["doc_id"]).join(sem.select("query_id").distinct(), "query_id", "left_semi")
    return Q.ranked(fused.withColumnRenamed("fused", "score"), ["doc_id"]).where(F.col("rank") <= Q.TOP_K).select("query_id", "doc_id", F.round("score", 8).alias("fused"), A.clean("rank").alias("rank"))


def r15_fallback(spark, sf_dir):
    """Documents that have no vector fall back to their first pages."""
    p = _pages(spark, sf_dir).withColumn("chunk_idx", F.lit(0))
    asked = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "doc_id")
    hits = _vectors(spark, sf_dir).select(F.col("doc_id").alias("query_id"))
    return Q.fallback(asked, hits, p, 4).select("query_id", A.clean("page").alias("page"), "score")


def r16_j09_vector_mismatches(spark, sf_dir):
    return Q.vector_mismatches(A.table(spark, sf_dir, "documents"), _vectors(spark, sf_dir), "doc_id")


def r17_hashed_vectors(spark, sf_dir):
    """Whole vectors, in millionths."""
    millionths = F.transform("vector", lambda x: F.floor(x * 1e6).cast("string"))
    return Q.hashed_vectors(A.table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.md5(F.array_join(millionths, ",")).alias("vector_md5"))


def r18_contexts(spark, sf_dir):
    hits = _lexical_best(spark, sf_dir, 4)
    asked = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    said = A.table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("query_id"), "text")
    balance = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_name").alias("text"))
    c = Q.request_contexts(asked, Q.contexts(hits, _pages(spark, sf_dir), KEYS), said, market=balance)
    return c.select("query_id", F.md5("context").alias("context_md5"))


def r19_reading_blocks(spark, sf_dir):
    """Orders as chart readings of their customers: those of one status are drawn, others sent."""
    o = A.table(spark, sf_dir, "orders")
    r = o.select(F.col("o_custkey").alias("query_id"), F.when(F.col("o_orderstatus") == "F", "drawn").otherwise("sent").alias("origin"), F.struct(F.col("o_orderpriority").alias("trend"), F.col("o_orderkey").alias("chart")).alias("reading"))
    return Q.reading_blocks(r).select("query_id", F.md5("block").alias("block_md5"))


def r20_asked_contexts(spark, sf_dir):
    """Each conversation's last turn as its question; conversations of an even number of turns have a report."""
    turns = A.table(spark, sf_dir, "conversations")
    asked = turns.groupBy("conv_id").agg(F.min("turn").alias("t"), F.count("*").alias("n"), F.max_by("role", "turn").alias("report"), F.max_by("text", "turn").alias("question"))
    asked = asked.select("conv_id", "question", F.when(F.col("n") % 2 == 0, F.col("report")).alias("report"), F.lit(" ").alias("hits"))
    return Q.asked_context(Q.conversation_context(turns), asked).select("conv_id", F.md5("context").alias("context_md5"))


def r20_conversation_context(spark, sf_dir):
    return Q.conversation_context(A.table(spark, sf_dir, "conversations")).select("conv_id", "turns", F.md5("context").alias("context_md5"))


def x01_fold(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.md5(X.fold("text")).alias("folded_md5"))


def x03_sentences(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.size(X.sentences("text")).cast("bigint").alias("n_sentences"), F.md5(F.array_join(X.sentences("text"), "|")).alias("sentences_md5"))


def x08_content_key(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", X.content_key("text", "lang", "source").alias("content_key"))


def x08_distinct_requests(spark, sf_dir):
    """Requests with equal keys are one."""
    d = A.table(spark, sf_dir, "documents").withColumn("key", X.content_key("text", "lang"))
    return d.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("requests")).drop("key")


def x08_reused_requests(spark, sf_dir):
    """Requests of one language are answered first, then all documents': the second run computes only new keys."""
    store = f"{A.shared_folder(spark)}/{uuid.uuid4().hex}"
    d = A.table(spark, sf_dir, "documents").select("doc_id", "lang", "text", X.content_key("text").alias("key"))
    answer = lambda r: r.select("key", F.size(X.words("text")).cast("bigint").alias("n_words"))
    reuse.compute_new(d.where("lang = 'en'"), answer, store, 0)
    return reuse.compute_new(d, answer, store, 1).select("doc_id", "n_words", A.clean("run").alias("run"))


def x09_p12_estimates(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", X.token_estimate("text").alias("tokens"), X.shorten(F.split_part("text", F.lit("\n"), F.lit(1)), 220).alias("head"))


QUERIES = {f.__name__: f for f in (r01_w11_page_budget, r02_chunks, r03_empty_documents, r04_document_stats, a08_text_by_page, r05_tokens, r06_tf_idf, r07_r09_lexical_top, r08_coverage, r10_r11_semantic_top, r12_r14_hybrid_top, r12_rrf, r15_fallback, r16_j09_vector_mismatches, r17_hashed_vectors, r18_contexts, r19_reading_blocks, r20_asked_contexts, r20_conversation_context, x01_fold, x03_sentences, x08_content_key, x08_distinct_requests, x08_reused_requests, x09_p12_estimates)}

_LINES = "raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents)"
_PAGES = _LINES + r""",
lines AS (SELECT * FROM (SELECT doc_id, page, trim(regexp_replace(line, '[\s\x0b]+', ' ', 'g')) AS text FROM raw) WHERE text <> '')"""
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_words = lambda t: f"list_filter(regexp_extract_all(strip_accents(lower({t})), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP}))"


def _terms(src: str, keys: str) -> str:
    return f"""(SELECT {keys}, unnest(w) AS term FROM (SELECT {keys}, {_words('text')} AS w FROM {src})
      UNION ALL SELECT {keys}, concat(w[i], ' ', w[i + 1]) FROM (SELECT {keys}, w, unnest(range(1, len(w))) AS i FROM (SELECT {keys}, {_words('text')} AS w FROM {src})))"""


def _weights(name: str, src: str, keys: str) -> str:
    return f"""{name} AS (SELECT {keys}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {keys})) AS weight FROM (
      SELECT {keys}, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w
      FROM (SELECT {keys}, term, count(*) AS tf FROM {_terms(src, keys)} GROUP BY ALL) JOIN dfs USING (term), total))"""


def _lexical(src: str, keys: str) -> str:
    return f"""total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {src}),
      dfs AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM (SELECT DISTINCT {keys}, term FROM {_terms(src, keys)}) GROUP BY term),
      {_weights('cw', src, keys)}, {_weights('qw', 'asked', 'query_id')},
      scores AS (SELECT query_id, {keys}, sum(cw.weight * qw.weight) AS score FROM cw JOIN qw USING (term) GROUP BY ALL),
      lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, {keys}) AS rank FROM scores)"""


_ASKED = "asked AS (SELECT item_id AS query_id, text FROM benchmark)"
_OWN = "asked AS (SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 20 = 0)"
_UNIT = "vectors AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / CASE WHEN nn = 0 THEN 1 ELSE nn END) AS v FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS nn FROM embeddings))"
_SEM = """sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM (
      SELECT q.doc_id AS query_id, c.doc_id, list_inner_product(c.v, q.v) AS score FROM vectors c, vectors q WHERE q.doc_id % 20 = 0))"""
_HYBRID = f"""{_OWN}, {_lexical('documents', 'doc_id')}, {_UNIT}, {_SEM},
      cover AS (SELECT query_id, coalesce(avg(CASE WHEN term IS NULL THEN NULL WHEN df IS NULL THEN 0.0 ELSE 1.0 END), 0) AS coverage
                FROM (SELECT DISTINCT query_id, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS term FROM (SELECT query_id, {_words('text')} AS w FROM asked)) LEFT JOIN dfs USING (term) GROUP BY query_id),
      fused AS (SELECT query_id, doc_id, sum(part) AS fused FROM (SELECT query_id, doc_id, coverage / (60 + rank) AS part FROM lex JOIN cover USING (query_id)
                UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank) FROM sem) GROUP BY ALL)"""

# A chunk is a range of a line's words, s to e; ends[i] are the characters of its first i words with a space each. It ends with the last
# word that fits, and the next begins with the words before its end that fit the overlap, unless its first new word then doesn't fit.
_CHUNKS = f"""RECURSIVE {_PAGES},
lists AS (SELECT doc_id, page, w, list_transform(range(1, len(w) + 1), lambda i: list_sum(list_transform(w[1:i], lambda x: length(x) + 1))::BIGINT) AS ends FROM (SELECT doc_id, page, string_split(text, ' ') AS w FROM lines)),
spans AS (
  SELECT doc_id, page, 0::BIGINT AS chunk_idx, 1::BIGINT AS s, greatest(1, len(list_filter(ends, lambda x: x <= {X.CHUNK_CHARS} + 1)))::BIGINT AS e FROM lists
  UNION ALL
  SELECT doc_id, page, chunk_idx + 1, s, greatest(f, len(list_filter(ends, lambda x: x <= {X.CHUNK_CHARS} + 1 + coalesce(ends[s - 1], 0))))::BIGINT FROM (
    SELECT doc_id, page, chunk_idx, ends, f, CASE WHEN tail > 0 AND ends[f] - 1 - coalesce(ends[f - 1 - tail], 0) <= {X.CHUNK_CHARS} THEN f - tail ELSE f END AS s FROM (
      SELECT doc_id, page, chunk_idx, ends, e + 1 AS f, len(list_filter(range(s, e + 1), lambda j: ends[e] - coalesce(ends[j - 1], 0) <= {X.OVERLAP_CHARS}))::BIGINT AS tail
      FROM spans JOIN lists USING (doc_id, page) WHERE e < len(w)))),
chunks AS (SELECT doc_id, page, chunk_idx, array_to_string(w[s:e], ' ') AS text FROM spans JOIN lists USING (doc_id, page))"""

ORACLE_SQL = {
    "r02_chunks": f"WITH {_CHUNKS} SELECT * FROM chunks",
    "r04_document_stats": f"WITH {_CHUNKS} SELECT doc_id, pages, truncated, chunks FROM (SELECT doc_id, count(*) AS pages, false AS truncated FROM lines GROUP BY 1) JOIN (SELECT doc_id, count(*) AS chunks FROM chunks GROUP BY 1) USING (doc_id)",
    # CRC-32 (its polynomial, reflected): eight shifts a byte
    "r17_hashed_vectors": """WITH words AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')) AS w FROM documents),
      hashed AS (SELECT w, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(w, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, bit: xor(r >> 1, 3988292384 * (r & 1))))) AS h FROM (SELECT DISTINCT w FROM words)),
      cells AS (SELECT doc_id, h % 256 AS d, sum(CASE WHEN (h >> 8) % 2 = 1 THEN 1.0::DOUBLE ELSE -1 END) AS x FROM words JOIN hashed USING (w) GROUP BY ALL),
      norms AS (SELECT doc_id, sqrt(sum(x * x)) AS nn FROM cells GROUP BY 1)
      SELECT doc_id, md5(string_agg(CAST(floor(coalesce(x, 0) / CASE WHEN coalesce(nn, 0) = 0 THEN 1 ELSE nn END * 1e6) AS BIGINT), ',' ORDER BY d)) AS vector_md5
      FROM (SELECT doc_id, unnest(range(256)) AS d FROM documents) LEFT JOIN cells USING (doc_id, d) LEFT JOIN norms USING (doc_id) GROUP BY doc_id""",
    "r01_w11_page_budget": "WITH " + _LINES + r""",
      p AS (SELECT doc_id, page, trim(regexp_replace(line, '[\s\x0b]+', ' ', 'g')) AS text FROM raw),
      b AS (SELECT *, greatest(0, 2000 - coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rest FROM p)
      SELECT doc_id, page, md5(left(text, CAST(rest AS INT))) AS text_md5, length(text) > rest AS truncated FROM b WHERE left(text, CAST(rest AS INT)) <> ''""",
    "r03_empty_documents": f"WITH {_PAGES} SELECT doc_id FROM (SELECT doc_id FROM documents UNION ALL SELECT -page_id - 1 FROM pages) WHERE doc_id NOT IN (SELECT doc_id FROM lines)",
    "a08_text_by_page": f"WITH {_PAGES} SELECT doc_id, md5(string_agg(text, ' ' ORDER BY page)) AS text_md5 FROM lines GROUP BY 1",
    "r05_tokens": f"SELECT doc_id, len({_words('text')}) AS n_words, md5(array_to_string({_words('text')}, ' ')) AS words_md5 FROM documents",
    "r06_tf_idf": f"""WITH {_PAGES}, c AS (SELECT doc_id, page, term, count(*) AS tf FROM {_terms('lines', 'doc_id, page')} GROUP BY ALL),
      w AS (SELECT doc_id, page, term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + count(*) OVER (PARTITION BY doc_id, term))) + 1) AS w FROM c JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1) USING (doc_id))
      SELECT doc_id, page, count(*) AS terms, round(sum(w) / sqrt(sum(w * w)), 6) AS total, round(max(w) / sqrt(sum(w * w)), 6) AS top FROM w GROUP BY 1, 2""",
    "r07_r09_lexical_top": f"WITH {_PAGES}, {_ASKED}, {_lexical('lines', 'doc_id, page')} SELECT query_id, doc_id, page, round(score, 6) AS score, rank FROM lex WHERE rank <= 8",
    "r08_coverage": f"""WITH {_PAGES}, {_ASKED}, dfs AS (SELECT DISTINCT term FROM {_terms('lines', 'doc_id, page')})
      SELECT query_id, round(avg(CASE WHEN d.term IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage FROM (SELECT DISTINCT query_id, unnest({_words('text')}) AS term FROM asked) a LEFT JOIN dfs d USING (term) GROUP BY 1""",
    "r10_r11_semantic_top": f"WITH {_UNIT}, {_SEM} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM sem WHERE rank <= 50",
    "r12_rrf": f"""WITH {_HYBRID} SELECT query_id, doc_id, round(fused, 8) AS fused, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, doc_id) AS rank FROM fused WHERE query_id IN (SELECT query_id FROM sem)) WHERE rank <= 8""",
    "r12_r14_hybrid_top": f"""WITH {_HYBRID}, c AS (SELECT f.query_id, f.doc_id, CASE WHEN h.query_id IS NOT NULL THEN fused ELSE lex.score END AS score, CASE WHEN h.query_id IS NOT NULL THEN 'hybrid' ELSE 'lexical' END AS mode,
        coalesce(sem.rank <= 3, false) AS reserved FROM fused f LEFT JOIN lex USING (query_id, doc_id) LEFT JOIN sem USING (query_id, doc_id) LEFT JOIN (SELECT DISTINCT query_id FROM sem) h ON h.query_id = f.query_id),
      k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reserved DESC, round(score, 12) DESC, doc_id) AS nth FROM c)
      SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank, mode FROM k WHERE nth <= 8""",
    "r15_fallback": f"""WITH {_PAGES} SELECT doc_id AS query_id, page, 0.0::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS nth FROM lines)
      WHERE nth <= 4 AND doc_id NOT IN (SELECT vec_id FROM embeddings)""",
    "r16_j09_vector_mismatches": "SELECT doc_id, 'vector' AS missing FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'chunk' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)",
    "r18_contexts": f"""WITH {_PAGES}, {_ASKED}, {_lexical('lines', 'doc_id, page')},
      found AS (SELECT query_id, string_agg(concat('[document p.', page, '] ', text), chr(10) ORDER BY rank) AS t FROM lex JOIN lines USING (doc_id, page) WHERE rank <= 4 GROUP BY 1)
      SELECT item_id AS query_id, md5(concat('Document:', chr(10), coalesce(t, '(none)'), chr(10), chr(10), 'Transcript:', chr(10), coalesce(left(d.text, 8000), '(none)'),
        CASE WHEN s_name IS NOT NULL THEN concat(chr(10), chr(10), 'Market:', chr(10), s_name) ELSE '' END)) AS context_md5
      FROM benchmark b LEFT JOIN found f ON f.query_id = item_id LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d ON d.doc_id = item_id LEFT JOIN supplier ON s_suppkey = item_id""",
    "r19_reading_blocks": """SELECT o_custkey AS query_id, md5(concat(string_agg(line, chr(10) ORDER BY nth, line), CASE WHEN count(*) > 1 THEN concat(chr(10), 'The charts may show different periods.') ELSE '' END)) AS block_md5
      FROM (SELECT o_custkey, o_orderstatus <> 'F' AS nth, concat(CASE WHEN o_orderstatus = 'F' THEN 'Chart drawn from market data' ELSE 'Chart sent with the request' END, ': {"trend":"', o_orderpriority, '","chart":', o_orderkey, '}') AS line FROM orders) GROUP BY 1""",
    "r20_asked_contexts": """SELECT conv_id, md5(concat(string_agg(concat(role, ': ', coalesce(text, '(none)')), chr(10) ORDER BY turn), chr(10), 'Report: ', CASE WHEN count(*) % 2 = 0 THEN arg_max(role, turn) ELSE '(none)' END, chr(10),
      'Found: (none)', chr(10), 'Question: ', coalesce(nullif(trim(arg_max(text, turn)), ''), '(none)'))) AS context_md5 FROM conversations GROUP BY 1""",
    "x08_content_key": "SELECT doc_id, sha256(" + " || ".join(f"unhex(printf('%016X', octet_length(encode(coalesce({c}, ''))))) || encode(coalesce({c}, ''))" for c in ("text", "lang", "source")) + ") AS content_key FROM documents",
    "r20_conversation_context": "SELECT conv_id, count(*) AS turns, md5(string_agg(concat(role, ': ', coalesce(text, '(none)')), chr(10) ORDER BY turn)) AS context_md5 FROM conversations GROUP BY 1",
    "x01_fold": "SELECT doc_id, md5(strip_accents(lower(text))) AS folded_md5 FROM documents",
    "x03_sentences": r"""SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (
      SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?;])\s+', concat('\1', chr(10)), 'g'), '\n+'), lambda x: trim(x) <> '') AS s FROM documents)""",
    "x08_reused_requests": f"SELECT doc_id, len({_words('text')}) AS n_words, CAST(CASE WHEN text IN (SELECT text FROM documents WHERE lang = 'en') THEN 0 ELSE 1 END AS BIGINT) AS run FROM documents",
    "x08_distinct_requests": "SELECT min(doc_id) AS doc_id, count(*) AS requests FROM documents GROUP BY text, lang",
    "x09_p12_estimates": "SELECT doc_id, greatest(1, length(text) // 4) AS tokens, CASE WHEN length(split_part(text, chr(10), 1)) > 220 THEN concat(rtrim(left(split_part(text, chr(10), 1), 219)), '…') ELSE split_part(text, chr(10), 1) END AS head FROM documents",
}
