"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finevidence.llm import ann, bpe, exact_dedup, html_text, lexical, licenses, line_dedup, near_dedup, packing, pii, quality, toxicity, vector_codes
from finevidence.llm.common import table


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digests(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.kept_digests(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(table(spark, sf_dir, "embeddings"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (op1_bpe_roundtrip, op2_pii, op3_near_dedup, op4_toxicity, op5_nearest_neighbours, op6_license_scan, op7_quality, op8_best_fit_packing, op9_exact_dedup, op10_line_dedup, op11_lexical_search, op12_vector_codes, op13_html_text)
}

def _vector_codes_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """Plain rounds over all pairs of a part and an entry."""
    nearest = """
        a{r} AS MATERIALIZED (
            SELECT vec_id, part, entry, away FROM (
                SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS away,
                       row_number() OVER (PARTITION BY c.vec_id, c.part ORDER BY away, b.entry) AS nth
                FROM comp c JOIN b{r} b USING (part, place) GROUP BY c.vec_id, c.part, b.entry)
            WHERE nth = 1)"""
    replaced = """
        b{s} AS MATERIALIZED (
            SELECT b.part, b.entry, b.place, CAST(coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, b.x) AS BIGINT) AS x
            FROM b{r} b LEFT JOIN (
                SELECT part, entry, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
                FROM comp JOIN a{r} USING (vec_id, part) GROUP BY part, entry, place) m USING (part, entry, place))"""
    steps = ",".join(nearest.format(r=r) + "," + replaced.format(r=r, s=r + 1) for r in range(rounds))
    return f"""
        WITH kept AS (
            SELECT vec_id, label, embedding FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        comp AS MATERIALIZED (
            SELECT vec_id, (j - 1) // (n // 8) AS part, (j - 1) % (n // 8) AS place, CAST(floor(4096 * CAST(y AS DOUBLE)) AS BIGINT) AS x
            FROM (SELECT vec_id, len(embedding) AS n, unnest(embedding) AS y, generate_subscripts(embedding, 1) AS j FROM kept)),
        b0 AS MATERIALIZED (
            SELECT part, entry, place, x
            FROM comp JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 16) USING (vec_id)),
        {steps},
        {nearest.format(r=rounds)},
        books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b{rounds}),
        coded AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(away) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM coded JOIN kept USING (vec_id), books
    """


ORACLE_SQL = {
    "op12_vector_codes": _vector_codes_sql(),
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op10_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
            FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines),
        marked AS (
            SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS gone
            FROM keyed)
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op11_lexical_search": r"""
        WITH found AS (
            SELECT doc_id, row_number() OVER () AS row_no,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        docs AS (SELECT *, len(terms) AS n FROM found WHERE len(terms) > 0),
        facts AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
        asked AS (
            SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        counts AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(terms) AS term FROM docs) GROUP BY ALL),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM counts, facts GROUP BY term),
        scored AS (
            SELECT a.item_id, d.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM asked a JOIN counts c USING (term) JOIN weights USING (term) JOIN docs d USING (row_no), facts
            GROUP BY a.item_id, d.row_no, d.doc_id),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank
            FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
}
