import itertools
import math
import random
import re
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from finevidence.functions import numbers as N
from finevidence.functions import text as X
from finevidence.operators import chart_claims, compliance, figures, filings, retrieval, routing, runs
from finevidence.sources import adapters
from finevidence.plans.evidence import PHRASES
from finevidence.sources import payloads
from finevidence.streaming import steps


@pytest.mark.parametrize("token, want", [("1.234", {(1234, 3), (1234, 0)}), ("12.300", {(12300, 0)}), ("3 200", {(3200, 0)}), ("1.234,56", {(123456, 2)}), ("1,234.5", {(12345, 1)}), ("1.234.567", {(1234567, 0)}), ("0.123", {(123, 3)}), ("7", {(7, 0)})])
def test_readings(token, want):
    assert set(N.readings(token)) == want


def check(spark, value, page, location="p.3", origin="document"):
    f = spark.createDataFrame([("d", "r", 0, "Sales", value, [(origin, location)])], "doc_id string, report_id string, ord int, name string, value string, citations array<struct<origin:string,location:string>>")
    p = spark.createDataFrame([("d", 3, page)], "doc_id string, page int, text string")
    return figures.check_figures(f, p).collect()[0]


@pytest.mark.parametrize("value, page, status", [
    ("10.700 millones", "Revenue of €10.7 billion in 2025", "verified"), ("$417 bn", "Total 416.161 bn", "not_found"), ("39.8 bn", "Amounts in millions: 39,864", "verified"),
    ("2.4 bn", "It was 2.3 bn", "not_found"), ("12,5 %", "margin of 12.5 %", "verified"), ("12.5 %", "12.5 stores", "not_found"), ("2024", "In 2024", "no_source"),
    ("n/a", "text", "no_source"), ("1.234 and 77", "1.234 then 77", "verified"), ("1.234 and 78", "1.234 then 77", "not_found"), ("12 300", "col 12 300 end", "verified"),
])
def test_figures(spark, value, page, status):
    assert check(spark, value, page).status == status


def test_figure_citations(spark):
    assert check(spark, "1.234", "1.234", "pp. 2-4").page == 3
    assert check(spark, "1.234", "1.234", "p.9").status == "not_found"
    assert check(spark, "1.234", "1.234", "p.abc").status == "not_found"
    assert check(spark, "1.234", "1.234", "").status == "no_source"
    assert check(spark, "1.234", "1.234", "x", "chart").status == "no_source"


def test_filing_figures(spark):
    f = spark.createDataFrame([("d", 7, "r", 0, "Sales", "$416.2 bn", [("sec", "")]), ("d", 7, "r", 1, "Sales", "$417 bn", [("sec", "")])], "doc_id string, cik bigint, report_id string, ord int, name string, value string, citations array<struct<origin:string,location:string>>")
    facts = spark.createDataFrame([(7, 0, "Revenue", 2025, 416161000000.0, "USD")], "cik bigint, nth int, label string, fy int, value double, unit string")
    pages = spark.createDataFrame([], "doc_id string, page int, text string")
    got = {r.ord: (r.status, r.source) for r in figures.check_figures(f, pages, facts).collect()}
    assert got == {0: ("verified", "sec"), 1: ("not_found", None)}


@pytest.mark.parametrize("text, flagged", PHRASES)
def test_compliance(spark, text, flagged):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert (compliance.clean(df, ["id"]).collect()[0].removed > 0) == flagged


def test_clean_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "Sales rose.  You should buy now. Margins fell."), (2, "  Quiet  text\n"), (3, "Strong buy."), (4, None)], "id int, text string")
    got = {r.id: r.clean for r in compliance.clean(df, ["id"]).collect()}
    assert got == {1: "Sales rose. Margins fell.", 2: "  Quiet  text\n", 3: compliance.NOTICE, 4: None}


def test_chart_claims(spark):
    texts = ["Soporte en 58.000 - 60.000 y precio de 63k. RSI 14 en 55. Sube 3 %. 12 velas. El 2026-04-06 cae.", "Volumen: 120K y 100K", "Soporte 10,5 a 11 y 12 - 13,25 - 14. Precio 99", "En mayo de 2024 cierra en 2024,5", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in chart_claims.price_claims(df, ["id"]).orderBy("id", "nth").collect():
        got.setdefault(r.id, []).append((r.kind, r.zone, r.token, list(r["values"])))
    assert [x[:2] for x in got[0]] == [("level", True), ("level", False)] and 1 not in got and 4 not in got
    assert got[0][0][2:] == ("58.000 - 60.000", [58000.0, 60000.0]) and got[0][1][3] == [63000.0]
    assert got[2] == [("level", True, "10,5 - 11", [10.5, 11.0]), ("level", True, "12 - 13,25", [12.0, 13.25]), ("level", False, "14", [14.0]), ("price", False, "99", [99.0])]
    assert got[3] == [("price", False, "2024,5", [2024.5])]


def test_fold(spark):
    import unicodedata

    text = "ğ ọ ά ﬁ ² Ǆ … É İ 한국 ½ Ａ 𝐀 o\u0301 ẛ̣ plain ø"
    want = "".join(c for c in unicodedata.normalize("NFKD", text.replace("한국", "").lower()) if not unicodedata.combining(c))
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    assert [r.f and r.f.replace("한국", "") for r in df.select(X.fold("text").alias("f")).collect()] == [want, None, ""]
    hidden = spark.createDataFrame([(1, "Ｓtrong ｂuy."), (2, "You should buy this ﬁne stock. Sales rose.")], "id int, text string")
    assert {r.id: r.clean for r in compliance.clean(hidden, ["id"]).collect()} == {1: compliance.NOTICE, 2: "Sales rose."}


def test_filings(spark):
    rows = [(1, "Assets", 0, None, "2024-12-31", 100.0, "10-K", "FY", "2025-02-01"), (1, "Assets", 1, None, "2024-12-31", 101.0, "10-K", "FY", "2025-02-01"), (1, "Assets", 2, None, "2025-01-31", 90.0, "10-K", "FY", "2025-03-01"),
            (1, "NetIncomeLoss", 0, "2024-01-01", "2024-03-31", 5.0, "10-K", "FY", "2025-02-01"), (1, "Assets", 3, None, "bad", 1.0, "10-K", "FY", "2025-03-01")]
    e = spark.createDataFrame(rows, "cik long, tag string, pos int, start string, end string, val double, form string, fp string, filed string")
    got = [(r.concept, str(r.end), r.fy, r.val) for r in filings.annual_facts(e, filings.concept_table(spark)).orderBy("end").collect()]
    assert got == [("assets", "2024-12-31", 2024, 101.0), ("assets", "2025-01-31", 2024, 90.0)]


def test_routing(spark):
    t = spark.createDataFrame([(x,) for x in ("btc", "accion:btc", "BTC-USD", "ITX.MC", "-USD", "met", "hype", "", "cripto:x")], "raw string")
    filers = spark.createDataFrame([("MET", 5)], "symbol string, cik long")
    perps = spark.createDataFrame([("HYPE",), ("MET",)], "symbol string")
    got = {r.raw: (r.symbol, r.market) for r in routing.route(t, filers, perps).collect()}
    assert got == {"btc": ("BTC", "crypto"), "accion:btc": ("BTC", "equity"), "BTC-USD": ("BTC", "crypto"), "ITX.MC": ("ITX.MC", "equity"), "-USD": ("-USD", "equity"), "met": ("MET", "equity"), "hype": ("HYPE", "crypto"), "": ("", None), "cripto:x": ("X", "crypto")}
    assert {r.market for r in routing.route(t.where("raw = 'hype'")).collect()} == {"equity"}


def test_payloads(spark):
    ctx = spark.createDataFrame([('[{"universe":[{"name":"btc"},{"name":"eth"}]},[{"funding":"0.0001","openInterest":"2","markPx":"10","oraclePx":"9","dayNtlVlm":"5","prevDayPx":"8"},{"funding":null,"openInterest":"2","markPx":"10","oraclePx":"9","dayNtlVlm":"5","prevDayPx":"8"}]]',)], "body string")
    r = payloads.perp_contexts(ctx).collect()
    assert len(r) == 1 and r[0].symbol == "BTC" and r[0].funding_annual == pytest.approx(0.876)
    bad = spark.createDataFrame([(1, '{"chart":{"result":null,"error":{"code":"Not Found","description":"x"}}}'), (2, "{}"), (3, '{"chart":{"result":[{"meta":{"symbol":"A","x":"y"},"timestamp":[1,2],"indicators":{"quote":[{"open":[1,null],"high":[1,1],"low":[1,1],"close":[1,1],"volume":[null,2]}]}}]}}')], "id int, body string")
    bars, meta, rejected = payloads.equity_bars(bad)
    assert [(b.symbol, b.v) for b in bars.collect()] == [("A", 0.0)] and {r.id: r.reason for r in rejected.collect()} == {1: "unknown symbol", 2: "no data"}
    assert meta.collect()[0].meta == {"symbol": "A"}


def test_words_and_chunks():
    text = " ".join(f"word{i}" for i in range(400))
    parts = X.pack_words(text)
    assert all(len(p) <= 1000 for p in parts) and parts[0].split()[-1] in parts[1].split() and X.pack_words("") == []
    assert X.pack_words("a " + "x" * 2000 + " b")[1] == "x" * 2000
    assert {w for p in parts for w in p.split()} == set(text.split())


def test_rank_fusion_and_coverage(spark):
    ranks = lambda order: spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(order)], "query_id int, doc_id int, rank int")
    fused = {r.doc_id: r.fused for r in retrieval.fuse([(ranks([0, 1, 2]), F.lit(1.0)), (ranks([2, 0]), F.lit(1.0))], ["doc_id"]).collect()}
    assert fused[0] == pytest.approx(1 / 61 + 1 / 62)
    q = spark.createDataFrame([(1, "ventas y margen de gross")], "query_id int, text string").select("query_id", F.explode(X.words("text")).alias("term"))
    vocabulary = spark.createDataFrame([("gross",), ("revenue",)], "term string")
    assert retrieval.coverage(q, vocabulary).collect()[0].coverage == pytest.approx(1 / 3)


def test_fold_of_events_ignores_order():
    e = ([3, 1, 2], ["a", "a", "b"], ["end", "start", "start"], [3, 1, 2])
    want = steps.fold({}, *e)
    assert want == steps.fold(steps.fold({}, *(x[1:] for x in e)), *(x[:1] for x in e)) and want["a"][2] == "end"


def test_long_conversations_stay_whole(spark):
    from finevidence.operators import retrieval

    rows = [(1, k, "user", f"turn {k} " + "x" * 500) for k in range(40)]
    got = retrieval.conversation_context(spark.createDataFrame(rows[::-1], "conv_id long, turn int, role string, text string")).first()
    assert got.turns == 40 and got.context == "\n".join(f"{r}: {t}" for _, _, r, t in rows)


def test_replay_of_a_folder_of_files(spark, tmp_path):
    """Several files, in order and with late, repeated and silent events."""
    import datetime as dt

    at = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    rows = [[(2, at(0), 1, "load", 1.0, "{}"), (4, at(0), 2, "load", 1.0, "{}")], [(3, at(0.5), 1, "load", 1.0, "{}"), (2, at(0), 1, "load", 1.0, "{}")], [(6, at(9), 3, "load", 1.0, "{}")], [(12, at(9.05), 4, "load", 1.0, "{}")], [(8, at(1), 2, "rank", 1.0, "{}"), (10, at(9.1), 3, "rank", 1.0, "{}")]]
    for name, batch in (("one", 1000), ("each", 1)):
        for i, part in enumerate(rows):
            df = spark.createDataFrame(part, steps.EVENTS).coalesce(1)
            df.write.mode("append").parquet(f"{tmp_path}/{name}/events.parquet")
        got = {r.run_id: (r.events, r.running, r.done) for r in steps.replay(spark, f"{tmp_path}/{name}", f"file://{tmp_path}/{name}-out", files_a_batch=batch).collect()}
        late = (1, "load", "") if batch == 1 else (2, "load,rank", "")  # eight hours behind the watermark of the batch before last
        assert got == {1: (2, "", "load"), 2: late, 3: (2, "load,rank", ""), 4: (1, "load", "")}, name
    stuck = steps.replay(spark, f"{tmp_path}/each", f"file://{tmp_path}/stuck", silence_ms=3_600_000, files_a_batch=1)
    assert {r.run_id for r in stuck.collect()} == {1, 2, 3, 4}


@pytest.mark.parametrize("most", [3, 1000])
def test_candidate_ranks_equal_whole_rankings(spark, monkeypatch, most):
    """Repeated vectors and terms make ties; small slices split the queries."""
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", most)
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 4 * most)
    monkeypatch.setattr(retrieval, "RRF_K", 2)
    k, keys = 2, ["doc_id"]
    cell = lambda i, j: float((i * i * 7 + i * j * 3 + j * j) % 11 - 5)
    w = spark.createDataFrame([(i, f"t{j}", abs(cell(i, j)) / 10) for i in range(60) for j in range(5) if (i + j) % 3], "doc_id long, term string, weight double")
    v = spark.createDataFrame([(i, [cell(i % 50, j) for j in range(4)]) for i in range(60)], "doc_id long, vector array<double>")
    qw = spark.createDataFrame([(i, f"t{j}", cell(i + 1, j) ** 2 / 100 + 0.01) for i in range(8) for j in range(5) if (i + j) % 2], "query_id long, term string, weight double")
    qv = spark.createDataFrame([(i, [cell(i, j + 1) for j in range(4)]) for i in range(0, 8, 2)], "query_id long, vector array<double>")
    cover = qw.select("query_id").distinct().withColumn("coverage", (1 + F.col("query_id")) / 10)
    few = retrieval.candidate_ranks(w, qw, v, qv, keys, adapters.kept, k)
    whole = retrieval.lexical(w, qw, keys), retrieval.semantic(v, qv, keys)
    rows = lambda df: sorted((r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in df.collect())
    for a, b in zip(few, whole):
        got = rows(a)
        assert got and set(got) <= set(rows(b))
    assert rows(few[1]) != rows(whole[1])  # some are left out
    assert rows(retrieval.hybrid(*few, cover, keys, k, 1)) == rows(retrieval.hybrid(*whole, cover, keys, k, 1))


def test_costs_by_modality(spark):
    schema = "run_id long, step string, modality string, chars long, seconds double, tokens_in long, tokens_out long, cost_usd double"
    rows = [(1, "a", "speech", 2_000_000, 1.0, 0, 0, None), (1, "b", "image", None, 1.0, 0, 0, None), (1, "c", "speech_to_text", None, 120.0, 0, 0, None), (1, "d", None, None, 1.0, 1_000_000, 0, None), (1, "e", "speech", 5, 1.0, 0, 0, 0.5)]
    got = {r.step: (r.cost, r.cost_real) for r in runs.with_cost(spark.createDataFrame(rows, schema), runs.tariff(spark, tts_mchar=10.0)).collect()}
    assert got == {"a": (20.0, False), "b": (0.04, False), "c": (pytest.approx(0.012), False), "d": (3.0, False), "e": (0.5, True)}


def test_notices_of_reports_and_outputs(spark):
    bad, good = "You should buy this stock now.", "Sales rose."
    f = spark.createDataFrame([(1, "summary", 1, f"{good} {bad}"), (1, "figure", 2, bad), (2, "summary", 1, good), (2, "limitation", 2, None)], "report_id int, kind string, ord int, text string")
    got = {r.report_id: r for r in compliance.sanitise_report(f).collect()}
    assert got[1].fields == f"{good}\n{compliance.REPORT_NOTICE}" and got[1].dropped == 1 and got[1].blocked
    assert got[2].fields == good and not got[2].blocked
    out = spark.createDataFrame([(1, "speech", good), (2, "speech", bad), (3, "image", good), (4, "image", bad), (5, "answer", bad)], "id int, kind string, text string")
    shown = {r.id: r.shown for r in compliance.gate(out).collect()}
    assert shown == {1: f"{good} {compliance.SPOKEN}", 2: None, 3: good, 4: None, 5: f"{compliance.NOTICE}\n\n{compliance.DISCLAIMER}"}


@pytest.mark.parametrize("chunks, queries", [(7, 3), (4096, 1024)])
def test_blocks_of_rankings_do_not_matter(spark, monkeypatch, chunks, queries):
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", chunks)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", queries)
    test_candidate_ranks_equal_whole_rankings(spark, monkeypatch, 1000)
    vectors = spark.createDataFrame([(i, [float(i % 7 - 3), float(i % 5 - 2)][: 1 + (i % 3 > 0)] if i % 11 else None) for i in range(80)], "doc_id long, vector array<double>")
    asked = vectors.where("doc_id % 9 = 0").selectExpr("doc_id AS query_id", "vector")
    whole = retrieval.semantic(vectors, asked, ["doc_id"]).where("rank <= 5")
    rows = lambda df: sorted((r.query_id, r.doc_id, round(r.score, 9), r["rank"]) for r in df.collect())
    assert rows(retrieval.semantic_top(vectors, asked, ["doc_id"], 5, adapters.kept)) == rows(whole) != []
    assert rows(retrieval.semantic_top(vectors.limit(0), asked, ["doc_id"], 5, adapters.kept)) == rows(retrieval.semantic_top(vectors, asked.limit(0), ["doc_id"], 5, adapters.kept)) == []


def test_lexical_top_scores_few_chunks(spark):
    """Common terms stand in all chunks, each query has some rare ones; copies and ties."""
    r = random.Random(2)
    rows = []
    for i in range(3000):
        rows += [(i, w) for w in [f"c{j}" for j in range(8)] + [f"r{r.randint(0, 400)}" for _ in range(r.choice([0, 3, 3]))]]
    texts = spark.createDataFrame([(i, " ".join(w for _, w in g)) for i, g in itertools.groupby(rows, lambda x: x[0])], "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"c0 c1 c2 c3 r{i} r{i + 1} r{2 * i}") for i in range(30)] + [(90, "nothing"), (91, "c1 c2")], "query_id long, text string")
    counts = retrieval.term_counts(texts, ["doc_id"])
    df, n = counts.groupBy("term").agg(F.count("*").alias("df")), texts.agg(F.count("*").alias("n"))
    cw, qw = adapters.kept(retrieval.tf_idf(counts, n, df, ["doc_id"], [])), adapters.kept(retrieval.tf_idf(retrieval.term_counts(queries, ["query_id"]), n, df, ["query_id"], []))
    seen = lambda d: sorted((x.query_id, x.doc_id, round(x.score, 9), x["rank"]) for x in d.collect())
    whole = retrieval.lexical(cw, qw, ["doc_id"])
    assert seen(retrieval.lexical_top(cw, qw, ["doc_id"], 5, adapters.kept)) == seen(whole.where("rank <= 5"))
    rare = qw.where("query_id < 90")
    pairs, _ = retrieval.lexical_pairs(cw, rare, ["doc_id"], 5, adapters.kept)
    assert pairs.count() < 0.05 * 30 * 3000 and whole.where("query_id < 90").count() > 0.9 * 30 * 3000  # chunks with a shared term
    assert retrieval.lexical_top(cw.limit(0), qw, ["doc_id"], 5, adapters.kept).count() == 0


def test_hashed_vectors_equal_brute_force(spark):
    texts = [(1, "Net sales rose 12 % and net margin fell"), (2, None), (3, ""), (4, "!!!"), (5, "ÉTÉ été ete " + "long words " * 3000), (6, "ventas netas"), (7, "ventas netas")]
    got = {r["k"]: r["vector"] for r in retrieval.hashed_vectors(spark.createDataFrame(texts, "k long, text string"), "k", 16).collect()}
    for k, text in texts:
        want = [0.0] * 16
        plain = "".join(c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.combining(c))
        for w in re.findall("[a-z0-9]+", plain):
            h = zlib.crc32(w.encode())
            want[h % 16] += 1.0 if (h >> 8) % 2 else -1.0
        norm = math.sqrt(sum(x * x for x in want))
        assert got[k] == pytest.approx([x / (norm or 1.0) for x in want], abs=1e-12)
    assert set(got) == {k for k, _ in texts}
    assert retrieval.hashed_vectors(spark.createDataFrame([], "k long, text string"), "k").count() == 0


def test_vectors_of_unit_length(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, []), (4, None)], "k long, vector array<float>")
    got = {r["k"]: r["v"] for r in rows.select("k", retrieval.unit("vector").alias("v")).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: [], 4: None}
