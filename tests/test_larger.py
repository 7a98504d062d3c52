"""Joins, shuffles and rounding that only larger tables show."""

import random
from re import _parser

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from finevidence.functions import text as X
from finevidence.operators import compliance, retrieval
from finevidence.plans import contexts, evidence, market, search
from finevidence.sources import files, landing, payloads
from finevidence.streaming import steps
from tests.test_streams import land


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_halves_round_as_in_sql(spark):
    """Halves in double arithmetic, with the sign of what rounds to zero: what the SQL of p11_price_formats does."""
    prices = [49.5, 50.0, 16050.5, 31650.5, 51495.0, 105505.0, 0.0, 0.5, 3.0, 850.25, 123456.5, 1e12]
    values = [s * v / d for v in prices for s in (1, -1) for d in (1.0, 1e3, 1e4, 1e6)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("r", X.half_away(F.col("v"), 6)).select("i", "r", X.price_text(F.col("r")).alias("p"), X.percent_text(F.col("r")).alias("s")).orderBy("i").collect()
    sql = """SELECT r, CASE WHEN abs(r) >= 1000 THEN format('{:,.0f}', r) WHEN abs(r) >= 1 THEN format('{:,.2f}', r) ELSE format('{:,.4f}', r) END, format('{:,.2f}', r * 100) || '%'
      FROM (SELECT i, round(v, 6) AS r FROM (SELECT unnest(range(len(?))) AS i, unnest(?) AS v)) ORDER BY i"""
    assert [(str(x.r), x.p, x.s) for x in got] == [(str(r), p, s) for r, p, s in duckdb.execute(sql, [values, values]).fetchall()]
    assert spark.range(1).select(X.half_away(F.lit(None).cast("double"), 6).alias("r")).collect()[0].r is None


def test_checked_figures_are_not_broadcast(spark, sf_dir):
    """Joins of figures with pages stay joins of two large tables, whatever the size that is guessed from files."""
    for query in (evidence.g14_check_figures, evidence.a09_verification_summary, evidence.a09_verified_by_origin, evidence.g16_top_cards):
        assert "BroadcastHashJoin" not in plan(query(spark, sf_dir))


def test_states_from_step_updates(spark, tmp_path):
    """A run's last state from updates of its steps, in several batches, with late, repeated and nameless events; no Python in the stream."""
    folder, base, seen = f"{tmp_path}/landed", f"file://{tmp_path}/out", []

    def updates_of(raw):
        out = steps.step_updates(steps.step_events(raw, "10 hours"))
        seen.append((out._jdf.queryExecution().analyzed().toString(), spark.conf.get("spark.sql.shuffle.partitions")))
        return out

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    for rows in ([(0, 2, 1, "load"), (4, 3, 2, None)], [(3, 4, 1, "load"), (5, 1, 1, "error"), (0, 2, 1, "load")], [(6, 3, 1, "load"), (9, 5, 2, "rank")]):
        land(spark, folder, rows)
        updates = steps.run_updates(spark, folder, base, updates_of)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {r.run_id: (r.events, sorted((s.step, s.first // 3_600_000_000 % 24, s.at // 3_600_000_000 % 24, s.event_id, s.kind, s.ok) for s in r.steps)) for r in steps.last_states(updates).collect()}
    assert got == {1: (4, [("error", 1, 1, 5, "end", False), ("load", 2, 4, 3, "end", True)]), 2: (2, [("", 3, 3, 4, "start", None), ("rank", 5, 5, 9, "end", True)])}
    assert all("TransformWithState" not in p and int(n) <= 2 * spark.sparkContext.defaultParallelism for p, n in seen)


def test_terms_within_documents_are_shuffled_once(spark, sf_dir):
    assert plan(search.r06_tf_idf(spark, sf_dir)).count("Exchange hashpartitioning") == 1


def test_coverage_writes_no_terms(spark, sf_dir, monkeypatch):
    """The share of known words needs the words alone, no weights and no pairs of words."""
    monkeypatch.setattr(search.A, "kept", None)
    assert search.r08_coverage(spark, sf_dir).where("coverage > 0").count() > 0


def test_wanted_terms_weigh_as_all_do(spark):
    texts = spark.createDataFrame([(1, "red fox runs"), (2, "red red hen"), (3, "blue"), (4, "")], "doc_id long, text string")
    counts = retrieval.term_counts(texts, ["doc_id"])
    df, n = counts.groupBy("term").agg(F.count("*").alias("df")), texts.agg(F.count("*").alias("n"))
    wanted = spark.createDataFrame([("red",), ("red hen",), ("absent",)], "term string")
    rows = lambda w: {(r.doc_id, r.term): round(r.weight, 12) for r in w.collect()}
    every = rows(retrieval.tf_idf(counts, n, df, ["doc_id"], []))
    assert rows(retrieval.wanted_tf_idf(counts, n, df, ["doc_id"], wanted)) == {k: v for k, v in every.items() if k[1] in ("red", "red hen")}


def test_chunks_are_sent_to_few_blocks_of_queries(spark):
    """3000 queries of 2000 chunks: a chunk goes to one block of queries, not to three."""
    chunks = spark.range(2000).select(F.col("id").alias("pos"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    queries = spark.range(3000).select(F.col("id").alias("query_id"), F.array(F.lit(0.0), F.lit(1.0)).alias("v"), F.array().cast("array<struct<s:double,pos:bigint>>").alias("marks"))
    top, _ = retrieval.blocked(chunks, queries, retrieval._of_vectors, 1)
    assert "sequence(0, 2" not in top._jdf.queryExecution().analyzed().toString()
    best = top.groupBy("query_id").agg(F.max_by("pos", "score").alias("pos"))
    assert [tuple(r) for r in best.groupBy("pos").count().collect()] == [(1999, 3000)]


def test_a_run_is_one_value(spark):
    """A run's state is read and written once a trigger, whatever the number of its steps."""
    class Handle:
        calls = 0

        def getValueState(self, name, schema):
            self.kept = None
            return self

        def get(self):
            self.calls += 1
            return self.kept

        def update(self, value):
            self.calls += 1
            self.kept = value

        def registerTimer(self, at):
            self.calls += 1

        def deleteTimer(self, at):
            self.calls += 1

    handle, run = Handle(), steps.RunSteps(1000)
    run.init(handle)
    rows = pd.DataFrame({"at": pd.to_datetime(range(50), unit="s"), "step": [f"s{i}" for i in range(50)], "kind": ["start"] * 50, "event_id": range(50), "ok": [True] * 50})
    for hours in (0, 1):
        out = list(run.handleInputRows((1,), iter([rows.assign(at=rows["at"] + pd.Timedelta(hours=hours))]), None))[0]
    assert (out["events"][0], len(out["steps"][0])) == (100, 50) and handle.calls == 7


def test_case_folders_in_bundles(spark, tmp_path):
    """Bundles give what a file each gives, with a row and no folder for a file; empty and oversize ones, nulls among the folders."""
    rows = [(i, n, b) for i in range(6) for n, b in (("informe.pdf", "%PDF"), ("audio.wav", "x" * 40 * i), ("a.gif", "GIF89a"), ("b.png", "no image"))[i % 2 : i + 1]]
    df = spark.createDataFrame(rows, "folder long, name string, body string")
    files.write_files(df, f"{tmp_path}/each", "folder", "name")
    files.write_bundles(df.coalesce(1), f"{tmp_path}/bundled", "folder", "name")
    seen = lambda kind, bundled: sorted(map(tuple, payloads.case_folders(spark, f"{tmp_path}/{kind}", 100, 500, bundled).collect()))
    assert seen("bundled", True) == seen("each", False) and len(seen("each", False)) == 3
    assert len(list((tmp_path / "bundled").glob("*.parquet"))) == 1
    sizes = lambda kind, bundled: sorted((r.length, bytes(r.content)) for r in files.read_files(spark, f"{tmp_path}/{kind}", bundled).collect())
    assert sizes("bundled", True) == sizes("each", False)


def test_folders_cost_no_file_each(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(files, "write_files", None)
    assert evidence.s11_case_folders(spark, sf_dir).count() > 0


def test_a_summary_reads_its_bars_twice(spark, sf_dir):
    """Once for the scalars and once for the levels (which Spark reuses), and all in one order by day; null symbols are none."""
    for query in (market.w14_technical_summary, market.t09_fact_sheet):
        p = plan(query(spark, sf_dir))
        assert p.count("FileScan parquet") == 2 and p.count("Exchange hashpartitioning") <= 4
    b = spark.sql("SELECT IF(id < 12, NULL, 1) AS symbol, date_add(date'2026-01-01', cast(id AS int)) AS day, 1.0D AS o, 1.0D AS h, 1.0D AS l, 1.0D AS c, 1.0D AS v FROM range(40)")
    assert [(r.symbol, r.n_bars, r.sma20, r.sma50) for r in market.T.summary(b).collect()] == [(1, 28, 1.0, None)]


def test_checks_read_the_summary_as_written(spark, sf_dir):
    for query in (evidence.c07_chart_readings, evidence.g13_market_figures, evidence.j08_nearest_level, contexts.j06_full_context):
        assert "l_suppkey" not in plan(query(spark, sf_dir))


def test_payloads_land_in_bundles(spark, sf_dir, tmp_path, monkeypatch):
    """A bundle's payloads give the rows and rejects of a file each; a later call reads new bundles only, and none is written alone."""
    good = '{"chart":{"result":[{"meta":{"symbol":"A%d"},"timestamp":[1,2],"indicators":{"quote":[{"open":[1,1],"high":[1,1],"low":[1,1],"close":[1,null],"volume":[1,2]}]}}]}}'
    rows = [[(i, "chart.json", good % i if i % 3 else "{}" if i % 2 else "") for i in part] for part in (range(9), range(9, 12))]
    seen = {}
    for kind, write, bundled in (("each", files.write_files, False), ("bundled", files.write_bundles, True)):
        base = f"file://{tmp_path}/{kind}"
        for part in rows:
            df = spark.createDataFrame(part, "id long, name string, body string")
            write(df if bundled else df.drop("name"), f"{base}/landed", "id", *(["name"] if bundled else []))
            bars, bad = landing.ingest(spark, f"{base}/landed", base, landing.equity, bundled=bundled)
        seen[kind] = sorted((r.symbol, r.batch) for r in bars.collect()), sorted((r.id, r.length, r.reason, r.batch) for r in bad.collect())
    assert seen["bundled"] == seen["each"] and len(seen["each"][0]) == 8 and {x[3] for x in seen["each"][1]} == {0, 1}
    monkeypatch.setattr(files, "write_files", None)
    assert evidence.s03_quarantine(spark, sf_dir).count() > 0


def test_symbols_are_routed_once(spark, sf_dir):
    """Routed symbols and each symbol's number of bars are written once; the joins by market read these."""
    p = plan(contexts.j03_source_selection(spark, sf_dir))
    assert "l_suppkey" not in p and "(?i)^accion" not in p and "try_to_timestamp" not in p and "gettimestamp" not in p


def _said_by(tree, r):
    """A text that a parsed pattern matches; look-arounds and anchors give nothing."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            out += "x" if "WORD" in str(arg) and "NOT_WORD" not in str(arg) else " " if "CATEGORY" in str(arg) else chr(r.choice([a for o, a in arg if str(o) == "LITERAL"]))
        elif name == "BRANCH":
            out += _said_by(r.choice(arg[1]), r)
        elif name == "SUBPATTERN":
            out += _said_by(arg[-1], r)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(_said_by(arg[2], r) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 2))))
        else:
            assert name in ("AT", "ASSERT_NOT"), name
    return out


def test_every_pattern_holds_a_stem():
    r = random.Random(1)
    for p in [*compliance.ANYWHERE, *compliance.AT_START]:
        for _ in range(400):
            said = _said_by(_parser.parse(p), r)
            assert any(s in said for s in compliance.STEMS), (p, said)


def test_ascii_is_folded_as_any_text(spark):
    texts = [a + b + c for a in ("", "Ab\tC", "a \n b", "\x0b\x0c\r", "\x1c\x1fZ", "A  b   c") for b in ("", " ", "\x00", "\r\n") for c in ("", "É", "\u00adx", "\u00a0\u2003 y")]
    df = spark.createDataFrame([(x,) for x in texts] + [(None,)], "t string")
    whole = F.regexp_replace(X._fold_any(F.regexp_replace(F.regexp_replace("t", r"\p{Cf}", ""), r"\p{Zs}", " ")), r"(?U)\s+", " ")
    assert df.where(~X.visible("t").eqNullSafe(whole) | ~X.fold("t").eqNullSafe(X._fold_any("t"))).count() == 0


def test_blocks_of_averages_are_written_once(spark, sf_dir):
    """The bars' blocks, from which maps and rows come, are not computed again for each."""
    p = plan(market.w04_ema_series(spark, sf_dir))
    assert "l_suppkey" not in p and "InPandas" not in p
