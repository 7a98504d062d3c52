import numpy as np
import pytest
from pyspark.sql import functions as F

from finevidence.operators import reports, retrieval, routing, runs
from finevidence.sources import payloads


def test_text_assets(spark, tmp_path):
    (tmp_path / "q1.txt").write_text("\n How does it trade? \n\n")
    (tmp_path / "other.txt").write_text("x")
    got = payloads.text_assets(spark.createDataFrame([("q1.txt",), ("q2.txt",), (None,)], "name string"), str(tmp_path))
    assert {r.name: r.text for r in got.collect()} == {"q1.txt": "How does it trade?", "q2.txt": "", None: ""}


def test_embedding_hook(spark):
    rows = spark.createDataFrame([(i, "a" * i if i else None) for i in range(200)], "id long, text string")
    got = retrieval.embed(rows, "id", lambda texts: [[len(t), len(texts) <= retrieval.EMBEDDED] for t in texts]).collect()
    assert {r.id: r.vector for r in got} == {i: [i, 1.0] for i in range(200)}
    with pytest.raises(Exception, match="the model gave 0 vectors"):
        retrieval.embed(rows, "id", lambda texts: []).collect()
    assert retrieval.embed(rows.limit(0), "id", lambda texts: np.zeros((len(texts), 2)).tolist()).count() == 0


def test_request_contexts(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    documents = spark.createDataFrame([(1, "[document p.1] a")], "query_id long, context string")
    said = spark.createDataFrame([(2, "x" * 9000)], "query_id long, text string")
    got = {r.query_id: r.context for r in retrieval.request_contexts(asked, documents, said).collect()}
    assert got == {1: "Document:\n[document p.1] a\n\nTranscript:\n(none)", 2: "Document:\n(none)\n\nTranscript:\n" + "x" * retrieval.TRANSCRIPT}


def test_question_after_history(spark):
    turns = spark.createDataFrame([("c", 1, "user", "b"), ("c", 0, "user", "a"), ("c", 2, "bot", None)], "conv_id string, turn int, role string, text string")
    asked = spark.createDataFrame([("c", "why?", "r", None), ("new", "what?", None, " h ")], "conv_id string, question string, report string, hits string")
    got = {r.conv_id: r.context for r in retrieval.asked_context(retrieval.conversation_context(turns), asked).collect()}
    assert got["c"] == "user: a\nuser: b\nbot: (none)\nReport: r\nFound: (none)\nQuestion: why?"
    assert got["new"] == "Report: (none)\nFound: h\nQuestion: what?"


def test_warnings_and_messages(spark):
    first = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None)], "id long, warning string")
    second = spark.createDataFrame([(1, "0"), (3, "z")], "id long, warning string")
    assert {r.id: r.warnings for r in reports.warnings_union([first, second], "id").collect()} == {1: ["a", "b", "0"], 3: ["z"]}
    trace = spark.createDataFrame([(1, 0, "read", False), (1, 1, "say", False), (2, 0, "say", False), (3, 0, "read", True), (4, 0, "read", True)], "run_id long, step_ord int, step string, ok boolean")
    got = {r.run_id: (r.outcome, r.message) for r in runs.outcome_messages(trace, ("read",), trace.where("run_id = 4")).collect()}
    assert got == {1: ("failed", "step failed: read"), 2: ("degraded", "without: say"), 3: ("ok", None), 4: ("failed", "no data for the ticker")}
    assert {r.outcome for r in runs.outcome_messages(trace.where("run_id = 3"), ("read",)).collect()} == {"ok"}


def test_sources_by_market(spark):
    asked = spark.createDataFrame([("A", "equity"), ("A", "crypto"), ("B", "equity"), ("", None)], "symbol string, market string")
    bars = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("", 3.0)], "symbol string, c double")
    got = routing.select_sources(asked, bars, bars.withColumn("c", F.col("c") * 10)).collect()
    assert sorted((r.symbol, r.market, r.c) for r in got) == [("A", "crypto", 10.0), ("A", "equity", 1.0), ("B", "equity", 2.0)]
    one = spark.createDataFrame([("A", 5.0)], "symbol string, mark double")
    facts = spark.createDataFrame([("A", 7), ("B", 8)], "symbol string, facts int")
    kept = {(r.symbol, r.market): (r.mark, r.facts) for r in routing.guarded_by_market(asked, one, facts).collect()}
    assert kept == {("A", "equity"): (None, 7), ("A", "crypto"): (5.0, None), ("B", "equity"): (None, 8), ("", None): (None, None)}
