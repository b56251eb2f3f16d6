"""Semantics that the driver's tables don't show."""

import io
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import text as tx
from ledgerloom.operators import evaluate, evidence, graph, guard, ingest, jobs, retrieve
from ledgerloom.plans import retry, tools
from ledgerloom.sources import files
from ledgerloom.streaming import status


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("30,040 and 74.5% or 70%", ["30040", "74.5%", "70%"]), ("12.5x", ["12"]), ("1.2.3", ["1.2", "3"]), ("Q2 FY2025", []), ("(1,114)", ["1114"]),
        ("-5", ["5"]), ("é5 5é", []), ("1234567", ["1.23457e+06"]), ("7 7.0 7%", ["7", "7%"]), (None, []), ("  ", []),
    ],
)
def test_numeric_claims(spark, text, want):
    assert one(spark, text, "string", tx.numeric_claims) == want


def test_title_strip_and_collapse(spark):
    assert one(spark, " o'neil 3rd-party ", "string", tx.title_name) == "O'Neil 3Rd-Party"
    assert one(spark, " a  b\n", "string", tx.collapse) == "a b"
    assert one(spark, " \t", "string", tx.blank_to_null) is None


def test_json_payload(spark):
    kind = "struct<a int>"
    assert one(spark, 'x ```json\n{"a": 3}\n``` y {"a": 4}', "string", lambda c: tx.json_payload(c, kind)).a == 3
    assert one(spark, "none here", "string", lambda c: tx.json_payload(c, kind)) is None


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=400), st.integers(5, 60))
def test_splitter_invariants(text, size):
    overlap = size // 4
    pieces = tx.split_text(text, size, overlap)
    assert all(0 < len(p) <= size and p == p.strip() for p in pieces)
    assert re.sub(r"\s", "", text) == "" or pieces
    at = 0
    for p in pieces:  # in order: each begins at or after where the one before began
        found = text.find(p, at)
        assert found >= 0
        at = found


def test_chunks_have_one_sequence(spark):
    sections = spark.createDataFrame([("d", 0, "d_sec_0", "RISK", "word " * 60, 2), ("d", 1, "d_sec_1", "NOTES", "more " * 60, 4), ("d", 2, "d_sec_2", "NOTES", "  ", 5)], "doc_id string, idx int, id string, section_type string, content string, page_start int")
    got = ingest.chunk(sections, 100, 10).orderBy("sequence").collect()
    assert [r.sequence for r in got] == list(range(len(got))) and len(got) > 4
    assert got[0].id == "d_RISK_0" and got[0].page == 2 and got[-1].section_id == "d_sec_1"


def test_extraction_drops_items_not_rows(spark):
    answer = '{"entities": [{"name": "a", "type": "Company"}, {"name": "b", "type": "Alien"}], "relations": [{"source": "a", "target": "b", "relationship": "CAUSED"}, {"source": "a", "target": "b", "relationship": "LIKES"}]}'
    got = ingest.extract(spark.createDataFrame([(answer,), ("broken {",), (None,)], "t string"), "t").collect()
    assert [(len(r.entities), len(r.relations)) for r in got] == [(1, 1), (0, 0), (0, 0)]


def test_first_seen_is_kept_then_ranked(spark):
    df = spark.createDataFrame([("chunk", "a", 0.8, 0), ("chunk", "b", 0.5, 1), ("chunk", "a", 0.9, 2), ("table", "a", 0.95, 3), ("chunk", "n", None, 4)], "source_type string, source_id string, score double, pos int")
    got = evidence.ranked(evidence.dedupe_rank(df, ["pos"]).withColumn("g", F.lit(1)), ["pos"], ["g"]).orderBy("rank").collect()
    assert [r.score for r in got] == [0.95, 0.8, 0.5, None]


@pytest.mark.parametrize(("tickers", "want"), [(["NVDA", "nvda ", "AAPL"], "NVDA"), (["A", "B", "C"], None), (["B", "A", "B", "A"], None)])
def test_ticker_vote(spark, tickers, want):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(tickers)], "g int, pos int, ticker string")
    assert evidence.ticker_vote(df, "g", "pos").first().ticker == want


def test_claim_support_gate(spark):
    df = spark.createDataFrame([("sales 10 and 20", "only 10", "high", 1.0), ("sales 99", "10", "high", 1.0), ("none", "10", "high", 0.2)], "answer string, ev string, confidence string, citation_coverage double")
    got = guard.claim_gate(guard.claim_support(df, "answer", "ev")).collect()
    assert [(r.claim_support_ratio, r.blocked_reason, r.final_confidence, r.confidence_overridden) for r in got] == [(0.5, None, "low", True), (0.0, "low_claim_support", "low", True), (1.0, None, "medium", True)]


def test_period_points_both_modes(spark):
    df = spark.createDataFrame([(1, "In Q2 FY2024, revenue was $10.0 billion. In Q3 FY2024, revenue was $12.5 billion.")], "id int, t string")
    assert {(r.period, r.value) for r in guard.period_points(df, "id", "t").collect()} == {("Q2 FY2024", 2.0), ("Q3 FY2024", 3.0)}
    assert {(r.period, r.value, r.unit) for r in guard.period_points(df, "id", "t", fixed=True).collect()} == {("Q2 FY2024", 10.0, "billion"), ("Q3 FY2024", 12.5, "billion")}


def test_default_plan_and_ticker(spark):
    df = spark.createDataFrame([("root_cause", True, True, 0, 5, 2)], "intent string, needs_tables boolean, needs_graph_traversal boolean, top_k_tables int, top_k_chunks int, hop_depth int")
    got = tools.default_plan(df).first()
    assert (got.selected_tools, got.chunk_top_k, got.table_top_k) == (["chunk_search", "table_search", "graph_traversal"], 5, 6)
    catalog = spark.createDataFrame([("NVDA", "n")], "ticker string, name string")
    asked = spark.createDataFrame([(" nvda",), ("X",)], "raw string")
    assert [r.known_ticker for r in tools.known_ticker(F.col("raw"), catalog, asked).orderBy("raw").collect()] == ["NVDA", None]
    assert {r.known_ticker for r in tools.known_ticker(F.col("raw"), catalog.limit(0), asked).collect()} == {"NVDA", "X"}


def test_retry():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError("later")
        return 5

    assert retry.with_retry(flaky, sleep=lambda s: None) == 5 and len(calls) == 3
    with pytest.raises(ValueError):
        retry.with_retry(lambda: int("x"), sleep=lambda s: None)


def test_graph_constraints_and_deletes(spark):
    with pytest.raises(ValueError):
        graph.check_unique(spark.createDataFrame([("a",), ("a",)], "id string"), ["id"])
    docs, edges = spark.createDataFrame([("1",), ("2",)], "id string"), spark.createDataFrame([("c", "1")], "src string, dst string")
    with pytest.raises(ValueError):
        graph.delete_documents(docs, edges, ["1"], cascade=False)
    left, left_edges, n = graph.delete_documents(docs, edges, ["1", "9"])
    assert (left.count(), left_edges.count(), n) == (1, 0, 1)
    counts = graph.document_counts(docs, spark.createDataFrame([("s", "1")], "id string, doc_id string"), spark.createDataFrame([], "id string, doc_id string"), spark.createDataFrame([], "id string, doc_id string"))
    assert {(r.doc_id, r.sections, r.has_graph_data) for r in counts.collect()} == {("1", 1, True), ("2", 0, False)}


def test_walk_and_messages(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert {(r.id, r.hop) for r in retrieve.walk(spark.createDataFrame([("a",)], "id string"), edges, 4).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    old, new = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "c int, m int, t string"), spark.createDataFrame([(1, 2, "z"), (1, 3, "w")], "c int, m int, t string")
    assert sorted(r.t for r in jobs.reduce_messages(old, new, ["c", "m"]).collect()) == ["w", "x", "z"]


def test_sections_from_pages(spark):
    pages = spark.createDataFrame([("d", 1, "one", ["t1"], ["Risk factors"]), ("d", 2, "two", [], ["More risk"]), ("d", 3, "three", [], ["Notes"])], "doc_id string, page int, markdown string, tables array<string>, headings array<string>")
    spans = ingest.classify_pages(pages)
    got = ingest.assemble(spans, pages).orderBy("idx").collect()
    assert [(r.section_type, r.content, r.tables) for r in got] == [("RISK", "one\ntwo", ["t1"]), ("NOTES", "three", [])]
    assert ingest.single_section(pages).first().content == "one\ntwo\nthree"
    assert ingest.outline(pages).first().outline.startswith("Page 1: headings=[Risk factors] | one\n")
    turned = spark.createDataFrame([([(5, 3)], [3, 4, 5])], "s array<struct<page_start int, page_end int>>, p array<int>")
    assert turned.select(ingest.covers(F.col("s"), F.col("p"))).first()[0] is False


def test_evaluation_of_odd_numbers(spark):
    df = spark.createDataFrame([("q1", "0.5", "x"), ("q2", "NaN", "0"), ("q3", None, "1")], "case_id string, a string, b string")
    got = {r.metric: r for r in evaluate.metric_stats(df, evaluate.metric_columns(df)).collect()}
    assert got["a"].n == 1 and got["a"]["std"] is None and got["b"].n == 2 and got["b"].warn_zero
    assert evaluate.weakest(df, ["a", "b"], "case_id").first().case_id == "q2"
    assert "| A |" in evaluate.report(df, ["a", "b"], "case_id")
    assert evaluate.overall(df, ["a", "b"], 0.9).first().failed


def test_files_and_uploads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello\nworld")
    got = files.text_sections(spark, str(tmp_path / "in")).first()
    assert (got.content, got.title, got.page_start) == ("hello\nworld", "Article", 1)
    path, size = files.persist_upload(io.BytesIO(b"x" * 10), "r.pdf", "d1", str(tmp_path / "in"))
    assert path.endswith("d1.pdf") and size == 10
    with pytest.raises(ValueError):
        files.persist_upload(io.BytesIO(b""), None, "d", str(tmp_path))
    pdf, rest = files.dispatch(files.binary_documents(spark, str(tmp_path / "in")))
    assert (pdf.count(), rest.count()) == (1, 1)
    docs = spark.createDataFrame([("d1.pdf",), ("gone.pdf",)], "filename string")
    assert [r.filename for r in files.missing_files(spark, docs, str(tmp_path / "in")).collect()] == ["gone.pdf"]
    (tmp_path / "t.json").write_text('[{"category": "trend", "question": "q"}]')
    assert files.testset(spark, str(tmp_path / "t.json")).first().question == "q"
    df = spark.createDataFrame([("a\nb", 'say "x"')], "u string, v string")
    files.write_csv(df, str(tmp_path / "csv"))
    assert tuple(files.results(spark, str(tmp_path / "csv")).first()) == ("a\nb", 'say "x"')


def test_streams(spark, sf, tmp_path):
    from pathlib import Path

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "ev"))
    stream = status.events(spark, str(tmp_path / "ev"), events.schema)
    q = status.latest_status(stream, "user_id", "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.user_id: r.event_type for r in events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_type")).alias("event_type")).collect()}
    assert {r.user_id: r.event_type for r in spark.table("latest").collect()} == want
    seen = []
    status.ingest(status.events(spark, str(tmp_path / "ev"), events.schema), lambda df, k: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == events.count() and Path(tmp_path / "cp").exists()
    w = status.windowed(stream, "ts", "event_type").writeStream.outputMode("append").format("memory").queryName("win").trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.table("win").count() > 0 and status.poll_seconds(True) == 3
