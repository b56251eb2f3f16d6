"""Dispatch, evaluation, writers and events beyond what the registered queries show."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as tx
from ledgerloom.operators import dispatch, evaluate, graph, guard, ingest, jobs, retrieve
from ledgerloom.plans import retry
from ledgerloom.plans.runtime import Runtime
from ledgerloom.sources import files
from ledgerloom.streaming import sse


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    ("error", "want"),
    [(TimeoutError("x"), "transient"), (ConnectionResetError("x"), "transient"), (ValueError("connection string"), "validation"), (TypeError("429"), "validation"), (KeyError("k"), "runtime"), (RuntimeError("database"), "runtime")],
)
def test_errors_are_classed_by_type(error, want):
    assert retry.classify(error) == want


def test_named_driver_errors():
    assert retry.classify(type("SessionExpired", (Exception,), {})("x")) == "transient"
    assert retry.classify(type("ClientError", (type("DatabaseError", (Exception,), {}),), {})("x")) == "database"


def test_retries_are_counted_and_delayed():
    calls, slept = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert retry.invoke(flaky, sleep=slept.append) == ("ok", 2, None) and slept == [0.2, 0.4]
    assert retry.attempt(lambda: 1 / 0, []) == ([], 0, "runtime")
    assert retry.attempt(lambda: int("x"), None, sleep=slept.append) == (None, 0, "validation")
    with pytest.raises(RuntimeError, match="embedding failed after 3 attempts"):
        retry.ingestion_retry(lambda: 1 / 0, "embedding", sleep=slept.append, delay=lambda n: n)
    assert slept == [0.2, 0.4, 1, 2] and 2 <= retry.ingestion_delay(2) <= 2.25
    assert retry.invoke(lambda: 5, attempts=0) == (5, 0, None)


def test_plan_bounds():
    for kind in ({"chunk_top_k": 0}, {"chunk_top_k": 21}, {"table_top_k": -1}, {"tools": ("magic",)}):
        with pytest.raises(ValueError):
            dispatch.Plan(**kind)
    assert dispatch.Plan(table_top_k=0).tools == ("chunk_search",)


def test_question_required(spark):
    ask = lambda q: frame(spark, [(q,)], "q string").select(dispatch.require_question(F.col("q"))).first()[0]
    assert ask(" a  b ") == "a b"
    for empty in (None, " \t"):
        with pytest.raises(Exception, match="No question"):
            ask(empty)


def test_catalog_text_without_companies(spark):
    rows = frame(spark, [("B", "two"), ("A", None), (" ", "none"), (None, "x")], "ticker string, name string")
    assert dispatch.catalog_text(rows).first()[0] == "- A\n- B: two"
    assert dispatch.catalog_text(rows.limit(0)).first()[0] == dispatch.NO_COMPANIES


def test_resolved_with_an_empty_catalog(spark):
    rows = frame(spark, [(None, "abc", "q", None), ("X", "abc", "q", "better")], "explicit_ticker string, model_ticker string, question string, model_question string")
    none = frame(spark, [], "ticker string")
    assert sorted(tuple(r) for r in dispatch.resolved(rows, none).select("ticker", "question").collect()) == [("ABC", "q"), ("X", "better")]
    known = frame(spark, [("zzz",)], "ticker string")
    assert {r.ticker for r in dispatch.resolved(rows, known).collect()} == {None, "X"}


def test_blocked_rows_have_no_answer_unless_blocked(spark):
    got = dispatch.blocked_response(frame(spark, [("non_financial", "c"), ("domain_uncertain", ""), ("domain_uncertain", "c"), (None, "c")], "blocked_reason string, clarification_question string")).collect()
    assert [r.open_questions and r.open_questions[0] for r in got] == [dispatch.BLOCKED["non_financial"][1], dispatch.BLOCKED["domain_uncertain"][1], "c", None]
    assert got[0].bullets == [] and got[3].bullets is None


def test_context_falls_back(spark):
    got = frame(spark, [(["  a ", " "], None), (None, ["t"]), (None, None), ([" "], [])], "c array<string>, t array<string>").select(evaluate.contexts(F.col("c"), F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [["a"], ["t"], [evaluate.NO_CONTEXT], [evaluate.NO_CONTEXT]]


def test_quantiles_match_numpy(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.gauss(0, 1), 5.0, rng.expovariate(0.01)]) for _ in range(3001)]
    df = frame(spark, [(float(v), 1.0 if i else None) for i, v in enumerate(values)], "a double, b double")
    got = {r.metric: r for r in evaluate.metric_stats(df, ["a", "b"]).collect()}
    for name, p in (("p25", 25), ("p50", 50), ("p75", 75)):
        assert got["a"][name] == pytest.approx(np.percentile(values, p), abs=2e-6) and got["b"][name] == 1.0
    assert got["a"].n == 3001 and got["b"].n == 3000 and got["a"]["std"] == pytest.approx(np.std(values, ddof=1), abs=2e-6)


def test_report_has_what_its_columns_allow(spark):
    rows = [(1, "q one", 0.0, 0.9, 1, "x", None, "financial_supported", True, 0.5, 2, 0.4), (2, "q two", 1.0, 0.8, None, "", "non_financial", "non_financial", False, None, 0, 0.6), (3, "q three", 0.2, 0.7, 3, None, "", "non_financial", None, 0.7, None, None)]
    df = frame(spark, rows, "case_id int, user_input string, faithfulness double, llm_context_precision_with_reference double, retry_count int, error_class string, blocked_reason string, expected_domain string, domain_gate_passed boolean, claim_support_ratio double, unsupported_claim_count int, citation_coverage double")
    out = evaluate.report(df, ["faithfulness", "llm_context_precision_with_reference"], "case_id")
    for line in ("3 cases", "- zero in Faithfulness: q one...", "- low mean of Faithfulness: 0.4000", "- high variance of Faithfulness", "- retries: 4, a case 1.33", "- error_class none: 2", "- domain_gate_passed: 33.33%", "- false block rate: 0.00%", "- false allow rate: 50.00%", "- unsupported: 2", "## Correlation"):
        assert line in out, line
    assert "## Reliability" not in evaluate.report(df.select("case_id", "faithfulness"), ["faithfulness"], "case_id")


def test_schema_is_made_once(spark, caplog):
    schema = graph.create_schema(dimension=8)
    assert not schema.add_unique("section_id", "other", ["x"]) and schema.unique["section_id"] == ("section", ["id"])
    assert graph.create_schema(schema, 99).vectors["chunk_embeddings"][2] == 8
    assert set(graph.init_schema(schema).indexes) == {"job_status", "job_created_at", "document_ticker", "document_status"}
    seen = []
    graph.init_schema(None, [lambda s: 1 / 0, seen.append])
    assert len(seen) == 1 and "schema step failed" in caplog.text
    assert schema.violations({}) is None
    twice = frame(spark, [("a",), ("a",), (None,), (None,)], "id string")
    assert [(r.constraint, r.key, r.n) for r in schema.violations({"chunk": twice}).collect()] == [("chunk_id", '{"id":"a"}', 2)]


def test_indexed_files_and_types(spark, tmp_path):
    schema = graph.init_schema()
    rows = frame(spark, [(i, "S" + str(i % 3)) for i in range(30)], "id int, status string")
    graph.write_indexed(rows, schema, "job", str(tmp_path / "job"))
    assert spark.read.parquet(str(tmp_path / "job")).count() == 30
    graph.write_by_type(rows, "status", str(tmp_path / "by"))
    assert sorted(p.name for p in (tmp_path / "by").iterdir() if p.is_dir()) == ["status=S0", "status=S1", "status=S2"]


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 12))
    rows = [(i, (centres[i % 5] + rng.normal(size=12) * 0.1).tolist()) for i in range(300)] + [(900, [1.0]), (901, None)]
    df = frame(spark, rows, "id int, embedding array<double>")
    graph.build_vector_index(df, str(tmp_path / "v"), 12, bits=5)
    index, query = spark.read.parquet(str(tmp_path / "v")), rows[7][1]
    assert index.count() == 300
    exact = [r.id for r in retrieve.top_k(df, query, 10).collect()]
    assert [r.id for r in graph.search_vector_index(index, query, 10, bits=5, radius=5).collect()] == exact
    assert len({r.id for r in graph.search_vector_index(index, query, 10, bits=5, radius=2).collect()} & set(exact)) >= 8


def test_topk_of_many_queries(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=6).round(1).tolist() if i % 17 else None) for i in range(400)] + [(400, [0.0] * 6), (401, [1.0, 2.0]), (402, [0.5] * 6), (403, [0.5] * 6)]
    df = frame(spark, vectors, "id long, embedding array<double>")
    asked = df.where("id % 7 = 0 or id > 399").selectExpr("id as query_id", "embedding")
    got = {(r.query_id, r["rank"]): (r.id, round(r.score, 9)) for r in retrieve.top_k_all(df, asked, 4, block=10, parts=3).collect()}
    data = {i: np.array(v) for i, v in vectors if v and any(v)}
    want = {}
    for q in (r.query_id for r in asked.collect()):
        if q in data:
            near = sorted((-round(float(data[q] @ v / np.sqrt((v @ v) * (data[q] @ data[q]))), 12), i) for i, v in data.items() if len(v) == len(data[q]))
            want |= {(q, k + 1): (i, round((1 - c) / 2, 9)) for k, (c, i) in enumerate(near[:4])}
    assert got == want
    literal = retrieve.top_k_batch(df, {7: vectors[7][1]}, 3).orderBy("rank").collect()
    assert [(r.id, round(r.score, 9)) for r in literal] == [got[7, k] for k in (1, 2, 3)]


def test_documents_keep_what_a_filing_does_not_say(spark):
    companies, filed = frame(spark, [("A", "TA"), ("B", None)], "name string, ticker string"), frame(spark, [("A", "1")], "company string, doc_id string")
    documents = frame(spark, [("1", "old", "2020", "f", "/f", "INGESTED")], "id string, type string, period string, filename string, file_path string, status string")
    new = frame(spark, [("1", "new", "2021", "g", "/g", "A", "XX"), ("2", "t", None, "h", "/h", "B", "TB")], "id string, type string, period string, filename string, file_path string, company_name string, ticker string")
    c, d, e = graph.upsert_documents(companies, documents, filed, new)
    assert sorted(tuple(r) for r in c.collect()) == [("A", "TA"), ("B", "TB")]
    assert sorted((r.id, r.type, r.period, r.status or "") for r in d.collect()) == [("1", "new", "2021", "INGESTED"), ("2", "t", None, "")]
    assert sorted(tuple(r) for r in e.collect()) == [("A", "1"), ("B", "2")]
    sections, contains = graph.upsert_sections(frame(spark, [("s", "1", "x")], "id string, doc_id string, title string"), frame(spark, [("1", "s")], "doc_id string, section_id string"), frame(spark, [("s", "1", "y"), ("t", "9", "z")], "id string, doc_id string, title string"), d)
    assert [tuple(r) for r in sections.collect()] == [("s", "1", "y")] and contains.count() == 1


def test_embeddings_by_kind(spark):
    chunks, tables = frame(spark, [("a", "one"), ("b", "three")], "id string, text string"), frame(spark, [("a", "tables")], "id string, context string")
    length = lambda c: F.array(F.length(c).cast("float"))
    x, y = ingest.embed_all(chunks, tables, length)
    assert sorted((r.id, r.embedding) for r in x.collect()) == [("a", [3.0]), ("b", [5.0])] and y.first().embedding == [6.0]
    assert ingest.check_embeddings(x) == 1
    for bad in (x.limit(0), x.withColumn("embedding", F.when(F.col("id") == "a", F.col("embedding"))), x.withColumn("embedding", F.when(F.col("id") == "a", F.col("embedding")).otherwise(F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")))):
        with pytest.raises(ValueError):
            ingest.check_embeddings(bad)
    stats = ingest.with_defaults(frame(spark, [("", None, "d", None, None)], "ticker string, company_name string, doc_type string, period string, stats map<string,bigint>")).first()
    assert (stats.ticker, stats.company_name, stats.period, stats.stats) == ("UNKNOWN", "Unknown Company", "Unknown", {})
    assert ingest.pages_of_type(frame(spark, [(1, "ok"), (2, "failed")], "page int, kind string"), "ok").count() == 1


def test_job_and_document_rows(spark):
    ids = [r.id for r in jobs.new_jobs(frame(spark, [(["a"],), (["b", "c"],)], "document_ids array<string>")).collect()]
    assert len(set(ids)) == 2 and all(len(i) == 36 for i in ids)
    shown = jobs.job_response(frame(spark, [("j", None, "bogus", "2026-01-02T03:04:05", "2027-01-01T00:00:00.5", {"n": 1})], "id string, status string, stage string, created_at string, estimated_completion string, stats map<string,bigint>"))
    r = shown.first()
    assert (r.status, r.stage, r.progress, r.stats, r.errors, r.estimated_completion.microsecond) == ("QUEUED", None, 0, {"n": 1}, [], 500_000)
    assert jobs.job_response(frame(spark, [("j", "2027-01-01T00:00:00")], "id string, estimated_completion string"), listed=True).first().estimated_completion is None
    d = jobs.document_response(frame(spark, [("1", None, "t", None)], "id string, doc_type string, type string, status string")).first()
    assert (d.doc_type, d.status, d.stats) == ("t", "UPLOADED", {})


def test_claims_leave_running_jobs_their_place(spark):
    rows = frame(spark, [("a", 1, "RUNNING"), ("b", 2, "QUEUED"), ("c", 3, "QUEUED"), ("d", 0, "QUEUED")], "id string, created_at int, status string")
    assert {r.id: r.status for r in jobs.claim(rows, 2).collect()} == {"a": "RUNNING", "b": "QUEUED", "c": "QUEUED", "d": "RUNNING"}
    assert jobs.claim(rows, 1).where("status = 'RUNNING'").count() == 1


def test_running_and_transitions_by_bucket(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), i, rng.randrange(40), rng.choice("ab")) for i in range(400)]
    df = frame(spark, rows, "u int, id int, t int, s string")
    bucket = F.floor(F.col("t") / 7)
    for f in (lambda **k: jobs.running(df, "u", ["t", "id"], F.col("s") == "a", **k), lambda **k: jobs.transitions(df, "u", ["t", "id"], "s", **k)):
        plain, split = f(), f(bucket=bucket)
        assert sorted(map(str, plain.collect())) == sorted(map(str, split.select(plain.columns).collect())) and plain.count() > 100


def test_claim_support_read_once_a_key(spark):
    docs = frame(spark, [(1, "x", "1 and 2"), (2, "x", "none"), (3, "y", "7 8 9")], "id int, k string, t string")
    known = frame(spark, [("x", "2 3"), ("y", None)], "k string, e string")
    got = {r.id: (r.claim_total_count, r.supported_claim_count, r.unsupported_claims) for r in guard.claim_support_by(docs, "k", "t", known, "e").collect()}
    assert got == {1: (2, 1, ["1"]), 2: (0, 0, []), 3: (3, 0, ["7", "8", "9"])}


def test_chunk_numbers_over_sections(spark):
    """Pieces are those of the splitter section by section, numbered without a gap."""
    texts = {("d", 0): "alpha beta. " * 40, ("d", 1): " ", ("d", 2): "gamma\n\n" * 60, ("e", 0): "delta"}
    rows = [(doc, i, f"{doc}_sec_{i}", "RISK", t, i + 1) for (doc, i), t in texts.items()]
    got = ingest.chunk(frame(spark, rows, "doc_id string, idx int, id string, section_type string, content string, page_start int"), 90, 20).collect()
    want = {}
    for doc in ("d", "e"):
        pieces = [(i, p) for (x, i), t in texts.items() if x == doc for p in (tx.split_text(t, 90, 20) if t.strip() else [])]
        want |= {f"{doc}_RISK_{n}": (n, p, f"{doc}_sec_{i}", i + 1) for n, (i, p) in enumerate(pieces)}
    assert {r.id: (r.sequence, r.text, r.section_id, r.page) for r in got} == want and len(want) > 8


def test_events_of_a_broken_stream(spark):
    raw = 'event: metadata\ndata: {}\n\nevent: messages\r\ndata: [{},\ndata: {"langgraph_node": "a"}]\r\n\r\nevent: messages\ndata: [1]\n\nevent: messages\ndata: no json\n\n'
    raw += "".join(f'event: messages\ndata: [{{}}, {{"langgraph_node": "{n}"}}]\n\n' for n in "abab") + 'event: messages\ndata: [{}, {"langgraph_node": "z"}]'
    got = sse.steps(sse.nodes(sse.events(frame(spark, [(1, raw)], "c int, raw string"), "c", "raw"), "c"), "c").first()
    assert (got.active, got.completed) == ("b", ["a", "b"])


def test_payloads_and_directives(spark):
    get = lambda f, v: frame(spark, [(v,)], "x string").select(f(F.col("x"))).first()[0]
    assert get(lambda c: F.size(tx.messages_of(c)), '{"messages": "no"}') == 0 and get(lambda c: F.size(tx.messages_of(c)), None) == 0
    assert get(lambda c: tx.latest_human(tx.messages_of(c)), '[{"type": "Human", "content": " a  b "}, {"role": "user", "content": " "}, {"type": "ai", "content": "c"}]') == "a b"
    hidden = get(lambda c: tx.with_directive(c, F.lit("do")), "ask")
    assert get(tx.without_directive, hidden) == "ask" and get(lambda c: tx.with_directive(c, F.lit("")), "ask") == "ask"
    assert get(tx.display_name, "factual_correctness(mode=f1)") == "Factual Correctness(Mode=F1)"
    assert get(tx.parse_iso, "2026-02-30T00:00:00") is None
    assert get(tx.folded, "a\nb\nc\nd\ne") == "a\nb\nc\nd\n..." and get(tx.folded, "x" * 501) == "x" * 500 + "..."


def test_document_content(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes(b"\x00raw")
    docs = frame(spark, [("1", str(tmp_path / "f.txt")), ("2", ""), ("3", str(tmp_path / "gone"))], "id string, file_path string")
    assert files.document_content(spark, docs, "1") == b"\x00raw"
    for missing in ("2", "3", "9"):
        with pytest.raises(FileNotFoundError):
            files.document_content(spark, docs, missing)


def test_runtime_states():
    r = Runtime()
    r.put("j", stage="PARSING")
    r.put("j", progress=3)
    assert r.get("j") == {"stage": "PARSING", "progress": 3} and r.get("k") == {}
    r.drop("j")
    assert r.get("j") == {}


def test_charts(spark):
    rows = [(1, "", "high", 0.9, "trend_analysis", False, " q" * 100, [" ", "first", "second"], ["a", "b", "c", "d"]), (2, "", "high", 0.9, "comparison", False, " ", None, None), (3, "x", "high", 0.9, "comparison", False, "q", [], [])]
    df = frame(spark, rows, "id int, blocked_reason string, confidence string, citation_coverage double, intent string, needs_multi_period boolean, question string, bullets array<string>, citations array<string>")
    texts = frame(spark, [(1, "FY2024 grew 5 million. Q1 FY2025 was 7. FY2024 again"), (2, "2023: 1; 2024: 2"), (3, "2023: 1; 2024: 2")], "id int, t string")
    got = {r.id: r for r in guard.chart_payload(df, guard.period_points(texts, "id", "t", fixed=True), "id").collect()}
    assert (got[1].chart_type, len(got[1].title), got[1].insight, got[1].shown_citations, got[1].unit) == ("line", 120, "first", ["a", "b", "c"], "million")
    assert [(p.period, p.value) for p in got[1].data] == [("FY2024", 5.0), ("Q1 FY2025", 7.0)]
    assert (got[2].title, got[2].insight, got[2].shown_citations) == (guard.CHART_TITLE, None, None) and len(got[2].data) == 2
    assert (got[3].reason, got[3].data, got[3].title) == ("blocked_response", None, None)


def test_parsed_files_become_sections(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.pdf").write_bytes(b"three")

    def parser(content):
        return [{"page": i + 1, "kind": "ok", "markdown": p, "items": [{"type": "heading", "value": " Head " + p}, {"type": "heading", "value": "abc"}, {"type": "table", "value": ""}, {"type": "table", "value": "|x|"}]} for i, p in enumerate(content.decode().split("|"))] + [{"page": 99, "kind": "failed"}]

    pages = ingest.pages_of_type(files.parsed_pages(files.binary_documents(spark, str(tmp_path)), parser), "ok")
    pages = pages.withColumn("doc_id", F.regexp_extract("file_path", "([ab]).pdf", 1))
    assert sorted((r.doc_id, r.page, r.headings, r.tables) for r in pages.collect()) == [("a", 1, ["Head one"], ["|x|"]), ("a", 2, ["Head two"], ["|x|"]), ("b", 1, ["Head three"], ["|x|"])]
    spans = frame(spark, [("a", 0, "RISK", "r", 1, 1), ("a", 1, "NOTES", "n", 2, 2), ("b", 0, "RISK", "r", 1, 3)], "doc_id string, idx int, section_type string, title string, page_start int, page_end int")
    got = sorted((r.doc_id, r.idx, r.section_type, r.content, r.tables) for r in ingest.sections_of(pages, spans).collect())
    assert got == [("a", 0, "RISK", "one", ["|x|"]), ("a", 1, "NOTES", "two", ["|x|"]), ("b", 0, "GENERAL", "three", ["|x|"])]
    assert {r.section_type for r in ingest.sections_of(pages, spans.limit(0)).collect()} == {"GENERAL"}


def test_replayed_calls_agree_with_invoke(spark):
    """Random attempts: the table's retries and outcomes are those of the calls themselves."""
    import random

    rng = random.Random(5)
    kinds = [None, TimeoutError, ConnectionResetError, ValueError, UnicodeError, KeyError, type("SessionExpired", (Exception,), {}), type("ClientError", (type("DatabaseError", (Exception,), {}),), {})]
    calls = {c: [rng.choice(kinds) for _ in range(rng.randrange(3, 7))] for c in range(120)}
    rows = [(c, n, None if k is None else [b.__name__ for b in k.__mro__]) for c, ks in calls.items() for n, k in enumerate(ks)]
    df = frame(spark, rows, "id int, at int, types array<string>")

    def made(kinds, any_error):
        left = list(kinds)

        def once():
            tried.append(1)
            kind = left.pop(0)
            if kind:
                raise kind
            return "ok"

        tried = []
        try:
            retry.invoke(once, sleep=lambda s: None, **({"retryable": lambda e: True} if any_error else {}))
            return len(tried) - 1, "ok"
        except Exception as error:
            return len(tried) - 1, retry.classify(error)

    for any_error in (False, True):
        got = {r["call"]: (r["retries"], r["outcome"]) for r in retry.replay(df, "id", "at", F.col("types"), any_error=any_error).collect()}
        assert got == {c: made(ks, any_error) for c, ks in calls.items()}
    assert retry.replay(df.limit(0), "id", "at", F.col("types")).count() == 0
    assert retry.replay(frame(spark, [(None, 1, []), (None, None, None)], "id int, at int, types array<string>"), "id", "at", F.col("types")).first()[1:] == (0, "ok")
