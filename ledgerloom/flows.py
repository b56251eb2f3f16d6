"""Registered queries of dispatch, evaluation and ingestion rows over the driver's tables, with their SQL.

The corpus of a question: chunks and tables are ``embeddings`` (vec_id, prefix c or t), four
of them a section (label 9 has none), sections belong to ``documents`` of their number,
companies are sources. States of questions come from orders and line items.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import dispatch, graph, held, ingest, jobs, retrieve, store, vectorindex
from .operators import evaluate as ev
from .operators import evidence as evi
from .plans import retry
from .queries import _SCORED, _SQL, _t, _vector_of, _vectors, query
from .sources import files
from .streaming import sse, stateful, status


def _corpus(spark: SparkSession, d: str) -> dispatch.Corpus:
    v, docs = _t(spark, d, "embeddings"), _t(spark, d, "documents")
    section = F.concat(F.lit("s"), F.floor(F.col("vec_id") / 4))
    linked = v.where("label <> 9")
    named = lambda prefix: F.concat(F.lit(prefix), F.col("vec_id"))
    source = docs.where("source is not null")
    c = named("c")
    return dispatch.Corpus(
        chunks=v.select(c.alias("id"), F.concat(F.lit("text "), "vec_id").alias("text"), "embedding"),
        tables=v.select(named("t").alias("id"), F.concat(F.lit("| "), "vec_id").alias("markdown"), F.col("label").alias("sequence"), "embedding"),
        has_chunk=linked.select(section.alias("section_id"), c.alias("id")), has_table=linked.select(section.alias("section_id"), named("t").alias("id")),
        sections=docs.select(F.concat(F.lit("s"), "doc_id").alias("id"), "doc_id", F.concat(F.lit("Section "), "doc_id").alias("title"), F.col("lang").alias("section_type")),
        documents=docs.select(F.col("doc_id").alias("id"), F.col("source").alias("doc_type"), F.col("lang").alias("period")),
        filed=source.select("doc_id", F.col("source").alias("company")), companies=source.select(F.col("source").alias("name"), F.upper("source").alias("ticker")).distinct(),
        next_chunk=v.select(c.alias("src"), F.concat(F.lit("c"), F.col("vec_id") + 1).alias("dst")), mentions=v.select(c.alias("chunk_id"), F.concat(F.lit("L"), "label").alias("name")),
        relations=v.where("label is not null").select(F.concat(F.lit("L"), "label").alias("src_name"), F.lit("IMPACTED").alias("rel_type"), F.concat(F.lit("L"), F.col("label") + 1).alias("tgt_name")).distinct(),
    )


_HIT = """h AS (SELECT s0.id AS v, score, vec.label FROM s0 JOIN embeddings vec ON vec.vec_id = s0.id),
x AS (SELECT h.*, CASE WHEN label <> 9 THEN d.doc_id END AS doc_id, CASE WHEN label <> 9 THEN d.source END AS source, CASE WHEN label <> 9 THEN d.lang END AS lang,
CASE WHEN label <> 9 THEN 's' || (v // 4) END AS section_id FROM h LEFT JOIN documents d ON d.doc_id = v // 4)"""


@query(f"""WITH {_SCORED.format(q=0)}, {_HIT}, k AS (SELECT * FROM x ORDER BY score DESC, 'c' || v LIMIT 12)
SELECT 'c' || v AS id, section_id, CASE WHEN doc_id IS NOT NULL THEN 'Section ' || doc_id END AS section_title, lang AS section_type, doc_id, source AS doc_type, lang AS period, source AS company, upper(source) AS ticker, round(score, 6) AS score FROM k""")
def evidence_sections(spark, d):
    """Hits with section, document and company; hits without section keep nulls."""
    c = _corpus(spark, d)
    got = dispatch.with_section(retrieve.top_k(c.chunks, _vector_of(spark, d, 0), 12), c.has_chunk, c)
    return got.select("id", "section_id", "section_title", "section_type", "doc_id", "doc_type", "period", "company", "ticker", F.round("score", 6).alias("score"))


_PLANS = {
    "chunks": dispatch.Plan(("chunk_search",), 6, 4), "no_tables": dispatch.Plan(("chunk_search", "table_search"), 5, 0), "both": dispatch.Plan(("table_search", "chunk_search", "graph_traversal"), 8, 6),
    "seeded": dispatch.Plan(("graph_traversal",), 7, 6), "tables_seed": dispatch.Plan(("table_search", "graph_traversal"), 7, 3), "filtered": dispatch.Plan(("chunk_search", "table_search"), 20, 20, period="en"),
    "nothing": dispatch.Plan(("table_search", "graph_traversal"), 20, 20, ticker="no such"),
}


def _hits_sql() -> str:
    parts = []
    for name, p in _PLANS.items():
        keep = " AND ".join(["TRUE", *([f"contains(lang, '{p.period}')"] if p.period else []), *([f"upper(source) = upper('{p.ticker}')"] if p.ticker else [])])
        searched = [("chunk", "c", p.chunk_top_k)] if "chunk_search" in p.tools or p.tools == ("graph_traversal",) or p.ticker else []
        searched += [("table", "t", p.table_top_k)] if "table_search" in p.tools and p.table_top_k else []
        for kind, prefix, k in searched:
            parts.append(f"SELECT '{name}' AS plan, '{kind}' AS source_type, '{prefix}' || v AS source_id, section_id, doc_id, score, {str('graph_traversal' in p.tools).upper()} AS paths FROM (SELECT * FROM x ORDER BY score DESC, '{prefix}' || v LIMIT {k}) WHERE {keep}")
    return " UNION ALL ".join(parts)


@query(f"WITH {_SCORED.format(q=3)}, s0 AS (SELECT * FROM s3), {_HIT} SELECT plan, source_type, source_id, section_id, doc_id, round(score, 6) AS score, paths FROM ({_hits_sql()})")
def retrieval_dispatch(spark, d):
    """What each plan's tools find."""
    c, q, out = _corpus(spark, d), _vector_of(spark, d, 3), None
    for name, plan in _PLANS.items():
        got = dispatch.dispatch(c, q, plan)
        rows = got.hits.select(F.lit(name).alias("plan"), "source_type", "source_id", "section_id", "doc_id", F.round("score", 6).alias("score"), F.lit(got.paths is not None).alias("paths"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH {_SCORED.format(q=3)}, s0 AS (SELECT * FROM s3), {_HIT}, e AS (SELECT 'chunk' AS source_type, source, score FROM (SELECT * FROM x ORDER BY score DESC, 'c' || v LIMIT 8) UNION ALL SELECT 'table', source, score FROM (SELECT * FROM x ORDER BY score DESC, 't' || v LIMIT 6)),
votes AS (SELECT upper(source) AS t, count(*) AS n, max(score) AS best FROM e WHERE source IS NOT NULL GROUP BY 1), w AS (SELECT t, n, n / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, best DESC) AS k FROM votes)
SELECT count(*) AS evidence_count, round(avg(score), 6) AS avg_score, count(*) FILTER (source_type = 'chunk') AS chunk_count, count(*) FILTER (source_type = 'table') AS table_count,
count(*) >= 2 AND avg(score) >= 0.35 AND count(*) FILTER (source_type = 'table') > 0 AS passed, (SELECT CASE WHEN n >= 2 AND share >= 0.6 THEN t END FROM w WHERE k = 1) AS ticker FROM e""")
def evidence_gate(spark, d):
    """Plan, searches, merged evidence, quality gate and the ticker that evidence votes for."""
    got = dispatch.gathered_evidence(_corpus(spark, d), _vector_of(spark, d, 3), _PLANS["both"], needs_tables=True)[1]
    return got.select("evidence_count", F.round("avg_score", 6).alias("avg_score"), "chunk_count", "table_count", "passed", "ticker")


_ASKED = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS question_id, a.vec_id // 100 % 4 AS p, b.vec_id AS v, b.label, (1 + list_cosine_similarity(b.e, a.e)) / 2 AS score FROM v a JOIN v b ON len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
r AS (SELECT s.*, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, 'c' || v) AS rc, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, 't' || v) AS rt,
  d.doc_id, d.source, d.lang FROM s LEFT JOIN documents d ON s.label <> 9 AND d.doc_id = v // 4),
t AS (SELECT *, 'table' AS source_type, 't' || v AS source_id FROM r WHERE (p = 1 AND rt <= 3) OR (p = 3 AND rt <= 4 AND contains(lang, 'en'))),
h AS (SELECT * FROM t UNION ALL SELECT *, 'chunk', 'c' || v FROM r WHERE (p = 0 AND rc <= 6) OR (p = 1 AND rc <= 5) OR (p = 2 AND rc <= 7) OR (p = 3 AND rc <= 7 AND contains(lang, 'en') AND question_id NOT IN (SELECT question_id FROM t)))"""


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 100 asks, by one of four plans in turn."""
    rows = _t(spark, d, "embeddings").where((F.col("vec_id") % 100 == 0) & F.col("embedding").isNotNull())
    turn = F.floor(F.col("vec_id") / 100) % 4
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (turn + 1).cast("int"))
    tools = F.split(pick("chunk_search", "table_search,chunk_search", "graph_traversal", "table_search,graph_traversal"), ",")
    return rows.select(
        F.col("vec_id").alias("question_id"), retrieve.doubles().alias("embedding"), tools.alias("tools"), pick(6, 5, 7, 7).alias("chunk_top_k"), pick(4, 3, 2, 4).alias("table_top_k"),
        F.lit(None).cast("string").alias("ticker"), F.when(turn == 3, F.lit("en")).alias("period"), (turn != 1).alias("use_causal_edges"), (turn == 1).alias("needs_tables"),
    )


@query(f"""{_ASKED} SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_type, source_id) AS INT) AS rank, source_type, source_id, doc_id, source AS doc_type, lang AS period, round(score, 6) AS score,
CASE WHEN source_type = 'table' THEN '' ELSE concat_ws(',', CASE WHEN EXISTS (SELECT 1 FROM embeddings b WHERE b.vec_id = v - 1) THEN 'c' || (v - 1) END, 'c' || (v + 1), 'L' || label, CASE WHEN p <> 1 AND label IS NOT NULL THEN 'IMPACTED:L' || (label + 1) END) END AS context FROM h""")
def retrieval_batch(spark, d):
    """Evidence of all questions in one plan."""
    hits = evi.ranked(dispatch.retrieve_all(_corpus(spark, d), _questions(spark, d)), ["src_ord", "pos"], ["question_id"])
    around = F.concat_ws(",", "prev_chunks", "next_chunks", "entities", "causal_links")
    return hits.select("question_id", "rank", "source_type", "source_id", "doc_id", "doc_type", "period", F.round("score", 6).alias("score"), around.alias("context"))


@query(f"""{_ASKED}, votes AS (SELECT question_id, upper(source) AS t, count(*) AS n, max(score) AS best FROM h WHERE source IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, n / sum(n) OVER (PARTITION BY question_id) AS share, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, best DESC) AS k FROM votes),
g AS (SELECT question_id, count(*) AS n, avg(score) AS a, count(*) FILTER (source_type = 'table') AS nt FROM h GROUP BY 1)
SELECT q.vec_id AS question_id, coalesce(g.n, 0) AS evidence_count, round(coalesce(a, 0), 6) AS avg_score, coalesce(nt, 0) AS table_count,
coalesce(g.n, 0) >= 2 AND coalesce(a, 0) >= 0.35 AND (q.vec_id // 100 % 4 <> 1 OR coalesce(nt, 0) > 0) AS passed, CASE WHEN w.n >= 2 AND share >= 0.6 THEN t END AS ticker
FROM v q LEFT JOIN g ON g.question_id = q.vec_id LEFT JOIN w ON w.question_id = q.vec_id AND k = 1 WHERE q.vec_id % 100 = 0""")
def evidence_gates(spark, d):
    """The gate's outcome and the voted ticker of all questions."""
    gates = dispatch.gather_all(_corpus(spark, d), _questions(spark, d))[1]
    return gates.select("question_id", "evidence_count", F.round("avg_score", 6).alias("avg_score"), "table_count", "passed", "ticker")


@query("""WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, (1 + list_cosine_similarity(b.e, a.e)) / 2 AS score FROM q a JOIN q b ON len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def vector_topk_all(spark, d):
    """Every vector whose id is divisible by 100 against all vectors."""
    vectors = _vectors(spark, d)
    got = retrieve.top_k_all(vectors, vectors.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "embedding"), 5)
    return got.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int"))


def _index(spark: SparkSession, d: str) -> tuple[vectorindex.Index, DataFrame, DataFrame]:
    """(inverted lists of all vectors, the vectors, those whose id is divisible by 100 as queries)."""
    vectors = _vectors(spark, d).select("id", "embedding")
    size = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    path = f"{held.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    return vectorindex.build(vectors, path, size), vectors, vectors.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "embedding")


@query("""WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, (1 + list_cosine_similarity(b.e, a.e)) / 2 AS score FROM q a JOIN q b ON len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def vector_index_exact(spark, d):
    """Every vector whose id is divisible by 100 against all, from the inverted lists that can hold its neighbours."""
    index, _, queries = _index(spark, d)
    got = vectorindex.search_exact(index, queries, 5)
    return got.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("int"))


@query("SELECT count(*) AS vectors, count(*) FILTER (vec_id % 100 = 0) AS queries, TRUE AS recall_reached, TRUE AS reads_less FROM embeddings WHERE embedding IS NOT NULL")
def vector_index_recall(spark, d):
    """Recall of the approximate search against brute force: 0.9 of the ten nearest, with fewer rows read."""
    index, vectors, queries = _index(spark, d)
    probes, share = vectorindex.probes_for(index, vectors, 10)
    got = vectorindex.recall_of(vectorindex.search(index, queries, 10, probes), retrieve.top_k_all(vectors, queries, 10))
    return vectors.where("embedding is not null").agg(
        F.count("*").alias("vectors"), F.count_if(F.col("id") % 100 == 0).alias("queries"), F.lit(got >= 0.9).alias("recall_reached"), F.lit(share < 1).alias("reads_less")
    )


@query("""SELECT doc_id // 32 AS g, string_agg('[chunk | ' || coalesce(source, 'None') || ' | ' || coalesce(lang, 'None') || ' | None | score=' || coalesce(CAST(n_chars AS VARCHAR), 'None') || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id) AS serialised
FROM documents GROUP BY 1""")
def evidence_documents(spark, d):
    """All documents as evidence texts, 32 consecutive ids a question."""
    rows = _t(spark, d, "documents").select(F.floor(F.col("doc_id") / 32).alias("g"), "doc_id", F.lit("chunk").alias("source_type"), F.col("source").alias("doc_type"), F.col("lang").alias("period"), F.lit(None).cast("string").alias("section_type"), F.col("n_chars").alias("score"), "text")
    return evi.serialised(rows, "g", "doc_id")


@query("""WITH old AS (SELECT c_name AS name, CASE WHEN c_acctbal >= 0 THEN 'A' || c_custkey END AS t FROM customer), new AS (SELECT c_name AS name, min('B' || c_nationkey) AS t FROM customer WHERE c_mktsegment < 'C' GROUP BY 1)
SELECT coalesce(old.name, new.name) AS name, coalesce(old.t, new.t) AS ticker FROM old FULL JOIN new ON old.name = new.name""")
def upsert_companies(spark, d):
    """All customers are companies; those of some segments are filed anew."""
    c = _t(spark, d, "customer")
    old = c.select(F.col("c_name").alias("name"), F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("A"), "c_custkey")).alias("ticker"))
    return graph.upsert_company(old, c.where("c_mktsegment < 'C'").select(F.col("c_name").alias("name"), F.concat(F.lit("B"), "c_nationkey").alias("ticker")))


@query("""WITH n AS (SELECT o_custkey, count(*) AS evidence FROM orders GROUP BY 1), k AS (SELECT o_custkey, least(6, count(DISTINCT o_orderpriority)) AS cited FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT c_custkey, coalesce(cited, 0) AS citations, coalesce(evidence, 0) AS evidence, round(coalesce(cited, 0) / greatest(1, coalesce(evidence, 0)), 6) AS coverage FROM customer LEFT JOIN n ON n.o_custkey = c_custkey LEFT JOIN k ON k.o_custkey = c_custkey""")
def citation_coverage(spark, d):
    orders = _t(spark, d, "orders")
    rows = orders.select("o_custkey", F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderstatus") == "O", F.lit("chunk")).alias("source_type"), F.col("o_orderpriority").alias("source_id"), F.lit(0.0).alias("score"), F.lit("t").alias("title"))
    cited = evi.citations(rows, "o_custkey", "pos").groupBy("o_custkey").agg(F.count("*").alias("cited"))
    n = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    both = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")).join(n, "o_custkey", "left").join(cited, "o_custkey", "left")
    cited_, n_ = F.coalesce("cited", F.lit(0)), F.coalesce("n", F.lit(0))
    return both.select(F.col("o_custkey").alias("c_custkey"), cited_.alias("citations"), n_.alias("evidence"), F.round(dispatch.citation_coverage(cited_, n_), 6).alias("coverage"))


@query("SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS question FROM conversations WHERE trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) <> ''")
def question_required(spark, d):
    rows = _t(spark, d, "conversations").where(tx.collapse(F.col("text")) != "")
    return rows.select("conv_id", "turn", dispatch.require_question(F.col("text")).alias("question"))


@query("SELECT string_agg('- ' || upper(c_mktsegment) || ': ' || n, chr(10) ORDER BY upper(c_mktsegment)) AS catalog FROM (SELECT c_mktsegment, min(c_name) AS n FROM customer GROUP BY 1)")
def catalog_text(spark, d):
    rows = _t(spark, d, "customer").groupBy("c_mktsegment").agg(F.min("c_name").alias("name"))
    return dispatch.catalog_text(rows.select(F.upper("c_mktsegment").alias("ticker"), "name"))


@query("""SELECT o_custkey, string_agg('{"source_id":"' || o_orderkey || '","score":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE CAST(o_orderkey % 10 AS VARCHAR) END || '}', chr(10) ORDER BY o_orderkey) AS paths FROM orders GROUP BY 1""")
def path_text(spark, d):
    rows = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("string").alias("source_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 10).alias("score"))
    return dispatch.path_text(rows, "o_custkey", "o_orderkey", ["source_id", "score"])


@query("""WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'non_financial' WHEN 'F' THEN 'domain_uncertain' END AS r, CASE WHEN left(o_orderpriority, 1) < '3' THEN o_orderpriority ELSE '' END AS q FROM orders)
SELECT o_orderkey, r AS blocked_reason, left(CASE r WHEN 'non_financial' THEN 'This assistant is configured' WHEN 'domain_uncertain' THEN 'The request appears ambiguous' END, 20) AS answer, CASE WHEN r IS NOT NULL THEN 'low' END AS confidence,
CASE r WHEN 'non_financial' THEN 'Ask a financial question tied to a company or reporting period available in the dataset.' WHEN 'domain_uncertain' THEN coalesce(nullif(q, ''), 'Which company, filing period, or financial metric should be analyzed?') END AS ask FROM x""")
def blocked_responses(spark, d):
    status, first = F.col("o_orderstatus"), F.left("o_orderpriority", F.lit(1))
    rows = _t(spark, d, "orders").select("o_orderkey", F.when(status == "O", F.lit("non_financial")).when(status == "F", F.lit("domain_uncertain")).alias("blocked_reason"), F.when(first < "3", F.col("o_orderpriority")).otherwise(F.lit("")).alias("clarification_question"))
    return dispatch.blocked_response(rows).select("o_orderkey", "blocked_reason", F.left("answer", F.lit(20)).alias("answer"), "confidence", F.get("open_questions", F.lit(0)).alias("ask"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN 'X' END, CASE WHEN n_nationkey IS NOT NULL THEN 'N' || (o_custkey % 40) END) AS ticker, CASE WHEN o_orderstatus = 'F' THEN 'q' ELSE o_orderpriority END AS question
FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 40""")
def resolved_tickers(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit("X")).alias("explicit_ticker"), F.concat(F.lit(" n"), F.col("o_custkey") % 40).alias("model_ticker"), F.lit("q").alias("question"), F.when(F.col("o_orderstatus") == "F", F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("model_question"))
    known = _t(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("ticker"))
    return dispatch.resolved(rows, known).select("o_orderkey", "ticker", "question")


@query("""SELECT conv_id, turn, coalesce(text, '') AS content, CASE WHEN role = 'user' THEN turn END AS score FROM conversations""")
def result_items(spark, d):
    meta = F.when(F.col("role") == "user", F.to_json(F.struct(F.col("turn").cast("long").alias("score")))).otherwise(F.lit("none"))
    item = dispatch.result_item(F.col("text"), meta, "struct<score bigint>").alias("i")
    return _t(spark, d, "conversations").select("conv_id", "turn", item).select("conv_id", "turn", "i.content", "i.metadata.score")


def _states(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("int").alias("n"), F.sort_array(F.collect_set("l_returnflag")).alias("modes"))
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    has = F.col("n").isNotNull()
    cited = F.transform(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(6))), lambda i: F.struct(F.lit("chunk").alias("source_type"), i.cast("string").alias("source_id")))
    return _t(spark, d, "orders").join(n, "o_orderkey", "left").select(
        k.alias("case_id"),
        F.when(has, F.struct(F.when(status != "P", F.col("o_orderpriority")).alias("answer"), F.lit("medium").alias("confidence"), F.lit(None).cast("array<string>").alias("bullets"), cited.alias("citations"))).alias("final_answer"),
        F.when(has, cited).alias("evidence"), F.when(has, F.concat(F.array(F.lit("  ")), F.transform("modes", lambda m: F.concat(F.lit(" "), m)))).alias("chunk_hits"), F.when(status == "F", F.array(F.lit("table "))).alias("table_hits"),
        F.struct(F.when(status == "O", F.col("n")).otherwise(F.lit(0)).alias("evidence_count"), F.when(has, F.col("n") / 10.0).alias("avg_score")).alias("retrieval_quality"),
        F.when(status != "F", F.struct(F.lit(0.5).alias("citation_coverage"), F.when(status == "O", F.lit("high")).otherwise(F.lit("")).alias("confidence"), (k % 4 / 4.0).alias("claim_support_ratio"), F.col("n").alias("claim_total_count"), F.lit(None).cast("int").alias("unsupported_claim_count"), (status == "O").alias("confidence_overridden"))).alias("evaluation_signals"),
        F.struct(F.when(status == "O", F.lit(True)).alias("domain_gate_passed"), F.lit(None).cast("string").alias("domain_confidence"), F.lit("r").alias("domain_reason"), F.array(F.lit(" a "), F.lit(" "), F.col("o_orderpriority")).alias("domain_signals"), F.lit(None).cast("boolean").alias("domain_adjudication_used")).alias("policy_flags"),
        F.when(status == "P", F.lit("uncertain")).alias("domain_status"), F.when(k % 3 == 0, (k % 4).cast("int")).alias("retry_count"), F.lit(None).cast("string").alias("error_class"), F.when(status == "P", F.lit("domain_uncertain")).alias("blocked_reason"),
    )


_STATE = """n AS (SELECT l_orderkey, count(*) AS n, list_sort(list(DISTINCT l_returnflag)) AS modes FROM lineitem GROUP BY 1), st AS (SELECT o_orderkey AS case_id, o_orderstatus AS s, o_orderpriority AS p, n, modes FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)"""


@query(f"""WITH {_STATE} SELECT case_id, CASE WHEN case_id % 3 = 0 THEN case_id % 4 ELSE 0 END AS retry_count, '' AS error_class, CASE WHEN s = 'P' THEN 'domain_uncertain' ELSE '' END AS blocked_reason, CASE WHEN s = 'P' THEN 'uncertain' ELSE '' END AS domain_status,
s = 'O' AS domain_gate_passed, '' AS domain_confidence, 'r' AS domain_reason, 'a, ' || p AS domain_signals, FALSE AS domain_adjudication_used, CASE WHEN s = 'O' THEN coalesce(n, 0) ELSE CASE WHEN n IS NULL THEN 0 ELSE least(n, 6) END END AS retrieval_evidence_count, coalesce(n / 10.0::DOUBLE, 0.0) AS retrieval_avg_score,
CASE WHEN n IS NULL THEN 0 ELSE least(n, 6) END AS citation_count, CASE WHEN s <> 'F' THEN 0.5 ELSE 0.0 END AS citation_coverage, CASE WHEN s = 'O' THEN 'high' WHEN n IS NOT NULL THEN 'medium' ELSE '' END AS answer_confidence, CASE WHEN s <> 'F' THEN (case_id % 4) / 4.0::DOUBLE ELSE 0.0 END AS claim_support_ratio,
CASE WHEN s <> 'F' THEN coalesce(n, 0) ELSE 0 END AS claim_total_count, 0 AS unsupported_claim_count, s = 'O' AS confidence_overridden FROM st""")
def diagnostics(spark, d):
    return ev.diagnostics(_states(spark, d))


@query(f"""WITH {_STATE}, t AS (SELECT *, list_concat(coalesce(modes, []), CASE WHEN s = 'F' THEN ['table'] ELSE [] END) AS c FROM st)
SELECT case_id, p AS user_input, CASE WHEN len(c) = 0 THEN '[no context retrieved]' ELSE array_to_string(list_transform(c, lambda x: trim(x)), '|') END AS contexts, CASE WHEN n IS NOT NULL AND s <> 'P' THEN p ELSE '' END AS response, CASE WHEN s = 'O' THEN 'ref' END AS reference FROM t""")
def eval_samples(spark, d):
    cases = _t(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("question"), F.when(F.col("o_orderstatus") == "O", F.lit("ref")).otherwise(F.lit("")).alias("reference"))
    return ev.samples(_states(spark, d), cases).select("case_id", "user_input", F.array_join("retrieved_contexts", "|").alias("contexts"), "response", "reference")


@query(f"""WITH {_STATE} SELECT case_id, CASE WHEN s = 'P' THEN '' ELSE 'robustness' END AS category, CASE WHEN s = 'P' THEN 'financial_supported' ELSE 'non_financial' END AS expected_domain, o_totalprice AS faithfulness,
CASE WHEN case_id % 3 = 0 THEN case_id % 4 ELSE 0 END AS retry_count FROM st JOIN orders ON o_orderkey = case_id""")
def result_rows(spark, d):
    orders = _t(spark, d, "orders").withColumnRenamed("o_orderkey", "case_id")
    cases = orders.select("case_id", F.when(F.col("o_orderstatus") != "P", F.lit("robustness")).alias("category"), F.lit("").alias("expected_domain"))
    got = ev.result_rows(orders.select("case_id", F.col("o_totalprice").alias("faithfulness")), ev.diagnostics(_states(spark, d)), cases)
    return got.select("case_id", "category", "expected_domain", "faithfulness", "retry_count")


@query("SELECT CAST(sum(CASE WHEN event_type = 'click' THEN 0 ELSE event_id % 4 END) AS BIGINT) AS total_retries, round(avg(CASE WHEN event_type = 'click' THEN 0 ELSE event_id % 4 END), 6) AS mean_retries FROM events")
def retry_totals(spark, d):
    return ev.retry_totals(_t(spark, d, "events").select(F.when(F.col("event_type") == "click", F.lit("none")).otherwise((F.col("event_id") % 4).cast("string")).alias("retry_count")))


@query("SELECT round(avg(l_discount), 6) AS mean_support, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_linenumber ELSE 0 END) AS BIGINT) AS unsupported, round(avg(CASE WHEN l_returnflag <> 'R' THEN l_tax END), 6) AS mean_coverage FROM lineitem")
def support_means(spark, d):
    flag = F.col("l_returnflag") != "R"
    return ev.support_means(_t(spark, d, "lineitem").select(F.col("l_discount").alias("claim_support_ratio"), F.when(flag, F.col("l_linenumber").cast("string")).otherwise(F.lit("x")).alias("unsupported_claim_count"), F.when(flag, F.col("l_tax")).otherwise(F.lit(float("nan"))).alias("citation_coverage")))


@query("""WITH x AS (SELECT event_id, 'value' AS metric, CASE WHEN event_type = 'click' THEN 0 ELSE value END AS x FROM events UNION ALL SELECT event_id, 'user_id', user_id % 5 FROM events)
SELECT metric, event_id FROM x WHERE x = 0 QUALIFY row_number() OVER (PARTITION BY metric ORDER BY event_id) <= 2""")
def zero_cases(spark, d):
    rows = _t(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", F.lit(0.0)).otherwise(F.col("value")).alias("value"), (F.col("user_id") % 5).alias("user_id"))
    return ev.zero_cases(rows, ["value", "user_id"], "event_id")


@query("""WITH n AS (SELECT o_custkey, count(*) AS n, min(o_orderdate) AS t FROM orders GROUP BY 1) SELECT 'j' || o_custkey AS id, 'QUEUED' AS status, 0 AS progress, strftime(CAST(t AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%f') AS created_at, CAST(n AS INT) AS documents_count FROM n""")
def job_rows(spark, d):
    asked = _t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("document_ids"), F.min("o_orderdate").alias("t"))
    return jobs.new_jobs(asked, F.concat(F.lit("j"), "o_custkey"), F.col("t"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'RUNNING' WHEN o_orderstatus = 'F' THEN 'QUEUED' END AS status, CASE WHEN left(o_orderpriority, 1) = '1' THEN 'PARSING' END AS stage, CAST(CASE WHEN o_orderstatus = 'O' THEN o_orderkey % 100 ELSE 0 END AS INT) AS progress,
CAST(o_orderdate AS TIMESTAMP) AS created_at, CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS TIMESTAMP) END AS started_at, CAST(0 AS INT) AS n_stats FROM orders""")
def job_responses(spark, d):
    status, day = F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(status == "O", F.lit("RUNNING")).when(status == "P", F.lit("ODD")).alias("status"), F.when(F.left("o_orderpriority", F.lit(1)) == "1", F.lit("PARSING")).otherwise(F.lit("")).alias("stage"), F.when(status == "O", F.col("o_orderkey") % 100).alias("progress"), day.alias("created_at"), F.when(status == "O", F.concat(day, F.lit(".000000"))).alias("started_at"))
    return jobs.job_response(rows).select("id", "status", "stage", "progress", "created_at", "started_at", F.size("stats").alias("n_stats"))


@query("""SELECT o_orderkey AS id, 'f' || o_orderkey AS filename, 'UPLOADED' AS status, o_orderpriority AS doc_type, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%f') AS created_at FROM orders""")
def document_rows(spark, d):
    key = F.col("o_orderkey")
    uploads = _t(spark, d, "orders").select(key.alias("id"), F.concat(F.lit("f"), key).alias("filename"), F.concat(F.lit("/f"), key).alias("file_path"), F.lit("text/plain").alias("mime_type"), key.alias("size_bytes"), F.lit("T").alias("ticker"), F.lit("N").alias("company_name"), F.col("o_orderpriority").alias("doc_type"), F.lit("2025").alias("period"), "o_orderdate")
    return jobs.new_documents(uploads, F.col("o_orderdate")).select("id", "filename", "status", "doc_type", "created_at")


@query("""WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS doc_type, o_orderdate AS created_at, o_orderstatus AS st FROM orders)
SELECT id, doc_type, created_at, 'UPLOADED' AS status, (SELECT count(*) FROM x WHERE doc_type = '2-HIGH') AS total FROM x WHERE doc_type = '2-HIGH' ORDER BY created_at DESC, id LIMIT 20 OFFSET 10""")
def document_listing(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("doc_type"), F.col("o_orderpriority").alias("type"), F.col("o_orderdate").alias("created_at"))
    total, shown = jobs.list_documents(rows, doc_type="2-HIGH", limit=20, offset=10)
    return shown.select("id", "doc_type", "created_at", "status").withColumn("total", total.scalar())


@query("""SELECT c_custkey AS id, CASE WHEN o IS NULL THEN 'old' ELSE o END AS type, c_mktsegment AS kept, f.company IS NOT NULL OR c_nationkey > 10 AS filed FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS o, 'C' || o_custkey AS company FROM orders GROUP BY o_custkey) f ON o_custkey = c_custkey""")
def filed_documents(spark, d):
    c, orders = _t(spark, d, "customer"), _t(spark, d, "orders")
    none = F.lit(None).cast("string")
    documents = c.select(F.col("c_custkey").alias("id"), F.lit("old").alias("type"), none.alias("period"), none.alias("filename"), none.alias("file_path"), F.col("c_mktsegment").alias("kept"))
    new = orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("type"), none.alias("period"), none.alias("filename"), none.alias("file_path"), F.concat(F.lit("C"), "o_custkey").alias("company_name"), F.lit("T").alias("ticker"))
    companies = c.select(F.concat(F.lit("C"), "c_custkey").alias("name"), F.lit("own").alias("ticker"))
    filed = c.where("c_nationkey > 10").select(F.concat(F.lit("C"), "c_custkey").alias("company"), F.col("c_custkey").alias("doc_id"))
    _, docs, edges = graph.upsert_documents(companies, documents, filed, new)
    there = edges.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    return docs.join(there, "id", "left").select("id", "type", "kept", F.coalesce(F.col("n") == 1, F.lit(False)).alias("filed"))


_LINKS = """l AS (SELECT DISTINCT o_orderkey AS section_id, o_orderkey || '{0}' AS id FROM orders WHERE o_orderstatus <> 'P')
SELECT section_id, id, CAST(CASE WHEN left(o_orderpriority, 1) < '3' THEN 7 ELSE 1 END AS INT) AS sequence FROM l JOIN orders ON o_orderkey = section_id WHERE left(o_orderpriority, 1) < '3' OR o_orderstatus = 'O'"""


def _children(spark: SparkSession, d: str, tail: str) -> DataFrame:
    orders, first = _t(spark, d, "orders"), F.left("o_orderpriority", F.lit(1))
    id_ = F.concat(F.col("o_orderkey"), F.lit(tail))
    row = [id_.alias("id"), F.col("o_orderkey").alias("section_id")]
    links = orders.where("o_orderstatus = 'O'").select(*row, F.lit(1).alias("sequence"))
    sections = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"))
    new = orders.where(first < "3").select(*row, F.lit(7).alias("sequence"), F.col("o_orderpriority").alias("text"))
    return graph.upsert_children(links.withColumn("text", F.lit("old")), links, new, sections)[1].select("section_id", "id", "sequence")


@query(f"WITH {_LINKS.format('c')}")
def chunk_links(spark, d):
    """Links of chunks after new ones came; those of a section that isn't there are dropped."""
    return _children(spark, d, "c")


@query(f"WITH {_LINKS.format('t')}")
def table_links(spark, d):
    return _children(spark, d, "t")


@query("""WITH c AS (SELECT o_custkey AS doc_id, o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey) AS seq FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT doc_id, 'k' || seq AS src, 'k' || lead(seq) OVER (PARTITION BY doc_id ORDER BY seq) AS dst FROM c QUALIFY dst IS NOT NULL""")
def document_chain(spark, d):
    from pyspark.sql import Window

    orders, items = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey", "l_linenumber", "l_partkey"))
    rows = orders.join(items, orders.o_orderkey == items.l_orderkey).select("o_custkey", F.col("o_orderkey").alias("section_id"), seq.alias("sequence"))
    has_chunk = rows.select("section_id", F.concat(F.lit("k"), "sequence").alias("id"), "sequence")
    return graph.document_chain(orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("section_id")), has_chunk)


@query("SELECT CAST(count(*) AS BIGINT) AS entities FROM lineitem")
def entity_totals(spark, d):
    got = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("entities"))
    return graph.entity_total(got)


@query("""SELECT 'section_id' AS "constraint", '{"id":' || o_custkey || '}' AS key, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1 UNION ALL SELECT 'company_name', '{"name":"' || c_mktsegment || '"}', count(*) FROM customer GROUP BY c_mktsegment HAVING count(*) > 1""")
def key_violations(spark, d):
    schema = graph.create_schema(graph.create_schema())
    return schema.violations({"section": _t(spark, d, "orders").select(F.col("o_custkey").alias("id")), "chunk": _t(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "company": _t(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.lit(None).cast("string").alias("ticker"))})


@query("""SELECT 'chunk' AS kind, 'c' || conv_id || '_' || turn AS id, length(text) AS n FROM conversations UNION ALL SELECT 'table', 't' || page_id, length(html) + 3 FROM pages""")
def tagged_texts(spark, d):
    chunks = _t(spark, d, "conversations").select(F.concat_ws("_", F.concat(F.lit("c"), "conv_id"), "turn").alias("id"), "text")
    tables = _t(spark, d, "pages").select(F.concat(F.lit("t"), "page_id").alias("id"), F.concat(F.lit("[] "), "html").alias("context"))
    return ingest.tagged_texts(chunks, tables).select("kind", "id", F.length("text").cast("bigint").alias("n"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 4 < 3 THEN trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) ELSE '' END AS question FROM conversations""")
def message_payloads(spark, d):
    """Questions of payloads that are lists, objects with a list, or neither."""
    one = F.struct(F.lit(None).cast("string").alias("type"), F.upper("role").alias("role"), F.col("text").alias("content"))
    listed = F.to_json(F.array(one, F.struct(F.lit("ai").alias("type"), F.lit(None).cast("string").alias("role"), F.lit("a").alias("content"))))
    payload = F.when(F.col("turn") % 4 == 0, listed).when(F.col("turn") % 4 < 3, F.concat(F.lit('{"messages":'), listed, F.lit("}"))).otherwise(F.lit('"text"'))
    return _t(spark, d, "conversations").select("conv_id", "turn", tx.latest_human(tx.messages_of(payload)).alias("question"))


@query("""SELECT conv_id, turn, text AS shown, length(text) + CASE WHEN role = 'user' THEN 56 ELSE 0 END AS n FROM conversations WHERE text IS NOT NULL""")
def hidden_directives(spark, d):
    told = tx.with_directive(F.col("text"), F.when(F.col("role") == "user", F.lit("do")))
    rows = _t(spark, d, "conversations").where("text is not null").select("conv_id", "turn", told.alias("t"))
    return rows.select("conv_id", "turn", tx.without_directive(F.col("t")).alias("shown"), F.length("t").cast("bigint").alias("n"))


@query("""SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' WHEN len(string_split(text, chr(10))) > 4 THEN array_to_string(string_split(text, chr(10))[1:4], chr(10)) || chr(10) || '...' ELSE text END AS folded,
left(coalesce(text, 'None'), 70) || '...' AS snippet, array_to_string(list_transform(string_split(text, ' ')[1:2], lambda x: CASE WHEN length(x) > 5 THEN left(x, 5) || '...' ELSE x END), ' ') AS items FROM documents""")
def folded_texts(spark, d):
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", tx.folded(t).alias("folded"), tx.snippet(t, 70).alias("snippet"), F.array_join(tx.first_items(F.split(t, " ", -1), 2, 5), " ").alias("items"))


@query("SELECT DISTINCT l_linenumber, l_returnflag || ' ' || l_linestatus AS shown FROM lineitem")
def display_names(spark, d):
    return _t(spark, d, "lineitem").select("l_linenumber", F.concat_ws("_", F.lower("l_returnflag"), F.lower("l_linestatus")).alias("x")).distinct().select("l_linenumber", tx.display_name(F.col("x")).alias("shown"))


_CALLS = """a AS (SELECT l_orderkey AS call, l_linenumber AS line, CASE WHEN l_returnflag = 'R' OR q IN (1, 2) THEN 'transient' WHEN l_returnflag = 'A' AND q = 3 THEN 'validation'
  WHEN l_returnflag = 'A' AND q = 4 THEN 'database' WHEN l_returnflag = 'A' THEN 'runtime' END AS class FROM (SELECT *, l_quantity % 5 AS q FROM lineitem)),
k AS (SELECT call, row_number() OVER (PARTITION BY call ORDER BY line, class NULLS FIRST) AS n, coalesce(class, 'ok') AS class FROM a)"""


@query(f"""WITH {_CALLS}, m AS (SELECT *, coalesce(bool_and(class = 'transient') OVER w, true) AS q, coalesce(bool_and(class <> 'ok') OVER w, true) AS g FROM k WHERE n <= 3 WINDOW w AS (PARTITION BY call ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT call, CAST(max(n) FILTER (q) - 1 AS INT) AS retries, arg_max(class, n) FILTER (q) AS outcome, CAST(max(n) FILTER (g) - 1 AS INT) AS step_retries, arg_max(class, n) FILTER (g) AS step_outcome FROM m GROUP BY 1)
SELECT call, retries, outcome, 0.2::DOUBLE * (pow(2, retries) - 1) AS waited, step_retries, step_outcome, pow(2, step_retries) - 1 AS step_least, pow(2, step_retries) - 1 + step_retries * 0.25::DOUBLE AS step_most FROM r""")
def call_retries(spark, d):
    """Orders as calls and their lines as what attempts would give: how often a query and an ingestion step try, and how long they wait."""
    q = F.col("l_quantity") % 5
    of = lambda *names: F.array(*map(F.lit, names))
    types = F.when(F.col("l_returnflag") == "R", of("ServiceUnavailable", "DatabaseError", "Exception")).when(q == 1, of("ConnectionResetError", "ConnectionError", "OSError")).when(q == 2, of("TimeoutError", "OSError"))
    failed = F.when(q == 3, of("UnicodeError", "ValueError")).when(q == 4, of("ClientError", "DatabaseError")).otherwise(of("KeyError", "LookupError"))
    types = types.when(F.col("l_returnflag") == "A", failed)
    rows = _t(spark, d, "lineitem")
    asked = retry.replay(rows, "l_orderkey", "l_linenumber", types)
    steps = retry.replay(rows, "l_orderkey", "l_linenumber", types, any_error=True).select("call", F.col("retries").alias("step_retries"), F.col("outcome").alias("step_outcome"))
    least, most = retry.ingestion_wait(F.col("step_retries"))
    return asked.join(steps, "call").select("call", "retries", "outcome", retry.query_wait(F.col("retries")).alias("waited"), "step_retries", "step_outcome", least.alias("step_least"), most.alias("step_most"))


@query("""SELECT user_id, arg_max(event_type, row(ts, event_type)) AS state, max(ts) AS updated_at, CASE WHEN arg_max(event_type, row(ts, event_type)) IN ('click', 'view') THEN 3 ELSE 10 END AS poll FROM events GROUP BY 1""")
def poll_intervals(spark, d):
    """Users' latest events, and seconds until they are asked for again."""
    latest = status.latest_status(_t(spark, d, "events"), "user_id", "ts", "event_type")
    return latest.select("user_id", F.col("event_type").alias("state"), "updated_at", status.poll_after(F.col("event_type").isin("click", "view")).alias("poll"))


@query("SELECT coalesce(nullif(lang, ''), 'none') AS value, count(*) AS count FROM documents GROUP BY 1")
def summary_round_trip(spark, d):
    """Documents counted by language, written as JSON and read again."""
    path = f"{held.shared_folder(spark)}/summary-{uuid.uuid4().hex}"
    files.write_json(ev.value_counts(_t(spark, d, "documents"), "lang"), path)
    return spark.read.schema("value string, count long").json(path)


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, CAST(ts AS TIMESTAMP) AS parsed, CAST(NULL AS TIMESTAMP) AS broken FROM events")
def iso_times(spark, d):
    iso = tx.utc_iso(F.col("ts"))
    return _t(spark, d, "events").select("event_id", iso.alias("iso"), tx.parse_iso(F.concat(F.lit(" "), iso)).alias("parsed"), tx.parse_iso(F.lit("soon")).alias("broken"))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 120 BETWEEN 0 AND 100 AND length(o_orderpriority) BETWEEN 1 AND 10 AND o_custkey % 25 BETWEEN 1 AND 20)")
def invalid_rows(spark, d):
    k = F.col("o_orderkey")
    ok = jobs.checked_job(k % 120) & jobs.checked_upload(F.col("o_orderpriority"), F.lit("n")) & jobs.checked_plan(F.col("o_custkey") % 25, F.lit(0), F.lit(2))
    return jobs.split_valid(_t(spark, d, "orders"), ok)[1].select("o_orderkey")


@query("""WITH x AS (SELECT user_id, event_id, ts, ['QUEUED', 'RUNNING', 'COMPLETED', 'FAILED', 'CANCELLED'][1 + event_id % 5] AS status FROM events), y AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM x)
SELECT user_id, event_id, status, previous FROM y WHERE (previous IS NULL AND status <> 'QUEUED') OR (previous IS NOT NULL AND previous <> status AND NOT ((previous = 'QUEUED' AND status IN ('RUNNING', 'CANCELLED', 'FAILED')) OR (previous = 'RUNNING' AND status IN ('COMPLETED', 'FAILED', 'CANCELLED'))))""")
def illegal_transitions(spark, d):
    status = F.element_at(F.lit(["QUEUED", "RUNNING", "COMPLETED", "FAILED", "CANCELLED"]), (1 + F.col("event_id") % 5).cast("int"))
    return jobs.illegal_jobs(_t(spark, d, "events").select("user_id", "event_id", "ts", status.alias("status")), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "status", "previous")


@query("""WITH q AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 10) SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (FROM q) THEN 'RUNNING' WHEN o_orderstatus = 'O' THEN 'QUEUED' ELSE 'COMPLETED' END AS status FROM orders""")
def job_claims(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "O", F.lit("QUEUED")).otherwise(F.lit("COMPLETED")).alias("status"))
    return jobs.claim(rows, 10).select("id", "status")


@query("""WITH m AS (SELECT conv_id, turn, role FROM conversations), c AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM m), f AS (SELECT conv_id, role, min(turn) AS first FROM c WHERE next IS NOT NULL AND next <> role GROUP BY 1, 2),
g AS (SELECT conv_id, string_agg(role, ',' ORDER BY first) AS completed FROM f GROUP BY 1) SELECT m.conv_id, arg_max(role, turn) AS active, coalesce(any_value(completed), '') AS completed FROM m LEFT JOIN g USING (conv_id) GROUP BY 1""")
def stream_steps(spark, d):
    """Steps of a stream of server-sent events, one for each message of a conversation."""
    got = sse.steps(sse.nodes(sse.events(_event_streams(spark, d), "conv_id", "raw"), "conv_id"), "conv_id")
    return got.select("conv_id", "active", F.array_join("completed", ",").alias("completed"))


def _event_streams(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, raw): an event for each message, then one that isn't whole."""
    data = F.concat(F.lit('[{}, {"langgraph_node": "'), F.col("role"), F.lit('"}]'))
    block = F.concat(F.lit("id: 1\nevent: messages\ndata: "), data, F.lit("\n\n"))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "")
    return _t(spark, d, "conversations").groupBy("conv_id").agg(F.concat(texts, F.lit("event: messages\ndata: [{}, {\"langgraph_node\": \"cut")).alias("raw"))


@query(_SQL["illegal_transitions"])
def illegal_transitions_stream(spark, d):
    """illegal_transitions from a replayed stream of the events, a quarter of the time a batch."""
    status = F.element_at(F.lit(["QUEUED", "RUNNING", "COMPLETED", "FAILED", "CANCELLED"]), (1 + F.col("event_id") % 5).cast("int"))
    rows = _t(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))
    stream = stateful.as_files(rows, 4, stateful.quarters(rows, "ts"))(spark)
    got = stateful.replayed(stateful.lifecycles(stream, "user_id", "ts", "event_id", "status"))
    return got.select(F.col("key").alias("user_id"), F.col("at").alias("event_id"), "status", "previous")


@query(_SQL["stream_steps"])
def stream_steps_stream(spark, d):
    """stream_steps from the bytes of the streams, cut into pieces of 61 that come in four batches."""
    pieces = stateful.cut(_event_streams(spark, d), "conv_id", "raw", 61)
    stream = stateful.as_files(pieces, 4, F.pmod(F.xxhash64("key", "turn"), F.lit(4)))(spark)
    got = stateful.replayed(stateful.server_events(stream, "key", "turn", "piece")).withColumnRenamed("key", "conv_id")
    return sse.steps(sse.nodes(got, "conv_id"), "conv_id").select("conv_id", "active", F.array_join("completed", ",").alias("completed"))


def _table(spark: SparkSession, schema: str, key: list[str], buckets: int = 16) -> store.KeyedTable:
    return store.KeyedTable.create(spark, f"{held.shared_folder(spark)}/table-{uuid.uuid4().hex}", schema, key, buckets)


@query(_SQL["upsert_rows"])
def upsert_batches(spark, d):
    """upsert_rows by batches that are recorded: all orders, a change of some, and the change once more."""
    old = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = old.where(F.col("o_orderkey") % 4 == 0).select("o_orderkey", F.lit("N").alias("status"), (F.col("price") * 2).alias("price"))
    table = _table(spark, f"o_orderkey {old.schema['o_orderkey'].dataType.simpleString()}, status string, price {old.schema['price'].dataType.simpleString()}", ["o_orderkey"])
    for batch, rows in (("load", old), ("change", new), ("change", new)):
        table.apply(batch, rows, ["price"])
    return table.read()


@query(_SQL["job_state_fold"])
def job_state_batches(spark, d):
    """job_state_fold batch by batch: a quarter of the events each, the second one twice; nulls change nothing."""
    k = F.col("event_id")
    log = _t(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(k % 3 != 0, F.col("event_type")).alias("status"), F.when(k % 2 == 0, F.col("value")).alias("value"), F.col("ts").cast("timestamp").alias("updated_at"))
    log = log.withColumn("quarter", stateful.quarters(log, "ts"))
    table = _table(spark, f"user_id {log.schema['user_id'].dataType.simpleString()}, status string, value double, updated_at timestamp", ["user_id"])
    for q in (0, 1, 1, 2, 3):
        rows = jobs.fold(log.where(F.col("quarter") == q), "user_id", ["ts", "event_id"], ["status", "value", "updated_at"])
        table.apply(f"quarter {q}", rows, ["updated_at"], store.update)
    return table.read()


@query(_SQL["next_chain"])
def chain_repair(spark, d):
    """next_chain, from the chain of what was there before some messages went and others came."""
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("turn").cast("double").alias("sequence"))
    late = (F.col("doc_id") % 3 == 0) & (F.col("sequence") % 3 == 1)
    extra = rows.where((F.col("doc_id") % 4 == 1) & (F.col("sequence") % 2 == 0)).select("doc_id", F.concat("id", F.lit("x")).alias("id"), F.col("sequence") + 0.5)
    before = rows.where(~late).unionAll(extra)
    chain = retrieve.next_links(before, "doc_id", ["sequence", "id"], "id")
    go, come = graph.repair_chain(chain, before, rows.where(late), extra)
    return graph.repaired(chain, go, come).select(F.col("doc_id").alias("conv_id"), "src", "dst")


_NEWEST = [("o_orderdate", True), ("o_orderkey", False)]


@query("SELECT (n - 1) // 20 AS page, o_orderdate, o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F') WHERE (n - 1) % 20 = 0")
def page_bounds(spark, d):
    """Where each page of the finished orders, newest first, begins."""
    return jobs.page_bounds(_t(spark, d, "orders").where("o_orderstatus = 'F'"), _NEWEST, 20)


@query(_SQL["list_documents_page"])
def list_documents_keyset(spark, d):
    """list_documents_page by the bounds of its page, without the rows before."""
    rows = _t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return jobs.page_at(rows, jobs.page_bounds(rows, _NEWEST, 20), _NEWEST, 20, 2)
