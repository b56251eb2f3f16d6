"""Registered queries of the library's own operators over the driver's tables, with their SQL.

Chunk vectors are ``embeddings`` (ticker T<label>), documents are ``documents`` (company
from source, period from lang), sections and chunks come from orders and line items,
entities from part, supplier and nation, messages from ``conversations``, status events
from ``events``, and gate outcomes from ``labels``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import evaluate as ev
from .operators import evidence as evi
from .operators import graph, guard, ingest, jobs, respond, retrieve
from .plans import tools
from .sources import files

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("doc_id"), F.concat(F.lit("T"), "label").alias("ticker"), "embedding")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.col("source").alias("doc_type"), F.col("lang").alias("period"), "text")


def _vector_of(spark: SparkSession, d: str, id_: int) -> list[float]:
    row = _t(spark, d, "embeddings").where(F.col("vec_id") == id_).select("embedding").first()
    return [float(x) for x in row[0]] if row else [0.0]


_SCORED = """v AS (SELECT vec_id AS id, 'T'||label AS ticker, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s{q} AS (SELECT v.id, v.ticker, (1 + list_cosine_similarity(v.e, (SELECT e FROM v WHERE id = {q}))) / 2 AS score FROM v)"""


@query(f"WITH {_SCORED.format(q=0)} SELECT id, ticker, round(score, 6) AS score FROM s0 ORDER BY s0.score DESC, id LIMIT 8")
def vector_topk(spark, d):
    return retrieve.top_k(_vectors(spark, d), _vector_of(spark, d, 0), 8).select("id", "ticker", F.round("score", 6).alias("score"))


_DOCS = "docs AS (SELECT doc_id, source AS doc_type, lang AS period, text FROM documents)"


@query(f"""WITH {_SCORED.format(q=0)}, {_DOCS}, k AS (SELECT * FROM s0 ORDER BY score DESC, id LIMIT 20)
SELECT id, ticker, doc_type, period, round(score, 6) AS score FROM k JOIN docs ON docs.doc_id = k.id WHERE contains(period, 'en')""")
def retrieve_postfilter(spark, d):
    got = retrieve.retrieve(_vectors(spark, d), _documents(spark, d), _vector_of(spark, d, 0), 20, period="en")
    return got.select("id", "ticker", "doc_type", "period", F.round("score", 6).alias("score"))


@query(f"""WITH {_SCORED.format(q=0)}, {_DOCS}
SELECT id, ticker, doc_type, period, round(score, 6) AS score FROM s0 JOIN docs ON docs.doc_id = s0.id
WHERE upper(ticker) = 'T1' AND contains(period, 'en') ORDER BY s0.score DESC, id LIMIT 8""")
def retrieve_prefilter(spark, d):
    got = retrieve.retrieve(_vectors(spark, d), _documents(spark, d), _vector_of(spark, d, 0), 8, ticker="t1", period="en", prefilter=True)
    return got.select("id", "ticker", "doc_type", "period", F.round("score", 6).alias("score"))


@query(f"""WITH {_SCORED.format(q=0)}, {_DOCS}, k AS (SELECT * FROM s0 ORDER BY score DESC, id LIMIT 8)
SELECT 'chunk' AS source_type, CAST(id AS VARCHAR) AS source_id, CAST(id AS VARCHAR) AS doc_id, doc_type, period, round(score, 6) AS score, ticker, length(text) AS n_text
FROM k LEFT JOIN docs ON docs.doc_id = k.id""")
def evidence_flagship(spark, d):
    return flagship(spark, d)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Evidence rows of the nearest chunks of a question, with their documents."""
    hits = retrieve.with_document(retrieve.top_k(_vectors(spark, d), _vector_of(spark, d, 0), 8), _documents(spark, d))
    usable = retrieve.usable(hits.withColumn("raw", F.col("text")), "chunk", "id", "raw")
    got = evi.evidence(usable.withColumn("doc_id", F.col("doc_id").cast("string")))
    return got.select("source_type", "source_id", "doc_id", "doc_type", "period", F.round("score", 6).alias("score"), "ticker", F.when(F.col("doc_type").isNotNull(), F.length("text")).cast("bigint").alias("n_text"))


_ORDER_KEYS = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
_CHUNKS = f"""c0 AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER_KEYS}) AS seq FROM lineitem l),
c AS (SELECT l_orderkey AS doc, l_orderkey || '_' || seq AS id, seq, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM c0)"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(_t(spark, d, "lineitem"))


def _numbered(items: DataFrame) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER_KEYS.split(", ")))
    rows = items.withColumn("seq", turn)
    return rows.select(F.col("l_orderkey").alias("doc"), F.concat_ws("_", "l_orderkey", "seq").alias("id"), "seq", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


@query(f"""WITH {_CHUNKS},
hits AS (SELECT id, doc, l_extendedprice FROM c ORDER BY l_extendedprice DESC, id LIMIT 20),
nb AS (SELECT id, lag(id) OVER w AS p, lead(id) OVER w AS n FROM c WINDOW w AS (PARTITION BY doc ORDER BY seq)),
m AS (SELECT c.id, s_name AS name, s_nationkey FROM c JOIN supplier ON l_suppkey = s_suppkey UNION ALL SELECT c.id, p_brand, NULL FROM c JOIN part ON l_partkey = p_partkey),
e AS (SELECT id, string_agg(DISTINCT name, ',' ORDER BY name) AS entities FROM m GROUP BY id),
k AS (SELECT id, string_agg(DISTINCT 'REPORTED_BY:' || n_name, ',' ORDER BY 'REPORTED_BY:' || n_name) AS causal FROM m JOIN nation ON s_nationkey = n_nationkey GROUP BY id)
SELECT hits.id, hits.doc, coalesce(p, '') AS prev_chunks, coalesce(n, '') AS next_chunks, coalesce(entities, '') AS entities, coalesce(causal, '') AS causal_links
FROM hits LEFT JOIN nb USING (id) LEFT JOIN e USING (id) LEFT JOIN k USING (id)""")
def expand_context(spark, d):
    # Only orders with a line at or over the twentieth price can hold a hit: only they are numbered.
    items = _t(spark, d, "lineitem")
    least = items.select("l_extendedprice").orderBy(F.desc("l_extendedprice")).limit(20).agg(F.min("l_extendedprice"))
    docs = items.where(F.col("l_extendedprice") >= least.scalar()).select("l_orderkey").distinct()
    near = _numbered(items.join(docs, "l_orderkey", "left_semi"))
    hits = near.orderBy(F.desc("l_extendedprice"), "id").limit(20).select("id", "doc")
    links = retrieve.next_links(near, "doc", ["seq"], "id")
    supplier, part = _t(spark, d, "supplier"), _t(spark, d, "part")
    named = near.join(supplier, near.l_suppkey == supplier.s_suppkey).select(F.col("id").alias("chunk_id"), F.col("s_name").alias("name"))
    named = named.unionByName(near.join(part, near.l_partkey == part.p_partkey).select(F.col("id").alias("chunk_id"), F.col("p_brand").alias("name")))
    nation = _t(spark, d, "nation")
    relations = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(F.col("s_name").alias("src_name"), F.lit("REPORTED_BY").alias("rel_type"), F.col("n_name").alias("tgt_name"))
    out = retrieve.expand(hits, links, named, relations)
    return out.select("id", "doc", *(F.array_join(c, ",").alias(c) for c in ("prev_chunks", "next_chunks", "entities", "causal_links")))


@query("SELECT conv_id, conv_id || '_' || turn AS src, conv_id || '_' || lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations QUALIFY dst IS NOT NULL")
def next_chain(spark, d):
    rows = _t(spark, d, "conversations").withColumn("id", F.concat_ws("_", "conv_id", "turn"))
    return retrieve.next_links(rows, "conv_id", ["turn"], "id")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer WHERE c_custkey <= 20
UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation),
h0 AS (SELECT 'c1' AS id), h1 AS (SELECT DISTINCT dst AS id FROM e JOIN h0 ON src = h0.id),
h2 AS (SELECT DISTINCT dst AS id FROM e JOIN h1 ON src = h1.id EXCEPT (SELECT id FROM h0 UNION SELECT id FROM h1)),
h3 AS (SELECT DISTINCT dst AS id FROM e JOIN h2 ON src = h2.id EXCEPT (SELECT id FROM h0 UNION SELECT id FROM h1 UNION SELECT id FROM h2))
SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 UNION ALL SELECT id, 3 FROM h3""")
def graph_walk(spark, d):
    cust, nation = _t(spark, d, "customer"), _t(spark, d, "nation")
    n, r = F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")
    edges = cust.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    edges = edges.unionByName(nation.select(n.alias("src"), r.alias("dst"))).unionByName(nation.select(r.alias("src"), n.alias("dst"))).distinct()
    return retrieve.walk(spark.range(1).select(F.lit("c1").alias("id")), edges, 3)


_HITS = f"""{_SCORED.format(q=0)}, s5 AS (SELECT v.id, v.ticker, (1 + list_cosine_similarity(v.e, (SELECT e FROM v WHERE id = 5))) / 2 AS score FROM v),
a AS (SELECT 'chunk' AS source_type, id, ticker, score, 0 AS src_ord, row_number() OVER (ORDER BY score DESC, id) AS pos FROM s0 QUALIFY pos <= 8),
b AS (SELECT 'table' AS source_type, id, ticker, score, 1 AS src_ord, row_number() OVER (ORDER BY score DESC, id) AS pos FROM s5 QUALIFY pos <= 6),
c AS (SELECT 'chunk' AS source_type, id, ticker, score, 2 AS src_ord, row_number() OVER (ORDER BY score DESC, id) AS pos FROM s5 QUALIFY pos <= 8),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY source_type, id ORDER BY src_ord, pos) AS k FROM u)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)

    def part(q: int, k: int, kind: str) -> DataFrame:
        top = retrieve.top_k(vectors, _vector_of(spark, d, q), k)
        # At most k rows: numbering them needs no partition.
        return top.select(F.lit(kind).alias("source_type"), F.col("id").alias("source_id"), "doc_id", "ticker", "score", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "id")).alias("pos"))

    return evi.dedupe_rank(evi.concat_hits(part(0, 8, "chunk"), part(5, 6, "table"), part(5, 8, "chunk")), ["src_ord", "pos"])


@query(f"""WITH {_HITS} SELECT source_type, id AS source_id, ticker, round(score, 6) AS score,
CAST(row_number() OVER (ORDER BY score DESC, src_ord, pos) AS INT) AS rank FROM f WHERE k = 1""")
def merge_rank_evidence(spark, d):
    got = evi.ranked(_hits(spark, d).withColumn("g", F.lit(1)), ["src_ord", "pos"], ["g"])
    return got.select("source_type", "source_id", "ticker", F.round("score", 6).alias("score"), F.col("rank").cast("int"))


@query(f"""WITH {_HITS}, q AS (SELECT count(*) AS evidence_count, avg(score) AS avg_score, count(*) FILTER (source_type = 'chunk') AS chunk_count,
count(*) FILTER (source_type = 'table') AS table_count FROM f WHERE k = 1)
SELECT evidence_count, round(avg_score, 6) AS avg_score, chunk_count, table_count, t.least,
concat_ws(',', CASE WHEN evidence_count < 2 THEN 'insufficient_evidence_count' END, CASE WHEN avg_score < t.least THEN 'low_retrieval_score' END, CASE WHEN table_count < 1 THEN 'missing_table_evidence' END) AS failures,
evidence_count >= 2 AND avg_score >= t.least AND table_count >= 1 AS passed FROM q, (VALUES (0.35::DOUBLE), (0.99::DOUBLE)) t(least)""")
def quality_gate(spark, d):
    q = evi.quality(_hits(spark, d).withColumn("g", F.lit(1)), ["g"]).withColumn("needs_tables", F.lit(True))
    out = None
    for least in (0.35, 0.99):
        got = guard.quality_gate(q, min_score=least).select("evidence_count", F.round("avg_score", 6).alias("avg_score"), "chunk_count", "table_count", F.lit(least).alias("least"), F.array_join("failures", ",").alias("failures"), "passed")
        out = got if out is None else out.unionByName(got)
    return out


@query(f"""WITH {_DOCS}, x AS (SELECT doc_type, period AS ticker, doc_id FROM docs),
v AS (SELECT doc_type, upper(trim(ticker)) AS t, count(*) AS votes, min(doc_id) AS first FROM x WHERE coalesce(trim(ticker), '') <> '' GROUP BY 1, 2),
w AS (SELECT *, votes / sum(votes) OVER (PARTITION BY doc_type) AS share, row_number() OVER (PARTITION BY doc_type ORDER BY votes DESC, first) AS n FROM v)
SELECT doc_type, CASE WHEN votes >= 2 AND share >= 0.6 THEN t END AS ticker, votes, round(share, 6) AS share FROM w WHERE n = 1""")
def ticker_vote(spark, d):
    return evi.ticker_vote(_documents(spark, d).select("doc_type", F.col("period").alias("ticker"), "doc_id"), "doc_type", "doc_id")


@query("""WITH x AS (SELECT o_custkey, o_orderkey AS pos, CASE o_orderstatus WHEN 'O' THEN 'Chunk ' WHEN 'F' THEN 'table' ELSE 'other' END AS st, o_orderpriority AS sid, o_totalprice AS score FROM orders),
y AS (SELECT *, lower(trim(st)) AS source_type, trim(sid) AS source_id FROM x WHERE lower(trim(st)) IN ('chunk', 'table', 'graph') AND trim(sid) <> ''),
z AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, source_type, source_id ORDER BY pos) AS k FROM y),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY pos) AS n FROM z WHERE k = 1)
SELECT o_custkey, source_type, source_id, 'T' || o_custkey AS title, score, CAST(n AS INT) AS n FROM n WHERE n <= 6""")
def citations(spark, d):
    kind = F.when(F.col("o_orderstatus") == "O", F.lit("Chunk ")).when(F.col("o_orderstatus") == "F", F.lit("table")).otherwise(F.lit("other"))
    rows = _t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), kind.alias("source_type"), F.col("o_orderpriority").alias("source_id"), F.col("o_totalprice").alias("score"), F.lit("").alias("section_title"), F.concat(F.lit("T"), "o_custkey").alias("doc_type"), F.lit("d").alias("doc_id"))
    return evi.citations(rows, "o_custkey", "pos").select("o_custkey", "source_type", "source_id", "title", "score", F.col("n").cast("int"))


#: Numbers of texts as RE2 can have them, which looks neither back nor ahead: texts fall into numbers, words and the rest;
#: a number that a word follows at once gives way, to what a comma, a point or a percent sign ends.
_CLAIMS = """tok AS (SELECT doc_id, source, x, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '(?s)\\p{Nd}[\\p{Nd},]*(?:\\.\\p{Nd}+)?%?|[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+') AS x FROM documents)),
num AS (SELECT doc_id, source, i, CASE WHEN NOT regexp_matches(coalesce(x[i + 1], ''), '^[\\p{L}\\p{N}_]') THEN t WHEN ends_with(t, '%') THEN t[1:length(t) - 1] WHEN contains(t, '.') THEN split_part(t, '.', 1) WHEN contains(t, ',') THEN regexp_extract(t, '^(.*),', 1) END AS t
  FROM tok WHERE regexp_matches(t, '^\\p{Nd}') AND NOT regexp_matches(coalesce(x[i - 1], ''), '[\\p{L}\\p{N}_]$')),
can AS (SELECT doc_id, source, min(i) AS i, printf('%g', TRY_CAST(replace(rtrim(t, '%'), ',', '') AS DOUBLE)) || CASE WHEN ends_with(t, '%') THEN '%' ELSE '' END AS c FROM num WHERE t IS NOT NULL AND t <> '' GROUP BY doc_id, source, t),
claim AS MATERIALIZED (SELECT doc_id, source, c, min(i) AS i FROM can WHERE c IS NOT NULL GROUP BY 1, 2, 3)"""


@query(f"""WITH {_CLAIMS}, first AS (SELECT source, arg_min(doc_id, doc_id) AS first FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY 1),
known AS (SELECT DISTINCT first.source, claim.c FROM first JOIN claim ON claim.doc_id = first.first),
g AS (SELECT claim.doc_id, count(*) AS n, count(*) FILTER (known.c IS NULL) AS lacking, string_agg(claim.c, ',' ORDER BY claim.i) FILTER (known.c IS NULL) AS missing FROM claim LEFT JOIN known ON known.source = claim.source AND known.c = claim.c GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS INT) AS claim_total_count, CAST(coalesce(n - lacking, 0) AS INT) AS supported_claim_count, CAST(coalesce(lacking, 0) AS INT) AS unsupported_claim_count,
round(CASE WHEN coalesce(n, 0) = 0 THEN 1 ELSE (n - lacking) / n END, 6) AS claim_support_ratio, coalesce(missing, '') AS unsupported_claims FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id WHERE d.source IS NOT NULL""")
def claim_support(spark, d):
    """Numbers of documents against those of the first document of their source."""
    docs = _t(spark, d, "documents")
    known = docs.groupBy("source").agg(F.min_by("text", "doc_id").alias("evidence"))
    got = guard.claim_support_by(docs, "source", "text", known, "evidence")
    return got.select("doc_id", "claim_total_count", "supported_claim_count", "unsupported_claim_count", F.round("claim_support_ratio", 6).alias("claim_support_ratio"), F.array_join("unsupported_claims", ",").alias("unsupported_claims"))


@query("""WITH x AS (SELECT o_orderkey, CAST(o_orderkey % 7 AS INT) AS claim_total_count, (o_orderkey % 11) / 10.0::DOUBLE AS claim_support_ratio, (o_orderkey % 5) / 4.0::DOUBLE AS citation_coverage,
CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM orders)
SELECT o_orderkey, CASE WHEN claim_total_count > 0 AND claim_support_ratio < 0.4 THEN 'low_claim_support' END AS blocked_reason,
CASE WHEN claim_total_count > 0 AND claim_support_ratio < 0.8 THEN 'low' WHEN confidence = 'high' AND citation_coverage < 0.5 THEN 'medium' ELSE confidence END AS final_confidence,
(claim_total_count > 0 AND claim_support_ratio < 0.8) OR (confidence = 'high' AND citation_coverage < 0.5) AS confidence_overridden FROM x""")
def confidence_override(spark, d):
    k = F.col("o_orderkey")
    x = _t(spark, d, "orders").select("o_orderkey", (k % 7).cast("int").alias("claim_total_count"), ((k % 11) / 10.0).alias("claim_support_ratio"), ((k % 5) / 4.0).alias("citation_coverage"), F.when(k % 3 == 0, F.lit("high")).when(k % 3 == 1, F.lit("medium")).otherwise(F.lit("low")).alias("confidence"))
    return guard.claim_gate(x).select("o_orderkey", "blocked_reason", "final_confidence", "confidence_overridden")


_GATE = """x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'non_financial' ELSE '' END AS blocked_reason, CASE WHEN o_orderkey % 4 = 0 THEN 'low' ELSE 'high' END AS confidence,
(o_orderkey % 5) / 4.0::DOUBLE AS cov, ['fact', 'trend_analysis', 'comparison', 'root_cause'][1 + o_orderkey % 4] AS intent, o_orderkey % 6 = 0 AS multi, o_orderkey % 3 AS n_points FROM orders)"""


@query(f"""WITH {_GATE}, r AS (SELECT *, CASE WHEN blocked_reason <> '' THEN 'blocked_response' WHEN confidence = 'low' THEN 'low_confidence_answer' WHEN cov < 0.5 THEN 'low_citation_coverage'
WHEN intent NOT IN ('comparison', 'trend_analysis', 'risk_assessment') AND NOT multi THEN 'intent_not_visualization_oriented' WHEN n_points < 2 THEN 'insufficient_structured_points'
ELSE 'comparison_or_trend_with_supported_period_values' END AS reason FROM x)
SELECT o_orderkey, reason, reason LIKE 'comparison_or%' AS enabled, CASE WHEN reason LIKE 'comparison_or%' THEN CASE WHEN intent = 'trend_analysis' THEN 'line' ELSE 'grouped_bar' END END AS chart_type FROM r""")
def viz_gate(spark, d):
    k = F.col("o_orderkey")
    x = _t(spark, d, "orders").select("o_orderkey", F.when(k % 13 == 0, F.lit("non_financial")).otherwise(F.lit("")).alias("blocked_reason"), F.when(k % 4 == 0, F.lit("low")).otherwise(F.lit("high")).alias("confidence"), ((k % 5) / 4.0).alias("citation_coverage"), F.element_at(F.lit(["fact", "trend_analysis", "comparison", "root_cause"]), (1 + k % 4).cast("int")).alias("intent"), (k % 6 == 0).alias("needs_multi_period"), (k % 3).alias("n_points"))
    return guard.chart_gate(x).select("o_orderkey", "reason", "enabled", "chart_type")


_ANSWER = "'In Q' || (1 + o_orderkey % 4) || ' FY20' || (10 + o_orderkey % 15) || ', revenue was $' || (o_orderkey % 900) || ' million. Again FY20' || (10 + o_orderkey % 15) || ' grew 5%; in 20' || (10 + o_orderkey % 9) || ' none'"


@query(f"""WITH a AS (SELECT o_orderkey, {_ANSWER} AS t FROM orders), s AS (SELECT o_orderkey, unnest(range(len(p))) AS pos, unnest(p) AS s FROM (SELECT o_orderkey, regexp_split_to_array(t, '[\\n.;]') AS p FROM a)),
m AS (SELECT o_orderkey, pos, regexp_extract(trim(s), '(?i)\\b(?:Q[1-4]\\s*FY\\d{{4}}|FY\\d{{4}}|20\\d{{2}})\\b', 0) AS raw, regexp_extract(trim(s), '(?i)(\\$?\\d[\\d,]*(?:\\.\\d+)?)\\s*(billion|million|%)?', 1) AS v,
regexp_extract(trim(s), '(?i)(\\$?\\d[\\d,]*(?:\\.\\d+)?)\\s*(billion|million|%)?', 2) AS u FROM s),
k AS (SELECT *, upper(regexp_replace(raw, '\\s+', ' ', 'g')) AS period, row_number() OVER (PARTITION BY o_orderkey, upper(regexp_replace(raw, '\\s+', ' ', 'g')) ORDER BY pos) AS k FROM m WHERE raw <> '' AND v <> '')
SELECT o_orderkey, CAST(pos AS INT) AS pos, period, TRY_CAST(regexp_replace(v, '[$,]', '', 'g') AS DOUBLE) AS value, nullif(lower(u), '') AS unit FROM k WHERE k = 1""")
def period_points(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", F.expr(_ANSWER).alias("answer"))
    return guard.period_points(rows, "o_orderkey", "answer")


@query("""SELECT conv_id, arg_max(text, turn) AS question FROM conversations WHERE role IN ('user', 'human') AND trim(text) <> '' GROUP BY conv_id""")
def latest_question(spark, d):
    return jobs.latest_question(_t(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("""SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS question FROM conversations""")
def question_normalise(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", tx.collapse(F.col("text")).alias("question"))


@query("SELECT DISTINCT upper('c' || c_nationkey) AS ticker, c_mktsegment AS name FROM customer WHERE c_nationkey IS NOT NULL")
def company_catalog(spark, d):
    rows = _t(spark, d, "customer").where("c_nationkey is not null").select(F.upper(F.concat(F.lit("c"), "c_nationkey")).alias("ticker"), F.col("c_mktsegment").alias("name"))
    return jobs.catalog(rows, F.col("ticker"), F.col("name"))


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def list_documents_page(spark, d):
    rows = _t(spark, d, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return jobs.page(rows, [F.desc("o_orderdate"), "o_orderkey"], 20, 40)


@query("SELECT event_type, count(*) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def count_total(spark, d):
    return jobs.count_total(_t(spark, d, "events"), "event_type", "user_id")


@query("""WITH o AS (SELECT o_custkey, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS sections FROM orders GROUP BY 1),
c AS (SELECT o_custkey, count(*) AS chunks, count(DISTINCT l_partkey) AS tables FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT c_custkey AS doc_id, coalesce(sections, 0) AS sections, coalesce(chunks, 0) AS chunks, coalesce(tables, 0) AS tables, coalesce(sections, 0) > 0 OR coalesce(chunks, 0) > 0 AS has_graph_data
FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN c ON c.o_custkey = c_custkey""")
def doc_graph_stats(spark, d):
    orders, items = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    sections = orders.select(F.col("o_custkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM").alias("id"))
    both = orders.join(items, orders.o_orderkey == items.l_orderkey).select(F.col("o_custkey").alias("doc_id"), F.struct("l_orderkey", "l_linenumber", F.xxhash64(*items.columns)).alias("chunk"), "l_partkey")
    chunks, parts = both.select("doc_id", F.col("chunk").alias("id")), both.select("doc_id", F.col("l_partkey").alias("id"))
    return graph.document_counts(_t(spark, d, "customer").select(F.col("c_custkey").alias("id")), sections, chunks, parts)


@query("""WITH x AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS status, CASE WHEN event_id % 2 = 0 THEN value END AS value, ts FROM events)
SELECT user_id, arg_max(status, (ts, event_id)) FILTER (status IS NOT NULL) AS status, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value, max(ts) AS updated_at FROM x GROUP BY user_id""")
def job_state_fold(spark, d):
    k = F.col("event_id")
    log = _t(spark, d, "events").select("user_id", "event_id", "ts", F.when(k % 3 != 0, F.col("event_type")).alias("status"), F.when(k % 2 == 0, F.col("value")).alias("value"), F.col("ts").alias("updated_at"))
    return jobs.fold(log, "user_id", ["ts", "event_id"], ["status", "value", "updated_at"])


@query("""WITH x AS (SELECT user_id, CASE WHEN event_id % 17 = 0 THEN 'failed' WHEN event_id % 5 = 0 THEN 'skipped' WHEN event_id % 3 = 0 THEN 'pending' ELSE 'processed' END AS o FROM events),
g AS (SELECT user_id, count(*) AS total, count(*) FILTER (o = 'processed') AS processed, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o = 'failed') AS failed FROM x GROUP BY 1)
SELECT *, CAST(floor((processed + skipped) * 100 / greatest(total, 1)) AS INT) AS progress, CASE WHEN failed = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status FROM g""")
def job_progress(spark, d):
    k = F.col("event_id")
    out = F.when(k % 17 == 0, F.lit("failed")).when(k % 5 == 0, F.lit("skipped")).when(k % 3 == 0, F.lit("pending")).otherwise(F.lit("processed"))
    return jobs.progress(_t(spark, d, "events").select("user_id", out.alias("outcome")), ["user_id"])


@query("SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM events")
def running_counts(spark, d):
    return jobs.running(_t(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "click", bucket=F.date_trunc("week", "ts")).select("event_id", "user_id", "so_far")


@query("""WITH new AS (SELECT o_orderkey, 'N' AS status, o_totalprice * 2 AS price FROM orders WHERE o_orderkey % 4 = 0)
SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new) UNION ALL SELECT * FROM new""")
def upsert_rows(spark, d):
    old = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    new = old.where(F.col("o_orderkey") % 4 == 0).select("o_orderkey", F.lit("N").alias("status"), (F.col("price") * 2).alias("price"))
    return graph.upsert(old, new, ["o_orderkey"])


@query("SELECT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_orderkey NOT IN (1, 3, 7) AND o_custkey NOT IN (1, 3, 7)")
def delete_document(spark, d):
    orders = _t(spark, d, "orders")
    return graph.delete_documents(orders.select(F.col("o_orderkey").alias("id")), orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")), [1, 3, 7])[1]


_ENTITY = "CASE WHEN p_size % 4 = 0 THEN 'Unknown' WHEN p_size % 4 = 1 THEN 'Product' ELSE 'RiskFactor' END"


@query(f"""SELECT DISTINCT {_ENTITY} AS label, p_brand AS name FROM part WHERE {_ENTITY} IN ('Product', 'RiskFactor') AND trim(p_brand) <> ''""")
def entity_sanitise(spark, d):
    rows = _t(spark, d, "part").select(F.expr(_ENTITY).alias("label"), F.concat(F.lit("  "), F.upper("p_brand"), F.lit(" ")).alias("name"))
    return graph.clean_entities(rows).distinct()


@query("""WITH r AS (SELECT DISTINCT s_name AS src_name, CASE WHEN s_suppkey % 3 = 0 THEN 'LIKES' ELSE 'IMPACTED' END AS rel_type, CASE WHEN s_suppkey % 5 = 0 THEN 'Nowhere' ELSE n_name END AS tgt_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT DISTINCT 'Company' AS src_label, src_name, rel_type, 'MacroEvent' AS tgt_label, tgt_name FROM r JOIN nation ON tgt_name = n_name WHERE rel_type = 'IMPACTED'""")
def relation_resolve(spark, d):
    supplier, nation = _t(spark, d, "supplier"), _t(spark, d, "nation")
    nodes = supplier.select(F.lit("Company").alias("label"), F.col("s_name").alias("name")).unionByName(nation.select(F.lit("MacroEvent").alias("label"), F.col("n_name").alias("name")))
    k = F.col("s_suppkey")
    relations = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(F.col("s_name").alias("src_name"), F.when(k % 3 == 0, F.lit("LIKES")).otherwise(F.lit("IMPACTED")).alias("rel_type"), F.when(k % 5 == 0, F.lit("Nowhere")).otherwise(F.col("n_name")).alias("tgt_name"))
    return graph.resolve_relations(relations, nodes)


@query("SELECT DISTINCT l_orderkey AS chunk_id, 'Product' AS label, l_partkey AS name FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def mention_dedupe(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.lit("Product").alias("label"), F.col("l_partkey").alias("name"))
    return graph.mentions(rows, _t(spark, d, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("id")))


@query("""WITH s AS (SELECT o_orderkey, 1 AS a1, CAST(1 + o_orderkey % 3 AS INT) AS z1, CAST(2 + o_orderkey % 3 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS INT) AS a2, 5 AS z2 FROM orders)
SELECT o_orderkey, a1 <= z1 AND a2 <= z2 AND list_concat(range(a1, z1 + 1), range(a2, z2 + 1)) = [1, 2, 3, 4, 5] AS covered FROM s""")
def section_cover(spark, d):
    k = F.col("o_orderkey")
    i = lambda c: c.cast("int")
    spans = F.array(F.struct(F.lit(1).alias("page_start"), i(1 + k % 3).alias("page_end")), F.struct(i(2 + k % 3 + F.when(k % 5 == 0, 1).otherwise(0)).alias("page_start"), F.lit(5).alias("page_end")))
    return _t(spark, d, "orders").select("o_orderkey", spans.alias("s")).select("o_orderkey", ingest.covers(F.col("s"), F.lit([5, 1, 2, 3, 4])).alias("covered"))


@query("""WITH p AS (SELECT conv_id AS doc_id, CAST(turn AS INT) AS page, text AS markdown FROM conversations), s AS (SELECT DISTINCT doc_id, 0 AS idx, 0 AS a, 1 AS z FROM p UNION ALL SELECT DISTINCT doc_id, 1, 2, 99 FROM p)
SELECT s.doc_id, s.idx, CASE s.idx WHEN 0 THEN 'RISK' ELSE 'NOTES' END AS section_type, coalesce(string_agg(markdown, chr(10) ORDER BY page, markdown), '') AS content FROM s LEFT JOIN p ON p.doc_id = s.doc_id AND page BETWEEN a AND z GROUP BY ALL""")
def section_assemble(spark, d):
    none = F.array().cast("array<string>")
    pages = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.col("text").alias("markdown"), none.alias("tables"), none.alias("headings"))
    docs = pages.select("doc_id").distinct()
    span = lambda i, kind, a, z: docs.select("doc_id", F.lit(i).alias("idx"), F.lit(kind).alias("section_type"), F.lit(kind).alias("title"), F.lit(a).alias("page_start"), F.lit(z).alias("page_end"))
    return ingest.assemble(span(0, "RISK", 0, 1).unionByName(span(1, "NOTES", 2, 99)), pages).select("doc_id", "idx", "section_type", "content")


def _split_sql(size: int, overlap: int) -> str:
    """Chunks of documents in SQL: pieces are cut level by level, then joined by a fold over each text's pieces."""
    quoted = lambda x: "'" + x.replace("\n", "' || chr(10) || '") + "'"
    steps = []
    for level, sep in enumerate(tx.SEPARATORS):
        if sep == "":
            parts = "string_split(p.t, '')"
        elif sep == "\n\n":  # before every line feed that another one follows
            lines = "list_transform(x, lambda y, k: CASE WHEN k = 1 THEN y WHEN y = '' AND k < len(x) THEN chr(1) || chr(10) ELSE chr(10) || y END)"
            parts = f"string_split(array_to_string(list_transform([string_split(p.t, chr(10))], lambda x: {lines})[1], ''), chr(1))"
        else:
            parts = f"list_transform(string_split(p.t, {quoted(sep)}), lambda y, k: CASE WHEN k = 1 THEN y ELSE {quoted(sep)} || y END)"
        has = f"contains(p.t, {quoted(sep)})" if sep else "TRUE"
        cut = f"list_transform(list_filter({parts}, lambda y: y <> ''), lambda y: {{'t': y, 'g': p.g || ':{level}.' || i}})"
        steps.append(f"p{level + 1} AS MATERIALIZED (SELECT doc_id, flatten(list_transform(ps, lambda p, i: CASE WHEN length(p.t) > {size} AND {has} THEN {cut} ELSE [p] END)) AS ps FROM p{level})")
    space = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    strip = lambda t: f"regexp_replace({t}, '^{space}+|{space}+$', '', 'g')"
    told = lambda s: f"CASE WHEN {strip(s + '.text')} <> '' THEN list_append({s}.out, {strip(s + '.text')}) ELSE {s}.out END"
    state = lambda out, text, sizes, g: f"{{'out': {out}, 'text': {text}, 'sizes': {sizes}, 'g': {g}}}"
    none = "CAST([] AS VARCHAR[])", "CAST([] AS BIGINT[])"
    first = f"list_filter(range(0, len(s.sizes) + 1), lambda k: coalesce(list_sum(s.sizes[k + 1:]), 0) <= least({overlap}, {size} - length(p.text)))[1]"
    less = "list_transform([{}], lambda k: {})[1]".format(first, state(told("s"), "right(s.text, CAST(coalesce(list_sum(s.sizes[k + 1:]), 0) AS BIGINT))", "s.sizes[k + 1:]", "s.g"))
    now = f"CASE WHEN s.g <> p.g THEN {state(told('s'), chr(39) * 2, none[1], 'p.g')} WHEN length(s.text) + length(p.text) > {size} THEN {less} ELSE s END"
    body = f"list_transform([{now}], lambda x: {state('x.out', 'x.text || p.text', 'list_concat(x.sizes, p.sizes)', 'p.g')})[1]"
    begin = state(none[0], "''", none[1], "''")
    each = f"list_transform(ps, lambda p: {state(none[0], 'p.t', '[length(p.t)]', 'p.g')})"
    last = len(tx.SEPARATORS)
    return f"""WITH p0 AS (SELECT doc_id, [{{'t': coalesce(text, ''), 'g': ''}}] AS ps FROM documents), {", ".join(steps)},
f AS MATERIALIZED (SELECT doc_id, list_reduce(list_concat([{begin}], {each}), lambda s, p: {body}) AS s FROM p{last}),
c AS (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) - 1 AS n FROM (SELECT doc_id, {told("s")} AS x FROM f))
SELECT doc_id || '_GENERAL_' || n AS id, doc_id || '_sec_0' AS section_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(n AS INT) AS sequence, 1 AS page, CAST(length(t) AS INT) AS n_chars FROM c"""


@query(_split_sql(2048, 256))
def chunk_documents(spark, d):
    docs = _t(spark, d, "documents")
    sections = ingest.section_ids(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("idx"), F.lit("GENERAL").alias("section_type"), F.col("text").alias("content"), F.lit(1).alias("page_start")))
    return ingest.chunk(sections).select("id", "section_id", "doc_id", "sequence", "page", F.length("text").alias("n_chars"))


@query(f"""WITH {_CHUNKS}, x AS (SELECT *, ['MD&A', 'RISK', 'NOTES', 'EARNINGS'][1 + l_partkey % 4] AS section_type FROM c)
SELECT doc AS doc_id, id, section_type FROM x WHERE section_type IN ('MD&A', 'RISK', 'EARNINGS') QUALIFY row_number() OVER (PARTITION BY doc ORDER BY seq) <= 3""")
def key_chunks_limit(spark, d):
    kind = F.element_at(F.lit(["MD&A", "RISK", "NOTES", "EARNINGS"]), (1 + F.col("l_partkey") % 4).cast("int"))
    rows = _chunks(spark, d).select(F.col("doc").alias("doc_id"), "id", F.col("seq").alias("sequence"), kind.alias("section_type"))
    return ingest.entity_chunks(rows, 3).select("doc_id", "id", "section_type")


_PLAN = """x AS (SELECT o_orderkey, ['fact', 'trend_analysis', 'comparison', 'root_cause'][1 + o_orderkey % 4] AS intent, o_orderkey % 3 = 0 AS needs_tables, o_orderkey % 7 = 0 AS needs_graph,
CAST(o_orderkey % 5 AS INT) AS kt, CAST(nullif(o_orderkey % 6, 5) AS INT) AS kc FROM orders)"""


@query(f"""WITH {_PLAN} SELECT o_orderkey, concat_ws(',', 'chunk_search', CASE WHEN needs_tables OR kt <> 0 THEN 'table_search' END, CASE WHEN needs_graph OR intent <> 'fact' THEN 'graph_traversal' END) AS selected_tools,
coalesce(nullif(kc, 0), 8) AS chunk_top_k, coalesce(nullif(kt, 0), 6) AS table_top_k FROM x""")
def tool_plan_default(spark, d):
    return tools.default_plan(_plans(spark, d)).select("o_orderkey", F.array_join("selected_tools", ",").alias("selected_tools"), "chunk_top_k", "table_top_k")


def _plans(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select("o_orderkey", F.element_at(F.lit(["fact", "trend_analysis", "comparison", "root_cause"]), (1 + k % 4).cast("int")).alias("intent"), (k % 3 == 0).alias("needs_tables"), (k % 7 == 0).alias("needs_graph_traversal"), (k % 5).cast("int").alias("top_k_tables"), F.nullif(k % 6, F.lit(5)).cast("int").alias("top_k_chunks"), F.lit(2).alias("hop_depth"))


@query(f"""WITH {_PLAN}, y AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN ['table_search', 'magic', 'table_search', 'chunk_search'] ELSE ['magic'] END AS asked, CASE WHEN o_orderkey % 8 = 0 THEN 0 END AS ak FROM x)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'table_search,chunk_search' ELSE concat_ws(',', 'chunk_search', CASE WHEN needs_tables OR kt <> 0 THEN 'table_search' END, CASE WHEN needs_graph OR intent <> 'fact' THEN 'graph_traversal' END) END AS selected_tools,
CASE WHEN o_orderkey % 2 = 0 THEN coalesce(ak, kc, 8) ELSE coalesce(nullif(kc, 0), 8) END AS chunk_top_k, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(kt, 6) ELSE coalesce(nullif(kt, 0), 6) END AS table_top_k FROM y""")
def tool_plan_normalised(spark, d):
    k = F.col("o_orderkey")
    asked = F.when(k % 2 == 0, F.lit(["table_search", "magic", "table_search", "chunk_search"])).otherwise(F.lit(["magic"]))
    rows = _plans(spark, d).withColumns({"asked_tools": asked, "asked_chunk_k": F.when(k % 8 == 0, F.lit(0)), "asked_table_k": F.lit(None).cast("int")})
    return tools.normalised_plan(rows).select("o_orderkey", F.array_join("selected_tools", ",").alias("selected_tools"), "chunk_top_k", "table_top_k")


@query("""WITH g AS (SELECT count(*) AS labeled_samples, count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 1 AND quality <> 0) AS fp, count(*) FILTER (toxic <> 1 AND quality <> 0) AS tn, count(*) FILTER (toxic <> 1 AND quality = 0) AS fn FROM labels),
r AS (SELECT *, (tp + tn) / labeled_samples AS accuracy, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r FROM g)
SELECT labeled_samples, tp, fp, tn, fn, round(accuracy, 6) AS accuracy, round(p, 6) AS precision_nf, round(r, 6) AS recall_nf, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1_nf,
round(fp / (fp + tn), 6) AS false_block_rate, round(fn / (tp + fn), 6) AS false_allow_rate FROM r""")
def domain_confusion(spark, d):
    got = ev.confusion(_t(spark, d, "labels"), F.col("toxic") == 1, F.col("quality") == 0)
    return got.select("labeled_samples", "tp", "fp", "tn", "fn", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision_nf", "recall_nf", "f1_nf", "false_block_rate", "false_allow_rate")))


_METRICS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@query("WITH x AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'l_extendedprice']) AS metric, unnest([l_quantity, l_discount, l_tax, l_extendedprice]) AS x FROM lineitem), g AS (SELECT metric, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, round(max(x), 6) AS max FROM x GROUP BY metric) SELECT *, CASE WHEN mean >= 0.85 THEN 'excellent' WHEN mean >= 0.7 THEN 'watch' ELSE 'critical' END AS health, mean < 0.7 AS warn_mean, coalesce(std > 0.25, false) AS warn_std, min = 0 AS warn_zero FROM g")
def metric_stats(spark, d):
    return ev.metric_stats(_t(spark, d, "lineitem"), _METRICS)


@query("WITH g AS (SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem) SELECT r, CASE WHEN r > 0.5 THEN 'high' WHEN r < 0.2 THEN 'low' ELSE 'moderate' END AS insight FROM g")
def metric_corr(spark, d):
    return ev.correlation(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("SELECT p_partkey, round((p_size + p_retailprice) / 2, 6) AS composite_score FROM part ORDER BY (p_size + p_retailprice) / 2, p_partkey LIMIT 5")
def weakest_five(spark, d):
    return ev.weakest(_t(spark, d, "part"), ["p_size", "p_retailprice"], "p_partkey").select("p_partkey", F.round("composite_score", 6).alias("composite_score"))


@query("SELECT 'c_acctbal' AS metric, arg_min(c_custkey, (c_acctbal, c_custkey)) AS c_custkey, min(c_acctbal) AS value FROM customer UNION ALL SELECT 'c_nationkey', arg_min(c_custkey, (c_nationkey, c_custkey)), CAST(min(c_nationkey) AS DOUBLE) FROM customer")
def weakest_per_metric(spark, d):
    return ev.weakest_per_metric(_t(spark, d, "customer"), ["c_acctbal", "c_nationkey"], "c_custkey")


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE o_orderstatus END AS value, count(*) AS count FROM orders GROUP BY 1")
def value_counts(spark, d):
    return ev.value_counts(_t(spark, d, "orders").select(F.nullif("o_orderstatus", F.lit("F")).alias("s")), "s")


@query("SELECT round(avg(CAST(l_returnflag = 'R' AS INT)), 6) AS returned, round(avg(CAST(l_linestatus = 'O' AS INT)), 6) AS open FROM lineitem")
def boolean_rates(spark, d):
    return ev.rates(_t(spark, d, "lineitem"), {"returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O"})


@query("SELECT round((avg(l_discount) + avg(l_tax)) / 2, 6) AS overall, (avg(l_discount) + avg(l_tax)) / 2 < 0.5 AS failed FROM lineitem")
def overall_threshold(spark, d):
    return ev.overall(_t(spark, d, "lineitem"), ["l_discount", "l_tax"], 0.5).select(F.round("overall", 6).alias("overall"), "failed")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_ids(spark, d):
    orders = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return jobs.absent(_t(spark, d, "customer").select("c_custkey"), orders, "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def existing_ids(spark, d):
    orders = _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return jobs.present(_t(spark, d, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


@query("WITH r AS (SELECT unnest([5, 3, 999999999, 1]) AS id, unnest([0, 1, 2, 3]) AS pos) SELECT r.pos, r.id, o_orderstatus FROM r LEFT JOIN orders ON o_orderkey = r.id")
def requested_order(spark, d):
    asked = spark.range(1).select(F.posexplode(F.lit([5, 3, 999999999, 1])).alias("pos", "id"))
    orders = _t(spark, d, "orders").where(F.col("o_orderkey").isin(5, 3, 999999999, 1))
    return jobs.in_order(asked, orders, "id", "o_orderkey").select("pos", "id", "o_orderstatus")


@query("SELECT conv_id, turn, split_part(conv_id || '_' || turn || '_x', '_', 1) AS doc_id FROM conversations")
def doc_id_from_source(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", jobs.document_of(F.concat_ws("_", "conv_id", "turn", F.lit("x"))).alias("doc_id"))


_READY = """x AS (SELECT o_orderkey, ['answer', 'clarify', 'request_ingestion', 'odd'][1 + o_orderkey % 4] AS mode, CASE WHEN o_orderkey % 3 = 0 THEN 'Not in the Company Catalog' ELSE 'no data' END AS reason,
CASE WHEN o_orderkey % 5 = 0 THEN ['Ticker', ' entity '] WHEN o_orderkey % 5 = 1 THEN ['period', 'ticker'] ELSE [] END AS slots, o_orderkey % 7 = 0 AS ncf FROM orders)"""


@query(f"""WITH {_READY}, y AS (SELECT *, mode = 'request_ingestion' AND NOT ncf AND (reason <> 'no data' OR o_orderkey % 5 = 0) AS overridden FROM x), z AS (SELECT *, CASE WHEN overridden OR mode = 'odd' THEN 'answer' ELSE mode END AS final_mode FROM y)
SELECT o_orderkey, final_mode, overridden, CASE final_mode WHEN 'clarify' THEN 'needs_clarification' WHEN 'request_ingestion' THEN 'needs_additional_data_ingestion' END AS blocked_reason, CAST(CASE final_mode WHEN 'clarify' THEN 2 WHEN 'request_ingestion' THEN 3 ELSE 0 END AS INT) AS n_open FROM z""")
def readiness_override(spark, d):
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    slots = F.when(k % 5 == 0, F.lit(["Ticker", " entity "])).when(k % 5 == 1, F.lit(["period", "ticker"])).otherwise(none)
    rows = _t(spark, d, "orders").select("o_orderkey", F.element_at(F.lit(["answer", "clarify", "request_ingestion", "odd"]), (1 + k % 4).cast("int")).alias("answer_mode"), F.when(k % 3 == 0, F.lit("Not in the Company Catalog")).otherwise(F.lit("no data")).alias("reason"), slots.alias("missing_slots"), none.alias("clarification_questions"), none.alias("ingest_recommendations"), (k % 7 == 0).alias("needs_company_filter"), F.lit("").alias("ticker"))
    return guard.readiness_decision(rows).select("o_orderkey", "final_mode", "overridden", "blocked_reason", F.size("open_questions").alias("n_open"))


@query("""WITH x AS (SELECT o_orderkey, ['Non_Financial', ' financial_supported ', 'uncertain', 'strange'][1 + o_orderkey % 4] AS s, ['HIGH', 'odd', 'low'][1 + o_orderkey % 3] AS c FROM orders),
y AS (SELECT o_orderkey, CASE WHEN lower(trim(s)) IN ('financial_supported', 'non_financial') THEN lower(trim(s)) ELSE 'uncertain' END AS domain_status, CASE WHEN lower(c) IN ('high', 'low') THEN lower(c) ELSE 'medium' END AS domain_confidence FROM x)
SELECT *, CASE domain_status WHEN 'non_financial' THEN 'non_financial' WHEN 'uncertain' THEN 'domain_uncertain' END AS blocked_reason, domain_status = 'financial_supported' AS gate_passed FROM y""")
def domain_decision(spark, d):
    k = F.col("o_orderkey")
    rows = _t(spark, d, "orders").select("o_orderkey", F.element_at(F.lit(["Non_Financial", " financial_supported ", "uncertain", "strange"]), (1 + k % 4).cast("int")).alias("domain_status"), F.element_at(F.lit(["HIGH", "odd", "low"]), (1 + k % 3).cast("int")).alias("domain_confidence"))
    return guard.domain_decision(rows).select("o_orderkey", "domain_status", "domain_confidence", "blocked_reason", "gate_passed")


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 9 <> 0 AS f, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS h, o_orderkey % 2 = 0 AS s, o_orderkey % 5 = 0 AS force FROM orders)
SELECT o_orderkey, CASE WHEN NOT f THEN 'failed' WHEN h AND s AND NOT force THEN 'skipped' ELSE 'processed' END AS outcome, CASE WHEN NOT f THEN 'FAILED' ELSE 'INGESTED' END AS status FROM x""")
def ingestion_decision(spark, d):
    orders, k = _t(spark, d, "orders"), F.col("o_orderkey")
    has = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("has_data", F.lit(True))
    rows = orders.select("o_orderkey").join(has, "o_orderkey", "left").select("o_orderkey", (k % 9 != 0).alias("file_exists"), F.coalesce("has_data", F.lit(False)).alias("has_data"), (k % 2 == 0).alias("skip_if_exists"), (k % 5 == 0).alias("force"))
    return jobs.decision(rows).select("o_orderkey", "outcome", "status")


@query("SELECT count(*) AS n, count(DISTINCT len(embedding)) AS sizes, count(*) FILTER (embedding IS NULL) AS missing, count(DISTINCT len(embedding)) <= 1 AS ok FROM embeddings")
def embedding_dims(spark, d):
    return ingest.check_dimension(_t(spark, d, "embeddings"))


@query("SELECT conv_id, coalesce(arg_min(text, turn), CAST(conv_id AS VARCHAR)) AS title FROM conversations GROUP BY conv_id")
def thread_titles(spark, d):
    return jobs.thread_titles(_t(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events QUALIFY previous IS NULL OR previous <> event_type")
def status_transitions(spark, d):
    return jobs.transitions(_t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", F.date_trunc("week", "ts")).select("user_id", "event_id", "event_type", "previous")


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ' Non_Financial' WHEN o_orderkey % 3 = 1 THEN 'x' END AS e, ['robustness', 'trend', 'Out_Of_Scope'][1 + o_orderkey % 3] AS c FROM orders)
SELECT o_orderkey, CASE WHEN lower(trim(e)) = 'non_financial' THEN 'non_financial' WHEN lower(c) IN ('robustness', 'out_of_scope') THEN 'non_financial' ELSE 'financial_supported' END AS expected FROM x""")
def expected_domain(spark, d):
    k = F.col("o_orderkey")
    e = F.when(k % 3 == 0, F.lit(" Non_Financial")).when(k % 3 == 1, F.lit("x"))
    c = F.element_at(F.lit(["robustness", "trend", "Out_Of_Scope"]), (1 + k % 3).cast("int"))
    return _t(spark, d, "orders").select("o_orderkey", tools.expected_domain(e, c).alias("expected"))


@query("SELECT page_id AS doc_id, len(list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))), lambda x: length(x) > 3)) AS n_headings FROM pages")
def page_headings(spark, d):
    return files.html_pages(_t(spark, d, "pages")).select("doc_id", F.size("headings").cast("bigint").alias("n_headings"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def status_windows(spark, d):
    return jobs.windows(_t(spark, d, "events"), "ts", "event_type", "value")


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS short, replace(left(text, 200), chr(10), ' ') AS snippet, split_part(text, ' ', 1) AS first FROM documents")
def text_previews(spark, d):
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", tx.truncate(t).alias("short"), tx.page_snippet(t).alias("snippet"), F.split_part(t, F.lit(" "), F.lit(1)).alias("first"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y %I:%M %p') AS shown, CASE WHEN TRY_CAST(o_orderpriority[1:1] AS INT) >= 2 THEN TRY_CAST(o_orderpriority[1:1] AS INT) ELSE 9 END AS bounded FROM orders")
def formatted_values(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy hh:mm a").alias("shown"), tx.bounded_int(F.left("o_orderpriority", F.lit(1)), 9, 2).alias("bounded"))


@query("""WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'non_financial' WHEN 'F' THEN 'financial_supported' END AS a,
CASE left(o_orderpriority, 1) WHEN '2' THEN 'uncertain' WHEN '3' THEN 'financial_supported' WHEN '4' THEN 'non_financial' WHEN '5' THEN 'other' END AS b FROM orders),
y AS (SELECT o_orderkey, a, b, coalesce(a, 'financial_supported') AS f FROM x),
z AS (SELECT *, f <> 'financial_supported' AS adjudicated, CASE WHEN f = 'financial_supported' THEN f WHEN b = 'other' THEN 'uncertain' ELSE coalesce(b, 'financial_supported') END AS final_status FROM y)
SELECT o_orderkey, final_status, CASE WHEN adjudicated THEN CASE WHEN b IS NULL THEN 'low' ELSE 'high' END WHEN a IS NULL THEN 'low' ELSE 'medium' END AS final_confidence,
CASE WHEN adjudicated THEN CASE WHEN b IS NULL THEN 's,domain_adjudicator_error' ELSE '' END WHEN a IS NULL THEN 'domain_classifier_error' ELSE 's' END AS final_signals, adjudicated,
CASE final_status WHEN 'non_financial' THEN 'non_financial' WHEN 'uncertain' THEN 'domain_uncertain' END AS blocked_reason FROM z""")
def domain_adjudicated(spark, d):
    first = F.when(F.col("o_orderstatus") == "O", F.lit(" Non_Financial")).when(F.col("o_orderstatus") == "F", F.lit("financial_supported"))
    p = F.left("o_orderpriority", F.lit(1))
    second = F.when(p == "2", F.lit("uncertain")).when(p == "3", F.lit("Financial_Supported")).when(p == "4", F.lit("non_financial")).when(p == "5", F.lit("other"))
    rows = _t(spark, d, "orders").select("o_orderkey", first.alias("domain_status"), F.lit("sure").alias("domain_confidence"), F.lit(["s", " "]).alias("domain_signals"), second.alias("second_status"), F.lit("HIGH").alias("second_confidence"), F.array().cast("array<string>").alias("second_signals"))
    return respond.adjudicate(rows).select("o_orderkey", "final_status", "final_confidence", F.array_join("final_signals", ",").alias("final_signals"), "adjudicated", "blocked_reason")


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
x AS (SELECT o_orderkey, coalesce(n, 0) AS n, CASE WHEN left(o_orderpriority, 1) = '1' THEN 'low_quality' END AS r, o_orderstatus = 'O' AS has, o_orderstatus <> 'P' AS ok FROM orders LEFT JOIN n ON l_orderkey = o_orderkey),
y AS (SELECT *, CASE WHEN r IS NOT NULL AND has THEN 'blocked_response' WHEN n = 0 THEN 'insufficient_evidence' WHEN NOT ok THEN 'generation_error' ELSE 'generated' END AS outcome FROM x)
SELECT o_orderkey, outcome, CASE outcome WHEN 'blocked_response' THEN r WHEN 'insufficient_evidence' THEN coalesce(r, outcome) WHEN 'generation_error' THEN outcome END AS out_reason,
CASE WHEN outcome <> 'generated' THEN outcome END AS chart_reason FROM y""")
def answer_states(spark, d):
    n = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("evidence_count"))
    status = F.col("o_orderstatus")
    rows = _t(spark, d, "orders").join(n, "o_orderkey", "left").select("o_orderkey", "evidence_count", F.when(F.left("o_orderpriority", F.lit(1)) == "1", F.lit("low_quality")).otherwise(F.lit("")).alias("blocked_reason"), F.when(status == "O", F.lit("a")).alias("final_answer"), F.when(status != "P", F.lit("g")).alias("generated"))
    return respond.answer_state(rows).select("o_orderkey", "outcome", "out_reason", "chart_reason")


@query("""SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'chunk_search,table_search' WHEN 'system' THEN '' ELSE 'chunk_search,graph_traversal' END AS tools,
CASE WHEN turn > 0 THEN 'T' || conv_id END AS context_ticker FROM conversations""")
def tool_context(spark, d):
    role = F.col("role")
    stored = F.when(role == "assistant", F.lit([" table_search ", "", "chunk_search", "table_search"])).when(role == "system", F.array().cast("array<string>"))
    rows = _t(spark, d, "conversations").select("conv_id", "turn", stored.alias("stored_tools"), F.when(role == "user", F.lit("trend_analysis")).otherwise(F.lit("fact_lookup")).alias("intent"), F.lit(False).alias("needs_tables"), F.lit(False).alias("needs_graph_traversal"), F.lit(8).alias("top_k_chunks"), F.lit(0).alias("top_k_tables"), F.lit(2).alias("hop_depth"), F.when(F.col("turn") == 0, F.lit(False)).alias("use_company_filter"), F.concat(F.lit("T"), "conv_id").alias("ticker"))
    return respond.retrieval_context(rows).select("conv_id", "turn", F.array_join("context_tools", ",").alias("tools"), "context_ticker")


_START = """d AS (SELECT o_custkey AS id, CASE WHEN left(min(o_orderpriority), 1) <> '1' THEN 'o' || min(o_orderkey) END AS file_path FROM orders GROUP BY 1),
f AS (SELECT DISTINCT 'o' || l_orderkey AS path FROM lineitem),
s AS (SELECT c_custkey AS pos, c_custkey AS id, CASE WHEN d.id IS NULL THEN 'not_found' WHEN file_path IS NULL THEN 'no_path' WHEN path IS NULL THEN 'no_file' END AS problem FROM customer LEFT JOIN d ON d.id = c_custkey LEFT JOIN f ON path = file_path)"""


def _start(spark: SparkSession, d: str, known_only: bool = False) -> DataFrame:
    least = F.min("o_orderpriority")
    documents = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.when(F.left(least, F.lit(1)) == "1", F.lit("")).otherwise(F.concat(F.lit("o"), F.min("o_orderkey"))).alias("file_path"))
    files_ = _t(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("path"))
    asked = documents.select(F.col("id").alias("pos"), "id") if known_only else _t(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("id"))
    return respond.start_check(asked, documents, files_)


@query(f"WITH {_START} SELECT pos, id, problem FROM s")
def start_check(spark, d):
    return _start(spark, d)


@query(f"""WITH {_START}, g AS (SELECT count(*) FILTER (problem = 'no_path') AS p, count(*) FILTER (problem = 'no_file') AS f FROM s WHERE id IN (SELECT id FROM d))
SELECT CASE WHEN p > 0 THEN 'no_path' WHEN f > 0 THEN 'no_file' END AS problem, CASE WHEN p + f > 0 THEN 400 ELSE 202 END AS code, CASE WHEN p > 0 THEN p ELSE f END AS n_ids FROM g""")
def start_status(spark, d):
    return respond.start_status(_start(spark, d, known_only=True))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (1, 7, 32) THEN 'CANCELLED' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey IN (1, 7, 32) THEN 0 ELSE 50 END AS progress FROM orders")
def job_cancel(spark, d):
    return respond.cancel(_t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(50).alias("progress")), [1, 7, 32])


@query("""SELECT round(count(*) FILTER (toxic = 0 AND quality = 0) / count(*) FILTER (toxic = 0), 6) AS false_block_rate,
round(count(*) FILTER (toxic = 1 AND quality <> 0) / count(*) FILTER (toxic = 1), 6) AS false_allow_rate FROM labels""")
def labelled_rates(spark, d):
    rows = _t(spark, d, "labels").select(F.when(F.col("toxic") == 1, F.lit(" Non_Financial ")).otherwise(F.lit("financial_supported")).alias("expected_domain"), F.when(F.col("quality") == 0, F.lit("low_quality")).alias("blocked_reason"))
    return respond.labelled_rates(rows, "expected_domain", "blocked_reason")


@query("SELECT conv_id, turn, CASE WHEN turn >= 2 THEN upper(role) ELSE role END AS role FROM conversations")
def message_reduce(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", "role")
    return jobs.reduce_messages(rows.where("turn <= 3"), rows.where("turn >= 2").withColumn("role", F.upper("role")), ["conv_id", "turn"])


from . import flows, ingestflows  # noqa: E402, F401  (they register their queries)
