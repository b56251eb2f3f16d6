"""Registered queries of ingestion over documents, pages and conversations, with their SQL.

A conversation is a document whose messages are its pages; its roles are their headings.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import graph, held, ingest, jobs
from .plans import tools
from .queries import _t, query
from .sources import files


def _folder(spark: SparkSession, name: str) -> str:
    return f"{held.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    heads = F.when(F.col("role") == "system", F.lit("Risk factors")).when(F.col("role") == "user", F.lit("Discussion and analysis")).otherwise(F.lit("Notes"))
    return _t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), F.array(heads).alias("headings"), F.array(F.col("role")).alias("tables"), F.col("text").alias("markdown"))


_KINDS = """k AS (SELECT conv_id, turn + 1 AS page, role, text, CASE role WHEN 'system' THEN 'RISK' WHEN 'user' THEN 'MD&A' ELSE 'NOTES' END AS kind FROM conversations),
n AS (SELECT *, CASE WHEN lag(kind) OVER w <> kind THEN 1 ELSE 0 END AS fresh FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY page)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY page) AS idx FROM n)"""


@query(f"""WITH {_KINDS}, whole AS (SELECT conv_id, count(*) = max(page) AND min(page) = 1 AND conv_id % 5 <> 0 AS ok FROM k GROUP BY 1)
SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(idx AS INT) AS idx, kind AS section_type, kind AS title, CAST(min(page) AS INT) AS page_start, CAST(max(page) AS INT) AS page_end, string_agg(text, chr(10) ORDER BY page) AS content, string_agg(role, ',' ORDER BY page) AS tables FROM s JOIN whole USING (conv_id) WHERE ok GROUP BY conv_id, idx, kind
UNION ALL SELECT CAST(conv_id AS VARCHAR), 0, 'GENERAL', 'Document', CAST(min(page) AS INT), CAST(max(page) AS INT), string_agg(text, chr(10) ORDER BY page), string_agg(role, ',' ORDER BY page) FROM k JOIN whole USING (conv_id) WHERE NOT ok GROUP BY conv_id""")
def page_sections(spark, d):
    """Pages classified into spans and gathered as sections; a fifth of the documents fail to be classified."""
    pages = _pages(spark, d)
    spans = ingest.classify_pages(pages).where(F.col("doc_id").cast("long") % 5 != 0)
    return ingest.sections_of(pages, spans).select("doc_id", "idx", "section_type", "title", "page_start", "page_end", "content", F.array_join("tables", ",").alias("tables"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS doc_id, string_agg('Page ' || (turn + 1) || ': headings=[' || CASE role WHEN 'system' THEN 'Risk factors' WHEN 'user' THEN 'Discussion and analysis' ELSE 'Notes' END || '] | ' || replace(left(text, 200), chr(10), ' '), chr(10) ORDER BY turn) AS outline FROM conversations GROUP BY 1""")
def page_outlines(spark, d):
    return ingest.outline(_pages(spark, d))


@query("""SELECT doc_id || '_sec_0_tbl_' || i AS id, doc_id || '_sec_0' AS section_id, x AS markdown, CAST(i AS INT) AS sequence, '[' || source || '] ' || lang || chr(10) || chr(10) || x AS context
FROM (SELECT doc_id, lang, source, unnest([left(text, 40), lang]) AS x, unnest([0, 1]) AS i FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL)""")
def table_contexts(spark, d):
    """Tables of sections with their ids and the text that is embedded."""
    docs = _t(spark, d, "documents").where("text is not null and lang is not null and source is not null")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("idx"), F.col("source").alias("section_type"), F.col("lang").alias("title"), F.array(F.left("text", F.lit(40)), "lang").alias("tables"))
    return ingest.section_tables(ingest.section_ids(rows))


@query("""SELECT page_id, CASE WHEN length(trim(coalesce(url, ''))) > 3 THEN trim(url) ELSE '' END AS headings, coalesce(nullif(left(html, 30), ''), '') AS tables, 3 AS items FROM pages""")
def page_items(spark, d):
    """Pages with their items: headings of over three characters, tables that aren't empty."""
    pages = _t(spark, d, "pages").select("page_id", F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), "url", "html")
    item = lambda k, kind, v: F.struct(F.lit(k).alias("pos"), F.lit(kind).alias("type"), v.alias("value"))
    items = pages.select("doc_id", "page", F.explode(F.array(item(0, "heading", F.coalesce("url", F.lit(""))), item(1, "table", F.left("html", F.lit(30))), item(2, "heading", F.lit(" abc ")))).alias("i")).select("doc_id", "page", "i.*")
    got = ingest.pages_with_items(pages, items)
    return got.select("page_id", F.array_join(ingest.headings(F.col("items")), ",").alias("headings"), F.array_join(ingest.page_tables(F.col("items")), ",").alias("tables"), F.size("items").alias("items"))


@query("""SELECT kind, id, n FROM (SELECT 'chunk' AS kind, CAST(doc_id AS VARCHAR) AS id, length(text) AS n FROM documents UNION ALL SELECT 'table', CAST(doc_id AS VARCHAR), length(lang) FROM documents)""")
def embedded_texts(spark, d):
    """Texts of chunks and tables embedded in one pass and told apart again; the embedder counts letters."""
    docs = _t(spark, d, "documents")
    id_ = F.col("doc_id").cast("string").alias("id")
    chunks, tables = ingest.embed_all(docs.select(id_, "text"), docs.select(id_, F.col("lang").alias("context")), lambda c: F.array(F.length(c).cast("float")))
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", F.element_at("embedding", 1).cast("long").alias("n"))
    return pick(chunks, "chunk").unionByName(pick(tables, "table"))


@query("""SELECT doc_id, coalesce(nullif(lang, ''), 'UNKNOWN') AS ticker, coalesce(nullif(source, ''), 'Unknown Company') AS company_name, 'Document' AS doc_type, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'Unknown' END AS period, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS n_stats FROM documents""")
def document_defaults(spark, d):
    """Documents with defaults for what is missing."""
    long = F.col("n_chars") > 1000
    rows = _t(spark, d, "documents").select("doc_id", F.col("lang").alias("ticker"), F.col("source").alias("company_name"), F.lit(None).cast("string").alias("doc_type"), F.when(long, F.lit("long")).otherwise(F.lit("")).alias("period"), F.when(long, F.create_map(F.lit("n"), F.col("n_chars"))).alias("stats"))
    return ingest.with_defaults(rows).select("doc_id", "ticker", "company_name", "doc_type", "period", F.size("stats").alias("n_stats"))


@query("""WITH c AS (SELECT DISTINCT upper(source) AS t FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND source IS NOT NULL)
SELECT doc_id, t AS known_ticker FROM documents LEFT JOIN c ON t = upper(trim(source))""")
def catalog_tickers(spark, d):
    """Tickers that the catalog has: sources of documents that are labelled junk."""
    docs = _t(spark, d, "documents")
    catalog = docs.join(_t(spark, d, "labels").where("quality = 0"), "doc_id").select(F.col("source").alias("ticker"))
    return tools.known_ticker(F.col("source"), catalog, docs).select("doc_id", "known_ticker")


@query("""WITH q AS (SELECT *, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'user' AND t <> '' THEN t WHEN role = 'system' AND t <> '' THEN 'system: ' || t ELSE 'turn ' || turn END AS question, CASE WHEN role = 'system' THEN 'synthesize' ELSE 'continue' END AS route FROM q""")
def question_routes(spark, d):
    """The question by the order of its sources, and where the run goes on."""
    system = F.col("role") == "system"
    none = F.lit(None).cast("string")
    asked = tools.question(F.when(F.col("role") == "user", F.col("text")), F.lit("  "), none, F.when(system & (tx.collapse(F.col("text")) != ""), F.concat(F.lit("system: "), tx.collapse(F.col("text")))), F.concat(F.lit("turn "), "turn"))
    return _t(spark, d, "conversations").select("conv_id", "turn", asked.alias("question"), tools.route(F.when(system, F.lit("low_claim_support"))).alias("route"))


@query("""SELECT conv_id, turn, role AS names, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS n_entities, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS n_relations FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS role FROM conversations)""")
def model_answers(spark, d):
    """Entities and relations of answers; those of unknown types go, what can't be read is empty."""
    good = F.concat(F.lit('Here it is:\n```json\n{"entities": [{"name": "'), "role", F.lit('", "type": "Company"}, {"name": "x", "type": "Planet"}], "relations": [{"source": "a", "target": "b", "relationship": "CAUSED"}, {"source": "a", "target": "b", "relationship": "LIKES"}]}\n```\ndone'))
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, good).otherwise(F.concat(F.lit("{ no json: "), "text")).alias("answer"))
    got = ingest.extract(rows, "answer")
    return got.select("conv_id", "turn", F.array_join(F.transform("entities", lambda e: e["name"]), ",").alias("names"), F.size("entities").alias("n_entities"), F.size("relations").alias("n_relations"))


@query("""SELECT conv_id, turn, concat_ws(' ', nullif(trim(role), ''), nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '')) AS shown FROM conversations""")
def content_blocks(spark, d):
    """Text of content blocks; blank ones add nothing."""
    block = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("text"))
    blocks = F.array(block("text", F.col("role")), block("text", F.lit(" \n ")), block("image", F.lit(None).cast("string")), block("text", F.col("text")))
    return _t(spark, d, "conversations").select("conv_id", "turn", tx.content_text(blocks).alias("shown"))


@query("""WITH s AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, greatest(0.0, least(1.0, x)) AS clamped, repeat('█', CAST(floor(greatest(0.0, least(1.0, x)) * 20) AS INT)) || repeat('░', 20 - CAST(floor(greatest(0.0, least(1.0, x)) * 20) AS INT)) AS bar, CASE WHEN x BETWEEN -0.5 AND 0.75 THEN x ELSE 0.25 END AS bounded FROM s""")
def score_bars(spark, d):
    """Scores within bounds, and as bars."""
    x = F.element_at("embedding", 1).cast("double")
    return _t(spark, d, "embeddings").where("embedding is not null").select("vec_id", tx.clamp(x).alias("clamped"), tx.bar(x).alias("bar"), tx.bounded_float(x, 0.25, -0.5, 0.75).alias("bounded"))


@query("SELECT conv_id, arg_min(text, turn) AS title FROM conversations GROUP BY 1 ORDER BY conv_id DESC LIMIT 100")
def recent_threads(spark, d):
    """The hundred latest threads by their titles."""
    return jobs.threads(jobs.thread_titles(_t(spark, d, "conversations"), "conv_id", "turn", "text"), [F.desc("conv_id")])


@query("SELECT doc_id % 3 = 0 AS pdf, count(*) AS n FROM documents GROUP BY 1")
def files_by_suffix(spark, d):
    """Which documents a parser reads, by the suffix of their file."""
    rows = _t(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, F.lit(".PDF")).otherwise(F.lit(".pdf.txt"))).alias("file_path"))
    pdf, other = files.dispatch(rows)
    return pdf.select(F.lit(True).alias("pdf")).unionByName(other.select(F.lit(False).alias("pdf"))).groupBy("pdf").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS kind, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def rows_by_type(spark, d):
    """Orders written in a folder for each status and read again."""
    path = _folder(spark, "types")
    graph.write_by_type(_t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("kind")), "kind", path, each=5000)
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text FROM conversations")
def csv_round_trip(spark, d):
    """Messages, line feeds and quotes included, written as CSV and read again."""
    path = _folder(spark, "csv")
    files.write_csv(_t(spark, d, "conversations").select("conv_id", "turn", "role", "text"), path)
    return files.results(spark, path)


@query("SELECT 'c' || item_id // 16 AS category, text AS question, CAST(item_id AS VARCHAR) AS reference, CAST(NULL AS VARCHAR) AS ticker FROM benchmark")
def testset_files(spark, d):
    """Benchmark items as test files, lists of objects of which fields may lack, read as a test set."""
    path = _folder(spark, "testset")
    item = F.struct(F.concat(F.lit("c"), F.floor(F.col("item_id") / 16)).alias("category"), F.col("text").alias("question"), F.col("item_id").cast("string").alias("reference"))
    rows = _t(spark, d, "benchmark").groupBy(F.floor(F.col("item_id") / 16).alias("part")).agg(F.to_json(F.collect_list(item)).alias("value"))
    rows.write.partitionBy("part").text(path)
    return files.testset(spark, f"{path}/*").select("category", "question", "reference", "ticker")


@query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(sum(length(text)) + 2 * count(*) - 1 AS BIGINT) AS n_chars, 'GENERAL' AS section_type, 'Article' AS title, 1 AS page_start FROM conversations GROUP BY 1")
def markdown_round_trip(spark, d):
    """Documents written as one text each, their parts in order, and read as whole sections."""
    path = _folder(spark, "markdown")
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.col("text").alias("content"))
    files.write_markdown(rows, path)
    got = files.text_sections(spark, f"{path}/*")
    return got.select(F.nullif(F.regexp_extract("file_path", r"doc_id=(-?\d+)(/|\.md$)", 1), F.lit("")).alias("doc_id"), F.length("content").cast("long").alias("n_chars"), "section_type", "title", "page_start")
