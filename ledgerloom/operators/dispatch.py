"""From a plan to evidence: section joins, the searches that a plan asks for, coverage, fixed responses."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, strip
from ..schema import MOST_HITS, TOOLS
from .evidence import concat_hits, dedupe_rank, evidence, quality, ranked, ticker_vote
from .guard import quality_gate
from .held import held, looked_up
from .retrieve import context, top_k, top_k_all, usable

# Fixed values.
NO_COMPANIES = "No companies available in the graph."
NO_QUESTION = "No question text found in the graph input or messages."
BLOCKED = {
    "non_financial": (
        "This assistant is configured for financial and filing-related questions only. Ask about company filings, metrics, periods, risks, or financial performance.",
        "Ask a financial question tied to a company or reporting period available in the dataset.",
    ),
    "domain_uncertain": (
        "The request appears ambiguous for this financial assistant. Please clarify the financial metric, filing, company, or period you want.",
        "Which company, filing period, or financial metric should be analyzed?",
    ),
}


@dataclass(frozen=True)
class Corpus:
    """What retrieval reads.

    chunks (id, text, embedding), tables (id, markdown, sequence, embedding), has_chunk and
    has_table (section_id, id), sections (id, doc_id, title, section_type), documents (id,
    doc_type, period), filed (company, doc_id), companies (name, ticker), next_chunk (src,
    dst), mentions (chunk_id, name), relations (src_name, rel_type, tgt_name).
    """

    chunks: DataFrame
    tables: DataFrame
    has_chunk: DataFrame
    has_table: DataFrame
    sections: DataFrame
    documents: DataFrame
    filed: DataFrame
    companies: DataFrame
    next_chunk: DataFrame
    mentions: DataFrame
    relations: DataFrame


@dataclass(frozen=True)
class Plan:
    """A normalised tool plan of one question."""

    tools: tuple[str, ...] = (TOOLS[0],)
    chunk_top_k: int = 8
    table_top_k: int = 6
    ticker: str | None = None
    period: str | None = None
    use_causal_edges: bool = True

    def __post_init__(self):
        if not (1 <= self.chunk_top_k <= MOST_HITS and 0 <= self.table_top_k <= MOST_HITS):
            raise ValueError(f"chunk_top_k is 1 to {MOST_HITS}, table_top_k 0 to {MOST_HITS}")
        if unknown := set(self.tools) - set(TOOLS):
            raise ValueError(f"unknown tools: {sorted(unknown)}")


#: A row of a table of questions: Plan's fields, and whether the answer needs tables.
QUESTION = (
    "question_id long, embedding array<double>, tools array<string>, chunk_top_k int, table_top_k int, "
    "ticker string, period string, use_causal_edges boolean, needs_tables boolean"
)


@dataclass(frozen=True)
class Retrieved:
    """hits in the order of the searches, their metadata if the graph was asked, and counts."""

    hits: DataFrame
    paths: DataFrame | None
    used_tools: list[str] = field(default_factory=list)


def _asked(plan: Plan, query: list[float], corpus: Corpus, needs_tables: bool = False) -> DataFrame:
    """A plan and its vector as the one row of a table of questions."""
    row = (0, [float(x) for x in query], list(plan.tools), plan.chunk_top_k, plan.table_top_k, plan.ticker, plan.period, plan.use_causal_edges, needs_tables)
    return corpus.chunks.sparkSession.createDataFrame([row], QUESTION)


def with_section(hits: DataFrame, links: DataFrame, corpus: Corpus, small: bool = True) -> DataFrame:
    """Hits with section, document and company; what is missing is null.

    ``small`` hits (MOST_HITS of each of few questions) are held between the steps, and the ids
    that a step needs are literals of its scan. Others are joined with each table once.
    """
    c = corpus
    steps = [
        ("id", links.select("section_id", "id"), "section_id"),
        ("section_id", c.sections.select(F.col("id").alias("section_id"), "doc_id", F.col("title").alias("section_title"), "section_type"), "doc_id"),
        ("doc_id", c.documents.select(F.col("id").alias("doc_id"), "doc_type", "period"), None),
        ("doc_id", c.filed.select("doc_id", "company"), "company"),
        ("company", c.companies.select(F.col("name").alias("company"), "ticker"), None),
    ]
    if not small:
        for key, table, _ in steps:
            hits = hits.join(table, key, "left")
        return hits
    now = held(hits, True, ("id",))
    keys = {"id": now.values("id")}
    for key, table, follows in steps:
        now = held(now.df.join(looked_up(table, key, keys[key]), key, "left"), True, (follows,) if follows else ())
        if follows:
            keys[follows] = now.values(follows)
    return now.df


def _found(vectors: DataFrame, asked: DataFrame, links: DataFrame, corpus: Corpus, one: bool) -> DataFrame:
    """Nearest rows of each question with their section, after the question's own filters.

    ``asked`` has question_id, embedding, k and the filters. One question is a bounded sort of
    one pass over the vectors; many are compared in blocks.
    """
    if one:
        q = asked.first()
        hits = None if q is None else top_k(vectors, q["embedding"], q["k"]).withColumn("question_id", F.lit(q["question_id"]))
        if hits is None:
            return _found_none(vectors, links, corpus)
    else:
        most = asked.agg(F.max("k")).first()[0]
        if most is None:
            return _found_none(vectors, links, corpus)
        near = top_k_all(vectors, asked.select(F.col("question_id").alias("query_id"), "embedding"), most)
        near = near.withColumnRenamed("query_id", "question_id").join(asked.select("question_id", "k"), "question_id").where(F.col("rank") <= F.col("k"))
        near = held(near.select("question_id", "id", "score"), False).df
        hits = near.join(vectors.drop("embedding"), "id")
    found = with_section(hits, links, corpus, one)
    want = asked.select("question_id", F.upper("ticker").alias("__ticker"), F.col("period").alias("__period"))
    found = found.join(F.broadcast(want) if one else want, "question_id")
    found = found.where(F.col("__ticker").isNull() | (F.upper("ticker") == F.col("__ticker"))).where(F.col("__period").isNull() | F.contains("period", "__period"))
    return held(found.drop("__ticker", "__period"), one).df


def _found_none(vectors: DataFrame, links: DataFrame, corpus: Corpus) -> DataFrame:
    hits = vectors.drop("embedding").limit(0).withColumns({"score": F.lit(0.0), "question_id": F.lit(0).cast("long")})
    return with_section(hits, links, corpus, False)


def _hits(corpus: Corpus, questions: DataFrame, one: bool) -> DataFrame:
    """Rows of all questions: those of chunks with their context, those of tables."""
    tools = F.coalesce("tools", F.array().cast("array<string>"))
    has = lambda t: F.array_contains(tools, t)
    table = questions.where(has("table_search") & (F.col("table_top_k") > 0)).withColumn("k", F.col("table_top_k"))
    tables = _found(corpus.tables, table, corpus.has_table, corpus, one)
    # The graph needs seeds: chunks are searched after all where tables found nothing.
    with_tables = tables.select("question_id").distinct()
    bare = questions.where(has("graph_traversal") & ~has("chunk_search")).join(with_tables, "question_id", "left_anti")
    asked = questions.where(has("chunk_search")).unionByName(bare).withColumn("k", F.col("chunk_top_k"))
    chunks = _found(corpus.chunks, held(asked, one).df, corpus.has_chunk, corpus, one)
    ids = held(chunks.select("id").distinct(), one, ("id",))
    known = ids.values("id")
    around = context(ids.df, corpus.next_chunk, corpus.mentions, corpus.relations, known)
    none = F.array().cast("array<string>")
    causal = questions.select("question_id", F.coalesce("use_causal_edges", F.lit(True)).alias("__causal"))
    chunks = chunks.join(around, "id", "left").join(causal, "question_id").withColumn("causal_links", F.when(F.col("__causal"), F.col("causal_links")).otherwise(none)).drop("__causal")
    turn = F.row_number().over(Window.partitionBy("question_id", "source_type").orderBy(F.desc("score"), "source_id"))
    parts = [usable(chunks, "chunk", "id", "text"), usable(tables, "table", "id", "markdown").drop("markdown")]
    hits = dedupe_rank(concat_hits(*(p.withColumn("pos", turn) for p in parts)), ["src_ord", "pos"], ["question_id"])
    return held(hits, one).df


def retrieve_all(corpus: Corpus, questions: DataFrame) -> DataFrame:
    """What the plans of ``questions`` (QUESTION) find: a row for each hit with question_id, source_type,
    source_id, score, text, section, document, company, context, and pos, its place among the
    question's hits of that kind.

    One plan whatever the number of questions: a search of tables and one of chunks, each
    comparing all its questions in blocks, then a join with each table of the graph. Tools that are
    null or unknown find nothing; k's are 1 to MOST_HITS for chunks, 0 to MOST_HITS for tables, others
    raise; an empty table of questions finds nothing.
    """
    k = F.coalesce("chunk_top_k", F.lit(0)).between(1, MOST_HITS) & F.coalesce("table_top_k", F.lit(-1)).between(0, MOST_HITS)
    checked = questions.withColumn("question_id", F.when(k, F.col("question_id")).otherwise(F.raise_error(F.lit(f"chunk_top_k is 1 to {MOST_HITS}, table_top_k 0 to {MOST_HITS}")).cast("long")))
    return _hits(corpus, held(checked, False).df, False)


def gather_all(corpus: Corpus, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence with question_id and rank, a row of counts, gate and ticker for each question)."""
    return _judged(retrieve_all(corpus, questions), questions)


def _judged(hits: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    ranked_ = ranked(hits, ["src_ord", "pos"], ["question_id"])
    rows = evidence(ranked_.withColumn("doc_id", F.col("doc_id").cast("string")), ["question_id", "rank"])
    counts = questions.select("question_id", F.col("ticker").alias("__own"), F.coalesce("needs_tables", F.lit(False)).alias("needs_tables")).join(quality(hits, ["question_id"]), "question_id", "left")
    counts = counts.na.fill(0, ["evidence_count", "chunk_count", "table_count"]).na.fill(0.0, ["avg_score"])
    vote = ticker_vote(ranked_, "question_id", "rank").select("question_id", F.col("ticker").alias("__voted"))
    return rows, quality_gate(counts).join(vote, "question_id", "left").withColumn("ticker", F.coalesce("__own", "__voted")).drop("__own", "__voted")


def search_chunks(corpus: Corpus, query: list[float], plan: Plan) -> DataFrame:
    """Nearest chunks, then their context, then the filters: fewer rows than asked may stay."""
    return dispatch(corpus, query, replace(plan, tools=("chunk_search",))).hits


def search_tables(corpus: Corpus, query: list[float], plan: Plan) -> DataFrame:
    return dispatch(corpus, query, replace(plan, tools=("table_search",))).hits


def dispatch(corpus: Corpus, query: list[float], plan: Plan) -> Retrieved:
    """The searches that the tools of one question's plan name.

    Tables are left out when none are asked for. The graph tool needs seeds: where the
    tables found nothing and chunks weren't asked for, chunks are searched after all. The
    few hits are held by the driver between the steps, so each search runs once.
    """
    hits = _hits(corpus, held(_asked(plan, query, corpus), True).df, True).drop("question_id")
    return Retrieved(hits, hits.drop("text", "src_ord", "pos") if "graph_traversal" in plan.tools else None, sorted(set(plan.tools)))


def gathered_evidence(corpus: Corpus, query: list[float], plan: Plan, needs_tables: bool = False) -> tuple[DataFrame, DataFrame]:
    """(evidence by rank, one row with counts, the ticker and the gate's outcome) of a question.

    Without a ticker in the plan the hits' vote decides.
    """
    asked = held(_asked(plan, query, corpus, needs_tables), True).df
    rows, gate = _judged(_hits(corpus, asked, True), asked)
    return rows.drop("question_id"), gate.drop("question_id")


def citation_coverage(citations: Column, evidence_count: Column) -> Column:
    """Citations over evidence; without evidence over one."""
    return citations / F.greatest(F.lit(1), F.coalesce(evidence_count, F.lit(0)))


def result_item(content: Column, metadata: Column, kind: str) -> Column:
    """struct(content, metadata): a missing content is empty, a JSON text that is no object gives no metadata."""
    empty = F.from_json(F.lit("{}"), kind)
    looks = metadata.rlike(r"(?s)^\s*\{.*\}\s*$")
    return F.struct(F.coalesce(content.cast("string"), F.lit("")).alias("content"), F.coalesce(F.when(looks, F.from_json(metadata, kind)), empty).alias("metadata"))


def catalog_text(catalog: DataFrame) -> DataFrame:
    """One row: a line for each company by ticker; without companies a fixed sentence.

    A catalog is a short list; its text is one value.
    """
    ticker = strip(F.coalesce("ticker", F.lit("")))
    rows = catalog.select(ticker.alias("ticker"), F.nullif("name", F.lit("")).alias("name")).where("ticker <> ''").distinct()
    line = F.concat(F.lit("- "), F.col("ticker"), F.coalesce(F.concat(F.lit(": "), F.col("name")), F.lit("")))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ticker", F.coalesce("name", F.lit("")).alias("name"), line.alias("line")))), lambda x: x["line"])
    return rows.agg(F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit(NO_COMPANIES)).alias("catalog"))


def path_text(paths: DataFrame, by: str, pos: str, fields: list[str]) -> DataFrame:
    """One text a question: each path's fields as a JSON object on a line, nulls written out."""
    line = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    lines = F.transform(F.sort_array(F.collect_list(F.struct(pos, line.alias("line")))), lambda x: x["line"])
    return paths.groupBy(by).agg(F.array_join(lines, "\n").alias("paths"))


def require_question(question: Column) -> Column:
    """The question without surplus blanks; the query fails where there is none."""
    text = collapse(question)
    return F.when(text != "", text).otherwise(F.raise_error(F.lit(NO_QUESTION)).cast("string"))


def blocked_response(df: DataFrame) -> DataFrame:
    """From blocked_reason and clarification_question the answer row of a blocked question:
    answer, bullets, confidence and open_questions; null where nothing blocks."""
    reason = F.col("blocked_reason")
    pick = lambda k: F.when(reason == "non_financial", F.lit(BLOCKED["non_financial"][k])).when(reason == "domain_uncertain", F.lit(BLOCKED["domain_uncertain"][k]))
    own = F.nullif("clarification_question", F.lit(""))
    ask = F.when(reason == "domain_uncertain", F.coalesce(own, pick(1))).otherwise(pick(1))
    none = F.array().cast("array<string>")
    return df.withColumns({"answer": pick(0), "bullets": F.when(pick(0).isNotNull(), none), "confidence": F.when(pick(0).isNotNull(), F.lit("low")), "open_questions": F.when(ask.isNotNull(), F.array(ask))})


def resolved(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """What the analysis of a question leaves: ticker and question.

    Reads explicit_ticker, model_ticker, question and model_question. An explicit ticker
    stands as it is; a model's must be in the catalog, if that has any.
    """
    listed = catalog.select(F.upper(strip("ticker")).alias("known")).where("known <> ''").distinct()
    any_ = listed.limit(1).agg(F.count("*")).scalar() > 0
    said = F.nullif(F.upper(strip(F.coalesce("model_ticker", F.lit("")))), F.lit(""))
    out = df.withColumn("__said", said).join(listed, F.col("__said") == F.col("known"), "left")
    model = F.when(any_, F.col("known")).otherwise(F.col("__said"))
    better = F.when(strip(F.coalesce("model_question", F.lit(""))) != "", F.col("model_question"))
    return out.withColumns({"ticker": F.coalesce(F.nullif("explicit_ticker", F.lit("")), model), "question": F.coalesce(better, F.col("question"))}).drop("__said", "known")
