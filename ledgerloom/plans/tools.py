"""Tool plans and question resolution as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, strip
from ..schema import TOOLS

# Fixed values.
GRAPH_INTENTS = ["root_cause", "comparison", "trend_analysis", "risk_assessment"]
DEFAULTS = {"top_k_chunks": 8, "top_k_tables": 6, "hop_depth": 2}


def _truthy(name: str) -> Column:
    """0 and null count as missing here."""
    return F.coalesce(F.nullif(F.col(name), F.lit(0)), F.lit(DEFAULTS[name]))


def default_plan(df: DataFrame) -> DataFrame:
    """selected_tools and k's from intent, needs_tables, needs_graph_traversal, top_k_*."""
    table = F.coalesce("needs_tables", F.lit(False)) | (F.coalesce("top_k_tables", F.lit(0)) != 0)
    graph = F.coalesce("needs_graph_traversal", F.lit(False)) | F.coalesce(F.col("intent").isin(GRAPH_INTENTS), F.lit(False))
    tools = F.array_compact(F.array(F.lit("chunk_search"), F.when(table, F.lit("table_search")), F.when(graph, F.lit("graph_traversal"))))
    return df.withColumns({"selected_tools": tools, "chunk_top_k": _truthy("top_k_chunks"), "table_top_k": _truthy("top_k_tables"), "plan_hops": _truthy("hop_depth")})


def normalised_plan(df: DataFrame) -> DataFrame:
    """The asked tools that are known, each once in order; without any the default plan.

    Explicit zeros of the payload (asked_*) are kept; missing ones come from the plan.
    """
    asked = F.array_distinct(F.filter(F.coalesce("asked_tools", F.array().cast("array<string>")), lambda t: t.isin(TOOLS)))
    own = F.size(asked) > 0
    base = default_plan(df)
    pick = lambda a, p, out: F.when(own, F.coalesce(a, p, F.lit(DEFAULTS[p]))).otherwise(F.col(out))
    return base.withColumns({
        "selected_tools": F.when(own, asked).otherwise(F.col("selected_tools")),
        "chunk_top_k": pick("asked_chunk_k", "top_k_chunks", "chunk_top_k"), "table_top_k": pick("asked_table_k", "top_k_tables", "table_top_k"),
    })


def question(messages: Column, input_messages: Column, question_: Column, input_: Column, input_question: Column) -> Column:
    """The first that isn't blank: messages, messages of the input, question, input, its question."""
    return F.coalesce(*(F.nullif(collapse(c), F.lit("")) for c in (messages, input_messages, question_, input_, input_question)), F.lit(""))


def effective_ticker(ticker: Column, use_company_filter: Column) -> Column:
    return F.when(F.coalesce(use_company_filter, F.lit(True)), ticker)


def known_ticker(raw: Column, catalog: DataFrame, df: DataFrame, out: str = "known_ticker") -> DataFrame:
    """Upper-case ticker if the catalog has it; an empty catalog allows all."""
    candidate = F.nullif(F.upper(strip(raw)), F.lit(""))
    if catalog.isEmpty():
        return df.withColumn(out, candidate)
    listed = catalog.select(F.upper(strip(F.col("ticker"))).alias(out)).where(f"{out} <> ''").distinct()
    return df.withColumn("__ticker", candidate).join(listed, F.col("__ticker") == F.col(out), "left").drop("__ticker")


def expected_domain(explicit: Column, category: Column) -> Column:
    own = F.lower(strip(F.coalesce(explicit, F.lit(""))))
    kind = F.lower(strip(F.coalesce(category, F.lit(""))))
    return F.when(own.isin("financial_supported", "non_financial"), own).when(kind.isin("robustness", "non_financial", "out_of_scope"), F.lit("non_financial")).otherwise(F.lit("financial_supported"))


def route(blocked_reason: Column) -> Column:
    return F.when(F.coalesce(blocked_reason, F.lit("")) != "", F.lit("synthesize")).otherwise(F.lit("continue"))
