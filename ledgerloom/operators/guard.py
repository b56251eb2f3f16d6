"""Guardrails: ordered decision tables over evidence, claims and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PERIOD, VALUE, numeric_claims, parse_value, strip
from ..schema import CLAIM_BLOCK, CLAIM_DOWNGRADE, COVERAGE_FLOOR, QUALITY_MIN_EVIDENCE, QUALITY_MIN_SCORE

# Fixed values.
GUIDANCE = {
    "insufficient_evidence_count": "Ingest additional filings or disclosures covering the requested metric and period.",
    "low_retrieval_score": "Ingest a source that directly states the requested value or comparison.",
    "missing_table_evidence": "Ingest a tabular source for the requested metric (for example, earnings table or outlook table).",
}
CATALOG_TOKENS = ["company catalog", "not in the company catalog", "company_ticker", "company ticker", "ticker"]
CATALOG_SLOTS = ["entity_data", "company_ticker", "ticker", "entity"]
CLARIFY = ["Which fiscal year or reporting period should be used?", "Which exact metric or scope should be prioritized?"]
INGEST = [
    "Ingest a newer filing or report that explicitly contains the requested metric and period.",
    "Include a source covering the exact timeframe needed for this question.",
    "Re-run ingestion and ask the same question again.",
]
CHART_INTENTS = ["comparison", "trend_analysis", "risk_assessment"]


def quality_gate(df: DataFrame, min_score: float = QUALITY_MIN_SCORE, min_evidence: int = QUALITY_MIN_EVIDENCE) -> DataFrame:
    """Adds failures, passed, blocked_reason and guidance from evidence_count, avg_score,
    table_count and needs_tables."""
    failures = F.array_compact(F.array(
        F.when(F.col("evidence_count") < min_evidence, F.lit("insufficient_evidence_count")),
        F.when(F.col("avg_score") < min_score, F.lit("low_retrieval_score")),
        F.when(F.col("needs_tables") & (F.col("table_count") < 1), F.lit("missing_table_evidence")),
    ))
    texts = F.create_map(*(F.lit(v) for kv in GUIDANCE.items() for v in kv))
    out = df.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)
    return out.withColumns({"blocked_reason": F.when(~F.col("passed"), F.lit("insufficient_evidence_quality")), "guidance": F.transform("failures", lambda f: F.element_at(texts, f))})


def claim_support(df: DataFrame, answer: str, evidence: str) -> DataFrame:
    """Numbers of the answer that the evidence text has too; without numbers the ratio is 1."""
    return _support(df.withColumns({"__claims": numeric_claims(F.col(answer)), "__known": numeric_claims(F.col(evidence))}))


def claim_support_by(df: DataFrame, key: str, answer: str, evidence: DataFrame, text: str) -> DataFrame:
    """claim_support of rows that share evidence: its numbers are read once for each ``key``, and
    they are joined, not the text."""
    known = evidence.select(key, numeric_claims(F.col(text)).alias("__known"))
    return _support(df.withColumn("__claims", numeric_claims(F.col(answer))).join(known, key))


def _support(out: DataFrame) -> DataFrame:
    missing = F.array_except("__claims", "__known")
    total, lacking = F.size("__claims"), F.size(missing)
    ratio = F.when(total == 0, F.lit(1.0)).otherwise((total - lacking) / F.greatest(total, F.lit(1)))
    return out.withColumns({
        "claim_total_count": total, "supported_claim_count": total - lacking, "unsupported_claim_count": lacking,
        "claim_support_ratio": ratio, "unsupported_claims": missing,
    }).drop("__claims", "__known")


def claim_gate(df: DataFrame) -> DataFrame:
    """From claim counts, ratio, coverage and confidence the block and the confidence left."""
    any_ = F.col("claim_total_count") > 0
    block = any_ & (F.col("claim_support_ratio") < CLAIM_BLOCK)
    down = any_ & (F.col("claim_support_ratio") < CLAIM_DOWNGRADE)
    thin = (F.col("confidence") == "high") & (F.col("citation_coverage") < COVERAGE_FLOOR)
    return df.withColumns({
        "blocked_reason": F.when(block, F.lit("low_claim_support")),
        "final_confidence": F.when(block | down, F.lit("low")).when(thin, F.lit("medium")).otherwise(F.col("confidence")),
        "confidence_overridden": block | down | thin,
    })


def period_points(df: DataFrame, id_: str, text: str, fixed: bool = False) -> DataFrame:
    """(id, pos, period, value, unit): the first value of each period of a text.

    Sentences end at line feeds, dots and semicolons. The first number of a sentence is
    its value, even if it is the period's own digit; ``fixed`` masks the period and
    doesn't cut decimals.
    """
    parts = F.split(F.coalesce(text, F.lit("")), r"\n|[.;](?!\d)" if fixed else r"[\n.;]")
    rows = df.select(id_, F.posexplode(parts).alias("pos", "s")).withColumn("s", strip(F.col("s")))
    masked = F.regexp_replace("s", f"(?iU){PERIOD}", "") if fixed else F.col("s")
    rows = rows.select(id_, "pos", F.regexp_extract("s", f"(?iU){PERIOD}", 0).alias("raw"), F.regexp_extract(masked, f"(?iU){VALUE}", 1).alias("v"), F.regexp_extract(masked, f"(?iU){VALUE}", 2).alias("u"))
    rows = rows.where("raw <> '' and v <> ''").withColumns({"period": F.upper(F.regexp_replace("raw", r"(?U)\s+", " ")), "value": parse_value(F.col("v"))}).where("value is not null")
    first = F.row_number().over(Window.partitionBy(id_, "period").orderBy("pos"))
    return rows.withColumn("k", first).where("k = 1").select(id_, "pos", "period", "value", F.nullif(F.lower("u"), F.lit("")).alias("unit"))


def chart_gate(df: DataFrame) -> DataFrame:
    """From blocked_reason, confidence, citation_coverage, intent, needs_multi_period and
    n_points: reason, enabled and chart_type, the first failing test first."""
    reason = (
        F.when(F.coalesce("blocked_reason", F.lit("")) != "", F.lit("blocked_response"))
        .when(F.lower("confidence") == "low", F.lit("low_confidence_answer"))
        .when(F.col("citation_coverage") < COVERAGE_FLOOR, F.lit("low_citation_coverage"))
        .when(~F.col("intent").isin(CHART_INTENTS) & ~F.col("needs_multi_period"), F.lit("intent_not_visualization_oriented"))
        .when(F.col("n_points") < 2, F.lit("insufficient_structured_points"))
        .otherwise(F.lit("comparison_or_trend_with_supported_period_values"))
    )
    on = reason == "comparison_or_trend_with_supported_period_values"
    return df.withColumns({"reason": reason, "enabled": on, "chart_type": F.when(on, F.when(F.col("intent") == "trend_analysis", F.lit("line")).otherwise(F.lit("grouped_bar")))})


CHART_TITLE = "Trend and Comparison View"


def chart_payload(df: DataFrame, points: DataFrame, id_: str) -> DataFrame:
    """chart_gate's columns with what an enabled chart shows: title, unit, data (period, value),
    insight and citations; null where it is disabled.

    Reads the columns of chart_gate without n_points, question, bullets and citations;
    ``points`` are those of period_points. The unit is the last one that a point has.
    """
    at = F.struct("pos", F.col("period"), F.col("value"))
    data = F.transform(F.sort_array(F.collect_list(at)), lambda p: F.struct(p["period"].alias("period"), p["value"].alias("value")))
    own = points.groupBy(id_).agg(data.alias("data"), F.max_by("unit", F.when(F.col("unit").isNotNull(), F.col("pos"))).alias("unit"))
    out = chart_gate(df.join(own, id_, "left").withColumn("n_points", F.coalesce(F.size("data"), F.lit(0))))
    on = F.col("enabled")
    title = F.when(strip(F.coalesce("question", F.lit(""))) != "", F.left("question", F.lit(120))).otherwise(F.lit(CHART_TITLE))
    none = F.lit(None)
    return out.withColumns({
        "title": F.when(on, title), "data": F.when(on, F.col("data")).otherwise(none), "unit": F.when(on, F.col("unit")),
        "insight": F.when(on, F.get(cleaned(F.col("bullets"), 1), F.lit(0))), "shown_citations": F.when(on, F.slice(F.col("citations"), F.lit(1), F.lit(3))),
    }).drop("n_points")


def _one_of(c: Column, allowed: list[str], default: str) -> Column:
    v = F.lower(strip(F.coalesce(c, F.lit(default))))
    return F.when(v.isin(allowed), v).otherwise(F.lit(default))


def cleaned(c: Column, most: int | None = None) -> Column:
    """Strings stripped, blank ones dropped, at most ``most``."""
    out = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return out if most is None else F.slice(out, F.lit(1), F.lit(most))


def domain_decision(df: DataFrame) -> DataFrame:
    status = _one_of(F.col("domain_status"), ["financial_supported", "non_financial", "uncertain"], "uncertain")
    sure = _one_of(F.col("domain_confidence"), ["low", "medium", "high"], "medium")
    blocked = F.when(status == "non_financial", F.lit("non_financial")).when(status == "uncertain", F.lit("domain_uncertain"))
    return df.withColumns({"domain_status": status, "domain_confidence": sure, "blocked_reason": blocked, "gate_passed": blocked.isNull()})


def readiness_decision(df: DataFrame) -> DataFrame:
    """answer_mode after the catalog-mismatch override, blocked_reason and open questions.

    Reads answer_mode, reason, missing_slots, clarification_questions,
    ingest_recommendations, needs_company_filter and ticker.
    """
    mode = _one_of(F.col("answer_mode"), ["answer", "clarify", "request_ingestion"], "answer")
    reason = F.lower(strip(F.coalesce("reason", F.lit(""))))
    slots = F.transform(cleaned(F.col("missing_slots")), lambda s: F.lower(s))
    token = F.lit(False)
    for t in CATALOG_TOKENS:
        token = token | reason.contains(t)
    only = (F.size(slots) > 0) & (F.size(F.array_except(slots, F.lit(CATALOG_SLOTS))) == 0)
    override = (mode == "request_ingestion") & ~F.coalesce("needs_company_filter", F.lit(False)) & (F.coalesce("ticker", F.lit("")) == "") & (token | only)
    final = F.when(override, F.lit("answer")).otherwise(mode)
    asks, recs = cleaned(F.col("clarification_questions"), 3), cleaned(F.col("ingest_recommendations"), 4)
    open_ = F.when(final == "clarify", F.when(F.size(asks) > 0, asks).otherwise(F.lit(CLARIFY))).when(final == "request_ingestion", F.when(F.size(recs) > 0, recs).otherwise(F.lit(INGEST))).otherwise(F.array().cast("array<string>"))
    blocked = F.when(final == "clarify", F.lit("needs_clarification")).when(final == "request_ingestion", F.lit("needs_additional_data_ingestion"))
    return df.withColumns({"final_mode": final, "overridden": override, "blocked_reason": blocked, "open_questions": open_})
