"""Decisions around a question: adjudicated domains, answers without generation, start checks, cancelled jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..plans.tools import default_plan, effective_ticker
from .evaluate import ratio
from .guard import cleaned

# Fixed values.
DOMAINS = ["financial_supported", "non_financial", "uncertain"]
CONFIDENCES = ["low", "medium", "high"]
CLASSIFIER_FAILED, ADJUDICATOR_FAILED = "domain_classifier_error", "domain_adjudicator_error"


def _known(c: Column, allowed: list[str], default: str) -> Column:
    v = F.lower(strip(c))
    return F.when(v.isin(allowed), v).otherwise(F.lit(default))


def adjudicate(df: DataFrame) -> DataFrame:
    """The domain after a second opinion, which is heard only where the first isn't financial_supported.

    Reads domain_status, domain_confidence, domain_signals and second_status,
    second_confidence, second_signals. A null status is a call that failed: the
    question then counts as supported with low confidence and a signal that says so.
    """
    failed, failed2 = F.col("domain_status").isNull(), F.col("second_status").isNull()
    first = F.when(failed, F.lit(DOMAINS[0])).otherwise(_known(F.col("domain_status"), DOMAINS, "uncertain"))
    used = first != DOMAINS[0]
    low = F.lit("low")
    sure = F.when(failed, low).otherwise(_known(F.col("domain_confidence"), CONFIDENCES, "medium"))
    signals = F.when(failed, F.array(F.lit(CLASSIFIER_FAILED))).otherwise(cleaned(F.col("domain_signals")))
    status2 = F.when(failed2, F.lit(DOMAINS[0])).otherwise(_known(F.col("second_status"), DOMAINS, "uncertain"))
    sure2 = F.when(failed2, low).otherwise(_known(F.col("second_confidence"), CONFIDENCES, "medium"))
    signals2 = F.when(failed2, F.array_distinct(F.concat(signals, F.array(F.lit(ADJUDICATOR_FAILED))))).otherwise(cleaned(F.col("second_signals")))
    status = F.when(used, status2).otherwise(first)
    return df.withColumns({
        "final_status": status, "final_confidence": F.when(used, sure2).otherwise(sure), "final_signals": F.when(used, signals2).otherwise(signals), "adjudicated": used,
        "blocked_reason": F.when(status == "non_financial", F.lit("non_financial")).when(status == "uncertain", F.lit("domain_uncertain")),
    })


def answer_state(df: DataFrame) -> DataFrame:
    """What becomes of an answer: passed on when blocked, without evidence, failed, or generated.

    Reads blocked_reason, final_answer, evidence_count and generated (null: the call
    failed). Adds outcome, out_reason (null where nothing blocks) and chart_reason.
    """
    reason = F.nullif(F.col("blocked_reason"), F.lit(""))
    passed, none = reason.isNotNull() & F.col("final_answer").isNotNull(), F.coalesce("evidence_count", F.lit(0)) == 0
    outcome = F.when(passed, F.lit("blocked_response")).when(none, F.lit("insufficient_evidence")).when(F.col("generated").isNull(), F.lit("generation_error")).otherwise(F.lit("generated"))
    out = df.withColumn("outcome", outcome)
    o = F.col("outcome")
    out_reason = F.when(o == "blocked_response", reason).when(o == "insufficient_evidence", F.coalesce(reason, o)).when(o == "generation_error", o)
    return out.withColumns({"out_reason": out_reason, "chart_reason": F.when(o != "generated", o)})


def retrieval_context(df: DataFrame) -> DataFrame:
    """The tools and the ticker that retrieval uses.

    Reads stored_tools (null: no stored plan, so that the default plan of intent,
    needs_* and top_k_* holds), use_company_filter and ticker.
    """
    base = default_plan(df)
    tools = F.coalesce("stored_tools", "selected_tools")
    return base.withColumns({"context_tools": F.sort_array(F.array_distinct(cleaned(tools))), "context_ticker": effective_ticker(F.col("ticker"), F.col("use_company_filter"))})


def start_check(asked: DataFrame, documents: DataFrame, files: DataFrame) -> DataFrame:
    """``asked`` (pos, id) with the problem that keeps an ingestion from starting, or null.

    ``documents`` has (id, file_path), each id once, and ``files`` (path).
    """
    known = documents.select("id", F.nullif("file_path", F.lit("")).alias("file_path"), F.lit(True).alias("known"))
    there = files.select(F.col("path").alias("file_path"), F.lit(True).alias("there")).distinct()
    out = asked.join(known, "id", "left").join(there, "file_path", "left")
    problem = F.when(F.col("known").isNull(), F.lit("not_found")).when(F.col("file_path").isNull(), F.lit("no_path")).when(F.col("there").isNull(), F.lit("no_file"))
    return out.select("pos", "id", problem.alias("problem"))


def start_status(checked: DataFrame) -> DataFrame:
    """One row: the first kind of problem that any id has, its status code and its ids' number."""
    kinds = ["not_found", "no_path", "no_file"]
    out = checked.agg(*(F.count_if(F.col("problem") == k).alias(k) for k in kinds))
    first = F.coalesce(*(F.when(F.col(k) > 0, F.lit(k)) for k in kinds))
    return out.select(first.alias("problem"), F.when(first.isNull(), 202).when(first == "not_found", 404).otherwise(400).alias("code"), F.coalesce(*(F.nullif(F.col(k), F.lit(0)) for k in kinds), F.lit(0)).alias("n_ids"))


def cancel(jobs: DataFrame, ids: list) -> DataFrame:
    """``jobs`` with the status of some set to CANCELLED, which resets their progress."""
    hit = F.coalesce(F.col("id").isin(ids), F.lit(False))
    return jobs.withColumns({"status": F.when(hit, F.lit("CANCELLED")).otherwise(F.col("status")), "progress": F.when(hit, F.lit(0)).otherwise(F.col("progress"))})


def labelled_rates(df: DataFrame, expected: str, blocked: str) -> DataFrame:
    """How many of the supported questions are blocked and of the others let through; null without any."""
    label, stop = F.lower(strip(F.col(expected))), F.coalesce(F.col(blocked), F.lit("")) != ""
    inside, outside = label == "financial_supported", label == "non_financial"
    got = df.agg(F.count_if(inside & stop).alias("a"), F.count_if(inside).alias("b"), F.count_if(outside & ~stop).alias("c"), F.count_if(outside).alias("d"))
    share = lambda x, n: F.when(F.col(n) > 0, F.round(ratio(F.col(x), F.col(n)), 6))
    return got.select(share("a", "b").alias("false_block_rate"), share("c", "d").alias("false_allow_rate"))
