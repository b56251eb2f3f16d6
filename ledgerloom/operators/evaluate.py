"""Evaluation analytics over question results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bar, blank_to_null, snippet, strip
from ..plans.tools import expected_domain

# Fixed values.
NOT_METRICS = {
    "user_input", "response", "reference", "retrieved_contexts", "category", "expected_domain", "retry_count", "error_class", "blocked_reason",
    "domain_status", "domain_gate_passed", "domain_confidence", "domain_reason", "domain_signals", "domain_adjudication_used",
    "retrieval_evidence_count", "retrieval_avg_score", "citation_count", "citation_coverage", "answer_confidence", "claim_support_ratio",
    "claim_total_count", "unsupported_claim_count", "confidence_overridden", "case_id",
}
NO_CONTEXT = "[no context retrieved]"


def metric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_METRICS]


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def number(c: str) -> Column:
    return F.col(c).cast("string").try_cast("double")


def confusion(df: DataFrame, blocked: Column, actual: Column) -> DataFrame:
    """Counts and rates; any block predicts non-financial."""
    n = df.select(blocked.alias("b"), actual.alias("a")).agg(
        F.count("*").alias("labeled_samples"), F.count_if(F.col("b") & F.col("a")).alias("tp"),
        F.count_if(F.col("b") & ~F.col("a")).alias("fp"), F.count_if(~F.col("b") & ~F.col("a")).alias("tn"), F.count_if(~F.col("b") & F.col("a")).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = n.withColumns({"accuracy": ratio(tp + tn, F.col("labeled_samples")), "precision_nf": ratio(tp, tp + fp), "recall_nf": ratio(tp, tp + fn), "false_block_rate": ratio(fp, fp + tn), "false_allow_rate": ratio(fn, tp + fn)})
    p, r = F.col("precision_nf"), F.col("recall_nf")
    return n.withColumn("f1_nf", ratio(2 * p * r, p + r))


def long_metrics(df: DataFrame, metrics: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep, metric, x): one row for each number; what isn't one is dropped."""
    parts = F.array(*(F.struct(F.lit(m).alias("metric"), number(m).alias("x")) for m in metrics))
    return df.select(*(keep or []), F.explode(parts).alias("m")).select(*(keep or []), "m.metric", "m.x").where(F.col("x").isNotNull() & ~F.isnan("x"))


def quantiles(counts: DataFrame, key: str, shares: dict[str, float], parts: int = 64) -> DataFrame:
    """(key, names of shares): linear quantiles of (key, x, count), each x of a key once.

    Values are dealt out by ranges that a sketch finds: each range's total gives its first
    rank, and a range is ranked by itself, so a key with very many different values is no
    single task. Keys are few (one a metric).
    """
    bounds = F.percentile_approx("x", [k / parts for k in range(1, parts)], 1000)
    low = counts.groupBy(key).agg(bounds.alias("__bounds"), F.sum("count").alias("__n"))
    part = F.size(F.filter("__bounds", lambda b: b < F.col("x")))
    rows = counts.join(low, key).withColumn("__part", part).drop("__bounds")
    sums = rows.groupBy(key, "__part").agg(F.sum("count").alias("__sum"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy(key, "__part").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("__in", F.sum("count").over(own)).join(sums, [key, "__part"]).withColumn("__end", F.col("__base") + F.col("__in"))
    begin = F.col("__end") - F.col("count")
    out = []
    for name, p in shares.items():
        at = (F.col("__n") - 1) * F.lit(p)
        lower, upper = F.floor(at), F.ceil(at)
        value = lambda k: F.max(F.when((begin <= k) & (k < F.col("__end")), F.col("x")))  # noqa: E731, B023
        a, z = value(lower), value(upper)
        out.append((a + (z - a) * (F.max(at) - F.max(lower))).alias(name))
    return ranked.groupBy(key).agg(*out)


def metric_stats(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, sample deviation, extremes, quartiles, health and warnings of each metric.

    One pass counts the different values of each metric; all else is from the counts.
    """
    counts = long_metrics(df, metrics).groupBy("metric", "x").agg(F.count("*").alias("count"))
    x = F.col("x")
    means = long_metrics(df, metrics).groupBy("metric").agg(F.count("*").alias("n"), F.avg(x).alias("__mean"), F.stddev_samp(x).alias("__std"), F.min(x).alias("__min"), F.max(x).alias("__max"))
    q = quantiles(counts, "metric", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    r = lambda c, name: F.round(c, 6).alias(name)
    out = means.join(q, "metric").select("metric", "n", r("__mean", "mean"), r("__std", "std"), r("__min", "min"), r("p25", "p25"), r("p50", "p50"), r("p75", "p75"), r("__max", "max"))
    mean = F.col("mean")
    return out.withColumns({
        "health": F.when(mean >= 0.85, F.lit("excellent")).when(mean >= 0.70, F.lit("watch")).otherwise(F.lit("critical")),
        "warn_mean": mean < 0.70, "warn_std": F.coalesce(F.col("std") > 0.25, F.lit(False)), "warn_zero": F.col("min") == 0,
    })


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    out = df.agg(F.round(F.corr(number(a), number(b)), 6).alias("r"))
    return out.withColumn("insight", F.when(F.col("r") > 0.5, F.lit("high")).when(F.col("r") < 0.2, F.lit("low")).otherwise(F.lit("moderate")))


def composite(df: DataFrame, metrics: list[str]) -> DataFrame:
    """The mean of a row's metrics that are numbers."""
    values = F.filter(F.array(*(number(m) for m in metrics)), lambda x: x.isNotNull() & ~F.isnan(x))
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("composite_score", F.when(F.size(values) > 0, total / F.size(values)))


def weakest(df: DataFrame, metrics: list[str], id_: str, n: int = 5) -> DataFrame:
    return composite(df, metrics).where("composite_score is not null").orderBy("composite_score", id_).limit(n)


def weakest_per_metric(df: DataFrame, metrics: list[str], id_: str) -> DataFrame:
    return long_metrics(df, metrics, [id_]).groupBy("metric").agg(F.min(F.struct("x", id_)).alias("w")).select("metric", F.col(f"w.{id_}").alias(id_), F.col("w.x").alias("value"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("none")).alias("value")).count()


def rates(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    return df.agg(*(F.round(F.avg(c.cast("int")), 6).alias(k) for k, c in flags.items()))


def overall(df: DataFrame, metrics: list[str], fail_under: float | None = None) -> DataFrame:
    """The mean of metric means, its bar, and whether it is under the threshold."""
    means = long_metrics(df, metrics).groupBy("metric").agg(F.avg("x").alias("mean"))
    out = means.agg(F.avg("mean").alias("overall"))
    return out.withColumns({"bar": bar(F.col("overall")), "failed": F.lit(False) if fail_under is None else F.col("overall") < fail_under})


def contexts(chunk_texts: Column, table_texts: Column) -> Column:
    """Texts of chunks, then of tables, stripped and not blank; a fixed one without any."""
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(chunk_texts, none), F.coalesce(table_texts, none))
    kept = F.filter(F.transform(both, lambda t: strip(F.coalesce(t, F.lit("")))), lambda t: t != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(NO_CONTEXT)))


def diagnostics(states: DataFrame) -> DataFrame:
    """case_id and 18 typed columns of each state (schema.STATE), with a default for what is missing.

    A count or a score of 0 counts as missing, as does an empty text.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    real = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    whole = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    signals = F.filter(F.transform(F.coalesce("policy_flags.domain_signals", F.array().cast("array<string>")), lambda x: strip(F.coalesce(x, F.lit("None")))), lambda x: x != "")
    return states.select(
        "case_id", whole("retry_count").alias("retry_count"), text("error_class").alias("error_class"), text("blocked_reason").alias("blocked_reason"),
        text("domain_status").alias("domain_status"), flag("policy_flags.domain_gate_passed").alias("domain_gate_passed"), text("policy_flags.domain_confidence").alias("domain_confidence"),
        text("policy_flags.domain_reason").alias("domain_reason"), F.array_join(signals, ", ").alias("domain_signals"), flag("policy_flags.domain_adjudication_used").alias("domain_adjudication_used"),
        F.coalesce(F.nullif("retrieval_quality.evidence_count", F.lit(0)), size("evidence")).alias("retrieval_evidence_count"), real("retrieval_quality.avg_score").alias("retrieval_avg_score"),
        size("final_answer.citations").alias("citation_count"), real("evaluation_signals.citation_coverage").alias("citation_coverage"),
        F.coalesce(F.nullif("evaluation_signals.confidence", F.lit("")), text("final_answer.confidence")).alias("answer_confidence"), real("evaluation_signals.claim_support_ratio").alias("claim_support_ratio"),
        whole("evaluation_signals.claim_total_count").alias("claim_total_count"), whole("evaluation_signals.unsupported_claim_count").alias("unsupported_claim_count"),
        flag("evaluation_signals.confidence_overridden").alias("confidence_overridden"),
    )


def samples(states: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, user_input, retrieved_contexts, response and reference (null if empty) of each case."""
    own = states.select("case_id", contexts(F.col("chunk_hits"), F.col("table_hits")).alias("retrieved_contexts"), F.coalesce("final_answer.answer", F.lit("")).alias("response"))
    asked = cases.select("case_id", F.col("question").alias("user_input"), F.nullif("reference", F.lit("")).alias("reference"))
    return asked.join(own, "case_id").select("case_id", "user_input", "retrieved_contexts", "response", "reference")


def result_rows(scored: DataFrame, diagnosed: DataFrame, cases: DataFrame) -> DataFrame:
    """Scored samples beside their diagnostics, category and expected domain first; by case_id,
    never by position."""
    c = cases.select("case_id", F.coalesce("category", F.lit("")).alias("category"), expected_domain(F.col("expected_domain"), F.col("category")).alias("expected_domain"))
    out = c.join(scored, "case_id").join(diagnosed, "case_id")
    return out.select("case_id", "category", "expected_domain", *(x for x in out.columns if x not in ("case_id", "category", "expected_domain")))


def retry_totals(df: DataFrame, column: str = "retry_count") -> DataFrame:
    """Sum and mean of retries; what is no number counts as 0."""
    n = F.coalesce(F.when(~F.isnan(number(column)), number(column)), F.lit(0.0))
    return df.agg(F.coalesce(F.sum(n), F.lit(0.0)).cast("long").alias("total_retries"), F.round(F.avg(n), 6).alias("mean_retries"))


def support_means(df: DataFrame) -> DataFrame:
    """Mean claim support and citation coverage over numbers, and the sum of unsupported claims."""
    real = lambda c: F.when(~F.isnan(number(c)), number(c))
    return df.agg(
        F.round(F.avg(real("claim_support_ratio")), 6).alias("mean_support"), F.coalesce(F.sum(real("unsupported_claim_count")), F.lit(0.0)).cast("long").alias("unsupported"),
        F.round(F.avg(real("citation_coverage")), 6).alias("mean_coverage"),
    )


def zero_cases(df: DataFrame, metrics: list[str], id_: str, most: int = 2) -> DataFrame:
    """(metric, id): of each metric the first rows that are exactly 0, at most ``most``."""
    zero = long_metrics(df, metrics, [id_]).where("x = 0")
    return zero.withColumn("n", F.row_number().over(Window.partitionBy("metric").orderBy(id_))).where(F.col("n") <= most).select("metric", id_)


def report(df: DataFrame, metrics: list[str], id_: str, question: str | None = None) -> str:
    """A Markdown report of small aggregates: metrics, warnings, weakest rows, correlation,
    reliability, domain gate and consistency; sections whose columns ``df`` lacks are left out."""
    shown = lambda m: m.replace("_", " ").title()
    there = set(df.columns)
    question = question or ("user_input" if "user_input" in there else id_)
    stats = {r["metric"]: r for r in metric_stats(df, metrics).collect()}
    stats = [stats[m] for m in metrics if m in stats]
    out = ["# Evaluation", "", f"{df.count()} cases", "", "## Metrics", "", "| metric | mean | std | min | p50 | p75 | max | health |", "|-|-|-|-|-|-|-|-|"]
    out += [f"| {shown(r['metric'])} | {r['mean']:.4f} | {(r['std'] or 0):.4f} | {r['min']:.4f} | {r['p50']:.4f} | {r['p75']:.4f} | {r['max']:.4f} | {r['health']} |" for r in stats]
    zeros: dict[str, list[str]] = {}
    for r in zero_cases(df, metrics, id_).join(df.select(id_, snippet(F.col(question).cast("string"), 70).alias("q")).dropDuplicates([id_]), id_).orderBy("metric", id_).collect():
        zeros.setdefault(r["metric"], []).append(r["q"])
    warn = []
    for r in stats:
        name = shown(r["metric"])
        warn += [f"- low mean of {name}: {r['mean']:.4f}"] if r["warn_mean"] else []
        warn += [f"- high variance of {name}: {r['std']:.4f}"] if r["warn_std"] else []
        warn += [f"- zero in {name}: {' | '.join(zeros.get(r['metric'], []))}"] if r["warn_zero"] else []
    out += ["", "## Warnings", "", *(warn or ["- none"]), "", "## Weakest", ""]
    for r in weakest(df, metrics, id_).collect():
        out.append(f"- {r[question]}: {r['composite_score']:.4f}")
        out += [f"  - {shown(m)}: {r[m]}" for m in metrics]
        out += [f"  - {c}: {str(r[c])[:300]}..." for c in ("response", "reference") if c in there and r[c] is not None]
    pair = ("llm_context_precision_with_reference", "faithfulness")
    if set(pair) <= there:
        r = correlation(df, *pair).first()
        out += ["", "## Correlation", "", f"- {shown(pair[0])} and {shown(pair[1])}: {'none' if r['r'] is None else format(r['r'], '.4f')} ({r['insight']})"]
    lines = []
    if "retry_count" in there:
        r = retry_totals(df).first()
        lines.append(f"- retries: {r['total_retries']}, a case {(r['mean_retries'] or 0):.2f}")
    for c in ("error_class", "domain_confidence"):
        if c in there:
            lines += [f"- {c} {r['value']}: {r['count']}" for r in value_counts(df, c).orderBy(F.desc("count"), "value").collect()]
    flags = {c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in ("domain_gate_passed", "domain_adjudication_used", "confidence_overridden") if c in there}
    if "blocked_reason" in there:
        flags |= {f"blocked_{k}": F.coalesce(F.col("blocked_reason"), F.lit("")) == k for k in ("non_financial", "domain_uncertain")}
    if flags:
        lines += [f"- {k}: {(v or 0):.2%}" for k, v in rates(df, flags).first().asDict().items()]
    if {"expected_domain", "blocked_reason"} <= there:
        label, stop = blank_to_null(F.lower(F.col("expected_domain"))), F.coalesce("blocked_reason", F.lit("")) != ""
        r = df.agg(F.avg(F.when(label == "financial_supported", stop.cast("int"))).alias("block"), F.avg(F.when(label == "non_financial", (~stop).cast("int"))).alias("allow")).first()
        lines += [f"- false {k} rate: {r[k]:.2%}" for k in ("block", "allow") if r[k] is not None]
    if {"claim_support_ratio", "unsupported_claim_count", "citation_coverage"} <= there:
        r = support_means(df).first()
        lines += [f"- {k}: {r[k]}" for k in ("mean_support", "unsupported", "mean_coverage") if r[k] is not None]
    return "\n".join([*out, "", "## Reliability", "", *lines] if lines else out)
