"""Evidence: union, first-seen dedupe, ranking, votes and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schema import EVIDENCE


def concat_hits(*parts: DataFrame) -> DataFrame:
    """Bag union; pos keeps the order of the parts and within them of score and id."""
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("src_ord", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def dedupe_rank(hits: DataFrame, order: list, by: list[str] | None = None) -> DataFrame:
    """First seen of each (source_type, source_id) by ``order``, then rank by score; of each of ``by``.

    A missing score ranks as 0; ties keep the order of first sight.
    """
    first = F.row_number().over(Window.partitionBy(*(by or []), "source_type", "source_id").orderBy(*order))
    return hits.withColumn("__first", first).where("__first = 1").drop("__first")


def ranked(hits: DataFrame, order: list, by: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.coalesce("score", F.lit(0.0))), *order))
    return hits.withColumn("rank", rank)


def evidence(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.select(*(keys or []), *(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in EVIDENCE))


def quality(df: DataFrame, by: list[str]) -> DataFrame:
    """evidence_count, avg_score (0 if none), chunk_count and table_count."""
    return df.groupBy(*by).agg(
        F.count("*").alias("evidence_count"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"),
        F.count_if(F.col("source_type") == "chunk").alias("chunk_count"), F.count_if(F.col("source_type") == "table").alias("table_count"),
    )


def ticker_vote(df: DataFrame, by: str, pos: str, min_votes: int = 2, min_share: float = 0.6) -> DataFrame:
    """The group's most frequent ticker if it has votes and share enough; ties: seen first."""
    named = df.withColumn("t", F.upper(strip(F.coalesce("ticker", F.lit(""))))).where("t <> ''")
    votes = named.groupBy(by, "t").agg(F.count("*").alias("votes"), F.min(pos).alias("first"))
    own = Window.partitionBy(by)
    votes = votes.withColumn("share", F.col("votes") / F.sum("votes").over(own)).withColumn("n", F.row_number().over(own.orderBy(F.desc("votes"), "first")))
    ok = (F.col("votes") >= min_votes) & (F.col("share") >= min_share)
    return votes.where("n = 1").select(by, F.when(ok, F.col("t")).alias("ticker"), "votes", F.round("share", 6).alias("share"))


def citations(df: DataFrame, by: str, pos: str, most: int = 6) -> DataFrame:
    """Up to ``most`` distinct citations of a group in evidence order, with a title."""
    kind, id_ = F.lower(strip(F.coalesce("source_type", F.lit("")))), strip(F.coalesce(F.col("source_id").cast("string"), F.lit("")))
    names = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("section_title", "title", "doc_type", "doc_id") if c in df.columns]
    rows = df.select(by, pos, kind.alias("source_type"), id_.alias("source_id"), F.coalesce(*names).alias("title"), F.col("score").cast("double").alias("score"))
    rows = rows.where(F.col("source_type").isin("chunk", "table", "graph") & (F.col("source_id") != ""))
    first = F.row_number().over(Window.partitionBy(by, "source_type", "source_id").orderBy(pos))
    rows = rows.withColumn("k", first).where("k = 1")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(pos))).where(F.col("n") <= most).drop("k", pos)


def serialised(df: DataFrame, by: str, pos: str) -> DataFrame:
    """Header and body of each row, joined in order; a missing value prints as None."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    line = F.concat(F.lit("["), F.concat_ws(" | ", none("source_type"), none("doc_type"), none("period"), none("section_type"), F.concat(F.lit("score="), none("score"))), F.lit("]\n"), F.coalesce("text", F.lit("")))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(pos, line.alias("line")))), lambda x: x["line"])
    return df.groupBy(by).agg(F.array_join(lines, "\n\n---\n\n").alias("serialised"))
