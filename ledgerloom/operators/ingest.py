"""Ingestion: pages to sections, sections to chunks, injected embedding and extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_payload, or_default, page_snippet, splitter
from ..schema import ENTITY_LABELS, EXTRACTION, KEY_SECTIONS, MAX_ENTITY_CHUNKS, RELATION_TYPES


def headings(items: Column) -> Column:
    """Texts of heading items of over three characters."""
    kept = F.filter(items, lambda i: (i["type"] == "heading") & (F.length(F.trim(i["value"])) > 3))
    return F.transform(kept, lambda i: F.trim(i["value"]))


def page_tables(items: Column) -> Column:
    return F.transform(F.filter(items, lambda i: (i["type"] == "table") & (F.coalesce(i["value"], F.lit("")) != "")), lambda i: i["value"])


def pages_with_items(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Each page with the array of its items; none gives an empty array."""
    own = items.groupBy("doc_id", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "type", "value"))), lambda i: F.struct(i["type"].alias("type"), i["value"].alias("value"))).alias("items"))
    return pages.join(own, ["doc_id", "page"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<type:string,value:string>>")))


def outline(pages: DataFrame) -> DataFrame:
    """One text a document: a line for each page with its headings and snippet."""
    line = F.concat(F.lit("Page "), F.col("page"), F.lit(": headings=["), F.array_join("headings", ", "), F.lit("] | "), page_snippet(F.col("markdown")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", line.alias("l")))), lambda x: x["l"]), "\n").alias("outline"))


def covers(spans: Column, pages: Column) -> Column:
    """Whether the spans, in order, are exactly the sorted pages: no gap, no overlap."""
    valid = F.forall(spans, lambda s: s["page_start"] <= s["page_end"])
    # sequence(5, 3) counts down, so a turned span becomes empty before it is looked at.
    listed = F.flatten(F.transform(spans, lambda s: F.when(s["page_start"] <= s["page_end"], F.sequence(s["page_start"], s["page_end"])).otherwise(F.array().cast("array<int>"))))
    return valid & (listed == F.sort_array(pages))


def assemble(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections from spans (doc_id, idx, section_type, title, page_start, page_end): the
    pages within by an equi-join on each page number, joined by line feeds in order."""
    each = spans.where("page_start <= page_end").withColumn("page", F.explode(F.sequence("page_start", "page_end")))
    joined = each.join(pages, ["doc_id", "page"], "left")
    parts = F.sort_array(F.collect_list(F.struct("page", "markdown", "tables", "headings")))
    keys = ["doc_id", "idx", "section_type", "title", "page_start", "page_end"]
    got = joined.groupBy(*keys).agg(parts.alias("p"))
    none = F.array().cast("array<string>")
    return got.select(
        *keys, F.array_join(F.filter(F.transform("p", lambda x: x["markdown"]), lambda m: m.isNotNull()), "\n").alias("content"),
        F.flatten(F.transform("p", lambda x: F.coalesce(x["tables"], none))).alias("tables"), F.flatten(F.transform("p", lambda x: F.coalesce(x["headings"], none))).alias("headings"),
    )


def single_section(pages: DataFrame) -> DataFrame:
    """Fallback: all pages of a document in order as one GENERAL section, with their tables and headings."""
    none = F.array().cast("array<string>")
    lists = [F.coalesce(F.col(c), none).alias(c) if c in pages.columns else none.alias(c) for c in ("tables", "headings")]
    rows = pages.select("doc_id", "page", F.coalesce("markdown", F.lit("")).alias("markdown"), *lists)
    got = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "markdown", "tables", "headings"))).alias("p"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    return got.select(
        "doc_id", F.lit(0).alias("idx"), F.lit("GENERAL").alias("section_type"), F.lit("Document").alias("title"), "page_start", "page_end",
        F.array_join(F.transform("p", lambda x: x["markdown"]), "\n").alias("content"), F.flatten(F.transform("p", lambda x: x["tables"])).alias("tables"), F.flatten(F.transform("p", lambda x: x["headings"])).alias("headings"),
    )


def classify_pages(pages: DataFrame) -> DataFrame:
    """Stand-in for the injected page classifier: a keyword rule on headings, then runs of
    pages of the same type become spans."""
    text = F.lower(F.array_join("headings", " "))
    kind = (
        F.when(text.contains("risk"), F.lit("RISK")).when(text.contains("discussion"), F.lit("MD&A")).when(text.contains("earnings"), F.lit("EARNINGS"))
        .when(text.contains("financial"), F.lit("FINANCIALS")).when(text.contains("note"), F.lit("NOTES")).otherwise(F.lit("GENERAL"))
    )
    own = Window.partitionBy("doc_id").orderBy("page")
    rows = pages.withColumn("section_type", kind).withColumn("new", F.coalesce((F.lag("section_type").over(own) != F.col("section_type")).cast("int"), F.lit(0)))
    rows = rows.withColumn("idx", F.sum("new").over(own).cast("int"))
    return rows.groupBy("doc_id", "idx", "section_type").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end")).withColumn("title", F.col("section_type"))


def sections_of(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Sections (doc_id, idx, section_type, title, page_start, page_end, content, tables,
    headings) of parsed pages.

    Spans that aren't exactly a document's pages, or a document without spans, as where its
    classification failed, give one GENERAL section of all its pages.
    """
    listed = spans.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "page_start", "page_end"))), lambda s: F.struct(s["page_start"].alias("page_start"), s["page_end"].alias("page_end"))).alias("__spans"))
    there = pages.groupBy("doc_id").agg(F.collect_list("page").alias("__pages")).join(listed, "doc_id", "left")
    good = there.where(F.coalesce(covers(F.col("__spans"), F.col("__pages")), F.lit(False))).select("doc_id")
    whole = assemble(spans.join(good, "doc_id", "left_semi"), pages)
    return whole.unionByName(single_section(pages.join(good, "doc_id", "left_anti")))


def section_ids(sections: DataFrame) -> DataFrame:
    return sections.withColumn("id", F.concat_ws("_", "doc_id", F.lit("sec"), "idx"))


def chunk(sections: DataFrame, size: int = 2048, overlap: int = 256) -> DataFrame:
    """Chunks with a sequence from 0 over all sections of a document; blank ones are dropped.

    A section's first number is the count of pieces of the document's sections before it
    (by idx, which is a document's own for each section): one row a section is sorted.
    """
    pieces = sections.withColumn("pieces", splitter(size, overlap)("content"))
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    based = pieces.withColumn("base", F.coalesce(F.sum(F.size("pieces")).over(before), F.lit(0)))
    rows = based.select("doc_id", "idx", F.col("id").alias("section_id"), "section_type", F.col("page_start").alias("page"), "base", F.posexplode("pieces").alias("pos", "text"))
    rows = rows.withColumn("sequence", (F.col("base") + F.col("pos")).cast("int"))
    return rows.select(F.concat_ws("_", "doc_id", "section_type", "sequence").alias("id"), "section_id", "doc_id", "text", "section_type", "page", "sequence")


def section_tables(sections: DataFrame) -> DataFrame:
    """Tables of sections with ids, and the text that is embedded for them."""
    rows = sections.select(F.col("id").alias("section_id"), "section_type", "title", F.posexplode("tables").alias("sequence", "markdown"))
    embedded = F.concat(F.lit("["), F.col("section_type"), F.lit("] "), F.col("title"), F.lit("\n\n"), F.col("markdown"))
    return rows.select(F.concat_ws("_", "section_id", F.lit("tbl"), "sequence").alias("id"), "section_id", "markdown", "sequence", embedded.alias("context"))


def embed(df: DataFrame, text: str, embedder: Callable[[Column], Column]) -> DataFrame:
    """``embedder`` maps a text column to array<float>, as a pandas UDF over Arrow batches."""
    return df.withColumn("embedding", embedder(F.col(text)))


def check_dimension(df: DataFrame) -> DataFrame:
    """Counts of vectors, of different sizes and of nulls; one size and no null is right."""
    return df.agg(F.count("*").alias("n"), F.countDistinct(F.size("embedding")).alias("sizes"), F.count_if(F.col("embedding").isNull()).alias("missing")).withColumn("ok", (F.col("sizes") <= 1) & (F.col("missing") == 0))


def entity_chunks(chunks: DataFrame, most: int = MAX_ENTITY_CHUNKS) -> DataFrame:
    """The first ``most`` chunks of key sections of each document."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("sequence"))
    return chunks.where(F.col("section_type").isin(KEY_SECTIONS)).withColumn("__n", rank).where(F.col("__n") <= most).drop("__n")


def extract(chunks: DataFrame, answer: str) -> DataFrame:
    """Entities and relations of a model's answers; what can't be read is empty.

    Items of unknown type are dropped one by one.
    """
    got = chunks.withColumn("x", json_payload(F.col(answer), EXTRACTION))
    none_e = F.array().cast("array<struct<name:string,type:string,properties:map<string,string>>>")
    none_r = F.array().cast("array<struct<source:string,target:string,relationship:string,properties:map<string,string>>>")
    return got.withColumns({
        "entities": F.filter(F.coalesce("x.entities", none_e), lambda e: F.coalesce(e["type"].isin(ENTITY_LABELS), F.lit(False))),
        "relations": F.filter(F.coalesce("x.relations", none_r), lambda r: F.coalesce(r["relationship"].isin(RELATION_TYPES), F.lit(False))),
    }).drop("x")


def with_defaults(documents: DataFrame) -> DataFrame:
    """Missing or empty document fields get their defaults, null stats an empty map."""
    out = documents.withColumns({
        "ticker": or_default(F.col("ticker"), "UNKNOWN"), "company_name": or_default(F.col("company_name"), "Unknown Company"),
        "doc_type": or_default(F.col("doc_type"), "Document"), "period": or_default(F.col("period"), "Unknown"),
    })
    if "stats" in documents.columns:
        kind = documents.schema["stats"].dataType.simpleString()
        out = out.withColumn("stats", F.coalesce("stats", F.create_map().cast(kind)))
    return out


def pages_of_type(results: DataFrame, page_type: str, kind: str = "kind") -> DataFrame:
    """Of a parser's pages those of a type; pages that failed have another one."""
    return results.where(F.col(kind) == page_type)


def tagged_texts(chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """(kind, id, text): texts of chunks and contexts of tables, to be embedded in one pass."""
    return chunks.select(F.lit("chunk").alias("kind"), "id", "text").unionByName(tables.select(F.lit("table").alias("kind"), "id", F.col("context").alias("text")))


def embed_all(chunks: DataFrame, tables: DataFrame, embedder: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Chunks and tables with embeddings of one pass; each is told apart by its kind, not its place."""
    got = embed(tagged_texts(chunks, tables), "text", embedder).select("kind", "id", "embedding")
    return tuple(df.join(got.where(F.col("kind") == k).drop("kind"), "id", "left") for k, df in (("chunk", chunks), ("table", tables)))


def check_embeddings(embedded: DataFrame) -> int:
    """The dimension of all vectors; raises if there are none, one is missing or sizes differ."""
    r = embedded.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), F.count_if(F.col("embedding").isNull()).alias("missing")).first()
    if not r["n"]:
        raise ValueError("no vectors")
    if r["missing"] or r["low"] != r["high"]:
        raise ValueError(f"{r['missing']} vectors are missing, sizes are {r['low']} to {r['high']}")
    return r["low"]
