"""File sources and sinks."""

from __future__ import annotations

import shutil
import uuid
import zlib
from collections.abc import Callable
from pathlib import Path
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import headings, page_tables
from ..plans.retry import ingestion_retry
from ..schema import TESTSET


def text_sections(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as one GENERAL section each, titled Article, of page 1.

    Spark counts a small file as 4 MB, so that a task reads few of them: 32 such tasks become one, unless cores would be idle.
    """
    raw = spark.read.text(path, wholetext=True).withColumn("file_path", F.input_file_name())
    raw = raw.coalesce(max(raw.rdd.getNumPartitions() // 32, 4 * spark.sparkContext.defaultParallelism))
    return raw.select("file_path", F.lit("GENERAL").alias("section_type"), F.lit("Article").alias("title"), F.col("value").alias("content"), F.array().cast("array<string>").alias("tables"), F.array().cast("array<string>").alias("headings"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))


def binary_documents(spark: SparkSession, path: str, parse: Callable[[Column], Column] | None = None) -> DataFrame:
    """Files as bytes; ``parse`` (a pandas UDF) turns them into an array of pages."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_path"), F.col("length").alias("size_bytes"), "content")
    return raw if parse is None else raw.withColumn("pages", parse(F.col("content"))).drop("content")


PAGE = "page int, kind string, markdown string, items array<struct<type string, value string>>"


def parsed_pages(files: DataFrame, parser: Callable[[bytes], list[dict]], attempts: int = 3) -> DataFrame:
    """(file_path, page, kind, markdown, headings, tables) of each page that ``parser`` makes of a file.

    ``parser``, such as a client of a parsing service, is called in the executors, a file at
    a time, and called again when it fails; it gives dictionaries with the fields of PAGE.
    """
    schema = f"file_path string, {PAGE}"
    names = ["page", "kind", "markdown", "items"]

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["file_path"], batch["content"], strict=True):
                pages = ingestion_retry(lambda c=content: parser(bytes(c)), f"parsing {path}", attempts)
                yield pd.DataFrame([{"file_path": path, **{n: p.get(n) for n in names}} for p in pages], columns=["file_path", *names])

    got = files.select("file_path", "content").mapInPandas(run, schema)
    return got.select("file_path", "page", "kind", F.coalesce("markdown", F.lit("")).alias("markdown"), headings(F.col("items")).alias("headings"), page_tables(F.col("items")).alias("tables"))


def dispatch(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(PDF files, all others) by suffix."""
    pdf = F.lower("file_path").endswith(".pdf")
    return files.where(pdf), files.where(~pdf)


def html_pages(pages: DataFrame) -> DataFrame:
    """Stand-in for a parsed document: headings, tables and text of HTML."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    heads = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)), text), lambda h: F.length(h) > 3)
    tables = F.regexp_extract_all(html, F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))
    return pages.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), heads.alias("headings"), tables.alias("tables"), text(html).alias("markdown"))


def testset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(TESTSET).json(path)


def results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def missing_files(spark: SparkSession, documents: DataFrame, folder: str) -> DataFrame:
    """Documents whose file isn't in the folder's listing."""
    there = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"[^/]+$", 0).alias("filename"))
    return documents.join(there, "filename", "left_anti")


def document_content(spark: SparkSession, documents: DataFrame, doc_id: str) -> bytes:
    """The bytes of a document's file; raises FileNotFoundError if the document, its path or its file is missing."""
    row = documents.where(F.col("id") == doc_id).select("file_path").first()
    if row is None or not row["file_path"]:
        raise FileNotFoundError(f"document {doc_id} has no file")
    try:
        found = spark.read.format("binaryFile").load(row["file_path"]).select("content").first()
    except AnalysisException as error:
        raise FileNotFoundError(f"{row['file_path']} isn't there") from error
    return bytes(found["content"])


def persist_upload(stream: BinaryIO, filename: str | None, doc_id: str, folder: str, block: int = 1 << 20) -> tuple[str, int]:
    """Blocks of 1 MiB to ``{doc_id}{suffix}``; the path and size."""
    if not filename:
        raise ValueError("a file name is required")
    path = Path(folder) / f"{doc_id}{Path(filename).suffix}"
    with path.open("wb") as out:
        shutil.copyfileobj(stream, out, block)
    return str(path), path.stat().st_size


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_markdown(sections: DataFrame, path: str, folders: int = 128) -> None:
    """One text file a document, its sections in order, found by ``text_sections(spark, f"{path}/*")``.

    In the local file system, in a folder that executors share, tasks save the files themselves as
    ``{path}/{folder}/doc_id={doc_id}.md``: Spark's writer makes a folder for each document, starts a process for
    each file's permissions there and moves all folders by the driver. In other stores it writes ``{path}/doc_id={doc_id}/``.
    """
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "content"))), lambda s: s["content"]), "\n\n")
    texts = sections.groupBy("doc_id").agg(joined.alias("value"))
    spark = sections.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = fs.makeQualified(at).toUri()
    if uri.getScheme() != "file":
        return texts.write.mode("overwrite").partitionBy("doc_id").text(path)
    fs.delete(at, True)
    fs.mkdirs(at)
    root = uri.getPath()

    def save(rows):
        """A task that is run again saves the same files; each is whole at any time."""
        for row in rows:
            name = f"doc_id={quote(row.doc_id, safe='')}.md"
            into = Path(root) / f"{zlib.crc32(name.encode()) % folders:04d}"
            into.mkdir(exist_ok=True)
            fresh = into / f".{uuid.uuid4().hex}"
            fresh.write_bytes(row.value + b"\n")
            fresh.replace(into / name)

    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    texts.select(doc_id.alias("doc_id"), F.col("value").cast("binary").alias("value")).foreachPartition(save)
    (Path(root) / "_SUCCESS").touch()
