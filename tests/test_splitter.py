"""Chunks by built-in functions against the plain splitter."""

import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as tx


def texts(rng, n):
    glue = ["\n\n", "\n", ". ", "! ", "? ", " ", "", "\n\n\n", "  ", "\x1c", "　", "…"]
    words = ["a", "word", "é" * 3, "longer-word", "x" * 30, "😀", "1.5", "?"]
    return ["".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize(("size", "overlap"), [(40, 10), (7, 3), (25, 0), (5, 5), (1, 0), (2048, 256)])
def test_chunks_are_those_of_the_splitter(spark, size, overlap):
    rows = [None, "", " \n ", "x" * 200, "\n\n".join(["para one. two"] * 9), " " * 90, *texts(random.Random(size), 150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").repartition(8)
    got = {r["i"]: r["c"] for r in df.select("i", tx.split_column(F.col("t"), size, overlap).alias("c")).collect()}
    for i, t in enumerate(rows):
        want = [] if t is None or not t.strip() else tx.split_text(t, size, overlap)
        assert got[i] == want, (t, got[i], want)


def test_documents_and_no_python_worker(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    began = time.time()
    df = docs.select("doc_id", tx.splitter()("text").alias("c"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: r["c"] for r in df.collect()}
    assert time.time() - began < 60
    for r in docs.collect():
        assert got[r["doc_id"]] == ([] if not (r["text"] or "").strip() else tx.split_text(r["text"]))


def test_a_long_text_without_separators(spark):
    long = "x" * 60_000
    got = spark.createDataFrame([(long,)], "t string").select(tx.split_column(F.col("t")).alias("c")).first()["c"]
    assert got == tx.split_text(long)
