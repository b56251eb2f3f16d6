"""Chains repaired by their neighbours, pages by their bounds, files by type and size."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import graph, jobs, retrieve

CHUNK = "doc_id long, id string, sequence long"


def chain_of(spark, rows):
    return retrieve.next_links(spark.createDataFrame(rows, CHUNK), "doc_id", ["sequence", "id"], "id")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repaired_chains_are_those_built_anew(spark, seed):
    rng = random.Random(seed)
    rows = [(d, f"{d}-{i}", rng.randrange(30)) for d in range(12) for i in range(rng.randrange(0, 14))]
    gone = [r for r in rows if r[0] % 3 and rng.random() < 0.4]
    moved = [(d, i, s + 7) for d, i, s in gone[::4]]
    new = [(d, f"{d}-new{i}", rng.randrange(30)) for d in range(2, 16, 2) for i in range(rng.randrange(4))] + moved
    held = [r for r in rows if r not in gone] + new
    old = chain_of(spark, rows)
    go, come = graph.repair_chain(old, spark.createDataFrame(rows, CHUNK), spark.createDataFrame(new, CHUNK), spark.createDataFrame(gone + [(3, "absent", 1)], CHUNK).select("doc_id", "id"))
    after = graph.repaired(old, go, come)
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "src", "dst").collect())
    assert key(after) == key(chain_of(spark, held))
    touched = {r[0] for r in gone + new} | {3}
    assert {r["doc_id"] for r in go.collect()} | {r["doc_id"] for r in come.collect()} <= touched


def test_only_documents_of_the_change_are_read(spark, tmp_path):
    rows = [(d, f"{d}-{i}", i) for d in range(200) for i in range(5)]
    spark.createDataFrame(rows, CHUNK).repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "c"))
    chunks = spark.read.parquet(str(tmp_path / "c"))
    chain = chain_of(spark, rows)
    go, come = graph.repair_chain(chain, chunks, spark.createDataFrame([(7, "7-x", 2)], CHUNK), spark.createDataFrame([], CHUNK).select("doc_id", "id"))
    assert [tuple(r) for r in go.collect()] == [(7, "7-2", "7-3")]
    assert sorted(tuple(r) for r in come.collect()) == [(7, "7-2", "7-x"), (7, "7-x", "7-3")]
    assert "EqualTo(doc_id,7)" in come._jdf.queryExecution().executedPlan().toString()


ORDERS = [[("at", True), ("id", False)], [("at", False), ("id", True)], [("id", False)]]


@pytest.mark.parametrize("order", ORDERS)
def test_pages_are_those_of_offsets(spark, order):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(9)]), "x") for i in range(137)]
    df = spark.createDataFrame(rows, "id long, at long, other string").repartition(5)
    bounds = jobs.page_bounds(df, order, 20).cache()
    assert sorted(r["page"] for r in bounds.collect()) == list(range(7))
    by = [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
    for number in (0, 3, 6, 7):
        want = [r["id"] for r in jobs.page(df, by, 20, 20 * number).collect()]
        assert [r["id"] for r in jobs.page_at(df, bounds, order, 20, number).collect()] == want


def test_a_page_reads_its_range(spark, tmp_path):
    spark.range(10_000).selectExpr("id", "id div 3 as at").repartitionByRange(10, "at").sortWithinPartitions("at").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    order = [("at", False), ("id", False)]
    page = jobs.page_at(df, jobs.page_bounds(df, order, 50), order, 50, 120)
    assert [r["id"] for r in page.collect()] == list(range(6000, 6050))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(at,2000)" in plan and "LessThanOrEqual(at,2016)" in plan


def test_a_type_of_most_rows_is_written_by_many_tasks(spark, tmp_path):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, F.lit("rare")).when(F.col("id") % 500 == 1, F.lit(None)).otherwise(F.lit("common")).alias("kind"))
    graph.write_by_type(df, "kind", str(tmp_path / "t"), each=300)
    files = {k: len(list((tmp_path / "t" / f"kind={k}").glob("*.parquet"))) for k in ("rare", "common", "__HIVE_DEFAULT_PARTITION__")}
    assert files["rare"] <= 2 and files["common"] >= 5
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("kind").count().orderBy("kind").collect() == df.groupBy("kind").count().orderBy("kind").collect()
