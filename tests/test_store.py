"""Batches applied once: replays change nothing, untouched files stay, a broken run is carried on."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import store

SCHEMA = "id long, status string, progress long"
BATCH = "id long, status string, progress long, at long"


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path, "rows").rglob("*.parquet")}


def rows(table):
    return sorted(tuple(r) for r in table.read().collect())


@pytest.fixture
def table(spark, tmp_path):
    return store.KeyedTable.create(spark, str(tmp_path / "jobs"), SCHEMA, ["id"], 16)


def test_replayed_batches_change_nothing(spark, table):
    first = spark.createDataFrame([(i, "QUEUED", 0, 1) for i in range(200)] + [(5, "LATER", 3, 2), (None, "nobody", 1, 1)], BATCH)
    assert table.apply("one", first, ["at"]) and len(rows(table)) == 200 and (5, "LATER", 3) in rows(table)
    held = files(table.path)
    assert not table.apply("one", first.withColumn("status", F.lit("other")), ["at"]) and files(table.path) == held
    second = spark.createDataFrame([(7, "RUNNING", 50, 9), (1000, "QUEUED", 0, 9)], BATCH)
    assert table.apply("two", second, ["at"])
    got, now = rows(table), files(table.path)
    assert (7, "RUNNING", 50) in got and (1000, "QUEUED", 0) in got and len(got) == 201
    touched = {r[0] for r in spark.createDataFrame([(7,), (1000,)], "id long").select(F.pmod(F.xxhash64("id"), F.lit(16))).collect()}
    gone = [n for n in held if n not in now]
    assert len(gone) == len(touched) and all(now[n] == t for n, t in held.items() if n in now)
    assert sorted(store.KeyedTable.open(spark, table.path).batches()) == ["one", "two"]


@pytest.mark.parametrize("broken", ["before the overwrite", "before the record", "before the rows"])
def test_a_broken_run_is_carried_on_or_done_again(spark, table, monkeypatch, broken):
    table.apply("one", spark.createDataFrame([(i, "QUEUED", 0, 1) for i in range(40)], BATCH), ["at"])
    new = spark.createDataFrame([(3, "RUNNING", 10, 2)], BATCH)
    kept = store.KeyedTable.carry_on

    def stop(self):
        if broken == "before the record" and self._exists("pending-id"):
            part = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/pending-rows")
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")
        if self._exists("pending-new"):
            raise RuntimeError("lost")

    if broken == "before the rows":
        monkeypatch.setattr(store, "replace", None)
        with pytest.raises(TypeError):
            table.apply("two", new, ["at"], store.replace)
    else:
        monkeypatch.setattr(store.KeyedTable, "carry_on", stop)
        with pytest.raises(RuntimeError):
            table.apply("two", new, ["at"])
    monkeypatch.undo()
    assert store.KeyedTable.carry_on is kept
    again = table.apply("two", new, ["at"])
    assert again == (broken == "before the rows")
    got = rows(table)
    assert (3, "RUNNING", 10) in got and len(got) == 40 and not table.apply("two", new, ["at"])


def test_updates_and_fills(spark, table):
    table.apply("a", spark.createDataFrame([(1, "QUEUED", None, 1), (2, None, 5, 1)], BATCH), ["at"])
    table.apply("b", spark.createDataFrame([(1, None, 7, 1), (2, "FAILED", None, 1), (3, "QUEUED", 0, 1)], BATCH), ["at"], store.update)
    assert rows(table) == [(1, "QUEUED", 7), (2, "FAILED", 5), (3, "QUEUED", 0)]
    table.apply("c", spark.createDataFrame([(1, "OTHER", 9, 1), (4, "QUEUED", 1, 1)], BATCH), ["at"], store.fill)
    assert rows(table) == [(1, "QUEUED", 7), (2, "FAILED", 5), (3, "QUEUED", 0), (4, "QUEUED", 1)]
    assert table.apply("d", spark.createDataFrame([], BATCH), ["at"]) and len(rows(table)) == 4


def test_a_stream_is_applied_once(spark, table, tmp_path):
    rng = random.Random(1)
    log = [(rng.randrange(30), rng.choice(["QUEUED", "RUNNING"]), k, k) for k in range(300)]
    for k in range(3):
        spark.createDataFrame(log[100 * k : 100 * k + 100], BATCH).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for checkpoint in ("c1", "c2"):  # a lost checkpoint replays all
        stream = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        table.follow(stream, "log", ["at"], str(tmp_path / checkpoint)).awaitTermination()
    last = {i: (i, s, k) for i, s, k, _ in log}
    assert rows(table) == sorted(last.values()) and sorted(table.batches()) == ["log-0", "log-1", "log-2"]
