"""Streams cut and ordered in any way give the rows of the batch operators."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import jobs
from ledgerloom.streaming import sse, stateful

START = datetime.datetime(2024, 1, 1)
LOG = "job string, event_id long, ts timestamp, status string"


def log(seed, n=240, people=6):
    rng = random.Random(seed)
    states = ["QUEUED", "RUNNING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED", None]
    return [(f"j{rng.randrange(people)}", i, START + datetime.timedelta(seconds=i), rng.choice(states)) for i in range(n)]


def files(spark, tmp_path, parts, schema):
    """Files that a stream takes one a batch, in order."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_illegal_changes_of_a_replayed_log(spark, tmp_path):
    rows = log(1)
    for i in range(0, len(rows), 40):  # events may come up to 40 s late
        part = rows[i : i + 40]
        random.Random(i).shuffle(part)
        rows[i : i + 40] = part
    end = [("end", 10**6, START + datetime.timedelta(days=1), "QUEUED")]
    stream = files(spark, tmp_path, [rows[:70], rows[70:75], rows[75:], end], LOG)
    got = stateful.replayed(stateful.lifecycles(stream, "job", "ts", "event_id", "status", late="60 seconds"))
    batch = jobs.illegal_jobs(spark.createDataFrame(rows + end, LOG), "job", ["ts", "event_id"])
    want = sorted((tuple(r) for r in batch.select("job", "event_id", "status", "previous").collect()), key=repr)
    assert sorted((tuple(r) for r in got.where("kind = 'illegal'").select("key", "at", "status", "previous").collect()), key=repr) == want
    assert len(want) > 40


def test_stalled_jobs_are_told_once(spark, tmp_path):
    at = lambda s: START + datetime.timedelta(seconds=s)
    first = [("slow", 1, at(0), "QUEUED"), ("slow", 2, at(1), "RUNNING"), ("quick", 3, at(0), "QUEUED"), ("quick", 4, at(2), "RUNNING"), ("quick", 5, at(5), "COMPLETED")]
    later = [("other", 6, at(400), "QUEUED")], [("other", 7, at(900), "RUNNING")], [("slow", 8, at(950), "RUNNING"), ("slow", 9, at(951), "COMPLETED")]
    stream = files(spark, tmp_path, [first, *later], LOG)
    got = stateful.replayed(stateful.lifecycles(stream, "job", "ts", "event_id", "status", patience=300_000)).collect()
    assert [(r["key"], r["status"], r["kind"]) for r in got] == [("slow", "RUNNING", "stalled")]


RAW = 'event: messages\ndata: [{}, {"langgraph_node": "plän"}]\n\nid: 1\r\nevent: messages\r\ndata: [{}, {"langgraph_node": "answer"}]\r\n\r\n: note\n\nevent: a\nevent: b\ndata: x\ndata: y\n\ndata: cut'


@pytest.mark.parametrize("size", [1, 3, 7, 500])
def test_events_cut_anywhere(spark, tmp_path, size):
    raw = spark.createDataFrame([(1, RAW), (2, "data: whole\n\n"), (3, ""), (4, None)], "run long, text string")
    pieces = [tuple(r) for r in stateful.cut(raw, "run", "text", size).collect()]
    random.Random(size).shuffle(pieces)  # early pieces wait for their turn
    half = len(pieces) // 2
    stream = files(spark, tmp_path, [pieces[:half], pieces[half:] + pieces[: half // 2]], "key long, turn int, piece binary")
    got = stateful.replayed(stateful.server_events(stream, "key", "turn", "piece"))
    want = sse.events(raw.where("text is not null"), "run", "text")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect()) and want.count() == 5
    steps = sse.steps(sse.nodes(got.withColumnRenamed("key", "run"), "run"), "run").first()
    assert (steps["active"], steps["completed"]) == ("answer", ["plän"])


def test_settings_go_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    with stateful.state_store(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name, None) == old
    assert stateful.cut(spark.createDataFrame([(1, "abc")], "k long, t string"), "k", "t", 2).select(F.sum(F.octet_length("piece"))).first()[0] == 3


def test_replayed_batches_have_several_files(spark, monkeypatch):
    """A batch is written by several tasks, each batch in as many files."""
    from glob import glob

    from pyspark.sql import functions as F

    from ledgerloom.streaming import stateful

    monkeypatch.setattr(stateful, "FILE", 50, raising=False)
    folder = f"{stateful.shared_folder(spark)}/replay-*"
    before = set(glob(folder))
    stateful.as_files(spark.range(800), 4, F.col("id") % 4)
    (path,) = set(glob(folder)) - before
    assert spark.read.parquet(path).count() == 800 and len(glob(f"{path}/*.parquet")) == 16
