"""State over micro-batches: job lifecycles with timers, and server-sent events cut anywhere."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.held import shared_folder, written
from ..schema import JOB_NEXT
from .sse import parsed

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows for each file of a replayed batch, at least.
FILE = 10_000
_BLANK = re.compile(rb"\r?\n\r?\n")


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """The session with the state store that these operators need; the setting goes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


def replayed(stream: DataFrame) -> DataFrame:
    """What ``stream`` appends until its source has no more, as a table in the shared folder."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    with state_store(spark):
        run = stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


class Lifecycle(StatefulProcessor):
    """Of each job the last state, and the events that the watermark hasn't reached yet.

    Events are judged in order of (ts, at) once the watermark is at their ts, so that batches
    may bring them in any order. A job that stays in a state of ``stalls`` for ``patience`` ms
    is told once; timers wake the job for both.
    """

    def __init__(self, following: dict[str, list[str]], stalls: tuple[str, ...], patience: int | None):
        self.following, self.stalls, self.patience = following, stalls, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, ts long, told boolean")
        self.waiting = handle.getListState("waiting", "ts long, at long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for batch in rows for r in zip(batch["ts_us"].tolist(), batch["at"].tolist(), (None if pd.isna(s) else s for s in batch["status"]), strict=True)]
        if new:
            self.handle.registerTimer(max(r[0] for r in new) // 1000)
        yield from self._judged(key, timerValues.getCurrentWatermarkInMs(), new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._judged(key, timerValues.getCurrentWatermarkInMs(), [])

    def _judged(self, key, watermark: int, new: list) -> Iterator[pd.DataFrame]:
        """Each access to state is a call to another process, and each frame a batch: none is made for nothing."""
        waiting = sorted([*((r[0], r[1], r[2]) for r in self.waiting.get()), *new], key=lambda r: r[:2])
        due = [r for r in waiting if r[0] // 1000 <= watermark]
        if due or new:
            rest = waiting[len(due) :]
            self.waiting.put(rest) if rest else self.waiting.clear()
        if not due and self.patience is None:
            return
        last = self.last.get()
        previous, ts, told = tuple(last) if last is not None else (None, None, False)
        held = (previous, ts, told)
        out = []
        first = next(iter(self.following))
        for at_ts, at, status in due:
            if previous is None:
                wrong = status != first
            else:
                wrong = status is not None and status != previous and status not in self.following.get(previous, [])
            if wrong:
                out.append((key[0], at, status, previous, "illegal"))
            previous, ts, told = status, at_ts, False
        if self.patience is not None and ts is not None and previous in self.stalls and not told:
            end = ts // 1000 + self.patience
            if end <= watermark:
                out.append((key[0], None, previous, previous, "stalled"))
                told = True
            elif due:
                self.handle.registerTimer(end)
        if (previous, ts, told) != held:
            self.last.update((previous, ts, told))
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "status", "previous", "kind"]).astype({"at": "Int64"})

    def close(self) -> None:
        pass


def lifecycles(stream: DataFrame, key: str, ts: str, at: str, state: str, late: str = "0 seconds", following: dict[str, list[str]] | None = None, stalls: tuple[str, ...] = ("RUNNING",), patience: int | None = None) -> DataFrame:
    """(key, at, status, previous, kind) of a stream of state events.

    kind ``illegal``: the state may not follow the previous one, as ``jobs.illegal`` has it.
    ``stalled``: no event for ``patience`` ms after a state of ``stalls``. Events that
    come more than ``late`` behind the newest are dropped. Needs ``state_store``.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(at).cast("long").alias("at"), F.col(state).alias("status"))
    rows = rows.withColumn("ts_us", F.unix_micros("ts")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Lifecycle(following or JOB_NEXT, stalls, patience), f"key {kind}, at long, status string, previous string, kind string", "Append", "eventTime")


class Blocks(StatefulProcessor):
    """Of each run the bytes of the block that isn't whole yet, and pieces that came before their turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rest = handle.getValueState("rest", "bytes binary, turn long, pos long")
        self.early = handle.getMapState("early", "turn long", "bytes binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rest = self.rest.get()
        rest, turn, pos = tuple(rest) if rest is not None else (b"", 0, 0)
        rest = bytes(rest)
        new = {t: bytes(b) for batch in rows for t, b in zip(batch["turn"].tolist(), batch["bytes"], strict=True) if t >= turn}
        if self.early.exists():
            for (t,), (b,) in list(self.early.iterator()):
                new.setdefault(t, bytes(b))
            self.early.clear()
        pieces = []
        while turn in new:
            pieces.append(new.pop(turn))
            turn += 1
        for t, b in new.items():
            self.early.updateValue((t,), (b,))
        out, begin = [], 0
        whole = rest + b"".join(pieces)
        for m in _BLANK.finditer(whole, max(0, len(rest) - 3)):  # what ends a block may be cut too
            out.append((key[0], pos, whole[begin : m.start()].decode(errors="replace")))
            begin, pos = m.end(), pos + 1
        if pieces:
            self.rest.update((whole[begin:], turn, pos))
        if out:
            yield pd.DataFrame(out, columns=["key", "pos", "block"])

    def close(self) -> None:
        pass


def server_events(stream: DataFrame, key: str, turn: str, piece: str) -> DataFrame:
    """(key, pos, event, data) of streams of bytes that come in pieces numbered from 0.

    A block is given out once its blank line has come, wherever the pieces were cut, inside
    a character too. A piece that comes early waits for those before it; one that comes twice
    counts once. What follows the last blank line isn't whole and stays. Needs ``state_store``.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), F.col(piece).cast("binary").alias("bytes"))
    blocks = rows.groupBy("key").transformWithStateInPandas(Blocks(), f"key {kind}, pos long, block string", "Append", "none")
    return blocks.select("key", "pos", parsed(F.col("block")).alias("e")).select("key", "pos", "e.event", "e.data")


def cut(raw: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, turn, piece): the bytes of a text in pieces of ``size``."""
    whole = F.col(text).cast("binary")
    turns = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.octet_length(text) / size)).cast("int") - 1)).alias("turn")
    return raw.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), whole.alias("whole"), turns).select("key", "turn", F.substring("whole", F.col("turn") * size + 1, F.lit(size)).alias("piece"))


def as_files(df: DataFrame, batches: int, batch: Column) -> Callable[[SparkSession], DataFrame]:
    """The stream of ``df`` for a replay: rows whose ``batch`` is 0 come first, then those of 1 ...

    A batch is written after the one before, as a stream takes files by their age, and all batches
    in the same number of files: one for every FILE rows of the least, the shuffle partitions at most.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    held = written(df.withColumn("__batch", batch))  # computed once, by all tasks
    sizes = {r["__batch"]: r["count"] for r in held.groupBy("__batch").count().collect()}
    files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), min((sizes.get(k, 0) for k in range(batches)), default=0) // FILE))
    for k in range(batches):
        rows = held.where(F.col("__batch") == k).drop("__batch")
        # Dealt out in turn: at FILE rows for each file none stays empty.
        (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.mode("append").parquet(path)
        if files > 1 and len(spark.read.schema(df.schema).parquet(path).inputFiles()) != (k + 1) * files:
            raise ValueError(f"batch {k} isn't in {files} files")
    return lambda spark: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def quarters(df: DataFrame, ts: str) -> Column:
    """0 to 3: the quarter of the time from the first to the last ``ts`` that a row falls in."""
    low, high = df.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    return F.least(F.lit(3), F.floor((F.unix_micros(ts) - F.lit(low or 0)) * 4 / max(1, (high or 0) - (low or 0)))).cast("int")
