"""Results that later steps use more than once: small ones held by the driver, others written."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be held, and keys of one that may have parts of its own in ``salted_join``.
MOST, MOST_HEAVY = 2000, 10_000


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="ledgerloom-core-")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset: a temporary folder if the session is one
    process, else one in the warehouse, unless that is a folder of each machine."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return _own_folder()
    base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if base.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base}/.ledgerloom"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its plan is not run again."""
    path = f"{shared_folder(df.sparkSession)}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Held:
    """Rows that are computed once. ``values`` knows a column's values if they are held."""

    df: DataFrame
    known: dict[str, list] | None

    def values(self, column: str) -> list | None:
        return None if self.known is None else sorted({v for v in self.known[column] if v is not None})


def held(df: DataFrame, small: bool, keys: tuple[str, ...] = ()) -> Held:
    """``small`` says that there are at most MOST rows by what they are made from; one more raises."""
    if not small:
        return Held(written(df), None)
    rows = df.limit(MOST + 1).toArrow()
    if rows.num_rows > MOST:
        raise ValueError(f"more than {MOST} rows: they aren't small")
    return Held(df.sparkSession.createDataFrame(rows, df.schema), {k: rows.column(k).to_pylist() for k in keys})


def looked_up(table: DataFrame, key: str, keys: list | None) -> DataFrame:
    """The rows of ``table`` that ``keys`` need: literals that reach its scan, or all where keys aren't known."""
    return table if keys is None else table.where(F.col(key).isin(keys))


def salted_join(left: DataFrame, right: DataFrame, on: str, by: Column, each: int = 100_000) -> DataFrame:
    """Inner join on ``on``. A value with over ``each`` rows on the left is dealt out in parts by
    ``by``, and its rows on the right go to each part. Heavy values are few, at most one in
    ``each`` rows; they are broadcast if MOST_HEAVY at most, else joined."""
    heavy = left.where(F.col(on).isNotNull()).groupBy(on).count().where(F.col("count") > each).select(on, F.ceil(F.col("count") / each).cast("int").alias("__parts"))
    heavy = written(heavy)
    if heavy.isEmpty():
        return left.join(right, on)
    heavy = F.broadcast(heavy) if heavy.limit(MOST_HEAVY + 1).count() <= MOST_HEAVY else heavy
    parts = F.coalesce("__parts", F.lit(1))
    a = left.join(heavy, on, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    b = right.join(heavy, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return a.join(b, [on, "__part"]).drop("__part")
