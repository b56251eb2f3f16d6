"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row.

    Inside a higher-order function a plain expression is evaluated for every
    element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="ledgerloom-")


def scratch_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset: a temporary folder if the session is one
    process, else one in the warehouse, which all executors share."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return _own_folder()
    return f"{spark.conf.get("spark.sql.warehouse.dir").rstrip("/")}/.ledgerloom"


class Scratch:
    """Written tables that cut lineage, in ``scratch_folder``. They are dropped when ``drop``
    is called or the driver's Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.drop_all)

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended; the folder is scratch
            pass

    def drop(self, df: DataFrame) -> None:
        self._delete(df._scratch_path)

    def drop_all(self) -> None:
        self._delete(self.root)


def even_keys(spark: SparkSession, n: int, each: int = 1, kind: str = "int") -> list[int]:
    """n * each integers of which hash partitioning into n, by a column of type ``kind``, sends
    ``each`` to every partition."""
    found: dict[int, list[int]] = {}
    start, step = 0, (16 + 2 * each) * n + 64
    while len(found) < n or min(map(len, found.values())) < each:
        rows = spark.range(start, start + step, 1, 1).select(F.col("id").cast(kind).alias("k")).select("k", F.pmod(F.hash("k"), F.lit(n)).alias("p")).collect()
        for r in rows:
            found.setdefault(r["p"], []).append(r["k"])
        start += step
    return [found[p][i] for i in range(each) for p in range(n)]


def file_bytes(path: str, limit: int = 64 << 20) -> bytes:
    """A vocabulary file, read by the driver to be broadcast; its size is checked."""
    data = Path(path).read_bytes()
    if len(data) > limit:
        raise ValueError(f"{path} has {len(data)} bytes; at most {limit} are broadcast")
    return data


def release() -> None:
    """Gives memory that was freed back to the system. Python workers live on from stage to stage, and
    what one stage no longer uses would count against the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(sizes, limit: int = 1 << 20):
    """Consecutive index ranges whose sizes sum up to about ``limit``."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)
