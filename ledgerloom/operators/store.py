"""Graph tables in key buckets: a batch rewrites the buckets that it touches, once."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of a table at most, which bounds what the driver lists.
MOST_BUCKETS = 1 << 16

Merge = Callable[[DataFrame, DataFrame, list[str], list[str]], DataFrame]


def replace(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """New rows in the place of old ones with their key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def update(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Fields of new rows that aren't null in the place of old ones; rows of new keys are added."""
    return _both(old, new, key, columns, lambda o, n: F.coalesce(n, o))


def fill(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Old fields stay; null ones take the new row's."""
    return _both(old, new, key, columns, lambda o, n: F.coalesce(o, n))


def _both(old: DataFrame, new: DataFrame, key: list[str], columns: list[str], pick: Callable[[Column, Column], Column]) -> DataFrame:
    rest = [c for c in columns if c not in key]
    new = new.select(*key, *(F.col(c).alias(f"__{c}") for c in rest))
    both = old.join(new, key, "full_outer")
    return both.select(*(F.col(c) if c in key else pick(F.col(c), F.col(f"__{c}")).alias(c) for c in columns))


def last_of(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Of rows with equal keys the last by ``order``, whose ties go by the row itself."""
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(*order, F.xxhash64(*rows.columns)))
    most = F.count("*").over(Window.partitionBy(*key))
    return rows.withColumns({"__turn": turn, "__most": most}).where("__turn = __most").drop("__turn", "__most")


@dataclass(frozen=True)
class KeyedTable:
    """A table whose rows lie in folders by the hash of their key.

    ``apply`` takes a batch under an id. The merged buckets are first written beside the
    table, whole; then they take the place of the old ones (dynamic partition overwrite);
    then the id is recorded. An id that is recorded does nothing. A run that broke off
    after its first step is carried on by the next ``apply``, so that a batch is applied
    once, wherever executors or the driver were lost. One writer at a time.
    """

    spark: SparkSession
    path: str
    schema: str
    key: tuple[str, ...]
    buckets: int

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int) -> KeyedTable:
        """``buckets`` follow from the size that is to come: one holds what a task can merge."""
        if not 1 <= buckets <= MOST_BUCKETS:
            raise ValueError(f"buckets are 1 to {MOST_BUCKETS}")
        table = cls(spark, path, schema, tuple(key), buckets)
        layout = json.dumps({"schema": schema, "key": key, "buckets": buckets})
        spark.createDataFrame([(layout,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/layout")
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeyedTable:
        layout = json.loads(spark.read.text(f"{path}/layout").first()[0])
        return cls(spark, path, layout["schema"], tuple(layout["key"]), layout["buckets"])

    def _exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _delete(self, name: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _bucketed(self) -> DataFrame:
        if not self._exists("rows"):
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        """The rows of all batches that are recorded, and of one that is being carried on."""
        self.carry_on()
        return self._bucketed().drop("bucket")

    def batches(self) -> list[str]:
        """Ids that are recorded."""
        if not self._exists("batches"):
            return []
        return [r[0] for r in self.spark.read.schema("id string").parquet(f"{self.path}/batches").collect()]

    def recorded(self, batch: str) -> bool:
        return self._exists("batches") and not self.spark.read.schema("id string").parquet(f"{self.path}/batches").where(F.col("id") == batch).isEmpty()

    def apply(self, batch: str, rows: DataFrame, order: list, merge: Merge = replace) -> bool:
        """Merges ``rows``, of equal keys the last by ``order``; says whether anything was to be done.

        Rows with a null in their key are no rows of the table and go. Buckets without a new
        row aren't read, and their files stay as they are.
        """
        self.carry_on()
        if self.recorded(batch):
            return False
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        for k in self.key:
            rows = rows.where(F.col(k).isNotNull())
        new = last_of(rows.select(*columns, *(o for o in self._extra(order, columns))), list(self.key), order).select(*columns)
        staged = f"{self.path}/pending-new"
        new.withColumn("bucket", bucket).write.mode("overwrite").parquet(staged)
        new = self.spark.read.schema(f"{self.schema}, bucket int").parquet(staged)
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # MOST_BUCKETS at most
        old = self._bucketed().where(F.col("bucket").isin(touched)).drop("bucket")
        merged = merge(old, new.drop("bucket"), list(self.key), columns).select(*columns)
        merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").parquet(f"{self.path}/pending-rows")
        self.spark.createDataFrame([(batch,)], "id string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pending-id")
        self.carry_on()
        return True

    @staticmethod
    def _extra(order: list, columns: list[str]) -> list[str]:
        return [o for o in order if isinstance(o, str) and o not in columns]

    def carry_on(self) -> None:
        """Ends a batch whose merged rows are written whole; one that isn't leaves no trace."""
        if not self._exists("pending-id/_SUCCESS"):
            return
        batch = self.spark.read.schema("id string").parquet(f"{self.path}/pending-id")
        if not self.recorded(batch.first()[0]):
            rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/pending-rows")
            rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")
            batch.coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        self._delete("pending-id")
        self._delete("pending-rows")
        self._delete("pending-new")

    def follow(self, stream: DataFrame, name: str, order: list, checkpoint: str, merge: Merge = replace):
        """Each micro-batch of ``stream`` applied once, under ``name`` and its number."""
        write = lambda rows, n: self.apply(f"{name}-{n}", rows, order, merge)
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
