"""Vectors in inverted lists: cells of a stored coarse quantiser, probed nearest first or until nothing is missing."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .held import written
from .retrieve import BLOCK, doubles, id_kind, nearest, top_k_all, top_ranked, units

#: Cells at most, and rows a cell of the bounded sample that they are fitted on.
MOST_CELLS, PER_CELL = 4096, 64
#: Rows of a cell in one part; a cell of more has several.
PART = 20_000
#: Sampled rows that ask when probes are chosen.
ASKED = 200
#: Numbers of a matrix that a task makes at a time: of cosines to the centres, or of vectors sent on.
NUMBERS = 1 << 20
_SLACK = 1e-9


@dataclass(frozen=True)
class Index:
    """A stored index: ``path``/vectors (id, x) in folders by cell, ``path``/cells with each
    cell's centre, rows, parts and least and largest angle. ``centres`` are the few unit centres."""

    spark: SparkSession
    path: str
    kind: str
    cells: np.ndarray
    centres: np.ndarray
    rows: np.ndarray
    parts: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.kind}, x array<double>, cell int, part int").parquet(f"{self.path}/vectors")

    @property
    def total(self) -> int:
        return int(self.rows.sum())


def _assigned(centres: np.ndarray, kind: pa.DataType):
    """The nearest cell of each vector, and its angle to the centre."""

    def run(batches):
        for batch in batches:
            for ids, v in units(pa.Table.from_batches([batch])).values():
                cell, cosine = np.empty(len(v), np.int64), np.empty(len(v))
                step = max(1, NUMBERS // len(centres))
                for s in range(0, len(v), step):
                    near = v[s : s + step] @ centres.T
                    cell[s : s + step] = near.argmax(1)
                    cosine[s : s + step] = near.max(1)
                angle = np.arccos(np.clip(cosine, -1, 1))
                x = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([ids.cast(kind), x, pa.array(cell, pa.int32()), pa.array(angle)], names=["id", "x", "cell", "angle"])

    return run


def fit_centres(vectors: DataFrame, dimension: int, cells: int, seed: int = 7, per_cell: int = PER_CELL) -> np.ndarray:
    """Unit centres of k-means by cosine over at most ``per_cell`` rows a cell, chosen by the hash of their id."""
    most = cells * per_cell
    x = doubles()
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    good = vectors.where(F.size("embedding") == dimension).select("id", x.alias("x")).withColumn("norm", norm).where("norm > 0 and norm < double('Infinity')")
    sample = written(good.orderBy(F.xxhash64("id"), "id").limit(most).select(array_to_vector(F.transform("x", lambda v: v / F.col("norm"))).alias("features")))
    got = KMeans(k=cells, seed=seed, maxIter=8, initSteps=1, distanceMeasure="cosine").fit(sample).clusterCenters() if not sample.isEmpty() else []
    centres = np.array(got, float).reshape(-1, dimension)
    return centres / np.maximum(np.linalg.norm(centres, axis=1), 1e-300)[:, None]


def build(vectors: DataFrame, path: str, dimension: int, cells: int | None = None, seed: int = 7) -> Index:
    """Files every vector of ``dimension`` of ``vectors`` (id, embedding) under its nearest cell.

    Cells are about the root of the number of rows, MOST_CELLS at most; they are fitted on a
    bounded sample, and every row is filed. Zero vectors, nulls and vectors with null or
    non-finite components aren't, as nothing is near them. A cell of many rows, copies of one vector
    say, has parts, which are searched by tasks of their own.
    """
    spark = vectors.sparkSession
    kind, arrow = id_kind(vectors, "id")
    good = vectors.where(F.size("embedding") == dimension)
    n = good.count()
    cells = cells or int(min(MOST_CELLS, max(1, round(n**0.5))))
    centres = fit_centres(good, dimension, cells, seed)
    if not len(centres):
        centres = np.eye(1, dimension)
    rows = good.select(F.col("id").cast(kind).alias("id"), doubles().alias("x")).mapInArrow(_assigned(centres, arrow), f"id {kind}, x array<double>, cell int, angle double")
    rows = written(rows)
    counts = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"), F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    shape = {r["cell"]: r for r in counts.collect()}  # a row a cell
    table = [(k, c.tolist(), *(shape[k][x] if k in shape else y for x, y in (("n", 0), ("parts", 1), ("near", 0.0), ("far", 0.0)))) for k, c in enumerate(centres)]
    spark.createDataFrame(table, "cell int, centre array<double>, n long, parts int, near double, far double").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    parts = F.element_at(F.lit([r[3] for r in table]), F.col("cell") + 1)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    dealt.select("id", "x", "cell", "part").repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    """A stored index; its cells, MOST_CELLS at most, are read by the driver."""
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    kind = next((f.dataType.simpleString() for f in spark.read.parquet(f"{path}/vectors").schema if f.name == "id"), "bigint") if any(r["n"] for r in rows) else "bigint"
    column = lambda c, t: np.array([r[c] for r in rows], t)
    return Index(spark, path, kind, column("cell", int), column("centre", float), column("n", int), column("parts", int), column("near", float), column("far", float))


def _probed(centres: np.ndarray, choose, extra: bool):
    """Rows (query_id, x, cell, turn) of the cells that ``choose`` takes of each query's cosines to the centres."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            least = dict(zip(table.column("query_id").to_pylist(), table.column("least").to_pylist(), strict=True)) if extra else {}
            for ids, q in units(table, "query_id", "x").values():
                if q.shape[1] != centres.shape[1]:
                    continue
                step = max(1, NUMBERS // len(centres))
                most = max(1, NUMBERS // q.shape[1])
                for s in range(0, len(q), step):
                    near = q[s : s + step] @ centres.T
                    order = np.argsort(-near, axis=1, kind="stable")
                    turns = [choose(near[i], order[i], least.get(ids[s + i].as_py())) for i in range(len(near))]
                    ask = np.repeat(np.arange(len(near)), [len(at) for at in turns])
                    turn = np.concatenate(turns)
                    cell = order[ask, turn]
                    for r in range(0, len(ask), most):
                        who = s + ask[r : r + most]
                        x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(who) * q.shape[1] + 1, q.shape[1]), pa.int32()), pa.array(q[who].ravel()))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), x, pa.array(cell[r : r + most], pa.int32()), pa.array(turn[r : r + most], pa.int32())], names=["query_id", "x", "cell", "turn"])

    return run


_PROBE = "query_id long, x array<double>, cell int, turn int"


def _asked(queries: DataFrame, least: DataFrame | None = None) -> DataFrame:
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), doubles().alias("x"))
    return rows if least is None else rows.join(least, "query_id", "left")


def _first(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    return _asked(queries).mapInArrow(_probed(index.centres, lambda near, order, least: np.arange(min(probes, len(order))), False), _PROBE)


def _compared(index: Index, probed: DataFrame, k: int, mode: str) -> DataFrame:
    """(query_id, id, cosine): the ``k`` nearest of each query in each part of its cells.

    Files of other cells aren't read. A cell that very many queries probe is compared by
    blocks of queries.
    """
    kind, arrow = index.kind, pa.int64() if index.kind == "bigint" else pa.string()
    asked = {r["cell"]: r["count"] for r in probed.groupBy("cell").count().collect()}  # a row a cell
    blocks = np.ones(len(index.cells), int)
    for cell, n in asked.items():
        blocks[cell] = -(-n // BLOCK)
    at = lambda values: F.element_at(F.lit(values.tolist()), F.col("cell") + 1)
    each = lambda n, name: F.explode(F.sequence(F.lit(0), at(n) - 1)).alias(name)
    left = probed.select("query_id", "x", "cell", F.pmod(F.xxhash64("query_id"), at(blocks)).cast("int").alias("block")).select("*", each(index.parts, "part"))
    right = index.vectors.where(F.col("cell").isin(sorted(asked))).select("id", "x", "cell", "part", each(blocks, "block"))
    keys = ["cell", "part", "block"]
    left = left.select(F.col("query_id").alias("id"), "x", *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest(k, arrow, mode), f"query_id long, id {kind}, cosine double")


def search(index: Index, queries: DataFrame, k: int, probes: int, mode: str = "index") -> DataFrame:
    """(query_id, id, score, rank): the nearest of each row of ``queries`` (query_id, embedding) in the
    ``probes`` cells whose centres are nearest. An approximation; see ``probes_for``."""
    return top_ranked(_compared(index, written(_first(index, queries, probes)), k, mode), k, mode)


def search_exact(index: Index, queries: DataFrame, k: int, first: int = 4, mode: str = "index") -> DataFrame:
    """What ``top_k_all`` gives, from the cells that can hold it.

    The nearest cells give a k-th cosine; a further one is read only if its vectors' angles to
    their centre let one of them be nearer than that (angles obey the triangle inequality).
    """
    begun = written(_compared(index, written(_first(index, queries, first)), k, mode))
    kth = top_ranked(begun, k, "cosine").groupBy("query_id").agg(F.min("score").alias("c"), F.count("*").alias("n"))
    least = kth.select("query_id", F.when(F.col("n") == k, F.col("c")).alias("least"))
    low, high, rows = index.near, index.far, index.rows

    def choose(near, order, bound):
        rest = np.arange(min(first, len(order)), len(order))
        cell = order[rest]
        angle = np.arccos(np.clip(near[cell], -1, 1))
        least_angle = np.maximum(0, np.maximum(angle - high[cell], low[cell] - angle))
        return rest[(rows[cell] > 0) & (np.cos(least_angle) >= (-1 if bound is None else bound) - _SLACK)]

    more = _asked(queries, least).mapInArrow(_probed(index.centres, choose, True), _PROBE)
    return top_ranked(begun.unionByName(_compared(index, written(more), k, mode)), k, mode)


def probes_for(index: Index, vectors: DataFrame, k: int, recall: float = 0.95, asked: int = ASKED, seed: int = 11) -> tuple[int, float]:
    """(probes, share of the rows that they read) for ``recall`` of the ``k`` nearest, measured.

    At most ``asked`` rows of ``vectors`` (id, embedding), chosen by hash, ask all rows exactly;
    the answer is the rank, among a query's cells, of the cell that each true neighbour is in.
    """
    picked = vectors.where("embedding is not null").orderBy(F.xxhash64(F.col("id"), F.lit(seed)), "id").limit(asked)
    queries = written(picked.select(F.monotonically_increasing_id().alias("query_id"), "embedding"))
    true = top_k_all(vectors, queries, k).select("query_id", "id")
    cells = index.vectors.select("id", "cell")
    turns = _first(index, queries, len(index.cells)).select("query_id", "cell", "turn")
    ranks = true.join(cells, "id").join(turns, ["query_id", "cell"]).groupBy("turn").count().collect()  # a row a cell
    found = np.zeros(len(index.cells), int)
    for r in ranks:
        found[r["turn"]] = r["count"]
    if not found.sum():
        return 1, 1.0
    probes = int(np.searchsorted(np.cumsum(found) / found.sum(), recall) + 1)
    return probes, rows_read(index, queries, probes)


def rows_read(index: Index, queries: DataFrame, probes: int) -> float:
    """The share of the index's rows that a query of ``queries`` is compared with, on average."""
    n = F.element_at(F.lit(index.rows.tolist()), F.col("cell") + 1)
    got = _first(index, queries, probes).groupBy("query_id").agg(F.sum(n).alias("n")).agg(F.avg("n")).first()[0]
    return (got or 0.0) / max(1, index.total)


def recall_of(found: DataFrame, true: DataFrame) -> float:
    """The share of the rows (query_id, id) of ``true`` that ``found`` has; 1 without any."""
    both = true.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    got = both.agg(F.count("*").alias("n"), F.sum("hit").alias("hit")).first()
    return 1.0 if not got["n"] else (got["hit"] or 0) / got["n"]
