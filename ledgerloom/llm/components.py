"""Distributed connected components by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for nodes 0..n-1 and edges (a, b)."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node) with the components of the edges (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = local_labels(len(nodes), at[: len(a)], at[len(a) :])
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _contract(batches):
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    held = 0
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        b.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
        held += batch.num_rows
        if held > 2_000_000:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], len(x)
            if held > 1_000_000:  # a long forest of its own: pass it on
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
                a, b, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    x, y = forest(np.concatenate(a), np.concatenate(b))
    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node that some edge joins to a smaller one.

    ``edges`` has long columns a and b; component is the smallest node reachable.
    Smallest nodes and nodes without edges are absent. Each task first contracts
    its own edges to stars (bounded memory); then large-star and small-star
    rounds, written to the shared folder each time, run until nothing changes.
    """
    edges = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    now = scratch.write(edges.mapInArrow(_contract, "a long, b long").distinct())
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark[0] == 0 or mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = mark
        both = now.select("a", "b").union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        following = scratch.write(small.where("a <> b").distinct())
        scratch.drop(now)
        now = following
