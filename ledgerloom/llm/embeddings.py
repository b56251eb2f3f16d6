"""Embedding near-dedup: sign hashes in several tables, exact cosines, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table
from .components import connected_components, forest, local_labels

COSINE = 0.93
#: Share of the pairs at the threshold itself that some table must find; nearer pairs
#: are found more surely.
RECALL = 0.999
#: Vectors that a bucket is meant to hold, from which the bits of a hash follow; the number
#: of tables then follows from RECALL. Cosines within a bucket cost less than another table,
#: to which every vector is sent.
BUCKET = 512
#: A bucket with more vectors is dealt out as pairs of chunks.
CHUNK = 4096
SEED = 20_111
#: Rows of a block of cosines, which is all that a task holds beside its vectors.
BLOCK = 512


def tables_for(vectors: int, cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits, tables) for a largest label of ``vectors`` vectors."""
    bits = max(4, min(30, math.ceil(math.log2(max(1, vectors / bucket)))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def _planes(size: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, count))


def _vectors(column, wide: bool) -> np.ndarray:
    """Vectors of one size as rows of doubles, scaled by their largest component: squares of
    very large or small ones stay finite, and cosines stay as they are."""
    kind = "<f8" if wide else "<f4"
    x = np.frombuffer(b"".join(v.as_py() for v in column), kind).astype(float)
    x = x.reshape(len(column), -1)
    return x / np.abs(x).max(1)[:, None]


def _signatures(bits: int, tables: int, wide: bool):
    """Adds the signs of a vector in each table, as 32-bit numbers."""

    def run(batches):
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            values = batch.column(1)
            sizes = pa.compute.binary_length(values).to_numpy(zero_copy_only=False)
            signs = np.zeros((n, tables), "<u4")
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                for s in range(0, len(rows), BLOCK):
                    at = rows[s : s + BLOCK]
                    x = _vectors(values.take(pa.array(at)), wide)
                    # Planes pass through the origin, so a scaled copy has the same signs.
                    up = (x @ _planes(x.shape[1], bits * tables) >= 0).reshape(len(at), tables, bits)
                    signs[at] = up @ weights
            flat = [r.tobytes() for r in signs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flat, pa.binary())], names=[*batch.schema.names, "sig"])

    return run


def _bucket(cosine: float, node, copies, sig, t: int, home, first: int, second: int, x):
    """Links of each row, and edges (node, smallest node) that connect what links connect.

    Blocks of cosines are masks; no pair leaves its block. A pair counts in the first table
    where its signatures agree, and among pairs of chunks in the one that is its own, so
    nothing is counted twice. Once two rows are connected their links are only counted.
    """
    n = len(node)
    links, label = np.zeros(n, np.int64), np.arange(n)
    norm = np.sqrt((x * x).sum(1))
    for s in range(0, n, BLOCK):
        a = slice(s, s + BLOCK)
        for u in range(s, n, BLOCK):
            b = slice(u, u + BLOCK)
            near = (x[a] @ x[b].T) / norm[a, None] / norm[None, b]
            mask = near >= cosine
            # At the threshold the cosine of the pair itself decides: dot over norms.
            i, j = np.nonzero(np.abs(near - cosine) < 1e-12)
            for c in range(0, len(i), BLOCK):
                p, q = i[c : c + BLOCK], j[c : c + BLOCK]
                mask[p, q] = np.einsum("ij,ij->i", x[a][p], x[b][q]) / (norm[a][p] * norm[b][q]) >= cosine
            if first != second:
                mask &= home[a, None] != home[None, b]
            if s == u:
                mask = np.triu(mask, 1)
            for earlier in range(t):
                if not mask.any():
                    break
                mask &= sig[a, earlier, None] != sig[None, b, earlier]
            if not mask.any():
                continue
            links[a] += mask @ copies[b]
            links[b] += copies[a] @ mask
            i, j = np.nonzero(mask & (label[a, None] != label[None, b]))
            if len(i):
                own = np.flatnonzero(label != np.arange(n))
                label = local_labels(n, np.concatenate([own, i + s]), np.concatenate([label[own], j + u]))
    some = np.flatnonzero(label != np.arange(n))
    return links, forest(node[some], node[label[some]])


def _links(cosine: float, wide: bool):
    """Rows (node, links, root) of a bucket (label, size, table, signature, pair of chunks)."""

    def run(key, rows):
        node, copies, home = (rows.column(k).to_numpy() for k in ("node", "copies", "home"))
        signs = np.frombuffer(b"".join(s.as_py() for s in rows.column("sig")), "<u4").reshape(len(node), -1)
        t, first, second = (rows.column(k)[0].as_py() for k in ("t", "first", "second"))
        links, (child, root) = _bucket(cosine, node, copies, signs, t, home, first, second, _vectors(rows.column("value"), wide))
        some = links > 0
        return pa.table({
            "node": np.concatenate([node[some], child]),
            "links": np.concatenate([links[some], np.zeros(len(child), np.int64)]),
            "root": pa.array(np.concatenate([node[some], root])),
        })

    return run


def _packed(wide: bool):
    """Vectors as bytes, 4 a component if they are floats, null unless they can link."""
    kind = "<f8" if wide else "<f4"

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            flat = column.flatten()
            values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind)
            out = []
            for n, end, ok in zip(sizes.tolist(), ends.tolist(), batch.column(2).to_pylist(), strict=True):
                x = values[end - n : end]
                out.append(x.tobytes() if ok and n and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(out, pa.binary())], names=["vec_id", "label", "value"])

    return run


def _explode_tables(tables: int):
    """Columns t and bucket: the four bytes of a vector's signs in each table."""
    each = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.substring(F.col("sig"), 4 * t + 1, F.lit(4)))
    return F.posexplode(each).alias("t", "bucket")


def near_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    Vectors link if their labels are equal and not null and their cosine is at least
    ``cosine``. Labels are compared as they are, of any type that Spark groups by. Equal vectors of a label are one class: its smallest vec_id stands for
    it and its copies are counted, never paired. Vectors that are null, empty, zero or
    hold null or non-finite components, and vectors of different sizes, link with
    nothing. A null vec_id stands for no class; repeated rows link like copies. An empty
    table gives an empty result.
    """
    scratch = Scratch(spark, "embeddings")
    element = vectors.schema["embedding"].dataType.elementType
    wide = not isinstance(element, (T.FloatType, T.ByteType, T.ShortType))
    value = F.col("embedding").cast("array<double>" if wide else "array<float>")
    rows = vectors.select(F.col("vec_id").cast("long"), value.alias("value"), (F.col("vec_id").isNotNull() & F.col("label").isNotNull()).alias("ok"), "label")
    label = T.StructField("label", vectors.schema["label"].dataType)
    column = lambda name, kind: T.StructField(name, kind())
    rows = scratch.write(rows.mapInArrow(_packed(wide), T.StructType([column("vec_id", T.LongType), label, column("value", T.BinaryType)])))
    classes = rows.where("value is not null").groupBy("label", "value").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    classes = scratch.write(classes)
    size = F.length("value").alias("size")
    largest = classes.groupBy("label", size).count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(largest, cosine, recall)
    signed = classes.select("node", "value", "copies", "label").mapInArrow(_signatures(bits, tables, wide), T.StructType([column("node", T.LongType), column("value", T.BinaryType), column("copies", T.LongType), label, column("sig", T.BinaryType)]))
    signed = scratch.write(signed)
    spread = signed.select("node", "label", size, _explode_tables(tables))
    key = ["label", "size", "t", "bucket"]
    many = spread.groupBy(*key).count().where("count > 1").select(*key, F.ceil(F.col("count") / chunk).cast("int").alias("parts"))
    many = scratch.write(many)
    full = signed.select("*", size, _explode_tables(tables)).join(many, key)
    full = full.withColumn("home", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    full = full.withColumns({"first": F.least("home", "other"), "second": F.greatest("home", "other")}).drop("other", "parts")
    found = full.groupBy(*key, "first", "second").applyInArrow(_links(cosine, wide), "node long, links long, root long")
    found = scratch.write(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    low = connected_components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    named = classes.join(links, "node", "left").join(low, "node", "left")
    named = scratch.write(named.select("label", "value", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    joined = rows.join(named, ["label", "value"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, table(spark, sf_dir, "embeddings"))
