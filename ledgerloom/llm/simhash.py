"""SimHash near-dedup: fingerprints, a binary trie self-join, components."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunks, table
from .components import connected_components, forest
from .nearcopies import mark, near_copies
from .trie import trie_pairs

#: h of a shingle is its XXH64 with this seed.
SEED = 42
BITS = 3
#: The 64 bits are cut into BLOCKS; two fingerprints with at most BITS differing
#: bits agree on BLOCKS - BITS blocks at least.
BLOCKS = 5
#: A block key with more fingerprints is dealt out as pairs of chunks.
CHUNK = 20_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of the text's ``width``-word shingles, unsigned; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and blanks only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), SEED)
    h = np.array([digest(b" ".join(words[i : i + width]), SEED) for i in range(len(words) - width + 1)], "<u8")
    ones = np.zeros(64, np.int64)
    for s in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[s : s + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint long) of whole texts; null text has fingerprint 0."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            got = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(got.view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint long")


def _links(bits: int):
    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        keys, values, nodes = (np.concatenate(x) for x in zip(*got, strict=True))
        keys, values = keys.view(np.uint64), values.view(np.uint64)
        order = np.lexsort((values, keys))
        keys, values, nodes = keys[order], values[order], nodes[order]
        a, b, held = [], [], 0
        for i, j in trie_pairs(keys, values, bits):
            a.append(nodes[i])
            b.append(nodes[j])
            held += len(i)
            if held > 2_000_000:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], len(x) // 2
        if a:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            for s in range(0, len(x), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[s : s + (1 << 16)]), pa.array(y[s : s + (1 << 16)])], names=["a", "b"])

    return run


def near_fingerprints(distinct: DataFrame, bits: int = BITS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between nodes whose fingerprints differ in at most ``bits`` bits.

    ``distinct`` has a row (fingerprint, node) for each different fingerprint. The
    edges connect exactly the pairs within budget and what they reach (a spanning
    forest for each task). A fingerprint goes to the tries of all choices of
    ``blocks - bits`` equal blocks; a key with over ``chunk`` fingerprints is split
    into chunks, and every pair of chunks is joined by a task of its own.
    """
    edges_at = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for t, chosen in enumerate(itertools.combinations(range(blocks), blocks - bits)):
        mask = sum(((1 << edges_at[i + 1]) - (1 << edges_at[i])) for i in chosen)
        mask -= (1 << 64) * (mask >> 63)
        keys.append(F.xxhash64(F.lit(t), F.col("fingerprint").bitwiseAND(F.lit(mask))))
    rows = distinct.select("fingerprint", "node", F.explode(F.array(*keys)).alias("key"))
    large = rows.groupBy("key").count().where(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("parts"))
    rows = rows.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fingerprint", "node")
    return rows.repartition("key").mapInArrow(_links(bits), "a long, b long")


def simhash_components(spark: SparkSession, docs: DataFrame, bits: int = BITS, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint long, component_id) of every row of ``docs``.

    Documents link when their fingerprints differ in at most ``bits`` bits;
    component_id is the smallest doc_id reachable. Null texts and texts without
    words have fingerprint 0 and link like any other. A null doc_id keeps its row:
    it never is the smallest of a component that has another one. Repeated rows
    are linked to each other; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "simhash")
    prints = scratch.write(fingerprints(docs, width))
    distinct = scratch.write(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc")))
    # Nodes are the smallest doc_id of each fingerprint; one without any has no id to pass on.
    edges = near_fingerprints(distinct.where("doc is not null").select("fingerprint", F.col("doc").alias("node")), bits)
    found = connected_components(edges, scratch)
    named = distinct.join(found, distinct.doc == found.node, "left").select("fingerprint", F.coalesce("component", "doc").alias("component_id"))
    return prints.join(named, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_components(spark, table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies one document stays, that of smallest doc_id.

    Near copies are texts of five-word Jaccard similarity 0.8 or more and what they reach;
    SimHash fingerprints and tries propose them (``near_copies``).
    Different texts under one doc_id are documents of their own: if they are near copies and
    the smallest, the one of smallest text hash stays. Of rows with equal doc_id and text the
    one stays whose other columns have the smallest hash. Rows with a null doc_id stay.
    """
    got = near_copies(spark, docs).where("first").select("doc_id", "mark").distinct()
    # Maps can't be hashed; the other columns order copies.
    plain = [f"`{f.name}`" for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), mark(F.col("text").cast("string")).alias("mark"), F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.xxhash64(*plain).alias("turn"))
    # Copies become one before they are dealt out, by what the join deals by as well.
    one = named.groupBy("doc_id", "mark").agg(F.min_by("row", "turn").alias("row"))
    return one.join(got, ["doc_id", "mark"], "left_semi").select("row.*").unionByName(docs.where("doc_id is null"))
