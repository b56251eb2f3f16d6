"""Near copies by Jaccard similarity: SimHash tries propose, exact comparisons decide, components follow."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, release
from .components import connected_components, forest
from .trie import trie_pairs

WIDTH = 5
#: Least Jaccard similarity of two texts' sets of shingles.
LEAST = 0.8
#: A fingerprint has WORDS times 64 bits. At LEAST a bit differs with probability 0.1515, as
#: the angle of the sets has it; DIFFER covers small sets but those of four and five shingles (0.19).
WORDS, DIFFER = 8, 0.16
#: Candidates agree on the bits of some table's key and differ in at most BUDGET bits of the
#: first TRIE words: four deviations over such a pair's mean, five under that of other texts.
TRIE, BUDGET = 2, 36
#: Texts that agree on a key by chance, and the least share of pairs at DIFFER that some key finds.
BUCKET, RECALL = 32, 0.99
#: Sets of fewer shingles are similar only if they are equal.
LEAST_SHINGLES = 4
#: A key with more fingerprints is dealt out as pairs of chunks; tries hold about RUN at a time.
KEY_CHUNK, RUN = 20_000, 1 << 17
#: A group of candidates with more rows or bytes of text is dealt out as pairs of chunks.
CHUNK, CHUNK_BYTES = 2000, 16 << 20
SEED = 20_117

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the different ``width``-word shingles; a shorter text is one."""
    words = (text or "").encode(errors="surrogatepass").lower().split()  # bytes: ASCII letters and blanks only
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.fromiter((digest(x, SEED) for x in words), np.uint64, len(words))
    n = max(1, len(w) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(width, len(w))):
        h = (h ^ w[k : k + n]) * _PRIME
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _mixed(h: np.ndarray) -> np.ndarray:
    """The bits (0 or 1) of WORDS hashes of each shingle."""
    x = (h[:, None] ^ np.random.default_rng(SEED).integers(0, 1 << 64, WORDS, dtype=np.uint64)) * _PRIME
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")


def fingerprint(h: np.ndarray) -> np.ndarray:
    """The SimHash, WORDS words, of a sorted set of shingles. Ties are broken by the 64 least
    shingles, with weights of their own at each bit, so that unlike small sets don't share them."""
    if not len(h):
        return np.zeros(WORDS, np.uint64)
    ones = np.zeros(64 * WORDS, np.int64)
    for s in range(0, len(h), 255):  # sums of 255 bits fit in a byte
        ones += _mixed(h[s : s + 255]).sum(0, dtype=np.uint8)
    on = 2 * ones > len(h)
    ties = np.flatnonzero(2 * ones == len(h))
    if len(ties):
        odd = np.random.default_rng(SEED).integers(0, 1 << 64, 64 * WORDS, dtype=np.uint64)[ties] | np.uint64(1)
        weights = (h[:64, None] * odd >> np.uint64(40)).astype(float)
        on[ties] = (weights * (2.0 * _mixed(h[:64])[:, ties] - 1)).sum(0) > 0
    return np.packbits(on, bitorder="little").view(np.uint64)


def tables_for(texts: int) -> tuple[int, int]:
    """(bits of a key, tables) for a number of different texts."""
    bits = max(0, math.ceil(math.log2(max(1, texts) / BUCKET)))
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - DIFFER) ** bits)) if bits else 1


def _signatures(batches):
    release()
    for batch in batches:
        first, second, size, count, prints = [], [], [], [], []
        for t in batch.column(2):
            text = t.as_py()
            h = shingles(text)
            both = xxhash.xxh128_intdigest(h.tobytes())
            first.append(both >> 64)
            second.append(both & ((1 << 64) - 1))
            size.append(len(text or ""))
            count.append(len(h))
            prints.append(fingerprint(h).view(np.int64))
        longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (first, second)]
        rest = [pa.array(size, pa.int64()), pa.array(count, pa.int64()), pa.array(prints, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *longs, *rest], names=["doc_id", "mark", "h1", "h2", "size", "count", "print"])


_FILED = [f"w{k}" for k in range(TRIE)]


def _filed(bits: int, tables: int):
    """A row for each table: a key of ``bits`` chosen bits, the node, the words of the trie."""

    def run(batches):
        release()
        rng = np.random.default_rng([SEED, bits, tables])
        masks = np.zeros((tables, WORDS), np.uint64)
        for mask in masks:
            for bit in rng.choice(64 * WORDS, bits, replace=False).tolist():
                mask[bit // 64] |= np.uint64(1 << bit % 64)
        odd = rng.integers(0, 1 << 64, (tables, WORDS), dtype=np.uint64) | np.uint64(1)
        salt = rng.integers(0, 1 << 64, tables, dtype=np.uint64)
        for batch in batches:
            words = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
            shared = [batch.column(0), *(pa.array(words[:, k].view(np.int64)) for k in range(TRIE))]
            for t in range(tables):
                key = ((words & masks[t]) * odd[t]).sum(1, dtype=np.uint64) ^ salt[t]
                key = (key ^ (key >> np.uint64(31))) * _PRIME
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *shared], names=["key", "node", *_FILED])

    return run


def _joined(key: np.ndarray, node: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
    """Edges that connect the nodes of equal keys within BUDGET."""
    order = np.lexsort((*words.T[::-1], key))
    key, node, words = key[order], node[order], words[order]
    a, b, held = [], [], 0
    for i, j in trie_pairs(key, words, BUDGET, 1 << 18):
        a.append(node[i])
        b.append(node[j])
        held += len(i)
        if held > 1 << 19:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], len(x)
    none = [np.empty(0, np.int64)]
    x, y = forest(np.concatenate(a or none), np.concatenate(b or none))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


def _joins(batches):
    """Tries of rows sorted by key, about RUN rows at a time and a key never parted."""
    release()
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node, *words = (batch.column(c).to_numpy() for c in range(2 + TRIE))
        held.append((key, node, np.stack(words, 1).view(np.uint64)))
        rows += len(key)
        if rows >= RUN and held[-1][0][-1] != held[0][0][0]:
            key, node, words = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = np.flatnonzero(key != key[-1])[-1] + 1
            yield _joined(key[:cut], node[:cut], words[:cut])
            held, rows = [(key[cut:], node[cut:], words[cut:])], rows - cut
    if held:
        yield _joined(*(np.concatenate(x) for x in zip(*held, strict=True)))


def candidates(scratch: Scratch, classes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the nodes of ``classes`` (node, print) which agree on a key
    and differ in at most BUDGET bits, by self-joins of binary tries.

    The number of tables grows with that of the texts, so that a key has BUCKET of them by
    chance. A key with over KEY_CHUNK fingerprints is split into chunks, and every pair of
    chunks is joined by a task of its own.
    """
    bits, tables = tables_for(classes.count())
    rows = classes.select("node", "print").mapInArrow(_filed(bits, tables), ", ".join(f"{c} long" for c in ["key", "node", *_FILED]))
    # Written, its size is known: a small one is sent to the rows, which are then dealt out once.
    large = scratch.write(rows.groupBy("key").count().where(F.col("count") > KEY_CHUNK).select("key", F.ceil(F.col("count") / KEY_CHUNK).cast("int").alias("parts")))
    rows = rows.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", *_FILED)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_joins, "a long, b long")


def similar(sets: list[np.ndarray], home: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect all sets of similarity LEAST or more.

    Each set is compared with those that it isn't connected to yet; with ``across``
    only with those of the other home.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(codes.max(initial=-1) + 1, bool)
    label, a, b = np.arange(n), [], []
    for i in range(n - 1):
        # Later sets only: earlier ones have been compared with this one.
        may = np.flatnonzero((label[i + 1 :] != label[i]) & (sizes[i + 1 :] >= LEAST * sizes[i] - 1e-6) & (LEAST * sizes[i + 1 :] <= sizes[i] + 1e-6)) + i + 1
        if across:
            may = may[home[may] != home[i]]
        if not len(may):
            continue
        own = codes[ends[i] : ends[i + 1]]
        mark[own] = True
        s = may[0]
        hits = np.concatenate([[0], np.cumsum(mark[codes[ends[s] :]])])
        mark[own] = False
        both = hits[ends[may + 1] - ends[s]] - hits[ends[may] - ends[s]]
        # 5 * both >= 4 * union, in integers: LEAST is 4 / 5.
        near = may[5 * both >= 4 * (sizes[i] + sizes[may] - both)]
        for j in near:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                a.append(i)
                b.append(j)
    return np.array(a, np.int64), np.array(b, np.int64)


def _verified(key, rows):
    node, home = (rows.column(k).to_numpy() for k in ("node", "home"))
    first, second = (rows.column(k)[0].as_py() for k in ("first", "second"))
    i, j = similar([shingles(t.as_py()) for t in rows.column("text")], home, first != second)
    x, y = forest(node[i], node[j])
    return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})


def mark(text) -> Column:
    """What tells texts of a shared doc_id apart."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def standing(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node, component, parts, text): one text for each node, however often its row is repeated."""
    return texts.join(chosen, ["doc_id", "mark"]).select("node", "component", "parts", "text").dropDuplicates(["node"])


def near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, mark, component_id, first) of every row of ``docs``.

    Documents link when the Jaccard similarity of their WIDTH-word shingles is LEAST or
    more; component_id is the smallest doc_id reachable, and first tells that the row's
    doc_id and text are those that stand for the component: of smallest doc_id and then
    of smallest ``mark`` of the text. Texts without words link with each other. Different
    texts under one doc_id link only if they are similar. A null doc_id keeps its row: it
    never is the smallest of a component that has another one. Repeated rows are linked to
    each other, and their text is compared once; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "nearcopies")
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark(text).alias("mark"), text.alias("text"))
    prints = scratch.write(texts.mapInArrow(_signatures, "doc_id long, mark long, h1 long, h2 long, size long, count long, print array<long>"))
    # Texts of equal sets are one class, which its first row stands for. Its node is a number of its own.
    low = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))).alias("low")
    classes = prints.groupBy("h1", "h2").agg(low, F.max("size").alias("size"), F.first("count").alias("count"), F.first("print").alias("print"))
    classes = scratch.write(classes.where("low is not null").withColumn("node", F.monotonically_increasing_id()))
    groups = connected_components(candidates(scratch, classes.where(F.col("count") >= LEAST_SHINGLES)), scratch)
    members = scratch.write(groups.select("node", "component").unionByName(groups.select(F.col("component").alias("node"), "component").distinct()))
    named = members.join(classes.select("node", "low", "size"), "node")
    large = named.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("size") / CHUNK_BYTES)).cast("int").alias("parts"))
    chosen = named.join(scratch.write(large), "component").select("node", "component", "parts", F.col("low.doc_id").alias("doc_id"), F.col("low.mark").alias("mark"))
    rows = standing(texts, chosen)
    rows = rows.withColumn("home", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"first": F.least("home", "other"), "second": F.greatest("home", "other")}).drop("other", "parts")
    links = scratch.write(rows.groupBy("component", "first", "second").applyInArrow(_verified, "a long, b long"))
    found = connected_components(links, scratch)
    whole = classes.select("h1", "h2", "node", "low").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = scratch.write(whole.groupBy("component").agg(F.min("low").alias("head")))
    whole = whole.join(heads, "component").select("h1", "h2", "head")
    first = F.coalesce((F.col("doc_id") == F.col("head.doc_id")) & (F.col("mark") == F.col("head.mark")), F.lit(False))
    return prints.select("doc_id", "mark", "h1", "h2").join(whole, ["h1", "h2"], "left").select("doc_id", "mark", F.col("head.doc_id").alias("component_id"), first.alias("first"))
