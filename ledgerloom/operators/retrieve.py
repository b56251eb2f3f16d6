"""Vector top-k, metadata filters and expansion by joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..functions.vector import score
from ..schema import CAUSAL_TYPES
from .held import looked_up, salted_join


def top_k(vectors: DataFrame, query: list[float], k: int, id_: str = "id", mode: str = "index") -> DataFrame:
    """The ``k`` nearest rows with their score; ties by id. One pass and a bounded sort."""
    scored = vectors.withColumn("score", score(F.col("embedding"), F.lit([float(v) for v in query]), mode)).drop("embedding")
    return scored.where("score is not null").orderBy(F.desc("score"), id_).limit(k)


def top_k_batch(vectors: DataFrame, queries: dict[int, list[float]], k: int, id_: str = "id", mode: str = "index") -> DataFrame:
    """Top-k for each query of a small literal set; ranking is limited before the shuffle."""
    literal = F.array(*(F.struct(F.lit(q).alias("query_id"), F.lit([float(x) for x in v]).alias("vector")) for q, v in queries.items()))
    asked = vectors.withColumn("q", F.explode(literal))
    scored = asked.select(F.col("q.query_id").alias("query_id"), F.col(id_), score(F.col("embedding"), F.col("q.vector"), mode).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_))
    return scored.where("score is not null").withColumn("rank", rank).where(F.col("rank") <= k)


#: Bytes of vectors (as doubles) in a part, and queries in a block, of top_k_all.
PART_BYTES, BLOCK = 32 << 20, 2048
#: Cosines that a task makes at a time, and products of components.
COSINES, PRODUCTS = 1 << 22, 1 << 16


def finite(table: pa.Table, id_: str = "id", x: str = "x") -> dict[int, tuple[pa.Array, np.ndarray, np.ndarray]]:
    """By size the ids in order, the vectors of lists of doubles and their squared norms. Vectors with a
    null or non-finite component, zero vectors and nulls are left out."""
    table = table.filter(pc.is_valid(table.column(x))).combine_chunks()
    table = table.take(pc.sort_indices(table.column(id_)))
    out: dict[int, tuple[pa.Array, np.ndarray, np.ndarray]] = {}
    if not table.num_rows:
        return out
    lists = table.column(x).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ids = table.column(id_).combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)  # a null component is NaN
    start = np.concatenate([[0], np.cumsum(size)])
    for n in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == n)
        m = flat.reshape(-1, n) if len(at) == len(size) else flat[start[at][:, None] + np.arange(n)]
        squares = np.zeros(len(m))
        for component in m.T:
            squares += component * component
        good = np.isfinite(squares) & (squares > 0)
        if good.any():
            out[n] = ids.take(pa.array(at[good])), m[good], squares[good]
    return out


def units(table: pa.Table, id_: str = "id", x: str = "x") -> dict[int, tuple[pa.Array, np.ndarray]]:
    """The ``finite`` vectors as unit vectors."""
    return {n: (ids, m / np.sqrt(squares)[:, None]) for n, (ids, m, squares) in finite(table, id_, x).items()}


def scored(cosine, mode: str):
    """The score that ranks, of a column or an array of cosines. Cosines that differ may have one score."""
    return (1 + cosine) / 2 if mode == "index" else cosine


def cosines(q: np.ndarray, q2: float, v: np.ndarray, v2: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cosines of ``q`` and the rows ``at`` of ``v``, summed component by component as SQL does.

    A pair has the same one wherever it is compared: the last bits of a matrix product depend on
    its shape and on a row's place in it.
    """
    dots, step = np.empty(len(at)), max(1, PRODUCTS // len(q))
    for s in range(0, len(at), step):
        products = v[at[s : s + step]] * q
        dots[s : s + step] = np.add.accumulate(products, axis=1)[:, -1]
    with np.errstate(over="ignore"):
        both = v2[at] * q2
    whole = (both > np.finfo(float).tiny) & (both < np.inf)
    return np.clip(dots / np.where(whole, np.sqrt(both), np.sqrt(v2[at]) * np.sqrt(q2)), -1, 1)


def best_of(q: np.ndarray, q2: np.ndarray, v: np.ndarray, v2: np.ndarray, k: int, mode: str):
    """For each query its number, and places and cosines of the ``k`` of highest score; ties by place.

    ``q2`` and ``v2`` are squared norms. A matrix product tells which few may be among the k; where
    these are many, copies say, equal rows are compared once.
    """
    unit, inverse = q / np.sqrt(q2)[:, None], 1 / np.sqrt(v2)
    slack = 1e-12 + 8 * v.shape[1] * np.finfo(float).eps  # over twice what a product can be off
    step = min(256, max(1, COSINES // max(1, len(v))))
    kinds = None
    for s in range(0, len(q), step):
        rough = unit[s : s + step] @ v.T
        rough *= inverse
        for i, row in enumerate(rough, s):
            if len(row) > 4 * k:
                may = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - slack)
            else:
                may = np.arange(len(row))
            if len(may) <= 4 * k:
                near = cosines(q[i], q2[i], v, v2, may)
            else:
                if kinds is None:
                    _, one, kinds = np.unique(v.view(f"V{v.itemsize * v.shape[1]}").ravel(), return_index=True, return_inverse=True)
                kind, of = np.unique(kinds[may], return_inverse=True)
                near = cosines(q[i], q2[i], v, v2, one[kind])[of]
            most = np.lexsort((may, -scored(near, mode)))[:k]
            yield i, may[most], near[most]


def nearest(k: int, kind: pa.DataType, mode: str):
    """Cogrouped queries and vectors to (query_id, id, cosine): at most ``k`` rows a query."""

    def run(asked: pa.Table, table: pa.Table) -> pa.Table:
        a, b = finite(asked), finite(table)
        queries, ids, found = [np.empty(0, np.int64)], [pa.array([], kind)], [np.empty(0)]
        for n in a.keys() & b.keys():
            (qs, *q), (vs, *v) = a[n], b[n]
            qs = qs.to_numpy()
            for i, at, near in best_of(*q, *v, k, mode):
                queries.append(np.full(len(at), qs[i]))
                ids.append(vs.take(pa.array(at)).cast(kind))
                found.append(near)
        return pa.table({"query_id": np.concatenate(queries), "id": pa.chunked_array(ids), "cosine": np.concatenate(found)})

    return run


def doubles(column: str = "embedding") -> Column:
    return F.transform(column, lambda v: v.cast("double"))


def top_ranked(found: DataFrame, k: int, mode: str) -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` nearest over all parts."""
    score_ = scored(F.col("cosine"), mode)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(score_.desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", score_.alias("score"), "rank")


def id_kind(df: DataFrame, id_: str) -> tuple[str, pa.DataType]:
    """Ids are longs or else strings."""
    whole = df.schema[id_].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return ("bigint", pa.int64()) if whole else ("string", pa.string())


def top_k_all(vectors: DataFrame, queries: DataFrame, k: int, id_: str = "id", mode: str = "index", block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest vectors of each row of ``queries`` (query_id, embedding).

    Queries are dealt into blocks of about ``block`` and vectors into parts of about
    PART_BYTES; each pair of a block and a part is a matrix of cosines, of which only k rows
    a query leave the task. A pair's score is the same in any block and part. Vectors of another
    size, zero vectors, nulls and vectors with null or non-finite components have no score; ties
    of the score go by id. Ids are integers or strings.
    """
    if parts is None:
        size = vectors.agg(F.sum(F.size("embedding").cast("long"))).first()[0] or 0
        parts = max(1, -(-8 * size // PART_BYTES))
    blocks = max(1, -(-queries.count() // block))
    kind, arrow = id_kind(vectors, id_)
    dealt = lambda df, name, n: df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    spread = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = dealt(queries.select(F.col("query_id").cast("long").alias("id"), doubles().alias("x")), "block", blocks).select("*", spread("part", parts))
    right = dealt(vectors.select(F.col(id_).cast(kind).alias("id"), doubles().alias("x")), "part", parts).select("*", spread("block", blocks))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(nearest(k, arrow, mode), f"query_id long, id {kind}, cosine double")
    return top_ranked(found, k, mode)


def optional_filters(df: DataFrame, ticker: str | None = None, period: str | None = None, doc_type: str | None = None) -> DataFrame:
    """A parameter that is None filters nothing; ticker ignores case, period is a substring."""
    if ticker is not None:
        df = df.where(F.upper("ticker") == ticker.upper())
    if period is not None:
        df = df.where(F.col("period").contains(period))
    if doc_type is not None:
        df = df.where(F.col("doc_type") == doc_type)
    return df


def with_document(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Left joins from the few hits outwards; a hit without document keeps null metadata."""
    return hits.join(documents, "doc_id", "left")


def retrieve(vectors: DataFrame, documents: DataFrame, query: list[float], k: int, ticker: str | None = None, period: str | None = None, prefilter: bool = False) -> DataFrame:
    """Search, then join, then filter: fewer than ``k`` rows may be left.

    ``prefilter`` filters before the search instead, which keeps ``k`` rows if there are.
    """
    if prefilter:
        found = optional_filters(with_document(vectors, documents), ticker, period)
        return top_k(found, query, k)
    return optional_filters(with_document(top_k(vectors, query, k), documents), ticker, period)


def next_links(chunks: DataFrame, group: str, order: list[str], id_: str) -> DataFrame:
    """(src, dst) of successive chunks of a document."""
    following = F.lead(id_).over(Window.partitionBy(group).orderBy(*order))
    return chunks.select(F.col(group), F.col(id_).alias("src"), following.alias("dst")).where("dst is not null")


CONTEXT = ("prev_chunks", "next_chunks", "entities", "causal_links")


def context(ids: DataFrame, links: DataFrame, mentions: DataFrame, relations: DataFrame, known: list | None = None) -> DataFrame:
    """For each of ``ids`` (id) previous and next chunks, entities and causal links, sorted and distinct.

    Each branch is aggregated by itself, so no branch multiplies another one. The scans get the
    ids as literals if they are ``known``. Causes of a name are gathered once; a name that very
    many chunks mention is dealt out in parts.
    """

    def gathered(df: DataFrame, value: Column, name: str) -> DataFrame:
        return df.groupBy("id").agg(F.sort_array(F.collect_set(value)).alias(name))

    before = gathered(ids.join(looked_up(links, "dst", known), F.col("id") == F.col("dst")), F.col("src"), "prev_chunks")
    after = gathered(ids.join(looked_up(links, "src", known), F.col("id") == F.col("src")), F.col("dst"), "next_chunks")
    named = ids.join(looked_up(mentions, "chunk_id", known), F.col("id") == F.col("chunk_id")).select("id", "name")
    entities = gathered(named, F.col("name"), "entities")
    causal = relations.where(F.col("rel_type").isin(CAUSAL_TYPES))
    label = F.concat(F.col("rel_type"), F.lit(":"), F.coalesce("tgt_name", F.lit("")))
    if known is None:
        causes = causal.groupBy(F.col("src_name").alias("name")).agg(F.collect_set(label).alias("labels"))
        met = salted_join(named.distinct(), causes, "name", F.col("id")).select("id", F.explode("labels").alias("label"))
    else:
        met = named.join(causal, F.col("name") == F.col("src_name")).select("id", label.alias("label"))
    out = ids
    for branch in (before, after, entities, gathered(met, F.col("label"), "causal_links")):
        out = out.join(branch, "id", "left")
    empty = F.array().cast("array<string>")
    return out.select("id", *(F.coalesce(F.col(c).cast("array<string>"), empty).alias(c) for c in CONTEXT))


def expand(hits: DataFrame, links: DataFrame, mentions: DataFrame, relations: DataFrame, use_causal_edges: bool = True) -> DataFrame:
    """Hits with their context; without causal edges those links are empty."""
    got = context(hits.select("id").distinct(), links, mentions, relations if use_causal_edges else relations.limit(0))
    return hits.join(got, "id", "left")


def walk(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(id, hop): nodes that edges (src, dst) reach in at most ``hops`` <= 4 steps."""
    if not 0 <= hops <= 4:
        raise ValueError("hops are 0 to 4")
    seen = seeds.select("id", F.lit(0).alias("hop"))
    edge = seen
    for hop in range(1, hops + 1):
        step = edge.join(edges, edge["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        edge = step.join(seen, "id", "left_anti").select("id", F.lit(hop).alias("hop"))
        seen = seen.unionByName(edge)
    return seen


def usable(hits: DataFrame, source: str, id_: str, text: str) -> DataFrame:
    """Retriever rows with their source; a blank id drops the row."""
    return hits.withColumns({"source_type": F.lit(source), "source_id": blank_to_null(F.col(id_).cast("string")), "text": F.coalesce(F.col(text).cast("string"), F.lit(""))}).where("source_id is not null")
