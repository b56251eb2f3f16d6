"""Property-graph tables: upserts by key, relation resolution, deletes, counts."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_name
from ..functions.vector import dot
from ..schema import ENTITY_LABELS, RELATION_TYPES
from .held import MOST, written
from .retrieve import next_links, top_k

log = logging.getLogger(__name__)


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once; nulls are no keys."""
    for k in key:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*key).count().where("count > 1")


def check_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """``df``; raises if a key repeats."""
    bad = duplicates(df, key).first()
    if bad is not None:
        raise ValueError(f"{key} repeats: {bad.asDict()}")
    return df


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list | None = None) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with their key; the last one by ``order`` wins."""
    if order:
        last = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
        new = new.withColumn("__last", last).where("__last = 1").drop("__last")
    else:
        new = new.dropDuplicates(key)
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_company(old: DataFrame, new: DataFrame) -> DataFrame:
    """Companies by name; a ticker that is set already stays."""
    a, b = old.select("name", F.col("ticker").alias("t0")), new.groupBy("name").agg(F.min("ticker").alias("t1"))
    return a.join(b, "name", "full_outer").select("name", F.coalesce("t0", "t1").alias("ticker"))


def with_parent(rows: DataFrame, parents: DataFrame, ref: str, id_: str = "id") -> DataFrame:
    """Rows whose parent exists; orphans are dropped."""
    return rows.join(parents.select(F.col(id_).alias(ref)).distinct(), ref, "left_semi")


def clean_entities(df: DataFrame, label: str = "label", name: str = "name") -> DataFrame:
    """Allowed labels only, title-cased names, blank names dropped."""
    return df.where(F.col(label).isin(ENTITY_LABELS)).withColumn(name, title_name(F.coalesce(name, F.lit("")))).where(f"{name} <> ''")


def mentions(df: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct (chunk_id, label, name) of chunks that exist."""
    return with_parent(df.select("chunk_id", "label", "name").distinct(), chunks, "chunk_id")


def resolve_relations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct typed edges between nodes found by name under any label.

    A relation whose end no node has is dropped; a name that labels share fans out.
    """
    good = relations.where(F.col("rel_type").isin(RELATION_TYPES) & (F.coalesce("src_name", F.lit("")) != "") & (F.coalesce("tgt_name", F.lit("")) != ""))
    src = nodes.select(F.col("label").alias("src_label"), F.col("name").alias("src_name"))
    tgt = nodes.select(F.col("label").alias("tgt_label"), F.col("name").alias("tgt_name"))
    return good.join(src, "src_name").join(tgt, "tgt_name").select("src_label", "src_name", "rel_type", "tgt_label", "tgt_name").distinct()


def delete_documents(documents: DataFrame, edges: DataFrame, ids: list[str], cascade: bool = True) -> tuple[DataFrame, DataFrame, int]:
    """Tables without the documents and how many went. ``cascade`` drops their edges only:
    sections and chunks stay. Without it a document with edges can't go."""
    gone = documents.where(F.col("id").isin(ids))
    if not cascade:
        ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
        used = gone.join(ends, "id", "left_semi").first()
        if used is not None:
            raise ValueError(f"document {used['id']} still has edges")
    left_edges = edges.where(~F.col("src").isin(ids) & ~F.col("dst").isin(ids)) if cascade else edges
    return documents.where(~F.col("id").isin(ids)), left_edges, gone.count()


def document_counts(documents: DataFrame, sections: DataFrame, chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """Per document distinct sections, chunks and tables, each branch counted by itself."""
    s = sections.groupBy("doc_id").agg(F.countDistinct("id").alias("sections"))
    c = chunks.groupBy("doc_id").agg(F.countDistinct("id").alias("chunks"))
    t = tables.groupBy("doc_id").agg(F.countDistinct("id").alias("tables"))
    out = documents.select(F.col("id").alias("doc_id")).join(s, "doc_id", "left").join(c, "doc_id", "left").join(t, "doc_id", "left").na.fill(0)
    return out.withColumn("has_graph_data", (F.col("sections") > 0) | (F.col("chunks") > 0))


@dataclass
class Schema:
    """Unique keys and vector indexes by name; a name that exists stays as it is."""

    unique: dict[str, tuple[str, list[str]]] = field(default_factory=dict)
    indexes: dict[str, tuple[str, list[str]]] = field(default_factory=dict)
    vectors: dict[str, tuple[str, str, int]] = field(default_factory=dict)

    def _add(self, kind: dict, name: str, value: tuple) -> bool:
        return kind.setdefault(name, value) is value

    def add_unique(self, name: str, table: str, key: list[str]) -> bool:
        return self._add(self.unique, name, (table, key))

    def add_index(self, name: str, table: str, columns: list[str]) -> bool:
        """Columns by which ``write_indexed`` lays a table out, for statistics that skip files."""
        return self._add(self.indexes, name, (table, columns))

    def add_vector(self, name: str, table: str, column: str, dimension: int) -> bool:
        return self._add(self.vectors, name, (table, column, dimension))

    def violations(self, tables: dict[str, DataFrame]) -> DataFrame | None:
        """(constraint, key, n): keys that repeat; nulls are no keys. Tables that aren't given aren't checked."""
        out = None
        for name, (table, key) in self.unique.items():
            if table in tables:
                found = duplicates(tables[table], key).select(F.lit(name).alias("constraint"), F.to_json(F.struct(*key)).alias("key"), F.col("count").alias("n"))
                out = found if out is None else out.unionByName(found)
        return out


def create_schema(schema: Schema | None = None, dimension: int = 3072) -> Schema:
    """The unique keys of the graph and the two vector indexes; may be called again."""
    schema = schema or Schema()
    for name, table, key in (("company_ticker", "company", "ticker"), ("company_name", "company", "name"), ("document_id", "document", "id"), ("section_id", "section", "id"), ("chunk_id", "chunk", "id"), ("table_id", "doc_table", "id")):
        schema.add_unique(name, table, [key])
    schema.add_vector("chunk_embeddings", "chunk", "embedding", dimension)
    schema.add_vector("table_embeddings", "doc_table", "embedding", dimension)
    return schema


def init_schema(schema: Schema | None = None, steps: list[Callable[[Schema], object]] | None = None) -> Schema:
    """Keys of jobs, documents, sections, chunks and entities and four secondary indexes. A step
    that fails is logged and the others run."""
    schema = schema or Schema()
    if steps is None:
        steps = [lambda s, t=t: s.add_unique(f"{t}_id", t, ["id"]) for t in ("job", "document", "section", "chunk", "entity")]
        steps += [lambda s, t=t, c=c: s.add_index(f"{t}_{c}", t, [c]) for t, c in (("job", "status"), ("job", "created_at"), ("document", "ticker"), ("document", "status"))]
    for step in steps:
        try:
            step(schema)
        except Exception as error:
            log.warning("schema step failed: %s", error)
    return schema


def write_indexed(df: DataFrame, schema: Schema, table: str, path: str) -> None:
    """``df`` sorted within files by the table's indexed columns: their statistics skip files."""
    columns = [c for t, cs in schema.indexes.values() if t == table for c in cs if c in df.columns]
    (df.repartitionByRange(*columns).sortWithinPartitions(*columns) if columns else df).write.mode("overwrite").parquet(path)


def sign_bucket(embedding: Column, dimension: int, bits: int = 8, seed: int = 7) -> Column:
    """Which side of each of ``bits`` random planes through the origin a vector lies on."""
    planes = np.random.default_rng([seed, dimension]).standard_normal((bits, dimension))
    out = F.lit(0)
    for k, plane in enumerate(planes.tolist()):
        out = out + F.when(dot(embedding, F.lit(plane)) >= 0, F.lit(1 << k)).otherwise(F.lit(0))
    return F.when(F.size(embedding) == dimension, out)


def build_vector_index(df: DataFrame, path: str, dimension: int, column: str = "embedding", bits: int = 8) -> None:
    """Vectors of the right size in folders by ``sign_bucket``; a search reads the near folders only."""
    df.withColumn("bucket", sign_bucket(F.col(column), dimension, bits)).where("bucket is not null").write.mode("overwrite").partitionBy("bucket").parquet(path)


def search_vector_index(index: DataFrame, query: list[float], k: int, bits: int = 8, radius: int = 2, mode: str = "index") -> DataFrame:
    """The nearest among vectors whose bucket differs in at most ``radius`` bits from the query's.

    An approximation: top_k over all vectors is exact, and radius = bits is that.
    """
    own = index.sparkSession.range(1).select(sign_bucket(F.lit([float(x) for x in query]), len(query), bits)).first()[0]
    near = [b for b in range(1 << bits) if (b ^ own).bit_count() <= radius]
    return top_k(index.where(F.col("bucket").isin(near)).drop("bucket"), query, k, mode=mode)


def upsert_documents(companies: DataFrame, documents: DataFrame, filed: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(companies, documents, filed) after new filings (id, type, period, filename, file_path,
    company_name, ticker).

    A company's ticker that is set stays; a document's four fields are replaced and its
    others stay; each (company, document) is one edge.
    """
    companies = upsert_company(companies, new.select(F.col("company_name").alias("name"), "ticker"))
    fields = ["type", "period", "filename", "file_path"]
    last = new.groupBy("id").agg(F.max(F.struct(*fields)).alias("__new"))
    both = documents.join(last, "id", "full_outer")
    written = [F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c) if c in documents.columns else F.lit(None)).alias(c) for c in fields]
    rest = [c for c in documents.columns if c not in (*fields, "id")]
    edges = filed.select("company", "doc_id").unionByName(new.select(F.col("company_name").alias("company"), F.col("id").alias("doc_id"))).distinct()
    return companies, both.select("id", *written, *rest), edges


def upsert_sections(sections: DataFrame, contains: DataFrame, new: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, contains) after new sections (id, doc_id, ...) of documents that exist."""
    good = with_parent(new, documents, "doc_id")
    edges = contains.select("doc_id", "section_id").unionByName(good.select("doc_id", F.col("id").alias("section_id"))).distinct()
    return upsert(sections, good, ["id"]), edges


def upsert_children(children: DataFrame, links: DataFrame, new: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks or tables, their links (section_id, id, sequence)) after new rows (id, section_id,
    sequence, ...).

    A row whose section doesn't exist is dropped; a link that exists gets the new sequence.
    """
    good = with_parent(new, sections, "section_id").dropDuplicates(["id"])
    return upsert(children, good, ["id"]), upsert(links.select("section_id", "id", "sequence"), good.select("section_id", "id", "sequence"), ["section_id", "id"])


def document_chunks(contains: DataFrame, has_chunk: DataFrame) -> DataFrame:
    """(doc_id, id, sequence): chunks that sections of a document have."""
    return contains.select("doc_id", "section_id").join(has_chunk.select("section_id", "id", "sequence"), "section_id").select("doc_id", "id", "sequence")


def document_chain(contains: DataFrame, has_chunk: DataFrame) -> DataFrame:
    """(doc_id, src, dst) of successive chunks over all sections of a document."""
    return next_links(document_chunks(contains, has_chunk), "doc_id", ["sequence", "id"], "id")


def write_by_type(df: DataFrame, kind: str, path: str, each: int = 1_000_000) -> None:
    """Rows grouped by type: one folder each, of files of about ``each`` rows, so that a type that
    most rows have is written by many tasks. Types are few: their counts are read by the driver."""
    counts = written(df.groupBy(F.col(kind).alias("__kind")).agg(F.ceil(F.count("*") / each).cast("int").alias("__parts")))
    dealt = df.join(F.broadcast(counts), F.col(kind).eqNullSafe(F.col("__kind")), "left").withColumn("__part", F.floor(F.rand(7) * F.col("__parts")).cast("int"))
    total = max(1, counts.agg(F.sum("__parts")).first()[0] or 1)
    dealt.repartition(total, kind, "__part").drop("__kind", "__parts", "__part").write.mode("overwrite").partitionBy(kind).parquet(path)


def entity_total(extractions: DataFrame) -> DataFrame:
    """One row: entities over all extractions, 0 without any."""
    return extractions.agg(F.coalesce(F.sum(F.coalesce(F.size("entities"), F.lit(0))), F.lit(0)).alias("entities"))


def repair_chain(chain: DataFrame, chunks: DataFrame, inserted: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links that go, links that come) of a chain (doc_id, src, dst) over ``chunks`` (doc_id, id,
    sequence) when ``inserted`` (doc_id, id, sequence) come and ``deleted`` (doc_id, id) go.

    Only the neighbours of what changes are linked anew, and only documents of the change are
    read: as literals if they are few. Chunks are in order of sequence, then id. An id that is
    deleted and inserted moves; one that is not there can't be deleted.
    """
    docs = inserted.select("doc_id").union(deleted.select("doc_id")).where("doc_id is not null").distinct()
    some = docs.limit(MOST + 1).collect()
    if len(some) <= MOST:
        ids = [r[0] for r in some]
        chain, chunks = chain.where(F.col("doc_id").isin(ids)), chunks.where(F.col("doc_id").isin(ids))
    else:
        docs = written(docs)
        chain, chunks = chain.join(docs, "doc_id", "left_semi"), chunks.join(docs, "doc_id", "left_semi")
    key = ["doc_id", "id"]
    gone = chunks.select(*key, "sequence").join(deleted.select(*key).distinct(), key, "left_semi")
    stay = chunks.select(*key, "sequence").join(deleted.select(*key).distinct(), key, "left_anti")
    new = inserted.select(*key, "sequence").distinct()
    kind = lambda df, k: df.withColumn("kind", F.lit(k))
    rows = kind(stay, "stays").unionByName(kind(new, "comes")).unionByName(kind(gone, "goes"))
    own = Window.partitionBy("doc_id").orderBy("sequence", "id")
    here = F.when(F.col("kind") != "goes", F.col("id"))
    before = F.last(here, True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(here, True).over(own.rowsBetween(1, Window.unboundedFollowing))
    around = rows.withColumns({"before": before, "after": after}).where("kind <> 'stays'")
    link = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    links = F.when(F.col("kind") == "comes", F.array(link("before", "id"), link("id", "after"))).otherwise(F.array(link("before", "after")))
    come = around.select("doc_id", F.explode(links).alias("l")).select("doc_id", "l.*").where("src is not null and dst is not null").distinct()
    ends = deleted.select(*key).union(come.select("doc_id", "src")).distinct()
    out = chain.join(ends.withColumnRenamed("id", "src"), ["doc_id", "src"], "left_semi").select("doc_id", "src", "dst")
    into = chain.join(deleted.select("doc_id", F.col("id").alias("dst")).distinct(), ["doc_id", "dst"], "left_semi").select("doc_id", "src", "dst")
    return out.union(into).distinct(), come


def repaired(chain: DataFrame, go: DataFrame, come: DataFrame) -> DataFrame:
    """The chain after ``repair_chain``."""
    return chain.join(go, ["doc_id", "src", "dst"], "left_anti").unionByName(come)
