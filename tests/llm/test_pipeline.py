import corpus_pipeline
from ledgerloom.llm import packing, secrets_scan, suffix

from .helpers import DOCS, edge_rows, write
from .test_nearcopies import firsts


def through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        out.append(docs.cache())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == out[0].columns and docs.schema == out[0].schema
    return out


def test_stages_take_effect_on_what_is_left(spark, sf):
    docs, known, one, cut, clean, packs = through(spark, sf)
    texts = {r["doc_id"]: r["text"] for r in known.collect()}
    # The near-copy stage has the rule of five words and 0.8.
    assert {r["doc_id"] for r in one.select("doc_id").collect()} == firsts(list(texts.items()))
    kept = {r["doc_id"]: r["text"] for r in one.collect()}
    want = suffix.brute_force(list(kept.items()))
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert got.keys() == kept.keys()
    for i, (n, removed, _, _) in want.items():
        left = len(got[i].encode())
        assert left == n - removed or (removed and n - removed - 6 * want[i][2] <= left <= n - removed)
    assert secrets_scan.with_spans(clean).where("size(__spans) > 0 and text not like '%[secret]%'").count() == 0
    assert {r["doc_id"] for r in packs.collect()} == set(got)
    assert packs.schema["sequence_id"].dataType.simpleString() == "bigint"
    again = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect())
    assert again == sorted(tuple(r) for r in packs.select("doc_id", "piece", "length", "ids_crc32").collect())
    assert packing.CAPACITY == 4096


def test_edge_rows_pass_through(spark, tmp_path):
    through(spark, write(spark, tmp_path, edge_rows()))[-1].collect()
    assert through(spark, write(spark, tmp_path / "b", []))[-1].count() == 0
    assert DOCS
