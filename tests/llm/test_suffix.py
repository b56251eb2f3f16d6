import random

import numpy as np
import pytest

from ledgerloom.llm import suffix

from .helpers import DOCS, edge_rows, frame, sentence, write


def collected(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_edge_rows_match_brute_force(spark, tmp_path):
    rows = edge_rows()
    got = collected(suffix.op7_suffix_array_dedup(spark, write(spark, tmp_path, rows)))
    assert got == suffix.brute_force([(r[0], r[1]) for r in rows])


def test_generated_corpus_matches_brute_force(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert collected(suffix.op7_suffix_array_dedup(spark, sf)) == suffix.brute_force(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_edits(spark, tmp_path, seed):
    rng = random.Random(seed)
    base = [sentence(rng, 60) for _ in range(4)]
    rows = []
    for i in range(60):
        t = list(rng.choice(base) + rng.choice(base))
        for _ in range(rng.randrange(12)):
            t[rng.randrange(len(t))] = rng.choice("xyzé \n")
        rows.append((i * 7 % 61, "".join(t), "en", "s", 1))
    got = collected(suffix.op7_suffix_array_dedup(spark, write(spark, tmp_path, rows)))
    assert got == suffix.brute_force([(r[0], r[1]) for r in rows])


def test_empty_table_null_ids_and_shared_ids(spark, tmp_path):
    assert suffix.op7_suffix_array_dedup(spark, write(spark, tmp_path, [])).count() == 0
    text = sentence(random.Random(1), 40)
    rows = [(None, text, "en", "s", 1), (3, text, "en", "s", 1), (3, text, "en", "s", 1), (5, text, "en", "s", 1)]
    got = suffix.op7_suffix_array_dedup(spark, write(spark, tmp_path / "b", rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("3", 0), ("3", 0), ("5", len(text)), ("None", 0)]


@pytest.mark.parametrize("depth", [3, 8, 11, 16, 50])
def test_refine_groups_equal_strings(depth):
    rng = np.random.default_rng(depth)
    text = np.concatenate([rng.integers(97, 99, 400, dtype=np.uint8), np.tile(rng.integers(97, 100, 60, dtype=np.uint8), 8)])
    wanted = np.arange(len(text) - depth)
    bucket = suffix.refine(np.concatenate([text, np.zeros(depth + 8, np.uint8)]), wanted, depth)
    strings = [text[i : i + depth].tobytes() for i in wanted]
    by = {}
    for s, b in zip(strings, bucket, strict=True):
        assert by.setdefault(s, b) == b
    assert len(set(by.values())) == len(by)
    # Pointers rise with the strings: the order is that of the suffix array to this depth.
    order = sorted(by)
    assert [by[s] for s in order] == sorted(by.values())


def test_stage_keeps_columns_and_drops_split_characters(spark):
    text = "é" * 40 + sentence(random.Random(2), 30)
    rows = [(1, text, "fr", "s", len(text)), (2, "ü" + text[3:], "fr", "s", len(text)), (3, None, None, None, None)]
    docs = frame(spark, rows)
    out = suffix.without_repeats(spark, docs, "")
    assert out.columns == docs.columns and out.schema == docs.schema
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["text"] == text and got[3]["text"] is None
    assert got[2]["text"] == "ü" and got[2]["n_chars"] == 1
    assert DOCS.split()[0] == "doc_id"


def test_a_line_in_very_many_contexts(spark):
    rng = random.Random(5)
    line = sentence(rng, 9)[:60]
    rows = [(i, f"{sentence(rng, 12)}\n{line}\n{sentence(rng, 12)}", "en", "s", 1) for i in range(20_000)]
    out = {r["doc_id"]: r["n_removed"] for r in suffix.cut_repeats(spark, frame(spark, rows), ["doc_id"]).select("doc_id", "n_removed").collect()}
    assert out[0] == 0 and all(out[i] >= len(line) for i in out if i)


@pytest.mark.parametrize("hot", [1, 4, 1 << 20])
def test_windows_of_hot_keys_one_by_one(spark, hot):
    rng = random.Random(6)
    line = sentence(rng, 9)[:60]
    rows = [(i * 11 % 301, f"{sentence(rng, 12)}\n{line}\n{rng.choice('abc') * 70}", "en", "s", 1) for i in range(300)] + [(900 + i, "ab" * 300, "en", "s", 1) for i in range(9)]
    got = suffix.cut_repeats(spark, frame(spark, rows), ["doc_id"], batch_bytes=2000, hot=hot)
    want = suffix.brute_force([(r[0], r[1]) for r in rows])
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got.collect()} == {i: w[:3] for i, w in want.items()}


def test_columns_named_like_results(spark):
    text = sentence(random.Random(3), 30)
    docs = frame(spark, [(1, text, "en", "s", 1), (2, text + "tail", "en", "s", 2)])
    for c in ("kept", "n_bytes", "N_removed", "n_spans", "__bytes", "__0", "batch", "kind"):
        docs = docs.selectExpr("*", f"'own' as `{c}`")
    out = suffix.without_repeats(spark, docs, "")
    assert out.dtypes == docs.dtypes
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[2]["kept"] == got[2]["N_removed"] == got[2]["__0"] == "own" and len(got[2]["text"]) < 6
    plain = suffix.cut_repeats(spark, docs)
    assert plain.columns == [c for c in docs.columns if c.lower() not in ("kept", "n_bytes", "n_removed", "n_spans")] + ["n_bytes", "n_removed", "n_spans", "kept"]


def test_one_very_long_text(spark):
    text = sentence(random.Random(8), 250_000)
    rows = [(1, text[:300_000], "en", "s", 1), (2, text, "en", "s", 1)]
    out = {r["doc_id"]: r["n_removed"] for r in suffix.cut_repeats(spark, frame(spark, rows), ["doc_id"], batch_bytes=1 << 20).select("doc_id", "n_removed").collect()}
    assert out[1] == 0 and 300_000 <= out[2] < 310_000


def test_order_of_rows_that_share_a_doc_id():
    import pyarrow as pa

    rows = [(3, b"c"), (1, b"b"), (3, b"a"), (1, b"b"), (2, b"z")]
    for k in range(5):
        turned = rows[k:] + rows[:k]
        group = pa.table({"__doc": [i for i, _ in turned], "__bytes": [b for _, b in turned]})
        assert suffix._documents(group)[1] == [b"b", b"b", b"z", b"a", b"c"]
