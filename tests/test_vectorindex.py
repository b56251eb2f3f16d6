"""Inverted lists: exact answers equal brute force, approximate ones reach their recall."""

import numpy as np
import pytest

from ledgerloom.operators import retrieve, vectorindex

KIND = "id long, embedding array<float>"


def clustered(seed=1, n=2400, groups=40, size=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    rows = [(i, (centres[i % groups] + 0.3 * rng.normal(size=size)).astype("float32").tolist()) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(n // 2)]  # a third are copies
    return rows + [(9000, None), (9001, [0.0] * size), (9002, [None] + [1.0] * (size - 1)), (9003, [float("nan")] * size), (9004, [1.0, 2.0])]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = clustered()
    df = spark.createDataFrame(rows, KIND)
    old = vectorindex.PART
    vectorindex.PART = 300
    try:
        index = vectorindex.build(df, str(tmp_path_factory.mktemp("index")), 16, cells=30)
    finally:
        vectorindex.PART = old
    queries = df.where("id % 100 = 0").selectExpr("id as query_id", "embedding")
    return df, index, queries


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


def test_every_row_is_filed_and_copies_have_parts(stored):
    df, index, _ = stored
    assert index.total == 3600 and index.vectors.count() == 3600 and index.parts.max() >= 5
    assert index.vectors.groupBy("cell", "part").count().where("count > 450").count() == 0


def test_exact_search_is_brute_force(stored):
    df, index, queries = stored
    assert ranked(vectorindex.search_exact(index, queries, 5, first=2)) == ranked(retrieve.top_k_all(df, queries, 5))


def test_exact_search_with_more_asked_than_there_are(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i % 3) + 1, float(i), 1.0]) for i in range(12)], KIND)
    index = vectorindex.build(df, str(tmp_path / "i"), 3)
    queries = df.selectExpr("id as query_id", "embedding")
    assert ranked(vectorindex.search_exact(index, queries, 40, first=1)) == ranked(retrieve.top_k_all(df, queries, 40))


def test_recall_and_rows_read(stored):
    df, index, queries = stored
    probes, share = vectorindex.probes_for(index, df, 10, recall=0.95)
    assert probes < 12 and share < 0.6
    got = vectorindex.search(index, queries, 10, probes)
    assert vectorindex.recall_of(got, retrieve.top_k_all(df, queries, 10)) >= 0.9


def test_a_stored_index_is_read_again(spark, stored):
    df, index, queries = stored
    again = vectorindex.load(spark, index.path)
    assert again.kind == index.kind and (again.rows == index.rows).all()
    assert ranked(vectorindex.search(again, queries, 3, 4)) == ranked(vectorindex.search(index, queries, 3, 4))


def test_string_ids_and_nothing_to_file(spark, tmp_path):
    df = spark.createDataFrame([(f"v{i}", [float(i), 1.0]) for i in range(30)], "id string, embedding array<double>")
    index = vectorindex.build(df, str(tmp_path / "s"), 2, cells=3)
    asked = spark.createDataFrame([(1, [4.0, 1.0])], "query_id long, embedding array<double>")
    assert vectorindex.search_exact(index, asked, 1, first=1).first()["id"] == "v4"
    none = vectorindex.build(df.limit(0), str(tmp_path / "n"), 2)
    assert none.total == 0 and vectorindex.search(none, asked, 3, 2).count() == 0 and vectorindex.search_exact(none, asked, 3).count() == 0


def test_batches_of_probes_and_cells_are_bounded():
    """What a task holds doesn't grow with the cells: a batch of probes has NUMBERS numbers at most."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(2048, 32))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    q = rng.normal(size=(2000, 32))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, q.size + 1, 32), pa.int32()), pa.array(q.ravel()))
    near = q / np.linalg.norm(q, axis=1)[:, None] @ centres.T
    probed = vectorindex._probed(centres, lambda near, order, least: np.arange(1024), False)
    tracemalloc.start()
    rows, most = 0, 0
    for b in probed([pa.RecordBatch.from_arrays([pa.array(range(2000)), lists], names=["query_id", "x"])]):
        rows, most = rows + b.num_rows, max(most, b.num_rows)
        first = b.filter(pa.compute.equal(b.column(3), 0))
        assert (near[first.column(0).to_numpy()].argmax(1) == first.column(2).to_numpy()).all()
    cells = vectorindex._assigned(centres, pa.int64())([pa.RecordBatch.from_arrays([pa.array(range(2000)), lists], names=["id", "x"])])
    assert (next(cells).column(2).to_numpy() == near.argmax(1)).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2000 * 1024 and most * 32 <= vectorindex.NUMBERS
    assert peak < 100 << 20
