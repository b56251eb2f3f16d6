"""Many questions in one plan: equal to one at a time, and no dearer in searches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import flows
from ledgerloom.operators import dispatch, held, retrieve


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return flows._corpus(spark, sf)


PLANS = {
    1: dispatch.Plan(("chunk_search",), 6, 4), 2: dispatch.Plan(("table_search", "chunk_search", "graph_traversal"), 8, 6, use_causal_edges=False), 3: dispatch.Plan(("graph_traversal",), 7, 6),
    4: dispatch.Plan(("table_search", "graph_traversal"), 7, 3), 5: dispatch.Plan(("table_search", "graph_traversal"), 5, 20, ticker="no such"), 6: dispatch.Plan(("chunk_search", "table_search"), 20, 0, period="en"),
}


def vector(k):
    return np.random.default_rng(k).normal(size=64).tolist()


def table(spark, plans):
    rows = [(k, vector(k), list(p.tools), p.chunk_top_k, p.table_top_k, p.ticker, p.period, p.use_causal_edges, False) for k, p in plans.items()]
    return spark.createDataFrame(rows, dispatch.QUESTION)


COLUMNS = ["source_type", "source_id", "section_id", "doc_id", "company", "ticker", "prev_chunks", "next_chunks", "entities", "causal_links"]


def shown(rows):
    return sorted(((*(r[c] for c in COLUMNS), round(r["score"], 9)) for r in rows), key=repr)


def test_all_at_once_is_one_at_a_time(spark, corpus):
    got = dispatch.retrieve_all(corpus, table(spark, PLANS)).collect()
    for k, plan in PLANS.items():
        one = dispatch.dispatch(corpus, vector(k), plan).hits.collect()
        assert shown(r for r in got if r["question_id"] == k) == shown(one), plan
    assert not [r for r in got if r["question_id"] == 5] and {r["source_type"] for r in got if r["question_id"] == 4} == {"table"}


def test_gates_have_a_row_for_each_question(spark, corpus):
    evidence, gates = dispatch.gather_all(corpus, table(spark, PLANS))
    rows = {r["question_id"]: r for r in gates.collect()}
    assert rows.keys() == PLANS.keys() and rows[5]["evidence_count"] == 0 and not rows[5]["passed"] and rows[5]["ticker"] == "no such"
    for k, plan in PLANS.items():
        if k != 5:
            one = dispatch.gathered_evidence(corpus, vector(k), plan)[1].first()
            assert [rows[k][c] for c in ("evidence_count", "chunk_count", "table_count", "passed", "ticker")] == [one[c] for c in ("evidence_count", "chunk_count", "table_count", "passed", "ticker")]
    assert evidence.groupBy("question_id", "rank").count().where("count > 1").count() == 0


def jobs_of(spark, name, work):
    """How many jobs ``work`` starts."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
        return len(tracker.getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_work_does_not_grow_with_the_number_of_questions(spark, corpus):
    few = table(spark, {k: PLANS[1 + k % 6] for k in range(6)})
    many = table(spark, {k: PLANS[1 + k % 6] for k in range(120)})
    plans = [dispatch.retrieve_all(corpus, q)._jdf.queryExecution().optimizedPlan().toString() for q in (few, many)]
    assert plans[0].count("Relation") == plans[1].count("Relation") == 1  # the held hits; no search is run again
    counts = [jobs_of(spark, f"asked {n}", lambda q=q: dispatch.retrieve_all(corpus, q).count()) for n, q in enumerate((few, many))]
    assert abs(counts[0] - counts[1]) <= 6, counts


def test_one_question_searches_once_each(spark, corpus):
    plan = dispatch.gathered_evidence(corpus, vector(1), PLANS[2])[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation [" not in plan.replace("LocalRelation", "") and plan.count("GlobalLimit") == 0  # hits are held


def test_no_questions_and_bad_ones(spark, corpus):
    assert dispatch.retrieve_all(corpus, table(spark, {})).count() == 0
    odd = spark.createDataFrame([(1, vector(1), None, 5, 5, None, None, None, None), (2, None, ["chunk_search"], 5, 5, None, None, None, None), (3, [0.0] * 64, ["chunk_search"], 5, 5, None, None, None, None), (4, vector(1), ["other"], 5, 0, None, None, True, None)], dispatch.QUESTION)
    assert dispatch.retrieve_all(corpus, odd).count() == 0
    wrong = spark.createDataFrame([(1, vector(1), ["chunk_search"], 21, 5, None, None, None, None)], dispatch.QUESTION)
    with pytest.raises(Exception, match="chunk_top_k is 1 to"):
        dispatch.retrieve_all(corpus, wrong).count()


def test_nearest_with_string_ids_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{i}", rng.normal(size=8).tolist()) for i in range(60)]
    rows += [("twin2", rows[0][1]), ("twin1", rows[0][1]), ("none", None), ("zero", [0.0] * 8), ("nan", [float("nan")] * 8), ("short", [1.0, 2.0]), ("hole", [None] + [1.0] * 7)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    asked = spark.createDataFrame([(7, rows[0][1]), (8, [1.0, 1.0]), (9, None)], "query_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in retrieve.top_k_all(df, asked, 4, parts=5).collect()}
    want = [r.id for r in retrieve.top_k(df.where("id not in ('nan', 'hole')"), rows[0][1], 4).collect()]
    assert [got[7, k] for k in (1, 2, 3, 4)] == want and want[:3] == ["c0", "twin1", "twin2"]
    assert got[8, 1] == "short" and {q for q, _ in got} == {7, 8}


def test_a_hub_is_dealt_out(spark, tmp_path):
    rng = random.Random(1)
    left = spark.createDataFrame([(i, "hub" if i % 3 == 0 else f"n{rng.randrange(500)}") for i in range(9000)], "id long, name string")
    right = spark.createDataFrame([("hub", "a"), ("hub", "b")] + [(f"n{k}", "c") for k in range(500)], "name string, label string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        got = held.salted_join(left, right, "name", F.col("id"), each=60)
        sizes = [r["count"] for r in got.where("label <> 'b'").groupBy(F.spark_partition_id()).count().collect()]
        plain = [r["count"] for r in left.join(right, "name").where("label <> 'b'").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == sum(plain) == 9000 and max(sizes) < 2 * sum(sizes) / 16 < 3000 <= max(plain)
        assert got.where("label = 'b'").count() == 3000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_more_rows_than_said_raise(spark):
    with pytest.raises(ValueError, match="more than"):
        held.held(spark.range(held.MOST + 1), True)


def test_a_pair_has_one_score_wherever_it_is_compared(spark):
    """Chunks and tables of one vector tie, whatever parts and blocks they were compared in, as they do in SQL."""
    import duckdb

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).astype("float32").tolist()) for i in range(1003)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = df.where("id % 23 = 0").selectExpr("id as query_id", "embedding")
    want = {(q, i): c for q, i, c in duckdb.connect().execute(
        "WITH v AS (SELECT unnest($1) AS r), w AS (SELECT r[1]::BIGINT AS id, CAST(r[2:] AS DOUBLE[]) AS e FROM v) SELECT a.id, b.id, (1 + list_cosine_similarity(b.e, a.e)) / 2 FROM w a, w b WHERE a.id % 23 = 0", [[[float(i), *e] for i, e in rows]]
    ).fetchall()}
    for queries, block, parts in ((asked, 2048, 1), (asked.where("query_id % 3 > 0"), 5, 3), (asked.limit(1), 1, 7)):
        got = retrieve.top_k_all(df, queries, 40, block=block, parts=parts).collect()
        assert len(got) == 40 * queries.count() and [r for r in got if r["score"] != want[r["query_id"], r["id"]]] == []


def test_cosines_of_one_score_tie_by_id(spark):
    df = spark.createDataFrame([(i, [i * 1e-18, 1.0]) for i in range(60)] + [(99, [-1.0, 0.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    for parts in (1, 4):
        got = retrieve.top_k_all(df, asked, 3, parts=parts).orderBy("rank").collect()
        assert [(r["id"], r["score"]) for r in got] == [(0, 0.5), (1, 0.5), (2, 0.5)]
        assert [r["id"] for r in retrieve.top_k_all(df, asked, 3, mode="cosine", parts=parts).orderBy("rank").collect()] == [59, 58, 57]


def test_batch_is_its_sql_where_chunks_and_tables_tie(spark, tmp_path):
    import duckdb

    e = 1 + np.random.default_rng(16).normal(size=(150, 64))
    rows = [(i, x.tolist(), i % 10) for i, x in enumerate((e / np.linalg.norm(e, axis=1)[:, None]).astype("float32"))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(38).selectExpr("id as doc_id", "'t' as text", "if(id % 2 = 0, 'en', 'de') as lang", "concat('src', id % 5) as source", "1L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    for t in ("embeddings", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    columns = "question_id", "rank", "source_type", "source_id", "doc_id", "context"
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({flows._SQL['retrieval_batch']}) ORDER BY 1, 2").fetchall()
    got = flows.retrieval_batch(spark, str(tmp_path)).select(*columns).orderBy("question_id", "rank").collect()
    assert list(map(tuple, got)) == want


def test_many_copies_are_ordered_by_place():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24))
    v, q = base[rng.integers(0, 40, 5000)], np.concatenate([base[:5], rng.normal(size=(15, 24))])
    total = lambda m: np.add.accumulate(m, axis=1)[:, -1]
    for k, mode in ((1, "index"), (7, "cosine"), (200, "index"), (3000, "index")):
        for i, at, near in retrieve.best_of(q, total(q * q), v, total(v * v), k, mode):
            cosine = np.clip(total(v * q[i]) / np.sqrt(total(v * v) * total(q * q)[i]), -1, 1)
            want = np.lexsort((np.arange(len(v)), -retrieve.scored(cosine, mode)))[:k]
            assert (at == want).all() and (near == cosine[want]).all()
