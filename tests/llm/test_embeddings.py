import numpy as np

from ledgerloom.llm import embeddings

from .helpers import write
from .test_simhash import plain_components  # noqa: F401

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    """(links, component) of each row number."""
    xs = [None if e is None or not len(e) or any(v is None or not np.isfinite(v) for v in e) or not any(e) else np.array(e, np.float32).astype(float) for _, e, _ in rows]
    n = len(rows)
    links, low = [0] * n, list(range(n))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = xs[i], xs[j]
            if a is None or b is None or rows[i][2] is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = sorted((root(i), root(j)))
                low[y] = x
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return {rows[i][0]: (links[i], least[root(i)], rows[i][0] == least[root(i)]) for i in range(n)}


def collected(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def sample(n=700, size=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, size))
    rows = []
    for i in range(n):
        c = centres[rng.integers(40)]
        x = c + rng.standard_normal(size) * rng.choice([0, 0.1, 0.3, 0.5])
        rows.append((i * 13 % 1009, [float(np.float32(v)) for v in x * rng.choice([1, 3])], [0, 1, 2, None][rng.integers(4)]))
    return rows


def test_links_match_brute_force(spark, tmp_path):
    rows = sample()
    x = rows[0][1]
    bad = [None, [], [0.0] * 16, [*x[:15], None], [*x[:15], float("nan")], [*x[:15], float("inf")], x[:8], x[:8]]
    rows += [(2000 + i, b, rows[0][2] or 0) for i, b in enumerate(bad)]
    got = collected(embeddings.op10_embedding_near_dedup(spark, write(spark, tmp_path, rows, "embeddings", SCHEMA)))
    want = brute(rows)
    found, there = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert got.keys() == want.keys() and all(got[k][0] <= want[k][0] for k in want)
    assert found >= 0.99 * there
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want)


def test_chunks_of_a_hot_bucket_count_each_pair_once(spark):
    rows = sample(400, seed=1)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = collected(embeddings.near_vectors(spark, df))
    assert collected(embeddings.near_vectors(spark, df, chunk=7)) == whole


def test_generated_table_recall(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got, want = collected(embeddings.op10_embedding_near_dedup(spark, sf)), brute(rows)
    there = sum(w[0] for w in want.values())
    assert sum(g[0] for g in got.values()) >= 0.99 * there
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want)


def test_empty_and_repeated(spark, tmp_path):
    assert embeddings.op10_embedding_near_dedup(spark, write(spark, tmp_path, [], "embeddings", SCHEMA)).count() == 0
    rows = [(1, [1.0, 2.0], 3)] * 3 + [(None, [1.0, 2.0], 3), (7, [2.0, 4.0], 3), (8, [2.0, 4.0], 4), (9, None, None)]
    got = embeddings.op10_embedding_near_dedup(spark, write(spark, tmp_path / "b", rows, "embeddings", SCHEMA)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == [
        ("1", 3, "1", True), ("1", 3, "1", True), ("1", 3, "1", True), ("7", 3, "1", False), ("8", 0, "8", True), ("9", 0, "9", True), ("None", 0, "None", True),
    ]


def test_labels_are_compared_as_they_are(spark):
    """Fractions aren't cut off, words are labels too, and big numbers aren't folded."""
    x = [1.0, 2.0]
    for kind, a, b in (("double", 1.2, 1.7), ("string", "one", "two"), ("long", 1, 2**32 + 1)):
        rows = [(1, x, a), (2, x, a), (3, [2.0, 4.0], a), (4, x, b), (5, x, None)]
        got = collected(embeddings.near_vectors(spark, spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}")))
        assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True), 5: (0, 5, True)}
