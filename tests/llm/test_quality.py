import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality
from ledgerloom.llm.common import Scratch

from .helpers import edge_rows, sentence, write


def plain(text):
    t = text or ""
    for c in "\t\x0b\x0c\r":
        t = t.replace(c, " ")
    words = [w for w in t.replace("\n", " ").split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {k + d for v in at.values() if len(v) > 1 for k in v for d in range(5)}
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, r, n < 10 or 100 * r > 20 * n


def check(df, rows):
    got = {r["doc_id"]: tuple(r)[1:7] for r in df.collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_base_statistics(spark, tmp_path):
    rows = edge_rows()
    rows.append((90, "\n".join(["one two three four five six"] * 3 + ["", "  ", "tail"]), "en", "s", 1))
    rows.append((91, "a b c d e " * 2 + sentence(random.Random(1), 100), "en", "s", 1))
    df = quality.op1_quality_rules(spark, write(spark, tmp_path, rows))
    check(df, [(r[0], r[1]) for r in rows])
    assert not df.where("base_failed and kept").count()


def test_generated_corpus(spark, sf):
    df = quality.op1_quality_rules(spark, sf)
    check(df, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    # Junk is what is labelled so or has symbols in its words; that goes or may go, other rows stay.
    junk = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").select("doc_id")
    clean = df.where("not base_failed and n_symbols = 0").join(junk, "doc_id", "left_anti")
    assert clean.count() > 100 and clean.where("not kept").count() <= 0.02 * clean.count()


def test_outliers_go_and_plain_documents_stay(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.randrange(40, 300)), "en", "big" if i % 3 else f"s{i % 5}", 1) for i in range(600)]
    odd = [(1000 + i, " ".join("#*$%&|<>" for _ in range(80)), "en", "big", 1) for i in range(20)]
    odd += [(2000 + i, " ".join(str(rng.random()) * 6 for _ in range(50)), "en", "s1", 1) for i in range(5)]
    got = {r["doc_id"]: r["kept"] for r in quality.op1_quality_rules(spark, write(spark, tmp_path, rows + odd)).collect()}
    assert not any(got[r[0]] for r in odd)
    assert sum(got[r[0]] for r in rows) == len(rows)


def test_estimate_is_near_the_clean_moments(spark):
    rng = np.random.default_rng(1)
    p = len(quality.DIMS)
    mix = np.tril(rng.standard_normal((p, p))) + 2 * np.eye(p)
    x = rng.standard_normal((3000, p)) @ mix.T
    x[:500] += 60
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], ", ".join(["grp string", *(f"{c} double" for c in quality.DIMS)]))
    e = quality.minimum_determinant(Scratch(spark, "t"), df).first()
    clean = x[500:]
    mean = np.array([e[f"m_{i}"] for i in range(p)])
    w = np.array([[e[f"w_{i}_{j}"] if j <= i else 0 for j in range(p)] for i in range(p)])
    cov = np.linalg.inv(w.T @ w)
    want = np.cov(clean.T) + np.diag([f**2 for f in quality.FLOORS.values()])
    assert np.abs(mean - clean.mean(0)).max() < 0.25
    assert np.abs(cov / want - 1)[np.eye(p, dtype=bool)].max() < 0.15


@pytest.mark.parametrize(("p", "k", "want"), [(0.975, 5, 12.8325), (0.5, 5, 4.3515), (0.99, 2, 9.2103)])
def test_chi_square(p, k, want):
    assert abs(quality.chi2_quantile(p, k) - want) < 1e-3


def test_empty_and_repeated(spark, tmp_path):
    assert quality.op1_quality_rules(spark, write(spark, tmp_path, [])).count() == 0
    rows = [(1, "same text here", "en", "s", 1)] * 3 + [(None, None, None, None, None)]
    assert quality.op1_quality_rules(spark, write(spark, tmp_path / "b", rows)).count() == 4


def test_labelled_junk_goes(spark, sf):
    got = quality.op1_quality_rules(spark, sf).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    junk = [r["kept"] for r in got if r["quality"] == 0]
    assert junk and sum(junk) <= 0.05 * len(junk)
    assert all(r["kept"] for r in got if r["quality"] == 1)


def test_repeated_lines_alone_are_enough(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "\n".join(sentence(rng, 8) for _ in range(rng.randrange(15, 40))), "en", "s", 1) for i in range(400)]
    odd = []
    for i in range(8):  # lines of four words: windows of five seldom repeat
        x = [sentence(rng, 4) for _ in range(30)]
        odd.append((1000 + i, "\n".join(rng.sample(x + x[:25], 55)), "en", "s", 1))
    got = {r["doc_id"]: r for r in quality.op1_quality_rules(spark, write(spark, tmp_path, rows + odd)).collect()}
    assert not any(got[r[0]]["base_failed"] or got[r[0]]["kept"] for r in odd)
    assert all(got[r[0]]["kept"] for r in rows)


def plain_estimate(x):
    """A minimum covariance determinant estimate in plain numpy: exact subsets, no bins."""
    n, p = x.shape
    floors = np.diag([f**2 for f in quality.FLOORS.values()])
    h = int(np.ceil(quality.SHARE * n))

    def moments(rows, factor):
        return rows.mean(0), np.cov(rows.T, bias=True).reshape(p, p) * factor + floors

    def far(e):
        d = x - e[0]
        return np.einsum("ij,ij->i", d @ np.linalg.inv(e[1]), d)

    mid = np.median(x, 0)
    starts = [(mid, np.diag((1.4826 * np.median(np.abs(x - mid), 0)) ** 2) + floors), moments(x, 1.0)]
    found = []
    for e in starts:
        for _ in range(100):
            following = moments(x[np.argsort(far(e), kind="stable")[:h]], quality.consistency(quality.SHARE, p))
            done = np.allclose(following[1], e[1], atol=1e-9)
            e = following
            if done:
                break
        found.append(e)
    best = min(found, key=lambda e: np.linalg.slogdet(e[1])[1])
    inner = x[far(best) <= quality.chi2_quantile(0.975, p)]
    return moments(inner, quality.consistency(0.975, p))


def test_verdicts_match_a_plain_estimate(spark):
    """On rows of several groups, against the estimate without histogram bins."""
    folder = "/root/testdata/sf0.01"
    scratch = Scratch(spark, "t")
    stats = quality.with_statistics(spark.read.parquet(f"{folder}/documents.parquet")).cache()
    rows = quality.with_groups(scratch, stats).select("doc_id", F.replace("grp", F.lit("\x00"), F.lit("/")).alias("grp"), *quality.DIMS).toPandas()
    got = quality.op1_quality_rules(spark, folder).where("not base_failed").toPandas().set_index("doc_id")
    assert rows.grp.nunique() > 3
    same = total = 0
    for _, part in rows.groupby("grp"):
        x = part[quality.DIMS].to_numpy()
        mean, cov = plain_estimate(x)
        d = x - mean
        far = np.einsum("ij,ij->i", d @ np.linalg.inv(cov), d)
        kept = got.loc[part.doc_id, "kept"].to_numpy()
        same += (kept == (far <= quality.chi2_quantile(quality.REJECT, len(quality.DIMS)))).sum()
        total += len(part)
        near = far < 30
        assert np.median(np.abs(got.loc[part.doc_id, "distance"].to_numpy()[near] / far[near] - 1)) < 0.1
    assert same >= 0.99 * total


def test_the_least_rows_of_an_own_group(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randrange(40, 200)), "en", "own" if i < 60 else "few", 1) for i in range(75)] + [(100 + i, sentence(rng, 50), "de", "few", 1) for i in range(3)]
    df = spark.read.parquet(f"{write(spark, tmp_path, rows)}/documents.parquet")
    names = lambda **kind: {r["doc_id"]: r["grp"] for r in quality.quality(spark, df, **kind).collect()}
    got = names()
    assert set(got.values()) == {"s/en/own", "all"} and got[0] == "s/en/own" and got[70] == got[101] == "all"
    assert set(names(least_rows=10).values()) == {"s/en/own", "s/en/few", "all"}
