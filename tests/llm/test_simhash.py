import random

import numpy as np
import xxhash

from ledgerloom.llm import simhash
from ledgerloom.llm.common import Scratch
from ledgerloom.llm.components import connected_components

from .helpers import edge_rows, frame, sentence, write


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, bits=3):
    ids = sorted(prints)
    low = {i: i for i in ids}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {i: root(i) for i in ids}


def check(df, rows):
    prints = {i: plain_fingerprint(t) for i, t in rows}
    low = plain_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in df.collect()}
    assert got == {i: (f"{prints[i]:016x}", low[i]) for i in prints}


def test_edge_rows(spark, tmp_path):
    rows = edge_rows()
    check(simhash.op9_simhash_near_dedup(spark, write(spark, tmp_path, rows)), [(r[0], r[1]) for r in rows])


def test_generated_corpus(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(simhash.op9_simhash_near_dedup(spark, sf), [(r[0], r[1]) for r in rows])


def test_empty_null_and_repeated_ids(spark, tmp_path):
    assert simhash.op9_simhash_near_dedup(spark, write(spark, tmp_path, [])).count() == 0
    rows = [(None, "a b c d", "en", "s", 1), (4, "a b c d", "en", "s", 1), (4, "a b c d", "en", "s", 1), (None, "only here", "en", "s", 1)]
    got = simhash.op9_simhash_near_dedup(spark, write(spark, tmp_path / "b", rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]


def test_trie_join_of_a_dense_cluster(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre, 0, (1 << 64) - 1}
    for _ in range(600):
        x = rng.choice(list(values)) if rng.random() < 0.5 else centre
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        values.add(x)
    values |= {rng.getrandbits(64) for _ in range(300)}
    values = sorted(values)
    prints = dict(enumerate(values))
    want = {i: c for i, c in plain_components(prints).items() if c != i}
    rows = [(v - (1 << 64) if v >> 63 else v, i) for i, v in prints.items()]
    df = spark.createDataFrame(rows, "fingerprint long, node long")
    for chunk in (20_000, 50):  # the second splits hot keys into pairs of chunks
        edges = simhash.near_fingerprints(df, chunk=chunk)
        got = {r["node"]: r["component"] for r in connected_components(edges, Scratch(spark, "t")).collect()}
        assert got == want


def test_components_of_long_chains(spark):
    rng = np.random.default_rng(3)
    n = 3000
    order = rng.permutation(n)
    rows = [(int(order[i]), int(order[i + 1])) for i in range(n - 1) if i % 1000 != 999]
    df = spark.createDataFrame(rows, "a long, b long").repartition(16)
    got = {r["node"]: r["component"] for r in connected_components(df, Scratch(spark, "t")).collect()}
    for k in range(3):
        part = order[k * 1000 : (k + 1) * 1000]
        assert all(got.get(int(x), int(x)) == part.min() for x in part)


def test_stage_keeps_one_of_each_group(spark):
    a = sentence(random.Random(1), 200)
    rows = [(5, a, "en", "s", 1), (2, a, "en", "s", 1), (2, a, "en", "t", 1), (9, "different words here", "en", "s", 1), (None, a, "en", "s", 1)]
    docs = frame(spark, rows)
    out = simhash.keep_one(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["2", "9", "None"]
