"""Spelling variants against a comparison of all words."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import spelling

from .helpers import edge_rows, frame, write


def collected(df):
    assert df.columns[:6] == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


def variants(rng, n):
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(5, 9))) for _ in range(n)]
    out = []
    for w in base:
        out += [w] * rng.choice([3, 8, 20, 50])
        for _ in range(3):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdéÉ") + w[i + 1 :], w[:i] + rng.choice("abÿ") + w[i:]])
            out += [v] * rng.choice([1, 3, 4, 7])
    rng.shuffle(out)
    return out


def test_whole_table(spark, tmp_path):
    rng = random.Random(1)
    words = variants(rng, 120)
    rows = [(i, " ".join(words[i::40]), "en", "s", 1) for i in range(40)]
    rows += [(100 + r[0], *r[1:]) for r in edge_rows() if r[0] != 15] + [(7, "Seven seven SEVEN sevem", "en", "s", 1)] * 3 + [(None, "nobody nobody nobody nobodx nobodx nobodx", None, None, None)]
    got = spelling.op12_spelling_variants(spark, write(spark, tmp_path, rows))
    want = sorted(spelling.brute_force([(r[0], r[1]) for r in rows]), key=repr)
    assert collected(got) == want
    assert sum(w[1] is not None for w in want) > 50 and any(w[1] != w[2] and w[1] for w in want)


def test_generated_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = spelling.brute_force([tuple(r) for r in docs.collect()])
    assert collected(spelling.op12_spelling_variants(spark, sf)) == sorted(want, key=repr)


@pytest.mark.parametrize("bits", [64, 6, 0])
def test_keys_that_collide_are_split_by_strings(spark, bits):
    rng = random.Random(2)
    counts = {w: rng.randrange(3, 90) for w in variants(rng, 25)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    text = " ".join(w for w, n in counts.items() for _ in range(n))
    plain = {w[0]: w for w in spelling.brute_force([(1, text)])}
    if any(w not in plain for w in counts):  # noise of the contract: compare with itself at full width
        assert collected(spelling.spelling_variants(spark, df, bits=bits)) == collected(spelling.spelling_variants(spark, df))
    else:
        assert collected(spelling.spelling_variants(spark, df, bits=bits)) == sorted(plain.values(), key=repr)


def test_a_chain_of_forms_ends_at_its_root(spark):
    steps = ["a" * 5 + "b" * k for k in range(12)]
    df = spark.createDataFrame([(w, 2**k) for k, w in enumerate(steps)], "word string, n long")
    got = {r["word"]: r for r in spelling.spelling_variants(spark, df).collect()}
    assert all(got[w]["root"] == steps[-1] for w in steps) and got[steps[0]]["form"] == steps[1] and got[steps[-1]]["form"] is None


def test_very_long_words_and_none(spark):
    long = "".join(random.Random(3).choice("abcdef") for _ in range(50_000))
    df = spark.createDataFrame([(long, 9), (long[:777] + "z" + long[778:], 4), (long[:-1], 3), ("other", 3), (None, 5)], "word string, n long")
    got = {r["word"]: r for r in spelling.spelling_variants(spark, df).collect()}
    assert got[long]["n_near"] == 2 and got[long[:-1]]["form"] == long and got["other"]["n_near"] == 0 and len(got) == 4
    assert spelling.spelling_variants(spark, df.limit(0)).count() == 0


def test_no_document(spark):
    assert spelling.word_counts(frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé", max_size=7), min_size=1, max_size=12))
def test_keys_are_those_of_the_strings_left(words):
    word, pos, key = spelling.deletion_keys(words)
    rest = [words[w] if p < 0 else words[w][:p] + words[w][p + 1 :] for w, p in zip(word, pos, strict=True)]
    assert len(rest) == sum(len(w) + 1 for w in words)
    by = {}
    for r, k in zip(rest, key.tolist(), strict=True):
        assert by.setdefault(r, k) == k
    assert len(set(by.values())) == len(by) and key.dtype == np.int64
