"""Decontamination against a dictionary of all windows."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import decontam

from .helpers import edge_rows, frame, sentence, write

ITEMS = "item_id long, text string"
COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def collected(df):
    assert df.columns[:6] == COLUMNS
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


def planted(rng):
    shared = sentence(rng, 12)
    items = [(i, sentence(rng, rng.randrange(8, 40))) for i in range(25)]
    items += [(100, None), (101, " .,! "), (102, "unusual"), (103, "two unusual"), (104, "É wide text here"), (105, items[0][1]), (106, items[1][1].upper()), (None, sentence(rng, 15)), (107, "a b a b a b a b a b a b a b")]
    items += [(200 + i, f"{shared} {sentence(rng, 4)}") for i in range(30)] + [(7, sentence(rng, 11))]
    docs = [(r[0], r[1]) for r in edge_rows() if r[0] != 15]
    for k in range(80):
        words = sentence(rng, rng.randrange(1, 60)).split()
        if k % 2:
            cut = rng.choice(items)[1] or ""
            cut = cut.split()[rng.randrange(3) :]
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.title() if rng.random() < 0.2 else w for w in cut]
        if k % 5 == 0:
            words += ["Unusual,", *shared.split(), "a", "b"] * rng.randrange(1, 3)
        docs.append((100 + k, rng.choice([" ", "-", "\n"]).join(words)))
    docs += [docs[-1], (None, shared), (500, shared), (501, f"É, wide; TEXT here/{shared}"), (502, "a b " * 30)]
    return docs, items


def test_whole_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(decontam, "HOT", 15)
    docs, items = planted(random.Random(1))
    folder = write(spark, tmp_path, [(*d, "en", "s", 1) for d in docs])
    write(spark, tmp_path, items, "benchmark", ITEMS)
    want = sorted(decontam.brute_force(docs, items), key=repr)
    assert collected(decontam.op13_decontamination(spark, folder)) == want
    assert 30 < sum(w[5] for w in want) < len(want) and max(w[3] for w in want) > 30


def test_generated_tables(spark, sf):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert collected(decontam.op13_decontamination(spark, sf)) == sorted(decontam.brute_force(docs, items), key=repr)


def test_filters_that_say_yes_too_often_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BITS", 10)
    docs, items = planted(random.Random(2))
    got = decontam.contaminated(spark, frame(spark, [(*d, "en", "s", 1) for d in docs]), spark.createDataFrame(items, ITEMS))
    want = {(w[0], *w[1:4]) for w in decontam.brute_force(docs, items)}
    assert {tuple(r)[:4] for r in got.collect()} == want


def test_empty_tables(spark):
    docs, items = frame(spark, [(1, "some words", "en", "s", 1)]), spark.createDataFrame([(1, "some words")], ITEMS)
    assert decontam.contaminated(spark, docs.limit(0), items).count() == 0
    assert [tuple(r) for r in decontam.contaminated(spark, docs, items.limit(0)).collect()] == [(1, 2, 0, 0, "", False)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("aB1é .", max_size=30), min_size=1, max_size=4), st.integers(2, 40))
def test_words_of_texts_in_slices(texts, size):
    old, decontam.SLICE = decontam.SLICE, size
    try:
        words = decontam.Words()
        seen = {}
        for t in texts:
            b = t.encode()
            start, end, mark = words.of(b)
            said = [b[a:z].lower() for a, z in zip(start, end, strict=True)]
            assert said == [w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", b.lower().decode())]
            # a word's hash is the same wherever it stands
            for w, m in zip(said, mark.tolist(), strict=True):
                assert seen.setdefault(w, m) == m
    finally:
        decontam.SLICE = old


def test_a_word_longer_than_slices(monkeypatch):
    monkeypatch.setattr(decontam, "SLICE", 8)
    words = decontam.Words()
    start, end, _ = words.of(b"x" * 100 + b" y")
    assert start.tolist() == [0, 101] and end.tolist() == [100, 102]
    assert np.diff(start).tolist() == [101]
