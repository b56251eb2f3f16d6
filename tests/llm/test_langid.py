import random
import zlib

import numpy as np

from ledgerloom.llm import langid

from .helpers import edge_rows, frame, write


def test_features_are_per_text():
    texts = ["Hello world", "", "été à la plage", "12 ## 34", "x" * 300_000, "the end"]
    whole = langid.features(texts)
    for k, t in enumerate(texts):
        assert np.allclose(whole[k], langid.features([t])[0])
    assert not whole[1].any() and not whole[3].any()


def test_svm_separates_and_balances():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.standard_normal((400, 5)) + 2, rng.standard_normal((20, 5)) - 2]).astype(np.float32)
    y = np.array([1.0] * 400 + [-1.0] * 20)
    w = langid.linear_svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op2_language_id(spark, sf)
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(lang, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    test = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert len(test) > 150 and np.mean([r["lang_pred"] == r["lang"] for r in test]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_inputs_are_text_alone(spark, tmp_path):
    rng = random.Random(1)
    words = {"en": "the of and with house tree", "de": "der und nicht haus baum schön", "fr": "le et une maison arbre été", "es": "el y una casa árbol año"}
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(30)), k, "s", 1) for i, k in enumerate(list(words) * 40)]
    asked = [(1000 + i, r[1], None, None, None) for i, r in enumerate(rows[:40])] + [(5000, None, "en", "s", 1), (5001, "", "en", "s", 1), (5002, "123 #", "en", "s", 1)]
    got = {r["doc_id"]: r for r in langid.op2_language_id(spark, write(spark, tmp_path, rows + asked)).collect()}
    assert all(got[a[0]]["lang_pred"] == rows[a[0] - 1000][2] for a in asked[:40])
    assert all((got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0) for k in (5000, 5001, 5002))


def test_without_labels_and_empty(spark, tmp_path):
    assert langid.op2_language_id(spark, write(spark, tmp_path, [])).count() == 0
    rows = [(r[0], r[1], None, None, None) for r in edge_rows()] + [(None, "text", None, None, None)] * 2
    got = langid.op2_language_id(spark, write(spark, tmp_path / "b", rows)).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} == {"und"}
    one = [(i, "some words here", "xx", "s", 1) for i in range(40)]
    assert {r["lang_pred"] for r in langid.op2_language_id(spark, write(spark, tmp_path / "c", one)).collect()} == {"xx"}


def test_stage_keeps_columns_and_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = docs.unionByName(frame(spark, [(90_001, "123 456", "en", "s", 7), (90_002, None, None, None, None)]))
    out = langid.known_language(spark, more, "")
    assert out.columns == docs.columns
    left = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert not left & {90_001, 90_002} and len(left) > 0.97 * docs.count()


def test_votes_by_hand(spark):
    """Predictions of whole documents against plain counting with the same weights."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.with_language(spark, docs, model).collect()}

    def winner(machine, x):
        votes, total = dict.fromkeys(range(len(machine.classes)), 0), dict.fromkeys(range(len(machine.classes)), 0.0)
        for (i, j), w in zip(machine.pairs, machine.weights.T, strict=True):
            m = float(x @ w[:-1] + w[-1])
            votes[i] += m > 0
            votes[j] += m < 0
            total[i] += m
            total[j] -= m
        return machine.classes[max(votes, key=lambda c: (votes[c], total[c], -c))]

    n = 0
    for r in docs.select("doc_id", "text").collect():
        if any(c.isalpha() for c in r["text"] or ""):
            x = langid.features([r["text"]])[0]
            assert got[r["doc_id"]] == winner(model.within[winner(model.family, x)], x)
            n += 1
        else:
            assert got[r["doc_id"]] == "und"
    assert n > 150 and len(model.family.classes) > 1


def test_slices_of_a_long_text(monkeypatch):
    text = "Der schnelle Fuchs springt; le renard saute 12 fois. " * 40
    whole = langid.features([text, "x y z", text[:7]])
    monkeypatch.setattr(langid, "SLICE", 37)
    assert np.allclose(langid.features([text, "x y z", text[:7]]), whole, atol=1e-6)


def test_rows_that_share_a_doc_id_are_bounded(spark):
    """However many rows have one doc_id or none, a language sends a fixed number to the driver."""
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(one, f"the words of row {i}", "en", "s", 1) for i in range(20_000)] + [(None, f"les mots du rang {i}", "fr", "s", 1) for i in range(3000)]
    rows += [(1000 + i, f"die Worte der Zeile {i}", "de", "s", 1) for i in range(3000)]
    docs = frame(spark, rows)
    got = {r["lang"]: r["count"] for r in langid.chosen(docs, 50).groupBy("lang").count().collect()}
    assert set(got) == {"en", "fr", "de"} and max(got.values()) == 50 and got["en"] == 50
    assert "WindowGroupLimit" in langid.chosen(docs, 50)._jdf.queryExecution().executedPlan().toString()
    assert langid.fit(docs, 50) is not None and langid.chosen(docs.limit(0), 50) is None
