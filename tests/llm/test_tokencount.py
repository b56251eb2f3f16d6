import random

import pytest
from tokenizers import Tokenizer, models

from ledgerloom.llm import tokencount

from .helpers import edge_rows, sentence, write


@pytest.fixture(scope="module")
def model():
    return open(tokencount._path(), "rb").read()


@pytest.fixture(scope="module")
def reference(model):
    pieces, _ = tokencount.vocabulary(model)
    vocab = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *pieces]
    # Byte pieces are no text: a score below all keeps them out, as their type does in the model.
    worst = min(s for _, s in pieces)
    vocab = [(p, s if k > 256 else worst) for k, (p, s) in enumerate(vocab)]
    unigram = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    return lambda t: len(unigram.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0


def test_edge_rows(spark, tmp_path, reference):
    rng = random.Random(5)
    rows = [r for r in edge_rows() if not r[1] or len(r[1]) < 20_000]
    letters = "abcde  \n\n.,▁éß中😀"
    rows += [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(80))), "en", "s", 1) for i in range(60)]
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.op6_token_counts(spark, write(spark, tmp_path, rows)).collect()}
    assert got == {r[0]: reference(r[1] or "") for r in rows}


def test_generated_corpus(spark, sf, reference):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.op6_token_counts(spark, sf).collect()}
    assert got == {i: reference(t or "") for i, t in rows}


def test_segments_and_memory_change_nothing(model):
    whole = tokencount.PieceCounter(model)
    small = tokencount.PieceCounter(model, limit=3)
    text = sentence(random.Random(1), 400) + "\n\n  tail  "
    normal = tokencount.SPACE + text.replace(" ", tokencount.SPACE)
    assert small.count(text) == whole.count(text) == whole.pieces(normal)


def test_ties_keep_the_piece_that_begins_first(model):
    c = tokencount.PieceCounter(model)
    import ahocorasick

    c.automaton = ahocorasick.Automaton()
    for p, s in {"a": -1.0, "b": -1.0, "ab": -2.0, "c": -1.0, "bc": -2.0, "abc": -9.0}.items():
        c.automaton.add_word(p, (len(p), s))
    c.automaton.make_automaton()
    c.single = set("abc")
    # ab: one piece of -2 begins before b of -1 + -1; abc: bc from 1 begins before c from 2.
    assert c.pieces("ab") == 1 and c.pieces("abc") == 2


def test_empty_and_repeated(spark, tmp_path):
    assert tokencount.op6_token_counts(spark, write(spark, tmp_path, [])).count() == 0
    rows = [(1, "same", "en", "s", 1)] * 2 + [(None, None, None, None, None)]
    got = sorted(r["n_tokens"] for r in tokencount.op6_token_counts(spark, write(spark, tmp_path / "b", rows)).collect())
    assert got[0] == 0 and got[1] == got[2] > 0
