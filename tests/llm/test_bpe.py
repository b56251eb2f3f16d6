import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from ledgerloom.llm import bpe

from .helpers import edge_rows, sentence, write


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))


def check(df, rows, ranks):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: tuple(r)[1:] for r in df.collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        assert got[i] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())), (i, t and t[:80])
    assert len(got) == len(rows)


def test_edge_rows(spark, tmp_path, ranks):
    rng = random.Random(3)
    rows = edge_rows()
    letters = "abcdefgh éüñçß 中文字 😀 ١٢ \t\n\r\x0b\x1c\x85\xa0  '’#$--"
    rows += [(100 + i, "".join(rng.choice(letters) for _ in range(300)), "en", "s", 300) for i in range(20)]
    rows += [(200, " " * 300 + "x" + "\n" * 77, "en", "s", 1), (201, "-" * 400 + "=" * 90, "en", "s", 1), (202, "they'll I'VE we've it's 's", "en", "s", 1)]
    rows += [(203, "".join(chr(97 + (i * 7) % 26) for i in range(700)), "en", "s", 1), (204, "internationalization " * 20, "en", "s", 1)]
    check(bpe.op3_byte_bpe(spark, write(spark, tmp_path, rows)), [(r[0], r[1]) for r in rows], ranks)


def test_generated_corpus(spark, sf, ranks):
    check(bpe.op3_byte_bpe(spark, sf), [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()], ranks)


def test_bound_on_remembered_words_changes_nothing(spark, ranks):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, sentence(rng, 50)) for i in range(20)], "doc_id long, text string")
    few = {r["doc_id"]: r["ids"] for r in bpe.encode(spark, df, ranks, P.PATTERN, frequent=5).collect()}
    assert few == {r["doc_id"]: r["ids"] for r in bpe.encode(spark, df, ranks, P.PATTERN).collect()}


def test_pair_table_holds_every_pair(ranks):
    v = bpe.Vocabulary(ranks)
    rng = random.Random(0)
    for token in rng.sample(sorted(ranks, key=len), 2000):
        for k in range(1, len(token)):
            if token[:k] in ranks and token[k:] in ranks:
                key = ranks[token[:k]] << 17 | ranks[token[k:]]
                slot = key << 17 | ranks[token]
                assert slot in (v.slots[key * bpe._A % bpe._P % bpe.PLACES], v.slots[key * bpe._B % bpe._Q % bpe.PLACES])


def test_odd_tokens_are_whole_words(spark, ranks):
    odd = dict(ranks)
    odd["zqxj".encode()] = max(ranks.values()) + 1  # no merge leads to it
    df = spark.createDataFrame([(1, "zqxj zqxj"), (2, "zqxj")], "doc_id long, text string")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=odd, special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(spark, df, odd, P.PATTERN).collect()}
    assert got == {1: own.encode_ordinary("zqxj zqxj"), 2: own.encode_ordinary("zqxj")}


def test_empty_and_repeated(spark, tmp_path):
    assert bpe.op3_byte_bpe(spark, write(spark, tmp_path, [])).count() == 0
    rows = [(1, "same", "en", "s", 1)] * 2 + [(None, None, None, None, None)]
    assert sorted(r["n_tokens"] for r in bpe.op3_byte_bpe(spark, write(spark, tmp_path / "b", rows)).collect()) == [0, 1, 1]


def test_long_words_by_heap(spark, tmp_path, ranks):
    rng = random.Random(5)
    v = bpe.Vocabulary(ranks)
    look = lambda a, b: v.pairs.get(a << 17 | b, bpe.NEVER)
    for n in (1, 2, 30, 200):
        for letters in ("ab", "etaoin shrdlu", "".join(map(chr, range(97, 123)))):
            ids = [v.byte_ids[b] for b in "".join(rng.choice(letters) for _ in range(n)).encode()]
            assert bpe.merge_long(ids, look) == bpe.merge(ids, look)
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000)), "a" * 300_000, "中文字" * 20_000, "-" * 100_000 + " " * 100_000]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    check(bpe.op3_byte_bpe(spark, write(spark, tmp_path, rows)), [(r[0], r[1]) for r in rows], ranks)


def test_batches_and_clashing_columns(spark, ranks):
    rng = random.Random(6)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i % 50, sentence(rng, rng.randrange(60)) if i % 9 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "'y' as batch", "map(doc_id, text) as __0", "2 as decoded")
    got = bpe.encode(spark, df, ranks, P.PATTERN, batch_bytes=2000)
    assert got.columns == ["doc_id", "text", "batch", "__0", "decoded", "ids"]
    found = bpe.decode(spark, got, ranks)
    assert found.columns == ["doc_id", "text", "batch", "__0", "ids", "decoded"]
    want = sorted((i, t or "", own.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((r["doc_id"], r["text"] or "", r["ids"]) for r in found.collect()) == want
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") and r["batch"] == "y" for r in found.collect())


def test_white_space_is_that_of_the_pattern():
    import regex

    space = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    assert {c for c in range(0x110000) if regex.match(r"\s", chr(c))} == space
