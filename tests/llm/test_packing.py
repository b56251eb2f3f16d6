import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing

from .helpers import edge_rows, write


def check(spark, folder, rows):
    encoder = Tokenizer.from_file(packing._path())
    encoder.encode_special_tokens = True
    got = packing.op5_best_fit_packing(spark, folder).collect()
    pieces = {(r["doc_id"], r["piece"]): r for r in got}
    assert len(pieces) == len(got)
    want = {}
    for i, t in rows:
        ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, k] = (at, len(part), zlib.crc32(part.tobytes()))
    assert {k: (r["start"], r["length"], r["ids_crc32"]) for k, r in pieces.items()} == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 4096) + 1
    return bins


def test_edge_rows(spark, tmp_path):
    rows = edge_rows()
    check(spark, write(spark, tmp_path, rows), [(r[0], r[1]) for r in rows])


def test_generated_corpus(spark, sf):
    check(spark, sf, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


def test_empty_and_repeated(spark, tmp_path):
    assert packing.op5_best_fit_packing(spark, write(spark, tmp_path, [])).count() == 0
    rows = [(1, "same text", "en", "s", 1)] * 3 + [(None, None, None, None, None)]
    got = packing.op5_best_fit_packing(spark, write(spark, tmp_path / "b", rows)).collect()
    assert len(got) == 4 and len({(r["sequence_id"], r["offset"]) for r in got}) == 4


def test_forgetting_words_changes_nothing():
    data = open(packing._path(), "rb").read()
    words = packing.Words(data, limit=5)
    fresh = packing.Words(data)
    rng = random.Random(0)
    for _ in range(20):
        t = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(30))]
        assert words.encode(t) == fresh.encode(t)


@pytest.mark.parametrize("seed", range(20))
def test_fullest_is_the_best_subset(seed):
    rng = random.Random(seed)
    items = sorted((rng.randrange(1, 40) for _ in range(9)), reverse=True)
    room = rng.randrange(1, 120)
    counts = {k: items.count(k) for k in items}
    used = packing.fullest(sorted(counts.items(), reverse=True), room)
    assert all(m <= counts[k] for k, m in used)
    best = max(sum(c) for n in range(10) for c in itertools.combinations(items, n) if sum(c) <= room)
    assert sum(k * m for k, m in used) == best


def test_patterns_use_every_piece_once():
    rng = random.Random(1)
    counts = {rng.randrange(1, 4097): rng.randrange(1, 2000) for _ in range(1500)}
    left = dict(counts)
    plan = packing.slack_patterns(counts)
    for bins, use in plan:
        assert sum(k * m for k, m in use) <= 4096
        for k, m in use:
            left[k] -= bins * m
    assert not any(left.values())
    total = sum(k * v for k, v in counts.items())
    assert sum(b for b, _ in plan) <= 1.02 * total / 4096 + 1 or max(counts) > 2048


def test_words_of_letters_are_encoded_as_the_tokenizer_does():
    data = open(packing._path(), "rb").read()
    ranks = packing.letter_ranks(data)
    assert len(ranks) > 40_000 and packing.letter_ranks(data.replace(b'"NFC"', b'"NFD"')) == {}
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFÀÉÖßÿñçÝÞµªº÷×'\"!-.9\x0b\x0c\x85 ́ΣſK"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(20_000)}
    words |= {c * n for c in "aéZß" for n in range(1, 200)} | {"<|endoftext|>", "it's", "l'été,", "Über...", "the"}
    for code in range(0x100):
        words |= {chr(code), f"a{chr(code)}", f"{chr(code)}b!"} if chr(code) not in " \t\r\n" else set()
    quick, plain = packing.Words(data, ranks=ranks), packing.Words(data)
    quick.learn(words)
    plain.learn(words)
    assert quick == plain
