"""The conversation trie against whole prefixes in memory."""

import random

import pytest

from ledgerloom.llm import convtrie

from .helpers import write

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def collected(df):
    assert df.columns[:8] == COLUMNS
    return sorted((tuple(r)[:8] for r in df.collect()), key=repr)


def talks(rng, n):
    said = ["hello", "yes", "no", "what is é?", "", None]
    rows = []
    for c in range(n):
        if c % 11 == 4:
            continue  # absent, sometimes a base
        for t in range(rng.randrange(1, 13)):
            rows.append((c, t, rng.choice(["user", "assistant", None]) if t > 2 else "user", rng.choice(said) if t else "hello"))
    return rows


EDGES = [
    (1000, None, "system", "first"), (1000, 5, "user", "later"), (1000, 5, "user", "later"), (1000, 5, "assistant", "later"), (1003, 0, None, None),
    (None, 1, "user", "nobody"), (-7, 1, "user", "below zero"), (-5, 1, "user", "base below zero"), (1001, 0, "user", "x" * 300_000), (1002, 0, "user", "x" * 300_000),
]


def test_whole_table(spark, tmp_path):
    rows = talks(random.Random(1), 150) + EDGES + [(2000, t, "user", str(t % 3)) for t in range(700)] + [(2005 + 5 * k, t, "user", str(t % 3)) for k in range(4) for t in range(100 * k + 90)]
    got = convtrie.op11_conversation_trie(spark, write(spark, tmp_path, rows, "conversations", TURNS))
    assert collected(got) == sorted(convtrie.brute_force(rows), key=repr)


def test_generated_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(convtrie.op11_conversation_trie(spark, sf)) == sorted(convtrie.brute_force(rows), key=repr)


@pytest.mark.parametrize("bits", [3, 0])
def test_fingerprints_that_collide_are_split_by_turns(spark, bits):
    rows = talks(random.Random(2), 40)
    df = spark.createDataFrame(rows, TURNS)
    assert collected(convtrie.prefix_trie(spark, df, convtrie.FIVES, bits=bits)) == sorted(convtrie.brute_force(rows), key=repr)


def test_many_copies_and_blocks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "ENDS", 16)
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    got = collected(convtrie.prefix_trie(spark, spark.createDataFrame(rows, TURNS), convtrie.FIVES))
    assert got == sorted(convtrie.brute_force(rows), key=repr) and len(got) == 4


def test_long_conversations_pass_in_parts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    turns = [(0, 0, "user", f"t{t % 5}") for t in range(50)] + [(1, 1, "user", f"t{t % 5}") for t in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*turns, strict=True)], names=["base", "conv_id", "role", "text"])
    whole = pa.Table.from_batches(convtrie._scan(None, 64)(iter([batch])))
    monkeypatch.setattr(convtrie, "ROWS", 7)
    parts = pa.Table.from_batches(convtrie._scan(None, 64)(iter([batch.slice(0, 33), batch.slice(33)])))
    assert whole.equals(parts.combine_chunks().cast(whole.schema)) and parts.num_rows == 82
    prints = whole.column("print").to_numpy()
    assert (prints[:31] == prints[51:82]).all() and len(np.unique(prints)) == 51


def test_no_conversation(spark):
    assert convtrie.prefix_trie(spark, spark.createDataFrame([], TURNS), convtrie.FIVES).count() == 0
