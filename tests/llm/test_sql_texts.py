"""SQL of the trie, the spelling variants and the decontamination, held against brute force."""

import random

import duckdb

from ledgerloom.llm import convtrie, decontam, spelling, sql

from .helpers import edge_rows
from .test_convtrie import EDGES, talks
from .test_decontam import planted
from .test_spelling import variants


def answers(name, **tables):
    c = duckdb.connect()
    for table, (kinds, rows) in tables.items():
        c.execute(f"CREATE TABLE {table} ({kinds})")
        c.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return sorted(c.execute(sql.oracle_sql()[name]).fetchall(), key=repr)


def test_trie():
    rows = talks(random.Random(5), 60) + EDGES
    got = answers("op11_conversation_trie", conversations=("conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR", rows))
    assert got == sorted(convtrie.brute_force(rows), key=repr)


def test_spelling():
    words = variants(random.Random(6), 100)
    rows = [(i, " ".join(words[i::40])) for i in range(40)] + [(100 + r[0], r[1]) for r in edge_rows() if r[0] != 15]
    got = answers("op12_spelling_variants", documents=("doc_id BIGINT, text VARCHAR", rows))
    assert got == sorted(spelling.brute_force(rows), key=repr) and len(got) > 100


def test_decontamination():
    docs, items = planted(random.Random(7))
    got = answers("op13_decontamination", documents=("doc_id BIGINT, text VARCHAR", docs), benchmark=("item_id BIGINT, text VARCHAR", items))
    assert got == sorted(decontam.brute_force(docs, items), key=repr)
