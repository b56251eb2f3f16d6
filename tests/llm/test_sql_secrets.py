"""The SQL twin of the secret scan, on tables with edge rows and on the generated ones."""

import random

from . import test_sql
from .helpers import edge_rows, write
from .test_secrets import secret_rows


def test_secrets(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setitem(test_sql.TABLE, "op8_secret_scans", "documents")
    assert len(test_sql.same(spark, sf, "op8_secret_scans"))
    rng = random.Random(3)
    mixed = [(500 + i, " ".join(rng.choice([t for _, t, *_ in secret_rows()]) for _ in range(4)), "en", "s", 1) for i in range(60)]
    got = test_sql.same(spark, write(spark, tmp_path, edge_rows() + secret_rows() + mixed), "op8_secret_scans")
    assert got.spans.str.contains("entropy").sum() > 20 and got.n_hex.sum() > 10
