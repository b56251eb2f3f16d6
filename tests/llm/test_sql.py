"""The SQL twins against their queries, on small tables with edge rows and on the generated ones."""

import random

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import queries

from ..test_oracle import rows
from .helpers import edge_rows, sentence, write

TABLE = {"op4_url_filters": "pages", "op7_suffix_array_dedup": "documents", "op10_embedding_near_dedup": "embeddings"}


def same(spark, folder, name):
    c = duckdb.connect()
    source = f"{folder}/{TABLE[name]}.parquet"
    c.execute(f"CREATE VIEW {TABLE[name]} AS SELECT * FROM '{source}{'/*.parquet' if not str(folder).startswith('/root/testdata') else ''}'")
    got, want = queries.queries()[name](spark, folder).toPandas(), c.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return want


@pytest.mark.parametrize("name", list(TABLE))
def test_generated_tables(spark, sf, name):
    assert len(same(spark, sf, name))


def test_repeats_of_edge_rows(spark, tmp_path):
    rng = random.Random(4)
    shared = [sentence(rng, 30) for _ in range(4)]
    more = [(100 + i, f"{sentence(rng, 20)} {rng.choice(shared)} {sentence(rng, 3)} {rng.choice(shared)}", "en", "s", 1) for i in range(40)]
    assert same(spark, write(spark, tmp_path, [r for r in edge_rows() if r[0] != 15] + more), "op7_suffix_array_dedup").n_spans.sum() > 30


def test_links_of_planted_vectors(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 16))
    made = [(i, (centres[i % 6] + rng.normal(size=16) * (0.02 if i % 4 else 0.4)).astype("float32").tolist(), [1, 1, 2, None][i % 4]) for i in range(160)]
    made += [(200, None, 1), (201, [], 1), (202, [0.0] * 16, 1), (203, [float("nan")] * 16, 1), (204, [None] + [1.0] * 15, 1), (205, made[0][1], 1)]
    folder = write(spark, tmp_path, made, "embeddings", "vec_id long, embedding array<float>, label int")
    assert same(spark, folder, "op10_embedding_near_dedup").n_links.sum() > 500


def test_scores_of_linked_hosts(spark, tmp_path):
    rng = random.Random(8)
    hosts = ["a.com", "b.net", "Example.com", "example.net", "x.example.com", "c.org", "plain.io", "other.io", "third.io"]
    paths = ["/en/1", "/en/7", "/de/8", "/de/2", "/es/3", "/", ""]
    made = [(i, f"https://{rng.choice(hosts)}{rng.choice(paths)}?q#f", "".join(f'<a href="http://{rng.choice(hosts)}:80/x">y</a>' for _ in range(rng.randrange(5)))) for i in range(300)]
    made += [(800 + i, "http://good.example.com/en/70", f"<a href='//{rng.choice(hosts)}/'>") for i in range(9)]
    made += [(850 + i, "http://bad.net/de/1", "") for i in range(9)] + [(880, "http://plain.io/", "<a href='http://bad.net'>")]
    made += [(900, None, None), (901, "no scheme", "<a href=/b>"), (902, "http://", ""), (903, "x://A.COM", None)]
    made += [(910 + i, f"http://{h}/de/1", "<a href='https://third.io/'><a href='//u@plain.io:9/'>") for i, h in enumerate(["b.net:80", "u@other.io", "third.io:8080", "u:p@third.io:1", ":80"])]
    got = same(spark, write(spark, tmp_path, made, "pages", "page_id long, url string, html string"), "op4_url_filters")
    assert (got.trust > 0).any() and (got.distrust > 0).any()
