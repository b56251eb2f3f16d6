import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.llm import secrets_scan as ss

from .helpers import DOCS, edge_rows, frame, write

ASSIGN = re.compile(r"""(?:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def entropy(text):
    for m in re.finditer(ss.CANDIDATE, text):
        c = m[0]
        if any(re.search(p, c) for p in ss.ALLOWED):
            continue
        least = ss.LEAST_BITS["hex" if re.fullmatch("[0-9A-Fa-f]+", c) else "word"]
        hits = []
        for i in range(len(c) - ss.WINDOW + 1):
            n = Counter(c[i : i + ss.WINDOW])
            if round(-sum(v / ss.WINDOW * math.log2(v / ss.WINDOW) for v in n.values()), 9) >= least:
                hits.append(i)
        if hits:
            yield m.start() + hits[0], 3, m.start() + hits[-1] + ss.WINDOW


def written(spans):
    return ",".join(f"{ss.KINDS[k]}:{a}:{z}" for a, k, z in spans)


def check(df, rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in df.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()}
    want = {}
    for i, t in rows:
        b = base(t or "")
        extra = [s for s in entropy(t or "") if not any(x[0] <= s[0] and s[2] <= x[2] for x in b)]
        want[i] = (*(sum(s[1] == k for s in b) for k in range(3)), hashlib.sha256(written(b).encode()).hexdigest(), written(sorted(b + extra)))
    assert got == want
    return want


def secret_rows():
    rng = random.Random(4)
    word = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    hexes, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [
        "password = 'abc123' token:x secret=token: abcdefg", "é😀 PassWord: hunter22222 API_KEY=\"zz.zz-zz\" apikey:123456", "ſecret=abcdefgh toKen=abcdefgh",
        f"AKIA{word(16, 'ABCDEF0123')} AKIA123 AKIAAKIA{word(20, 'ABC')}", f"{word(24, hexes)} {word(23, hexes)} x{word(40, hexes)}x",
        f"key {word(40, b64)} and {word(64, b64)}==", "a" * 30 + "1", "550e8400-e29b-41d4-a716-446655440000", "sha256-" + word(44, b64),
        "Example" + word(30, b64), "path/to/some/long/file-name/2024/index", word(60, "AB1"), word(300, b64), "secret=" * 50 + "abcdefg",
        f"{word(32, '0123456789ABCDEF')}", " ".join(f"token={word(12, b64)}" for _ in range(40)),
    ]
    return [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)]


def test_spans_match_brute_force(spark, tmp_path):
    rows = edge_rows() + secret_rows()
    want = check(ss.op8_secret_scans(spark, write(spark, tmp_path, rows)), [(r[0], r[1]) for r in rows])
    assert "entropy:" in want[105][4] and "entropy" not in want[107][4] and "entropy" not in want[110][4]


def test_generated_corpus(spark, sf):
    check(ss.op8_secret_scans(spark, sf), [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


def test_empty_and_repeated(spark, tmp_path):
    assert ss.op8_secret_scans(spark, write(spark, tmp_path, [])).count() == 0
    rows = [(1, "token=abcdef12", "en", "s", 1)] * 2 + [(None, None, None, None, None)]
    got = ss.op8_secret_scans(spark, write(spark, tmp_path / "b", rows)).collect()
    assert sorted(r["n_assign"] for r in got) == [0, 1, 1]


def test_redaction(spark):
    rows = [(1, "é password=abcdefgh end", "en", "s", 23), (2, "clean", "en", "s", 5), (3, None, None, None, None), (4, "token=" + "ab12" * 8 + " z", "en", "s", 40)]
    docs = frame(spark, rows)
    out = ss.redacted(spark, docs, "")
    assert out.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {1: ("é [secret] end", 14), 2: ("clean", 5), 3: (None, None), 4: ("[secret] z", 10)}
    assert DOCS


def test_slugs_of_many_shapes(spark):
    rng = random.Random(9)
    parts = ["", "a", "Ab", "AB", "abc", "1", "12345", "2024", "aB", "x9", "/", "_", "-", "=", "+", "path", "File"]
    rows = [(i, " ".join("".join(rng.choice(parts) + rng.choice("/_-/") for _ in range(rng.randrange(4, 12))) for _ in range(8)) + " 9a", None, None, None) for i in range(200)]
    check(ss_query(spark, rows), [(r[0], r[1]) for r in rows])


def ss_query(spark, rows):
    got = ss.with_spans(frame(spark, rows))
    of_kind = lambda k: F.filter("__spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).alias(f"n_{kind}") for k, kind in enumerate(ss.BASE)]
    return got.select("doc_id", *counts, F.sha2(ss._written(F.filter("__spans", lambda s: s["kind"] < len(ss.BASE))), 256).alias("base_sha256"), ss._written(F.col("__spans")).alias("spans"))


def test_very_long_texts_of_one_kind(spark, tmp_path):
    n, rng = 1_000_000, random.Random(1)
    word = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(20_000))
    texts = ["ab/12/" * (n // 6), "a-b_" * (n // 4) + "1", "/Ab" * 100_000 + "/1", word, "word " * (n // 5), "aB3" * 20_000]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["spans"] for r in ss.op8_secret_scans(spark, write(spark, tmp_path, rows)).collect()}
    assert got[0] == got[1] == got[2] == got[4] == got[5] == "" and got[3] == "entropy:0:20000"


def test_redaction_of_overlapping_and_touching_spans(spark):
    rows = secret_rows()
    found = {r["doc_id"]: (r["text"], [tuple(s) for s in r["__spans"]]) for r in ss.with_spans(frame(spark, rows)).collect()}
    for r in ss.redacted(spark, frame(spark, rows), "").collect():
        text, spans = found[r["doc_id"]]
        out, at = [], 0
        for a, _, z in spans:
            if a >= at:
                out += [text[at:a], "[secret]"]
            at = max(at, z)
        assert r["text"] == (None if text is None else "".join(out) + text[at:])
