"""Small document tables with nulls, ties, repeats, long texts and clashing column names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def edge_rows(seed=0):
    rng = random.Random(seed)
    base = sentence(rng, 120)
    texts = [
        None, "", " \t\n", "word", "two words", base, base, base + " tail", "head " + base, base[:300] + "X" + base[301:],
        "é" * 60 + base, " nbsp wide\x1cfs " + base[:80], "a" * 500, "ab" * 400, "\n".join([base[:70]] * 5),
        sentence(rng, 30_000), "12 34 #!$ <|endoftext|> don't I'LL", "  leading and  double  spaces ", "emoji 😀😀 中文 текст ẞ İ",
    ]
    rows = [(i, t, ["en", "de", "fr", None][i % 4], f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def write(spark, tmp_path, rows, name="documents", schema=DOCS):
    """A table with extra columns whose names clash with what operators compute."""
    df = spark.createDataFrame(rows, schema)
    for extra in ("kept", "score", "batch", "bucket", "key", "node", "length", "fingerprint", "rank", "host", "sig"):
        if extra not in df.columns:
            df = df.selectExpr("*", f"'x' as {extra}")
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
