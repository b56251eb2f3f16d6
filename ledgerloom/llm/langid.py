"""Language ID: the family first, then one-versus-one linear SVMs within it."""

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, parallelism, table

#: Labelled documents a language that the classifiers are fitted on, at most; each sends
#: 2 * SIZE bytes to the driver, 5 MB a language.
PER_LANGUAGE = 500
#: Hashed byte pairs and byte triples of lower-case letters.
PAIRS, TRIPLES = 1 << 10, 1 << 12
SIZE = PAIRS + TRIPLES
COST, EPOCHS = 10.0, 12
#: Bytes whose n-grams are counted at once; a longer text is counted in slices.
SLICE = 1 << 18
#: Below this score the pipeline rejects a document.
LEAST_SCORE = 0.3
UNKNOWN = "und"

#: Families of ISO 639-1 codes (fixed values); a code that is absent is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi fo",
    "romance": "fr es it pt ro ca gl oc la sc co",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "indo-iranian": "hi bn ur pa gu mr ne fa ps tg ku sd",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tt ky tk",
    "semitic": "ar he am mt",
    "austronesian": "id ms tl jv mg mi",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Bytes that are no part of a lower-case word become blanks.
_LETTERS = np.where((np.arange(256) >= 128) | ((np.arange(256) >= 97) & (np.arange(256) <= 122)), np.arange(256), 32).astype(np.uint8)


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].split("_")[0].lower(), f"own:{lang}")


def features(texts: list[str]) -> np.ndarray:
    """A row of length 1 for each whole text: square roots of n-gram counts."""
    data = [b" " + t.lower().encode() + b"  " for t in texts]
    out = np.zeros((len(texts), SIZE), np.float32)
    for s, e in chunks([len(d) for d in data], SLICE):
        got = np.zeros((e - s) * SIZE)
        whole = np.frombuffer(b"".join(data[s:e]), np.uint8)
        rows = np.repeat(np.arange(e - s, dtype=np.int32), [len(d) for d in data[s:e]])
        # Slices overlap by two bytes, so that an n-gram begins in one of them alone.
        for c in range(0, max(1, len(whole) - 2), SLICE):
            got += _counted(_LETTERS[whole[c : c + SLICE + 2]].astype(np.uint32), rows[c : c + SLICE + 2].astype(np.int64), e - s)
        out[s:e] = np.sqrt(got.reshape(e - s, SIZE))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _counted(a: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Hashed n-grams of bytes and their rows, for n rows."""
    two = a[:-2] | (a[1:-1] << np.uint32(8))
    three = two | (a[2:] << np.uint32(16))
    word = a[1:-1] != 32  # an n-gram's second byte is a letter
    same = word & (row[:-2] == row[2:])
    at = row[:-2][same] * SIZE
    two, three = (x[same] * np.uint32(0x9E3779B1) for x in (two, three))
    got = np.bincount(at + (two >> np.uint32(22)), minlength=n * SIZE)
    return got + np.bincount(at + PAIRS + (three >> np.uint32(20)), minlength=n * SIZE)


def linear_svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias (last) of a linear SVM, y in -1 and 1, by dual coordinate descent.

    Each class counts alike, however many rows it has.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha, square = np.zeros(x.shape[1], np.float64), np.zeros(len(x)), (x * x).sum(1)
    cost = np.where(y > 0, COST * len(y) / (2 * max(1, (y > 0).sum())), COST * len(y) / (2 * max(1, (y < 0).sum())))
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            grad = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - grad / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class OneVersusOne:
    """A linear SVM for each pair of classes; most votes win, then the sum of margins."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.classes = sorted(set(labels.tolist()))
        self.pairs = list(itertools.combinations(range(len(self.classes)), 2))
        self.weights = np.zeros((SIZE + 1, len(self.pairs)), np.float32)
        for k, (i, j) in enumerate(self.pairs):
            rows = np.isin(labels, [self.classes[i], self.classes[j]])
            self.weights[:, k] = linear_svm(x[rows], np.where(labels[rows] == self.classes[i], 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers, and a score in (0, 1]: the logistic of the winner's least margin."""
        n = len(x)
        if not self.pairs:
            return np.zeros(n, np.int64), np.ones(n)
        margin = (x @ self.weights[:-1] + self.weights[-1]).astype(np.float64)
        votes, total = np.zeros((n, len(self.classes))), np.zeros((n, len(self.classes)))
        least = np.full((n, len(self.classes)), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            for c, m in ((i, margin[:, k]), (j, -margin[:, k])):
                votes[:, c] += m > 0
                total[:, c] += m
                least[:, c] = np.minimum(least[:, c], m)
        won = np.lexsort((np.arange(len(self.classes))[None, :].repeat(n, 0), -total, -votes), axis=1)[:, 0]
        return won, 1 / (1 + np.exp(-2 * np.clip(least[np.arange(n), won], -300, 300)))


class Languages:
    """The family's classifier, and one for each family's languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        langs_, families = np.array(langs, object), np.array([family_of(v) for v in langs], object)
        self.family = OneVersusOne(x, families)
        self.within = {f: OneVersusOne(x[families == f], langs_[families == f]) for f in self.family.classes}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, score = self.family.predict(x)
        out = [""] * len(x)
        for k, f in enumerate(self.family.classes):
            rows = np.flatnonzero(family == k)
            lang, more = self.within[f].predict(x[rows])
            score[rows] *= more
            for r, v in zip(rows.tolist(), lang.tolist(), strict=True):
                out[r] = self.within[f].classes[v]
        return out, score


def held_out() -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def chosen(docs: DataFrame, per_language: int) -> DataFrame | None:
    """(rank, lang, text) of ``per_language`` lettered rows of each language at most, those of the
    smallest hash of their doc_id and text.

    Tasks keep no more of a language before the rows meet, also where very many share a doc_id
    or have none, or are equal.
    """
    lettered = docs.where(~held_out() & F.col("lang").isNotNull() & (F.col("lang") != ""))
    counts = {r["lang"]: r["count"] for r in lettered.groupBy("lang").count().collect()}
    if not counts:
        return None
    # Hashes are even: a little more than the share that is wanted is looked at.
    rank = F.xxhash64(F.lit(1), "doc_id", F.col("text").cast("string")) / 2.0**64 + 0.5
    share = F.element_at(F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, (1.2 * per_language + 50) / n)))), F.col("lang"))
    rows = lettered.where(rank <= share).where(F.col("text").rlike(r"\p{L}")).select(rank.alias("rank"), "lang", F.col("text").cast("string").alias("text"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "text"))
    return rows.withColumn("turn", turn).where(F.col("turn") <= per_language).drop("turn")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Languages | None:
    """Classifiers from texts and languages of the documents that aren't held out.

    Of each language ``per_language`` rows at most are used (``chosen``), so the driver sees a
    bounded number of feature rows.
    """
    rows = chosen(docs, per_language)
    if rows is None:
        return None

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                x = features(part.column(2).to_pylist()).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["rank", "lang", "x"])

    used = rows.repartition(parallelism(docs.sparkSession)).mapInArrow(run, "rank double, lang string, x binary").collect()
    used = sorted(used, key=lambda r: (r["lang"], r["rank"], bytes(r["x"])))
    if not used:
        return None
    x = np.array([np.frombuffer(r["x"], np.float16) for r in used], np.float32)
    return Languages(x, [r["lang"] for r in used])


def with_language(spark: SparkSession, docs: DataFrame, model: Languages | None) -> DataFrame:
    """``docs`` with lang_pred and score, from the whole text alone, however long.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned.
    Ties of votes go to the larger sum of margins, then to the first name. Repeated rows get
    the same answer each; columns of these names are replaced; an empty table gives an empty
    result.
    """
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = np.flatnonzero(texts.notna().to_numpy()) if shared.value is not None else []
            for s in range(0, len(rows), 256):
                part = rows[s : s + 256]
                got, sure = shared.value.predict(features(texts.iloc[part].tolist()))
                score[part] = sure
                for r, v in zip(part, got, strict=True):
                    lang[r] = v
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    text = F.when(F.col("text").cast("string").rlike(r"\p{L}"), F.col("text").cast("string"))
    out = docs.withColumn("__lang", F.pandas_udf(predict, "struct<lang_pred string, score double>")(text))
    return out.withColumns({"lang_pred": F.col("__lang.lang_pred"), "score": F.col("__lang.score")}).drop("__lang")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = with_language(spark, docs.select("doc_id", "text"), fit(docs))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without letters or of no clear language go."""
    renamed = docs.select(F.struct(*docs.columns).alias("__doc"), F.col("text"))
    got = with_language(spark, renamed, fit(docs.select("doc_id", "text", "lang")))
    return got.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("__doc.*")
