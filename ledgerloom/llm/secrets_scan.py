"""Secret scans: patterns, and sliding-window entropy of candidate strings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: kind: pattern, group whose length counts, least length.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: A quick test of whether a text has a match that counts.
GATES = {"assign": BASE["assign"][0], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: A kind's number orders spans that start together.
KINDS = [*BASE, "entropy"]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: The alphabet as a character class.
RUN = "A-Za-z0-9+/_=-"
WINDOW = 20
#: Runs of the alphabet that have a digit and a letter, a window long at least.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
#: Bits a character that a window must have, by the character class of the candidate.
LEAST_BITS = {"hex": 2.9, "word": 3.6}
#: Paths and slugs of plain words and short numbers.
SLUG = r"^/?([a-z]*|[0-9]{1,4})([/_-]([A-Za-z]?[a-z]*|[0-9]{1,4}))+$"
#: Candidates that are never secrets: UUIDs, digests named as such, paths and slugs, placeholders.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(sha1|sha256|sha384|sha512|md5)[-=]",
    SLUG,
    r"(?i)example|sample|placeholder|dummy|changeme|xxxx",
]


def _is_slug(candidate: Column) -> Column:
    """Whether SLUG matches, part by part: a repeated group in a pattern takes stack for each
    turn. A leading slash makes the first part empty, which it may be."""
    first, other = r"^([a-z]*|[0-9]{1,4})$", r"^([A-Za-z]?[a-z]*|[0-9]{1,4})$"
    parts = F.split(candidate, "[/_-]", -1)
    return let(parts, lambda p: (F.size(p) > 1) & F.get(p, 0).rlike(first) & F.forall(F.slice(p, F.lit(2), F.size(p)), lambda x: x.rlike(other)))


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """[start, end) of the leftmost non-overlapping matches whose group is long enough.

    What stands between matches comes from split, and running lengths give places.
    """
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    zipped = F.arrays_zip(between.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out"))

    def step(acc, m):
        a = acc["at"] + F.length(m["0"])
        z = a + F.length(m["1"])
        more = F.array(F.struct(a.alias("start"), z.alias("end")))
        return F.struct(z.alias("at"), F.when(F.length(m["2"]) >= least, F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    named = F.transform(zipped, lambda m: F.struct(m["gap"].alias("0"), m["whole"].alias("1"), m["value"].alias("2")))
    return F.aggregate(named, start, step, lambda acc: acc["out"])


def _no_spans() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int>>)")


def _window_span(candidate: Column) -> Column:
    """struct(start, end) within the candidate of its windows with bits enough, or null.

    One pass: a window's counts are the last one's less the character that leaves and
    more the one that enters; so is the sum of c log2 c, which gives the entropy.
    """
    weight = F.lit([0.0, *[c * math.log2(c) for c in range(1, WINDOW + 1)]])

    def scan(c: Column) -> Column:
        least = F.when(c.rlike("^[0-9A-Fa-f]+$"), F.lit(LEAST_BITS["hex"])).otherwise(F.lit(LEAST_BITS["word"]))
        codes = F.transform(F.split(c, ""), lambda x: F.instr(F.lit(ALPHABET), x))
        zero = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("sum"),
            F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("i"),
        )

        def over(code_least):
            code, bits = code_least["codes"], code_least["least"]

            def step(acc, new):
                old = F.when(acc["i"] >= WINDOW, F.get(code, acc["i"] - WINDOW)).otherwise(F.lit(-1))

                def counted(pair):
                    gone = F.when(pair["old"] >= 0, F.get(acc["counts"], pair["old"])).otherwise(F.lit(0))
                    had = F.get(acc["counts"], new) - F.when(pair["old"] == new, 1).otherwise(0)
                    total = acc["sum"] + F.when(pair["old"] >= 0, F.get(weight, gone - 1) - F.get(weight, gone)).otherwise(0.0) + F.get(weight, had + 1) - F.get(weight, had)
                    full = acc["i"] >= WINDOW - 1
                    entropy = F.log2(F.lit(float(WINDOW))) - total / WINDOW
                    hit = full & (F.round(entropy, 9) >= bits)
                    counts = F.transform(acc["counts"], lambda c, i: c - F.when(i == pair["old"], 1).otherwise(0) + F.when(i == new, 1).otherwise(0))
                    first = F.when(hit & (acc["first"] < 0), acc["i"] - (WINDOW - 1)).otherwise(acc["first"])
                    last = F.when(hit, acc["i"] + 1).otherwise(acc["last"])
                    return F.struct(counts.alias("counts"), total.alias("sum"), first.alias("first"), last.alias("last"), (acc["i"] + 1).alias("i"))

                return let(F.struct(old.alias("old")), counted)

            return F.aggregate(code, zero, step, lambda acc: F.when(acc["first"] >= 0, F.struct(acc["first"].alias("start"), acc["last"].alias("end"))))

        return let(F.struct(codes.alias("codes"), least.alias("least")), over)

    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | (_is_slug(candidate) if pattern == SLUG else candidate.rlike(pattern))
    return F.when(~allowed, scan(candidate))


def _entropy(text: Column) -> Column:
    """Spans of the high-entropy windows of candidates that no allow-list pattern suppresses."""

    def place(span):
        inner = _window_span(F.substring(text, span["start"] + 1, span["end"] - span["start"]))
        return let(inner, lambda w: F.when(w.isNotNull(), F.struct((span["start"] + w["start"]).alias("start"), (span["start"] + w["end"]).alias("end"))))

    return F.filter(F.transform(_matches(text, CANDIDATE, 0, WINDOW), place), lambda s: s.isNotNull())


def _kind(spans: Column, k: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with a column __spans, array of (start, kind number, end), sorted; code points.

    Base matches always are in it; a high-entropy span is added unless one base match
    covers it. Null and empty texts have none; spans that start together are ordered by
    kind. Each row is judged by its whole text alone, however long, so repeated rows get
    the same spans and an empty table an empty result; a column named __spans is replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = []
    for k, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        found = F.when(text.rlike(GATES[kind]), _matches(text, pattern, group, least)).otherwise(_no_spans())
        parts.append(_kind(found, k))
    base = F.concat(*parts)
    extra = F.when(text.rlike(CANDIDATE), _entropy(text)).otherwise(_no_spans())

    def joined(base):
        new = F.filter(extra, lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
        return F.sort_array(F.concat(base, _kind(new, len(BASE))))

    return docs.withColumn("__spans", let(base, joined))


def _written(spans: Column) -> Column:
    kinds = F.lit(KINDS)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("__spans", lambda s: s["kind"] < len(BASE))

    def counted(k: int) -> Column:
        return F.size(F.filter("__spans", lambda s: s["kind"] == k)).cast("long")

    counts = [counted(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return got.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("__spans")).alias("spans"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every found span is replaced by ``[secret]``, n_chars counted anew.

    A null text stays null; rows are neither dropped nor joined, and other columns stay.
    """
    text = F.col("text").cast("string")
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out"))

    # Spans that overlap are one: the pieces are between the ends so far and the next start.
    def step(acc, s):
        piece = F.array(F.struct(acc["at"].alias("start"), s["start"].alias("end")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    def joined(found):
        between = F.transform(found["out"], lambda p: F.substring(text, p["start"] + 1, p["end"] - p["start"]))
        return F.array_join(F.concat(between, F.array(F.substring(text, found["at"] + 1, F.length(text)))), "[secret]")

    clean = let(F.aggregate("__spans", start, step), joined)
    hit = F.size("__spans") > 0
    out = with_spans(docs).withColumn("__clean", F.when(hit, clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("__clean")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.col("__clean")).select(docs.columns)
