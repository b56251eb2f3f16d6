"""Quality rules: text statistics and robust multivariate outliers, in Spark alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, let, table

GRAM = 5
#: Statistics after their transformation, and for each the least standard deviation
#: that the estimates assume: most texts have no symbols or repeats at all, and
#: without it a single one would be an outlier.
FLOORS = {"size": 0.35, "word_length": 0.10, "symbols": 0.05, "dup_lines": 0.10, "repeats": 0.12}
DIMS = list(FLOORS)
#: Share of a group's rows that the determinant is made small over.
SHARE = 0.75
#: Concentration steps run until no group's least determinant so far falls by more than this
#: share, which takes a handful. Estimates that swing between two bins fall no further.
SETTLED = 1e-3
#: Rows that the estimate of a group (language, source) needs, ten for each dimension; a
#: smaller group joins its language's, then all small ones together.
LEAST_ROWS = 10 * len(FLOORS)
#: Quantile of the chi-square distribution beyond which a row is rejected. Texts' tails
#: are heavier than the normal distribution's; farther out junk stays (see README).
REJECT = 0.999999
#: Width of a histogram bin of features and of the logarithm of squared distances.
STEP = 0.01


def chi2_cdf(x: float, k: int) -> float:
    """The chi-square distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = k / 2, x / 2
    term = total = 1 / a
    n = a
    while abs(term) > 1e-17 * abs(total):
        n += 1
        term *= half / n
        total += term
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


def consistency(share: float, k: int) -> float:
    """What the covariance of the inner ``share`` of normal data is too small by."""
    return share / chi2_cdf(chi2_quantile(share, k), k + 2)


def _spaced(text: Column) -> Column:
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _repeat_words(words: Column) -> Column:
    """Words in ``GRAM``-word windows found twice or more. ``words`` is a lambda variable.

    Hashes of windows tell at once that nothing repeats, which is the rule; only when
    two are equal are the windows themselves sorted and compared.
    """
    starts = F.sequence(F.lit(0), F.size(words) - GRAM)

    def covered(words: Column) -> Column:
        def marked(pairs: Column) -> Column:
            def mark(p: Column, k: Column) -> Column:
                before = (k > 0) & (F.get(pairs, k - 1)["gram"] == p["gram"])
                after = F.coalesce(F.get(pairs, k + 1)["gram"] == p["gram"], F.lit(False))
                return F.when(before | after, p["at"])

            return F.sort_array(F.filter(F.transform(pairs, mark), lambda x: x.isNotNull()))

        pairs = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i + 1, F.lit(GRAM)), " ").alias("gram"), i.alias("at"))))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

        def add(acc: Column, at: Column) -> Column:
            return F.struct((at + GRAM).alias("end"), (acc["n"] + at + GRAM - F.greatest(acc["end"], at)).alias("n"))

        return F.aggregate(let(pairs, marked), zero, add, lambda acc: acc["n"])

    def hashed(h: Column) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(GRAM)]))

    grams = let(F.transform(words, lambda w: F.xxhash64(w)), hashed)
    clean = let(grams, lambda g: F.size(F.array_distinct(g)) == F.size(g))
    none = F.lit(0).cast("long")
    return F.when(F.size(words) < GRAM, none).when(clean, none).otherwise(covered(words))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of whole texts; null texts have no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    spaced = _spaced(text)
    counted = let(
        F.array_remove(F.split(spaced, " "), ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")),
    )
    got = docs.select(
        "doc_id", "lang", "source",
        F.length(F.replace(spaced, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        counted.alias("c"),
    )
    n, r = F.col("c.n_words"), F.col("c.n_repeat_words")
    return got.select("doc_id", "lang", "source", n.alias("n_words"), "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", r.alias("n_repeat_words"), ((n < 10) | (100 * r > 20 * n)).alias("base_failed"))


def _features() -> dict[str, Column]:
    """Transformed statistics; ratios by their square root, sizes by their logarithm."""
    n = F.col("n_words")
    return {
        "size": F.log(n.cast("double")),
        "word_length": F.log(F.col("word_chars") / n),
        "symbols": F.sqrt(F.col("n_symbols") / F.col("word_chars")),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / F.col("n_lines")),
        "repeats": F.sqrt(F.col("n_repeat_words") / n),
    }


def _quantile(rows: DataFrame, keys: list[str], bin_: Column, share: float) -> DataFrame:
    """(keys, bin): the least bin with ``share`` of the key's rows at or below it.

    Rows become counts of bins before they are dealt out, and a key has at most a few
    thousand bins, so a group with a third of all rows is no large task.
    """
    counts = rows.groupBy(*keys, bin_.alias("bin")).count()
    own = Window.partitionBy(*keys)
    below = F.sum("count").over(own.orderBy("bin"))
    return counts.withColumn("below", below).withColumn("all", F.sum("count").over(own)).where(F.col("below") >= F.col("all") * share).groupBy(*keys).agg(F.min("bin").alias("bin"))


def _bins(x: Column) -> Column:
    return F.floor(x / STEP).cast("int")


def _whitening(table_: DataFrame) -> DataFrame:
    """From means m_i and covariances c_i_j the inverse w_i_j of the Cholesky factor, and
    the logarithm of the determinant."""
    p = len(DIMS)
    out = table_
    for i in range(p):
        for j in range(i + 1):
            value = F.col(f"c_{i}_{j}")
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l_{j}_{j}"))
    for j in range(p):
        for i in range(j, p):
            value = F.lit(1.0) if i == j else F.lit(0.0)
            for k in range(j, i):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}")
            out = out.withColumn(f"w_{i}_{j}", value / F.col(f"l_{i}_{i}"))
    logdet = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, p)), F.log(F.col("l_0_0")))
    return out.withColumn("logdet", logdet)


#: Of an estimate: means, whitening matrix, and what the best start is chosen by.
_ESTIMATE = [*(f"m_{i}" for i in range(len(DIMS))), *(f"w_{i}_{j}" for i in range(len(DIMS)) for j in range(i + 1)), "logdet"]


def _distance() -> Column:
    """The squared Mahalanobis distance of a row joined with its group's estimate."""
    total = F.lit(0.0)
    for i in range(len(DIMS)):
        part = sum((F.col(f"w_{i}_{j}") * (F.col(DIMS[j]) - F.col(f"m_{j}")) for j in range(1, i + 1)), F.col(f"w_{i}_0") * (F.col(DIMS[0]) - F.col("m_0")))
        total = total + part * part
    return total


def _estimate(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """(keys, estimate) from the mean and covariance of ``rows``, the latter times ``factor``.

    Sums are taken about the rounded coordinates as they are: features are of order 1.
    """
    p = len(DIMS)
    sums = [F.count("*").alias("n"), *(F.sum(c).alias(f"s_{i}") for i, c in enumerate(DIMS))]
    sums += [F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"q_{i}_{j}") for i in range(p) for j in range(i + 1)]
    got = rows.groupBy(*keys).agg(*sums)
    means = [F.round(F.col(f"s_{i}") / F.col("n"), 9).alias(f"m_{i}") for i in range(p)]
    cov = []
    for i in range(p):
        for j in range(i + 1):
            value = (F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"s_{i}") / F.col("n") * F.col(f"s_{j}") / F.col("n")) * factor
            value = value + FLOORS[DIMS[i]] ** 2 if i == j else value
            cov.append(F.round(value, 9).alias(f"c_{i}_{j}"))
    return _whitening(got.select(*keys, *means, *cov)).select(*keys, *_ESTIMATE)


def _medians(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """The start from each coordinate's median and median absolute deviation."""
    p = len(DIMS)
    long_ = rows.select("grp", F.posexplode(F.array(*DIMS)).alias("dim", "x"))
    mid = scratch.write(_quantile(long_, ["grp", "dim"], _bins(F.col("x")), 0.5).select("grp", "dim", ((F.col("bin") + 0.5) * STEP).alias("mid")))
    off = _quantile(long_.join(mid, ["grp", "dim"]), ["grp", "dim"], _bins(F.abs(F.col("x") - F.col("mid"))), 0.5)
    both = mid.join(off.select("grp", "dim", ((F.col("bin") + 1) * STEP * 1.4826).alias("off")), ["grp", "dim"])
    wide = both.groupBy("grp").agg(*(F.max(F.when(F.col("dim") == i, F.col("mid"))).alias(f"m_{i}") for i in range(p)), *(F.max(F.when(F.col("dim") == i, F.col("off") * F.col("off") + FLOORS[DIMS[i]] ** 2)).alias(f"c_{i}_{i}") for i in range(p)))
    wide = wide.withColumns({f"c_{i}_{j}": F.lit(0.0) for i in range(p) for j in range(i)})
    return _whitening(wide).select("grp", *_ESTIMATE)


def minimum_determinant(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """(grp, estimate): minimum covariance determinant of each group, reweighted.

    Two starts, by medians and by all rows, are improved side by side by concentration
    steps: the ``SHARE`` of rows nearest to the estimate gives the next one, whose
    determinant isn't larger, until it stands still. The start with the smaller determinant
    wins; the rows within its 97.5 % ellipsoid give the final estimate.
    """
    p = len(DIMS)
    starts = _medians(scratch, rows).withColumn("start", F.lit(0)).unionByName(_estimate(rows, ["grp"], 1.0).withColumn("start", F.lit(1)))
    now = scratch.write(starts.withColumn("least", F.lit(float("inf"))))
    factor = consistency(SHARE, p)
    keys = ["grp", "start"]
    fell = None
    while fell is None or fell > SETTLED:
        far = rows.join(now, "grp").withColumn("bin", _bins(F.log(_distance() + 1e-6)))
        # Written, its size is known: a small one is sent to the rows, and no row is dealt out by its group.
        cut = scratch.write(_quantile(far, keys, F.col("bin"), SHARE).withColumnRenamed("bin", "most"))
        better = _estimate(far.join(cut, keys).where("bin <= most"), keys, factor).join(now.select(*keys, "least"), keys)
        following = scratch.write(better.withColumns({"fell": F.col("least") - F.col("logdet"), "least": F.least("least", "logdet")}))
        fell = following.agg(F.coalesce(F.max("fell"), F.lit(0.0))).first()[0]
        scratch.drop(cut)
        scratch.drop(now)
        now = following
    best = now.groupBy("grp").agg(F.min_by(F.struct("start", *_ESTIMATE), F.struct("logdet", "start")).alias("e")).select("grp", *(f"e.{c}" for c in _ESTIMATE))
    best = scratch.write(best)
    inner = rows.join(best, "grp").where(_distance() <= chi2_quantile(0.975, p)).select("grp", *DIMS)
    return scratch.write(_estimate(inner, ["grp"], consistency(0.975, p)))


def with_groups(scratch: Scratch, stats: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Rows that pass the base rules, with features and the group whose estimate they get."""
    rows = stats.where("not base_failed")
    own = F.struct(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    counts = scratch.write(rows.groupBy(own.alias("own")).count())
    lang = Window.partitionBy("own.lang")
    small = F.col("count") < least_rows
    pooled = F.sum(F.when(small, F.col("count")).otherwise(0)).over(lang)
    name = F.when(~small, F.concat_ws("\x00", F.lit("s"), "own.lang", "own.source")).when(pooled >= least_rows, F.concat_ws("\x00", F.lit("l"), "own.lang")).otherwise(F.lit("all"))
    named = scratch.write(counts.select("own", name.alias("grp")))
    return rows.withColumn("own", own).join(named, "own").withColumns(_features())


def quality(spark: SparkSession, docs: DataFrame, least_rows: int = LEAST_ROWS, reject: float = REJECT) -> DataFrame:
    """Per row of ``docs`` the base statistics, base_failed, distance, kept and the group
    whose estimate judged it (null where the base rules did).

    Estimates are made for each (lang, source) from the rows that pass the base rules;
    such a row is rejected if its squared Mahalanobis distance is beyond the ``reject``
    quantile. Null lang and source are groups of their own; groups of under ``least_rows``
    rows are pooled by language, and such pools together; ties and repeated rows count
    each. Null and empty texts fail the base rules; texts are read whole, however long. An
    empty table gives an empty result.
    """
    scratch = Scratch(spark, "quality")
    stats = scratch.write(with_statistics(docs))
    rows = scratch.write(with_groups(scratch, stats, least_rows))
    estimates = minimum_determinant(scratch, rows.select("grp", *DIMS))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = rows.join(estimates, "grp", "left").select(*cols, F.round(_distance(), 6).alias("distance"), F.replace("grp", F.lit("\x00"), F.lit("/")).alias("grp"))
    judged = judged.withColumn("kept", F.coalesce(F.col("distance") <= chi2_quantile(reject, len(DIMS)), F.lit(True)))
    failed = stats.where("base_failed").select(*cols, F.lit(None).cast("double").alias("distance"), F.lit(None).cast("string").alias("grp"), F.lit(False).alias("kept"))
    return judged.unionByName(failed)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", F.col("grp").alias("estimate"))
