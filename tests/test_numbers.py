"""Numbers with six significant digits: the JVM's against the language's own %g."""

import random

from pyspark.sql import functions as F

from ledgerloom.functions import text as tx


def test_six_digits_are_those_of_the_format(spark):
    rng = random.Random(1)
    values = [0.0, 1.0, 9.999995, 99999.95, 999999.5, 999999.4999999999, 1234565.0, 1234575.0, 2.0000005, 0.0001, 0.00001, 0.000099999951, 1e22, 1e35, 1e-24, 123456789.0, 2**53 + 2.0, 1.7e308, float("inf"), 1e40, 1e-30]
    values += [rng.random() * 10 ** rng.randrange(-20, 30) for _ in range(1500)]
    values += [float(f"{rng.randrange(100_000, 1_000_000)}5e{rng.randrange(-22, 24)}") for _ in range(1500)]  # halfway, or nearly so
    values += [float(10**k) for k in range(-10, 30)] + [float(f"1e{k}") * (1 - 2**-53) for k in range(-10, 30)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(8)
    bad = [(r.v, r.s, f"{r.v:g}") for r in df.select("v", tx.six_digits(F.col("v")).alias("s")).collect() if r.s != f"{r.v:g}"]
    assert not bad, bad[:10]


def test_tokens(spark):
    tokens = ["1,234", "1,234.50", "007", "0", "000", "12%", "3.140%", "٣٤", "1,,2", "1234567", "0.000012", "5,", "12.", "9" * 400]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select(tx.canonical_number(F.col("t"))).collect()

    def plain(t):
        return f"{float(t.rstrip('%').replace(',', '')):g}{'%' if t.endswith('%') else ''}"

    assert [r[0] for r in got] == [plain(t) for t in tokens]


def test_no_python_worker(spark):
    df = spark.createDataFrame([("1,234.5 and 7%",)], "t string").select(tx.numeric_claims(F.col("t")))
    assert df.first()[0] == ["1234.5", "7%"]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
