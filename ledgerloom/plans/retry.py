"""Retries of calls to injected models."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

T = TypeVar("T")
# Names of error classes of drivers that needn't be installed.
TRANSIENT = {"ServiceUnavailable", "SessionExpired", "TransientError"}
DATABASE = {"DatabaseError", "Neo4jError", "PySparkException", "Py4JJavaError"}


def classify(error: BaseException) -> str:
    """transient, validation, database or runtime, by the type and its bases; texts don't count."""
    names = {k.__name__ for k in type(error).__mro__}
    if isinstance(error, (TimeoutError, ConnectionError)) or names & TRANSIENT:
        return "transient"
    if isinstance(error, (TypeError, ValueError)):
        return "validation"
    return "database" if names & DATABASE else "runtime"


def query_delay(n: int, base: float = 0.2) -> float:
    """Seconds after the n-th failed attempt of a query."""
    return base * 2 ** (n - 1)


def ingestion_delay(n: int, most: float = 0.25, draw: Callable[[float, float], float] = random.uniform) -> float:
    """Seconds after the n-th failed attempt of an ingestion step, with jitter."""
    return 2 ** (n - 1) + draw(0, most)


def invoke(call: Callable[[], T], attempts: int = 3, delay: Callable[[int], float] = query_delay, sleep: Callable[[float], None] = time.sleep, retryable: Callable[[BaseException], bool] = lambda e: classify(e) == "transient") -> tuple[T, int, str | None]:
    """(result, retries used, None). Only retryable errors are tried again; the last one is raised.

    At least one attempt is made.
    """
    attempts = max(1, attempts)
    for n in range(1, attempts + 1):
        try:
            return call(), n - 1, None
        except Exception as error:
            if n == attempts or not retryable(error):
                raise
            sleep(delay(n))
    raise AssertionError("unreachable")


def attempt(call: Callable[[], T], default: T, **kind) -> tuple[T, int, str | None]:
    """As ``invoke``, but an error gives ``default`` and the error's class instead."""
    try:
        return invoke(call, **kind)
    except Exception as error:
        return default, 0, classify(error)


def with_retry(call: Callable[[], T], attempts: int = 3, base: float = 0.2, sleep: Callable[[float], None] = time.sleep) -> T:
    """The result alone, after at most ``attempts`` tries."""
    return invoke(call, attempts, lambda n: query_delay(n, base), sleep)[0]


def ingestion_retry(call: Callable[[], T], context: str, attempts: int = 3, sleep: Callable[[float], None] = time.sleep, delay: Callable[[int], float] = ingestion_delay) -> T:
    """Any error is tried again; after the last one a RuntimeError tells the context."""
    try:
        return invoke(call, attempts, delay, sleep, lambda e: True)[0]
    except Exception as error:
        raise RuntimeError(f"{context} failed after {attempts} attempts: {error}") from error


def error_class(types: Column) -> Column:
    """As ``classify``, of an array of the names of an error's type and its bases; null for null."""
    of = lambda *names: F.arrays_overlap(types, F.array(*map(F.lit, sorted(names))))
    known = F.when(of("TimeoutError", "ConnectionError", *TRANSIENT), F.lit("transient")).when(of("TypeError", "ValueError"), F.lit("validation"))
    return F.when(types.isNotNull(), known.when(of(*DATABASE), F.lit("database")).otherwise(F.lit("runtime")))


def replay(attempts: DataFrame, call: str, order: str, types: Column, most: int = 3, any_error: bool = False) -> DataFrame:
    """(call, retries, outcome) of each call of a table of what its attempts would give, in ``order``.

    ``types`` holds the names of an attempt's error and its bases, null if it succeeds. An
    attempt is made if all before it failed with errors that are tried again: transient
    ones, or all with ``any_error``; at most ``most``, at least one. outcome is the last
    made attempt's class of error, or ok. Rows of equal order are attempts of their own.
    Calls are dealt out by their key; rows beyond ``most`` of a call go before they are kept.
    """
    again = F.col("__class").isNotNull() if any_error else F.coalesce(F.col("__class") == "transient", F.lit(False))
    rows = attempts.select(F.col(call).alias("call"), F.col(order).alias("__order"), error_class(types).alias("__class"))
    w = Window.partitionBy("call").orderBy("__order", "__class")
    rows = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max(1, most))
    made = rows.withColumn("__made", F.coalesce(F.min(again).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))).where("__made")
    return made.groupBy("call").agg((F.max("__n") - 1).cast("int").alias("retries"), F.coalesce(F.max_by("__class", "__n"), F.lit("ok")).alias("outcome"))


def query_wait(retries: Column, base: float = 0.2) -> Column:
    """Seconds that a query has waited in all after this many retries."""
    return F.lit(base) * (F.pow(F.lit(2.0), retries) - 1)


def ingestion_wait(retries: Column, most: float = 0.25) -> tuple[Column, Column]:
    """(least, most) seconds that an ingestion step has waited in all, by its jitter."""
    least = F.pow(F.lit(2.0), retries) - 1
    return least, least + retries * F.lit(most)
