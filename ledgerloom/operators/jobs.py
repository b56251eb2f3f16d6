"""Jobs, documents and messages as event logs folded to their latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, parse_iso, utc_iso
from ..schema import DOCUMENT_NEXT, DOCUMENT_STATES, JOB_NEXT, JOB_STATES, STAGES
from .held import written


def fold(log: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The last value that isn't null of each field of each key.

    max_by ignores no nulls, so each field's rank is null where the field is; the fold is
    one aggregation with partial results, without sorting a key's events.
    """
    at = F.struct(*order)
    return log.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in fields))


def progress(rows: DataFrame, by: list[str]) -> DataFrame:
    """Processed, skipped and failed counts, percent and final status."""
    out = rows.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.col("outcome") == "processed").alias("processed"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"), F.count_if(F.col("outcome") == "failed").alias("failed"),
    )
    done = F.col("processed") + F.col("skipped")
    return out.withColumns({"progress": F.floor(done * 100 / F.greatest("total", F.lit(1))).cast("int"), "status": F.when(F.col("failed") == 0, F.lit("COMPLETED")).otherwise(F.lit("FAILED"))})


def running(rows: DataFrame, by: str, order: list[str], hit: Column, name: str = "so_far", bucket: Column | None = None) -> DataFrame:
    """Hits of a key so far. With ``bucket``, which must not fall along ``order``, a key's rows
    are counted bucket by bucket and carried over, so a busy key is no single task."""
    within = [by] if bucket is None else [by, "__bucket"]
    own = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__hit", F.coalesce(hit, F.lit(False)).cast("int"))
    if bucket is None:
        return rows.withColumn(name, F.sum("__hit").over(own)).drop("__hit")
    rows = rows.withColumn("__bucket", bucket)
    before = Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(by, "__bucket").agg(F.sum("__hit").alias("__n")).select(by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return rows.withColumn("__in", F.sum("__hit").over(own)).join(base, [by, "__bucket"]).withColumn(name, F.col("__base") + F.col("__in")).drop("__hit", "__bucket", "__in", "__base")


def decision(df: DataFrame) -> DataFrame:
    """Per document from file_exists, has_data, skip_if_exists and force what happens."""
    out = F.when(~F.col("file_exists"), F.lit("failed")).when(F.col("has_data") & F.col("skip_if_exists") & ~F.col("force"), F.lit("skipped")).otherwise(F.lit("processed"))
    return df.withColumn("outcome", out).withColumn("status", F.when(F.col("outcome") == "failed", F.lit("FAILED")).otherwise(F.lit("INGESTED")))


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of a listing; ``order`` ends in a unique column."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_bounds(df: DataFrame, order: list[tuple[str, bool]], size: int) -> DataFrame:
    """(page, columns of ``order``): the first row of each page of ``size`` rows.

    ``order`` has (column, descending), the last of them unique. Rows are sorted by ranges, and
    counted range by range, so that no task numbers them all; nulls come first going up, last going down.
    """
    by = [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
    names = [c for c, _ in order]
    rows = df.select(*names).repartitionByRange(*by).sortWithinPartitions(*by)
    rows = written(rows.withColumn("__at", F.monotonically_increasing_id()))
    part, turn = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__part", before.alias("__before"))  # a row a range
    placed = rows.withColumn("__part", part).join(F.broadcast(counts), "__part").withColumn("__pos", F.col("__before") + turn)
    return placed.where(F.col("__pos") % size == 0).select((F.col("__pos") / size).cast("long").alias("page"), *names)


def _not_before(order: list[tuple[str, bool]], row: dict) -> Column:
    """Rows at or after ``row``."""

    def after(c: str, down: bool, v) -> Column:
        x = F.col(c)
        if v is None:
            return F.lit(False) if down else x.isNotNull()
        return (x < F.lit(v)) | x.isNull() if down else x > F.lit(v)

    out, same = F.lit(False), F.lit(True)
    for c, down in order:
        out = out | (same & after(c, down, row[c]))
        same = same & F.col(c).eqNullSafe(F.lit(row[c]))
    return F.coalesce(out | same, F.lit(False))


def _edge(column: str, low: object, high: object) -> Column:
    """``column`` from low to high, nulls being least; a bound that is null bounds nothing. This reaches the scan."""
    least = F.lit(True) if low is None else F.col(column) >= F.lit(low)
    most = F.lit(True) if high is None else (F.col(column) <= F.lit(high)) | F.col(column).isNull()
    return least & most


def page_at(df: DataFrame, bounds: DataFrame, order: list[tuple[str, bool]], size: int, number: int) -> DataFrame:
    """Page ``number`` (from 0) of a listing whose ``bounds`` are known: rows from its first to the
    next page's are read, not all that come before. As OFFSET gives it, while rows are those of the bounds."""
    ends = {r["page"]: r.asDict() for r in bounds.where(F.col("page").isin(number, number + 1)).collect()}
    if number not in ends:
        return df.limit(0)
    first, down = order[0]
    begin, end = ends[number], ends.get(number + 1)
    values = begin[first], end[first] if end else None
    low, high = values[::-1] if down else values
    df = df.where(_edge(first, low, high)).where(_not_before(order, begin))
    if end:
        df = df.where(~_not_before(order, end))
    return df.orderBy(*(F.col(c).desc() if down else F.col(c).asc() for c, down in order)).limit(size)


def latest_question(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The last message of a person that isn't blank."""
    own = messages.where(F.col(role).isin("user", "human") & (F.trim(F.coalesce(text, F.lit(""))) != ""))
    return own.groupBy(conv).agg(F.max_by(text, turn).alias("question"))


def reduce_messages(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New messages replace those of their id, others are appended."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def transitions(log: DataFrame, by: str, order: list[str], state: str, bucket: Column | None = None) -> DataFrame:
    """Events at which the state differs from the one before.

    With ``bucket``, which must not fall along ``order``, the first row of a bucket is
    compared with the last one of the key's bucket before, so a busy key is no single task.
    """
    if bucket is None:
        rows = log.withColumn("previous", F.lag(state).over(Window.partitionBy(by).orderBy(*order)))
    else:
        log = log.withColumn("__bucket", bucket)
        ends = log.groupBy(by, "__bucket").agg(F.max_by(state, F.struct(*order)).alias("__last"))
        ends = ends.select(by, "__bucket", F.lag("__last").over(Window.partitionBy(by).orderBy("__bucket")).alias("__before"))
        own = Window.partitionBy(by, "__bucket").orderBy(*order)
        rows = log.withColumns({"__lag": F.lag(state).over(own), "__first": F.row_number().over(own) == 1}).join(ends, [by, "__bucket"])
        rows = rows.withColumn("previous", F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__lag"))).drop("__bucket", "__before", "__lag", "__first")
    return rows.where(F.col("previous").isNull() | (F.col("previous") != F.col(state)))


def new_jobs(requests: DataFrame, id_: Column | None = None, now: Column | None = None) -> DataFrame:
    """Job rows of requests (document_ids): QUEUED, progress 0, their number of documents.

    Random ids are made once: write the rows before they are used twice.
    """
    return requests.select(
        (F.uuid() if id_ is None else id_).cast("string").alias("id"), F.lit("QUEUED").alias("status"), F.lit(0).alias("progress"),
        utc_iso(now).alias("created_at"), F.size("document_ids").alias("documents_count"),
    )


DOCUMENT_FIELDS = ["id", "filename", "file_path", "mime_type", "size_bytes", "ticker", "company_name", "doc_type", "period"]


def new_documents(uploads: DataFrame, now: Column | None = None) -> DataFrame:
    """Document rows of uploads: their fields, UPLOADED and when."""
    return uploads.select(*DOCUMENT_FIELDS, F.lit("UPLOADED").alias("status"), utc_iso(now).alias("created_at"))


def _has(df: DataFrame, c: str, kind: str) -> Column:
    return F.col(c) if c in df.columns else F.lit(None).cast(kind)


def job_response(jobs: DataFrame, listed: bool = False) -> DataFrame:
    """Jobs as they are shown: QUEUED and 0 by default, times parsed, null stats an empty map.

    Unknown states and stages are shown as null, and no errors ever. A listing leaves the
    estimated completion out.
    """
    has = lambda c, kind="string": _has(jobs, c, kind)
    status = F.coalesce(has("status"), F.lit("QUEUED"))
    created = F.coalesce(parse_iso(has("created_at")), F.current_timestamp())
    end = F.lit(None).cast("timestamp") if listed else parse_iso(has("estimated_completion"))
    return jobs.select(
        "id", F.when(status.isin(JOB_STATES), status).alias("status"), F.when(has("stage").isin(STAGES), has("stage")).alias("stage"),
        F.coalesce(has("progress", "int").cast("int"), F.lit(0)).alias("progress"), has("message").alias("message"), created.alias("created_at"),
        parse_iso(has("started_at")).alias("started_at"), end.alias("estimated_completion"),
        F.coalesce(has("stats", "map<string,bigint>"), F.create_map().cast("map<string,bigint>")).alias("stats"), F.array().cast("array<string>").alias("errors"),
    )


def document_response(documents: DataFrame) -> DataFrame:
    """Documents as they are shown: doc_type or else type, UPLOADED by default, null stats an empty map."""
    has = lambda c, kind="string": _has(documents, c, kind)
    return documents.select(
        "id", has("filename").alias("filename"), has("ticker").alias("ticker"), has("company_name").alias("company_name"),
        F.coalesce(has("doc_type"), has("type")).alias("doc_type"), has("period").alias("period"), has("created_at").alias("created_at"),
        F.coalesce(has("status"), F.lit("UPLOADED")).alias("status"), F.coalesce(has("stats", "map<string,bigint>"), F.create_map().cast("map<string,bigint>")).alias("stats"),
    )


def list_documents(documents: DataFrame, ticker: str | None = None, doc_type: str | None = None, period: str | None = None, limit: int = 20, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(one row with the total, a page newest first). Filters are equalities; doc_type is that of
    the document itself, not the type shown in its place. An empty one filters nothing."""
    for c, v in (("ticker", ticker), ("doc_type", doc_type), ("period", period)):
        if v:
            documents = documents.where(F.col(c) == v)
    shown = document_response(documents)
    return documents.agg(F.count("*").alias("total")), page(shown, [F.desc("created_at"), "id"], limit, offset)


def checked_job(progress: Column) -> Column:
    return (progress >= 0) & (progress <= 100)


def checked_upload(ticker: Column, company: Column) -> Column:
    return F.length(ticker).between(1, 10) & F.length(company).between(1, 255)


def checked_plan(chunks: Column, tables: Column, hops: Column) -> Column:
    return chunks.between(1, 20) & tables.between(0, 20) & hops.between(0, 4)


def split_valid(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that don't); a check that is null doesn't pass."""
    good = F.coalesce(ok, F.lit(False))
    return df.where(good), df.where(~good)


def illegal(log: DataFrame, by: str, order: list[str], state: str, following: dict[str, list[str]]) -> DataFrame:
    """Changes of state that ``following`` doesn't have; a log begins with the first state."""
    first = next(iter(following))
    changes = transitions(log, by, order, state)
    ok = F.when(F.col("previous").isNull(), F.col(state) == first)
    for k, v in following.items():
        ok = ok.when(F.col("previous") == k, F.col(state).isin(v) if v else F.lit(False))
    return changes.where(~F.coalesce(ok, F.lit(False)))


def illegal_jobs(log: DataFrame, by: str, order: list[str], state: str = "status") -> DataFrame:
    return illegal(log, by, order, state, JOB_NEXT)


def illegal_documents(log: DataFrame, by: str, order: list[str], state: str = "status") -> DataFrame:
    return illegal(log, by, order, state, {k: DOCUMENT_NEXT[k] for k in DOCUMENT_STATES})


def claim(jobs: DataFrame, workers: int) -> DataFrame:
    """``jobs`` with the oldest queued ones RUNNING, as many as workers are free.

    A top-k finds them, so the queue is never sorted as a whole.
    """
    free = F.greatest(F.lit(0), F.lit(workers) - F.count_if(F.col("status") == "RUNNING"))
    free = jobs.agg(free.alias("n"))
    turn = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("created_at", "id"))
    oldest = jobs.where("status = 'QUEUED'").orderBy("created_at", "id").limit(workers).withColumn("__turn", turn)
    taken = oldest.where(F.col("__turn") <= free.scalar()).select("id", F.lit(True).alias("__taken"))
    out = jobs.join(F.broadcast(taken), "id", "left")
    return out.withColumn("status", F.when(F.col("__taken"), F.lit("RUNNING")).otherwise(F.col("status"))).drop("__taken")


def count_total(rows: DataFrame, by: str, distinct: str) -> DataFrame:
    """Rows and different values of each group."""
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.countDistinct(distinct).alias("users"))


def catalog(rows: DataFrame, ticker: Column, name: Column) -> DataFrame:
    """Different (ticker, name) with a ticker that isn't blank, by ticker."""
    got = rows.select(F.upper(ticker).alias("ticker"), name.alias("name"))
    return got.where(blank_to_null(F.col("ticker")).isNotNull()).distinct().orderBy("ticker", "name")


def absent(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return ids.join(known.select(key), key, "left_anti")


def present(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_semi")


def in_order(asked: DataFrame, rows: DataFrame, id_: str, key: str) -> DataFrame:
    """The rows of asked ids (pos, id), each at its place; without a row its columns are null."""
    return asked.join(rows, asked[id_] == rows[key], "left")


def document_of(source_id: Column) -> Column:
    return F.split_part(source_id, F.lit("_"), F.lit(1))


def thread_titles(messages: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """The first message of a thread, or else its id."""
    return messages.groupBy(conv).agg(F.coalesce(F.min_by(text, turn), F.first(conv).cast("string")).alias("title"))


def threads(titles: DataFrame, order: list, most: int = 100) -> DataFrame:
    return page(titles, order, most)


def windows(rows: DataFrame, ts: str, key: str, value: str, size: str = "1 day") -> DataFrame:
    """Counts and sums of tumbling windows."""
    got = rows.groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return got.select(F.col("w.start").alias("start"), key, "n", "total")
