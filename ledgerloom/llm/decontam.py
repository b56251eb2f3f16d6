"""Benchmark decontamination: windows of items joined to documents by their rarest shingle, then compared whole."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, chunks, table

#: Words of a window, and of the shingles that it is searched by; shorter items are one window.
WINDOW, WIDTH = 10, 3
#: A filter has 2**BITS bits at most (16 MB), whatever the size of the benchmark.
BITS = 27
#: Shingles are filed in BUCKETS; a bucket with over HOT occurrences is dealt out in parts.
BUCKETS, HOT = 4096, 20_000
#: Bytes of text that are worked on at once.
SLICE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
# Words are digits, a-z and whatever is not ASCII; A-Z count as a-z.
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_WORD = (_LOWER >= 0x80) | ((_LOWER >= 0x30) & (_LOWER <= 0x39)) | ((_LOWER >= 0x61) & (_LOWER <= 0x7A))


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


class Words:
    """Starts, ends and hashes of words: numpy passes over the bytes of texts, a slice at a time."""

    def __init__(self):
        self.up, self.down = _powers(_BASE, 2 * SLICE), _powers(pow(_BASE, -1, 1 << 64), 2 * SLICE)
        self.value = _spread(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got, at = [], 0
        while at < len(text):
            end = at + SLICE
            if end < len(text):  # to the end of the word; one longer than a slice is cut
                rest = re.compile(rb"[^0-9a-zA-Z\x80-\xff]").search(text, end, at + 2 * SLICE - 1)
                end = rest.end() if rest else at + 2 * SLICE - 1
            got.append((at, *self._slice(np.frombuffer(text[at:end], np.uint8))))
            at = end
        if not got:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        start, end, mark = (np.concatenate(x) for x in zip(*((a + s, a + e, h) for a, s, e, h in got), strict=True))
        # Pieces of one word touch. Words of a slice or more have a hash of their own, wherever they were cut.
        begins, ends = (np.concatenate(x) for x in ([np.ones(min(1, len(start)), bool), start[1:] != end[:-1]], [start[1:] != end[:-1], np.ones(min(1, len(start)), bool)]))
        start, end, mark = start[begins], end[ends], mark[begins]
        for k in np.flatnonzero(end - start >= SLICE).tolist():
            mark[k] = xxhash.xxh64_intdigest(text[start[k] : end[k]].lower())
        return start, end, mark

    def _slice(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = _WORD[b]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[_LOWER[b]] * self.up[: len(b)], dtype=np.uint64)])
        return start, end, _spread((total[end] - total[start]) * self.down[start])


def shingles(mark: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` words in a row, one for each start."""
    n = max(0, len(mark) - width + 1)
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = _spread((h ^ mark[k : k + n]) * np.uint64(_BASE))
    return h


def _plain(text: bytes, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    return [text[a:z].lower() for a, z in zip(start.tolist(), end.tolist(), strict=True)]


def _windows(window: int, width: int):
    """Windows of items: their words, and the hashes of their shingles in order."""
    kind = pa.schema([("item_id", pa.string()), ("words", pa.string()), ("size", pa.int32()), ("width", pa.int32()), ("prints", pa.list_(pa.int64()))])

    def run(batches):
        words = Words()
        for batch in batches:
            for item, cell in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                text = cell.as_py()
                start, end, mark = words.of(text)
                said = _plain(text, start, end)
                size = min(window, len(said))
                k = min(width, size)
                prints = shingles(mark, k).view(np.int64) if size else []
                for s in range(0, len(said) - size + 1 if size else 0, 4096):
                    at = range(s, min(s + 4096, len(said) - size + 1))
                    yield pa.RecordBatch.from_pylist([{"item_id": item, "words": b" ".join(said[i : i + size]).decode(), "size": size, "width": k, "prints": prints[i : i + size - k + 1]} for i in at], kind)

    return run


class Filter:
    """A set of hashes as bits; it may say yes of others too. Its size follows the set's, up to 2**BITS bits."""

    def __init__(self, marks: DataFrame):
        n = marks.count()
        self.bits = int(min(BITS, max(10, np.ceil(np.log2(32 * max(1, n))))))
        slot = F.shiftrightunsigned("print", 64 - self.bits)
        rows = marks.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(print, {64 - self.bits}) & 63 as int))")).alias("bits")).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        self.words[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _counted(known, widths: list[int]):
    """How often shingles that the filter knows occur, summed over a slice of texts."""

    def run(batches):
        words, of = Words(), known.value
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for a, z in chunks([len(t.as_buffer() or b"") if t.is_valid else 0 for t in texts], 4 * SLICE):
                found = [np.empty(0, np.uint64)]
                for t in texts[a:z]:
                    mark = words.of(t.as_py())[2]
                    for width in widths:
                        h = shingles(mark, width)
                        found.append(h[of.has(h)])
                marks, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64)), pa.array(n.astype(np.int64))], names=["print", "n"])

    return run


_CANDIDATE = pa.struct([("print", pa.int64()), ("part", pa.int32()), ("pos", pa.int64()), ("begin", pa.int64()), ("words", pa.string())])


def _candidates(known, parts: list[int], widths: list[int], window: int):
    """Of each document the places of the windows' rarest shingles, with the words that a window there can have."""

    def run(batches):
        words, of = Words(), known.value
        dealt = np.array(parts, np.int64)
        turn = 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for a, z in chunks([len(t.as_buffer() or b"") if t.is_valid else 0 for t in texts], 4 * SLICE):
                counts, found = [], []
                for t in texts[a:z]:
                    text = t.as_py()
                    start, end, mark = words.of(text)
                    mine = []
                    for width in widths:
                        h = shingles(mark, width)
                        at = np.flatnonzero(of.has(h))
                        for pos, x in zip(at.tolist(), h[at].tolist(), strict=True):
                            begin, stop = (max(0, pos - window + width), min(len(start), pos + window)) if width == widths[-1] else (pos, pos + width)
                            turn += 1
                            said = b" ".join(_plain(text, start[begin:stop], end[begin:stop]))
                            mine.append({"print": x - (x >> 63 << 64), "part": turn % int(dealt[x % BUCKETS]), "pos": pos, "begin": begin, "words": said.decode()})
                    counts.append(len(start))
                    found.append(mine)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_CANDIDATE))], names=["doc_id", "n_words", "found"])

    return run


def _bucket(mark: str | Column) -> Column:
    return F.pmod(F.col(mark), F.lit(BUCKETS)).cast("int")


class Contained:
    """Where windows of benchmark items occur in documents.

    ``documents`` (row, doc_id, n_words) has a row for each document, ``hits`` (row, start, size,
    window) one for each occurrence of a different window, ``owners`` (window, item_id) the
    items of each window.

    A window occurs only where each of its shingles does. So it is searched by one alone,
    the one that is rarest in the documents (counted in a first pass): with all shingles
    required, the prefix of the set in order of rarity that must be shared is one long. A
    second pass over the documents sends the places of these shingles, with the words around
    them, to the windows; a window must fit between the document's ends and the place's
    bounds, and then its words decide. Filters that the tasks hold have a fixed most size.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, width: int = WIDTH):
        scratch = Scratch(spark, "contained")
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        items = benchmark.select(F.col("item_id").cast("string"), text.alias("text"))
        named = scratch.write(items.mapInArrow(_windows(window, width), "item_id string, words string, size int, width int, prints array<long>"))
        each = named.groupBy("words").agg(F.min("size").alias("size"), F.min("width").alias("width"), F.min("prints").alias("prints"))
        each = scratch.write(each.select(F.monotonically_increasing_id().alias("window"), "*"))
        self.owners = named.where("item_id is not null").join(each.select("words", "window"), "words").select("window", "item_id").distinct()
        placed = each.select("window", F.posexplode("prints").alias("off", "print"))
        widths = sorted(r[0] for r in each.select("width").distinct().collect())
        known = spark.sparkContext.broadcast(Filter(placed.select("print").distinct()))
        counts = docs.select(text.alias("text")).mapInArrow(_counted(known, widths), "print long, n long").groupBy("print").agg(F.sum("n").alias("n"))
        rarest = F.min(F.struct("n", "print", "off")).alias("least")
        # A window one of whose shingles occurs nowhere occurs nowhere.
        rare = placed.join(counts, "print", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).groupBy("window").agg(rarest).where("least.n > 0").select("window", "least.*")
        rare = scratch.write(rare)
        searched = rare.select("print", "n").distinct()
        filed = searched.groupBy(_bucket("print").alias("bucket")).agg(F.ceil(F.sum("n") / HOT).cast("int").alias("parts"))
        parts = [1] * BUCKETS
        for r in filed.collect():  # at most BUCKETS rows
            parts[r["bucket"]] = max(1, r["parts"])
        rarely = spark.sparkContext.broadcast(Filter(searched.select("print")))
        found = docs.select(F.col("doc_id"), text.alias("text")).mapInArrow(_candidates(rarely, parts, widths or [width], window), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, found array<struct<print:long,part:int,pos:long,begin:long,words:string>>")
        found = scratch.write(found.select(F.monotonically_increasing_id().alias("row"), "*"))
        self.documents = found.select("row", "doc_id", "n_words", (F.size("found") > 0).alias("maybe"))
        places = found.select("row", "n_words", F.explode("found").alias("c")).select("row", "n_words", "c.*")
        spread = F.explode(F.sequence(F.lit(0), F.element_at(F.lit(parts), _bucket("print") + 1) - 1))
        wanted = rare.join(each.select("window", "size", F.col("words").alias("said")), "window").select("window", "print", "off", "size", "said", spread.alias("part"))
        start = F.col("pos") - F.col("off")
        met = places.join(wanted, ["print", "part"]).withColumn("start", start).where("start >= begin and start + size <= n_words")
        same = F.array_join(F.slice(F.split("words", " "), (F.col("start") - F.col("begin") + 1).cast("int"), F.col("size")), " ") == F.col("said")
        self.hits = scratch.write(met.where(same).select("row", "start", "size", "window").distinct())

    def covered(self) -> DataFrame:
        """(row, n_hit): words of the document inside any occurrence."""
        before = Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
        end = F.col("start") + F.col("size")
        new = self.hits.select("row", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.col("start")))).alias("new"))
        return new.groupBy("row").agg(F.sum("new").alias("n_hit"))

    def items(self) -> DataFrame:
        """(row, n_items, ids): items with an occurring window, ids sorted as strings and joined by commas.

        Documents with the same windows have the same items, which are gathered once.
        """
        sets = self.hits.groupBy("row").agg(F.array_sort(F.collect_set("window")).alias("windows"))
        of = sets.select("windows").distinct().select("windows", F.explode("windows").alias("window")).join(self.owners, "window").select("windows", "item_id").distinct()
        ids = of.groupBy("windows").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
        return sets.join(ids, "windows").select("row", F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("ids"))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) of each row of ``docs``.

    A document word is hit if it stands in an occurrence of ``window`` words in a row of an
    item of ``benchmark`` (item_id, text); an item of fewer words, but not none, is one window. Null and
    empty texts have no words. Rows with equal doc_id are documents of their own. Rows with
    equal item_id are one item; one with a null item_id hits, but has no name to be counted by. An
    empty benchmark hits nothing.
    """
    at = Contained(spark, docs, benchmark, window, width)
    rows = at.documents.where("maybe").join(at.covered(), "row", "left").join(at.items(), "row", "left")
    zero = F.lit(0).cast("long")
    out = rows.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("ids", F.lit("")).alias("items"))
    rest = at.documents.where("not maybe").select("doc_id", "n_words", zero.alias("n_hit"), zero.alias("n_items"), F.lit("").alias("items"))
    return out.unionByName(rest).withColumn("contaminated", F.col("n_hit") > 0)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold windows of ten words of benchmark items. Other columns aren't read."""
    got = contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int | None, str | None]]) -> list[tuple]:
    """What op13 returns, from a dictionary of all windows; for tests."""

    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)

    windows: dict[tuple, set] = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(WINDOW, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[i : i + size])].add(item)
    sizes, out = {len(w) for w in windows}, []
    for doc, text in docs:
        w = words(text)
        hit, of = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (at := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    of |= windows[at]
        ids = sorted(str(i) for i in of if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out
