"""Byte-level BPE: higher-order functions fold ranked merges over the bytes of distinct words.

Every different word of all documents is folded once, and its ids are brought back to the
documents that have it. The plan of one query, in packed blobs:

1. documents become batches: a list of the batch's different words, and each text as places in
   that list; words are sent to buckets by their hash, texts to the home of their batch;
2. a bucket's different words are folded by Spark, with the ranks as a literal of the plan, and
   each batch gets the ids of its words in the order in which it sent them;
3. at home the places become ids.

A batch is held by one task at a time and bounded in bytes of text and in words; a bucket holds
different words only, however often they occur. Words that are tokens by themselves need no
fold. All steps give the same result when a lost task runs again; a batch whose replies don't
fit its words, as its rows came in another order, fails instead of giving wrong ids.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, even_keys, file_bytes, let, parallelism, table

#: Bytes of text, and different words, after which a batch ends.
BATCH, FREQUENT = 8 << 20, 1 << 20
#: Words of more bytes are folded with a heap, in n log n: a fold by higher-order functions
#: passes over what is left of the word at every merge. The ids are the same.
LONG = 48
NEVER = 2_000_000_000
#: The pair table has two places for each pair of ids.
PLACES = 1_048_573
_A, _B, _P, _Q = 433_494_437, 402_653_189, 2_147_483_647, 2_147_483_629


def load_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file_bytes(path).splitlines())}


def merge(parts: list[int], rank) -> list[int]:
    """Ids after all merges, the pair of lowest rank first and of equal ones the leftmost."""
    while len(parts) > 1:
        best, at = min((rank(a, b), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best == NEVER:
            break
        parts = [*parts[:at], best, *parts[at + 2 :]]
    return parts


def merge_long(parts: list[int], rank) -> list[int]:
    """As ``merge``, with a heap of pairs and links between what is left."""
    n = len(parts)
    after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank(a, b)) != NEVER]
    heapq.heapify(heap)
    parts = list(parts)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j] = r, False
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (got := rank(r, parts[k])) != NEVER:
                heapq.heappush(heap, (got, i, r, parts[k]))
        if (h := before[i]) >= 0 and (got := rank(parts[h], r)) != NEVER:
            heapq.heappush(heap, (got, h, parts[h], r))
    return [p for p, ok in zip(parts, alive, strict=True) if ok]


class Vocabulary:
    """Ranks as tables: ids of bytes, and ids of pairs for the plan."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= (1 << 17) - 1 or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks have all single bytes and are below 2 ** 17 - 1")
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    pairs[a << 17 | b] = rank
        self.slots, self.pairs = self._places(pairs), pairs
    @staticmethod
    def _places(pairs: dict[int, int]) -> np.ndarray:
        """Cuckoo hashing: key << 17 | id is at one of the key's two places, 0 elsewhere."""
        at: dict[int, tuple[int, int]] = {}
        for key, value in pairs.items():
            item, place = (key, value), key * _A % _P % PLACES
            for _ in range(500):
                item, at[place] = at.get(place), item
                if item is None:
                    break
                first, second = item[0] * _A % _P % PLACES, item[0] * _B % _Q % PLACES
                place = second if place == first else first
            else:
                raise ValueError("the pair table is too full")
        slots = np.zeros(PLACES, np.int64)
        for place, (key, value) in at.items():
            slots[place] = key << 17 | value
        return slots

    def frame(self, spark: SparkSession) -> DataFrame:
        """The pairs as one row; as a scalar subquery they are a literal of the plan."""
        return spark.createDataFrame(pa.table({"slots": pa.array([self.slots.tolist()], pa.list_(pa.int64()))})).coalesce(1)


def _rank(slots: Column, a: Column, b: Column) -> Column:
    key = a.cast("long") * (1 << 17) + b

    def found(s: Column) -> Column:
        return F.when(F.shiftright(s, 17) == key, s.bitwiseAND((1 << 17) - 1).cast("int"))

    return F.coalesce(found(F.get(slots, (key * _A % _P % PLACES).cast("int"))), found(F.get(slots, (key * _B % _Q % PLACES).cast("int"))), F.lit(NEVER))


def _fold(start: Column, ranks: Column, slots: Column) -> Column:
    """Ids after all merges of ``start``, ids of bytes between two that pair with nothing,
    whose pairs have ``ranks``.

    One merge a step, ranks kept beside the ids; only the two ranks beside a merge are
    looked up anew. A word of n bytes takes n - 1 steps, each a pass over what is left.
    """

    def step(acc: Column, _: Column) -> Column:
        ids, ranks = acc["ids"], acc["ranks"]

        def merged(m: Column) -> Column:
            best, at = m["best"], m["at"]  # from 1; the first and the last pair never merge
            beside = F.array(_rank(slots, F.get(ids, at - 2), best), _rank(slots, best, F.get(ids, at + 1)))
            new_ids = F.concat(F.slice(ids, F.lit(1), at - 1), F.array(best), F.slice(ids, at + 2, F.size(ids)))
            new_ranks = F.concat(F.slice(ranks, F.lit(1), at - 2), beside, F.slice(ranks, at + 2, F.size(ids)))
            return F.struct(new_ids.alias("ids"), new_ranks.alias("ranks"))

        best = F.array_min(ranks)
        go = let(F.struct(best.alias("best"), F.array_position(ranks, best).cast("int").alias("at")), merged)
        return F.when(best == NEVER, acc).otherwise(go)

    def all_steps(begun: Column) -> Column:
        return F.aggregate(F.slice(begun["ids"], F.lit(4), F.size(begun["ids"])), begun, step, lambda acc: F.slice(acc["ids"], F.lit(2), F.size(acc["ids"]) - 2))

    return let(F.struct(start.alias("ids"), ranks.alias("ranks")), all_steps)


#: Pairs with nothing: its keys are at no place or are those of the last id, which no token has.
EDGE = -1


def bound(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with __bound, the only value of ``one``: a scalar subquery, which the plan
    holds once a task as a literal. Used once above, it is no column of any row."""
    return df.withColumn("__bound", one.scalar())


def _press(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one blob: sizes, then their bytes compressed."""
    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    body = b"".join(raw)
    sizes = np.array([len(raw), len(body), *map(len, raw)], "<u8").tobytes()
    return sizes + pa.compress(body, codec="zstd", asbytes=True)


def _unpress(blob: bytes) -> list[bytes]:
    n, total = (int(x) for x in np.frombuffer(blob, "<u8", 2))
    body = pa.decompress(blob[16 + 8 * n :], total, codec="zstd", asbytes=True)
    ends = np.cumsum(np.frombuffer(blob, "<u8", n, 16)).tolist()
    return [body[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]


def _spans(lengths: np.ndarray) -> np.ndarray:
    """Starts of consecutive spans, and the end."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _gathered(pool: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Spans of ``pool`` one after another."""
    at = _spans(count)
    return pool[np.repeat(start - at[:-1], count) + np.arange(at[-1])]


def _home(batch: int) -> int:
    """The key of a batch's texts; keys of buckets aren't negative."""
    return -1 - batch


class _Places(dict):
    """Words to their places in order of sight."""

    def __missing__(self, word):
        self[word] = place = len(self)
        return place


PACKED = "key long, batch long, bucket int, blob binary"


def _pack(shared, names: list[int], pattern: str, most_bytes: int, most_words: int):
    """Step 1. A bucket's key has words; a home's has the batch's texts as places, the buckets
    of its words, the ids of words that are tokens, and the columns kept."""

    def closed(batch: int, places: _Places, codes: list, rows: list) -> pa.RecordBatch:
        ranks = shared.value
        words = [w.encode() for w in places]
        own = [ranks.get(w, -1) for w in words]
        # 16 bits name the bucket of a word, the last number a token.
        bucket = np.fromiter((0xFFFF if r >= 0 else xxhash.xxh64_intdigest(w) % len(names) for w, r in zip(words, own, strict=True)), "<u2", len(words))
        order = np.argsort(bucket, kind="stable")
        sorted_ = bucket[order]
        out = []
        for k in np.unique(sorted_[sorted_ != 0xFFFF]).tolist():
            a, z = np.searchsorted(sorted_, [k, k + 1])
            mine = [words[i] for i in order[a:z].tolist()]
            out.append((names[k], batch, k, _press(np.array([len(w) for w in mine], "<u4"), b"".join(mine))))
        own = np.array(own, np.int64)
        kept = pa.Table.from_batches(rows).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept.schema) as writer:
            writer.write_table(kept)
        lengths = np.array([len(c) for c in codes], "<u4")
        flat = np.concatenate(codes) if codes else np.empty(0, "<u4")
        # Low and high halves apart: the high ones are mostly zero.
        blob = _press(bucket, own[own >= 0].astype("<u4"), lengths, flat.astype("<u2"), (flat >> 16).astype("<u2"), sink.getvalue().to_pybytes())
        out.append((_home(batch), batch, -1, blob))
        columns = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "batch", "bucket", "blob"])

    def run(batches):
        find = regex.compile(pattern).findall
        batch = TaskContext.get().partitionId() << 24
        places, codes, rows, held = _Places(), [], [], 0
        for b in batches:
            texts, kept = b.column(0), b.select(b.schema.names[1:])
            since = 0
            for i in range(b.num_rows):
                text = texts[i].as_py() or ""
                words = find(text)
                codes.append(np.fromiter(map(places.__getitem__, words), "<u4", len(words)))
                held += len(text) + 64
                if held > most_bytes or len(places) > most_words:
                    rows.append(kept.slice(since, i + 1 - since))
                    since = i + 1
                    yield closed(batch, places, codes, rows)
                    batch += 1
                    places, codes, rows, held = _Places(), [], [], 0
            if since < b.num_rows:
                rows.append(kept.slice(since))
        if rows:
            yield closed(batch, places, codes, rows)

    return run


STREAM = "batch long, bucket int, blob binary, start array<int>, ranks array<int>, done array<int>"


class Pairs:
    """Ranks of many pairs of ids at once, and of one."""

    def __init__(self, pairs: dict[int, int]):
        self.one = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def __call__(self, a: int, b: int) -> int:
        return self.one.get(a << 17 | b, NEVER)

    def beside(self, ids: np.ndarray) -> np.ndarray:
        """The rank of each id and the one after it; EDGE pairs with nothing."""
        key = (ids[:-1].astype(np.int64) << 17) | ids[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (ids[:-1] >= 0) & (ids[1:] >= 0), self.ranks[at], NEVER).astype(np.int32)


def _distinct(byte_ids: list[int], pairs):
    """Step 2, before the fold: a row for each different word of a bucket, then one for each
    batch with the places of its words among them."""
    table_ = np.array(byte_ids, np.int32)

    def run(group: pa.Table) -> pa.Table:
        ints = pa.list_(pa.int32())
        schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary()), ("start", ints), ("ranks", ints), ("done", ints)])
        if group.column("key")[0].as_py() < 0:
            return schema.empty_table()
        place, sent = _Places(), []
        for blob in group.column("blob"):
            lengths, body = _unpress(blob.as_py())
            at = _spans(np.frombuffer(lengths, "<u4")).tolist()
            sent.append(np.fromiter((place[body[a:z]] for a, z in zip(at, at[1:], strict=False)), "<u4", len(at) - 1).tobytes())
        words = list(place)
        short = np.array([len(w) <= LONG for w in words], bool)
        # Ids of the bytes of short words, each word between two edges, and the ranks of their pairs.
        sizes = np.array([len(w) + 2 for w, ok in zip(words, short, strict=True) if ok], np.int64)
        ends = _spans(sizes)
        flat = np.full(ends[-1], EDGE, np.int32)
        inner = np.ones(len(flat), bool)
        inner[ends[:-1]] = inner[ends[1:] - 1] = False
        flat[inner] = table_[np.frombuffer(b"".join(w for w, ok in zip(words, short, strict=True) if ok), np.uint8)]
        beside = pairs.value.beside(flat)
        last = np.ones(len(beside), bool)
        last[ends[1:-1] - 1] = False  # the last id of a word and the first of the next are no pair
        n, m = len(words), len(sent)
        nulls = np.concatenate([~short, np.ones(m, bool)])

        def lists(values: np.ndarray, size: np.ndarray) -> pa.Array:
            each = np.zeros(n + m, np.int64)
            each[np.flatnonzero(~nulls)] = size
            return pa.ListArray.from_arrays(pa.array(_spans(each).astype(np.int32), mask=np.concatenate([nulls, [False]])), pa.array(values, pa.int32()))

        done = [None if ok else merge_long(table_[np.frombuffer(w, np.uint8)].tolist(), pairs.value) for w, ok in zip(words, short, strict=True)]
        columns = [pa.array([None] * n + group.column(c).to_pylist(), k) for c, k in (("batch", pa.int64()), ("bucket", pa.int32()))]
        columns += [pa.array([None] * n + sent, pa.binary()), lists(flat, sizes), lists(beside[last], sizes - 1), pa.array(done + [None] * m, ints)]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def _replies(batches):
    """Step 2, after it: to each batch the numbers of ids of its words, and the ids."""
    count, pool, start, closed = [], [], None, False
    for b in batches:
        is_word = b.column(0).is_null().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(is_word.astype(np.int8))) + 1
        for a, z in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
            if a == z:
                continue
            part = b.slice(a, z - a)
            if is_word[a]:
                if closed:
                    count, pool, closed = [], [], False
                ids = part.column(3)
                count.append(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64))
                pool.append(ids.flatten().to_numpy().astype("<u4"))
                continue
            if not closed:
                count, pool, closed = np.concatenate(count), np.concatenate(pool), True
                start = _spans(count)[:-1]
            out = []
            for batch, bucket, blob in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                at = np.frombuffer(blob, "<u4")
                out.append((_home(batch), bucket, _press(count[at].astype("<u4"), _gathered(pool, start[at], count[at]))))
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "bucket", "blob"])


def _unpack(columns: list[str]):
    """Step 3. The kept columns of a batch, and ids."""

    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows or group.column("key")[0].as_py() >= 0:
            return None
        bucket, own, lengths, low, high, kept = _unpress(group.column("blob")[0].as_py())
        bucket, own, lengths = np.frombuffer(bucket, "<u2"), np.frombuffer(own, "<u4"), np.frombuffer(lengths, "<u4")
        order = np.argsort(np.where(bucket == 0xFFFF, 0, bucket + np.int64(1)), kind="stable")  # tokens first
        count, pool = [np.ones(len(own), np.int64)], [own]
        for i in np.argsort(replies.column("bucket").to_numpy()).tolist():
            a, b = _unpress(replies.column("blob")[i].as_py())
            count.append(np.frombuffer(a, "<u4").astype(np.int64))
            pool.append(np.frombuffer(b, "<u4"))
        count, pool = np.concatenate(count), np.concatenate(pool)
        if len(count) != len(bucket):
            raise RuntimeError("a batch's replies don't fit its words: its rows came in another order")
        first = np.empty(len(order), np.int64)
        first[order] = _spans(count)[:-1]
        each = np.empty(len(order), np.int64)
        each[order] = count
        codes = np.frombuffer(low, "<u2").astype(np.int64) | np.frombuffer(high, "<u2").astype(np.int64) << 16
        at, ids, sizes = _spans(lengths), [], []
        for s, e in chunks(lengths.tolist(), 1 << 18):
            mine = codes[at[s] : at[e]]
            ids.append(_gathered(pool, first[mine], each[mine]).astype(np.int32))
            ends = _spans(each[mine])
            sizes.append(np.diff(ends[at[s : e + 1] - at[s]]))
        offsets = _spans(np.concatenate(sizes) if sizes else np.empty(0, np.int64)).astype(np.int32)
        out = pa.ipc.open_stream(kept).read_all().rename_columns(columns)
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        return out.append_column("__ids", pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))

    return run


def encode(spark: SparkSession, docs: DataFrame, ranks: dict[bytes, int], pattern: str, frequent: int = FREQUENT, keep: list[str] | None = None, batch_bytes: int = BATCH) -> DataFrame:
    """``docs`` (columns ``keep``) with a column ids, the tokens of the whole text; null text is empty.

    Each match of ``pattern`` is encoded by itself: a token if it is one, else its bytes
    after all merges, that of lowest rank first and of equal ranks the leftmost. A batch
    ends after ``batch_bytes`` or ``frequent`` different words; results don't depend on
    it. Repeated rows and shared doc_ids are encoded each; a kept column named ids gives
    way to it; an empty table gives an empty result.
    """
    vocabulary, n = Vocabulary(ranks), parallelism(spark)
    names = even_keys(spark, n, kind="bigint")
    if len(names) >= 0xFFFF:
        names = names[:0xFFFE]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "ids"]
    inner = [f"__{i}" for i in range(len(keep))]
    kinds = [docs.select(f"`{c}`").schema[0].dataType.simpleString() for c in keep]
    rows = docs.select(F.col("text").cast("string").alias("__text"), *(F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner, strict=True)))
    context = spark.sparkContext
    packed = rows.mapInArrow(_pack(context.broadcast(ranks), names, pattern, batch_bytes, frequent), PACKED).repartition(n, "key")
    words = packed.groupBy("key").applyInArrow(_distinct(vocabulary.byte_ids, context.broadcast(Pairs(vocabulary.pairs))), STREAM)
    slots = vocabulary.frame(spark)
    folded = let(F.col("__bound"), lambda t: F.coalesce("done", F.when(F.col("start").isNotNull(), _fold(F.col("start"), F.col("ranks"), t))))
    replies = bound(words, slots).select("batch", "bucket", "blob", folded.alias("ids")).mapInArrow(_replies, "key long, bucket int, blob binary").repartition(n, "key")
    schema = ", ".join([*(f"`{i}` {k}" for i, k in zip(inner, kinds, strict=True)), "__ids array<int>"])
    out = packed.groupBy("key").cogroup(replies.groupBy("key")).applyInArrow(_whole(_unpack(inner), schema, inner, rows), schema)
    return out.select(*(F.col(i).alias(c) for i, c in zip(inner, keep, strict=True)), F.col("__ids").alias("ids"))


def _whole(run, schema: str, inner: list[str], rows: DataFrame):
    """``run`` with an empty table where it gives none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType([rows.schema[i] for i in inner])).append(pa.field("__ids", pa.list_(pa.int32()))).empty_table()

    def either(group: pa.Table, replies: pa.Table) -> pa.Table:
        got = run(group, replies)
        return empty if got is None else got

    return either


def decode(spark: SparkSession, encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with a column decoded: the binary pieces of ids, one after another.

    Null ids give null, an empty list empty bytes; other columns stay.
    """
    shared = spark.sparkContext.broadcast({r: t for t, r in ranks.items()})

    def run(batches):
        piece = shared.value.__getitem__
        for b in batches:
            out = [None if ids is None else b"".join(map(piece, ids)) for ids in (x.values.to_numpy().tolist() if x.is_valid else None for x in b.column(0))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "__decoded"])

    columns = [c for c in encoded.columns if c != "decoded"]
    inner = [f"__{i}" for i in range(len(columns))]
    rows = encoded.select(F.col("ids").alias("__ids"), *(F.col(f"`{c}`").alias(i) for c, i in zip(columns, inner, strict=True) if c != "ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", __decoded binary"
    got = rows.mapInArrow(run, schema)
    return got.select(*((F.col("__ids") if c == "ids" else F.col(i)).alias(c) for c, i in zip(columns, inner, strict=True)), F.col("__decoded").alias("decoded"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = decode(spark, encode(spark, table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep=["doc_id"]), ranks)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
