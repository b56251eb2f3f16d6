"""Best-fit packing by minimum bin slack over a histogram of lengths."""

from __future__ import annotations

import os
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, chunks, file_bytes, table
from .letters import SHAPE, Letters, letter_ranks

CAPACITY = 4096
#: The id that ends a document.
END = 1
#: Entries of a generation of a worker's memory of encoded words.
REMEMBERED = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Words(dict):
    """White-space-free words to their ids as bytes, in two generations of bounded size.

    The tokenizer drops white space and no token spans it, so that a text's ids are
    those of its words. Only space, tab, line feed and carriage return split here.
    Words of letters and punctuation after them go to ``Letters``, all others and the
    punctuation to the tokenizer.
    """

    def __init__(self, data: bytes, limit: int = REMEMBERED, ranks: dict[bytes, int] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_str(data.decode())
        # Strings like those of special tokens are ordinary text, as the vocabulary's notes have it.
        self.encoder.encode_special_tokens = True
        self.limit, self.old = limit, {}
        self.letters, self.tails = Letters(ranks) if ranks else None, {"": b""}

    def learn(self, words: set[str]) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        new = []
        for w in words - self.keys():
            if (got := self.old.get(w)) is None:
                new.append(w)
            else:
                self[w] = got
        if self.letters and new:
            shapes = SHAPE.findall("\n".join(new))
            easy = [(w, s[0], s[1]) for w, s in zip(new, shapes, strict=True) if s[0]]
            new = [w for w, s in zip(new, shapes, strict=True) if not s[0]]
            if len(self.tails) > self.limit:
                self.tails = {"": b""}
            unknown = list({tail for _, _, tail in easy} - self.tails.keys())
            self.tails.update(zip(unknown, self.slow(unknown), strict=True))
            tails = self.tails
            self.update(zip([w for w, _, _ in easy], [ids + tails[e[2]] for ids, e in zip(self.letters.encode([c for _, c, _ in easy]), easy, strict=True)], strict=True))
        self.update(zip(new, self.slow(new), strict=True))

    def slow(self, words: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in self.encoder.encode_batch_fast(words, add_special_tokens=False))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit numbers."""
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        self.learn({w for words in split for w in words})
        get = self.__getitem__
        return [b"".join(map(get, words)) for words in split]


_words: dict[int, Words] = {}


def token_pieces(docs: DataFrame, tokenizer: bytes, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of at most ``capacity`` ids that the documents' ids are cut into.

    A document's ids are those of its whole text (null: empty) and ``end``; only a
    longer document is cut. Every row of ``docs`` gives a piece at least.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer, letter_ranks(tokenizer)))
    key = zlib.crc32(tokenizer)
    tail, size = struct.pack("<I", end), 4 * capacity

    def run(batches):
        if key not in _words:
            _words[key] = Words(shared.value[0], ranks=shared.value[1])
        words = _words[key]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows = []
            for s, e in chunks(texts.is_valid().to_numpy(zero_copy_only=False) * 4096, 1 << 20):
                for doc, got in zip(ids[s:e], words.encode([t or "" for t in texts[s:e].to_pylist()]), strict=True):
                    got += tail
                    for k, at in enumerate(range(0, len(got), size)):
                        part = got[at : at + size]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def fullest(available: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """(length, how many) of the combination of largest sum within ``room``.

    ``available`` has (length, count) with falling lengths. A bitset holds the sums
    that can be reached; counts are taken in powers of two. Stops when ``room`` is met.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length, count in available:
        if length > room:
            continue
        left, take = min(count, room // length), 1
        while left and not reach >> room & 1:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    best, used = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            used[length] += take
            best -= length * take
    return sorted(used.items(), reverse=True)


def slack_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum bin slack: (bins, [(length, how many in each bin), ...]) until nothing is left.

    A bin takes the longest piece left and the fullest combination for the rest. The
    same combination is taken again while its pieces last, so that the number of
    patterns depends on the number of different lengths and not of pieces.
    """
    left, out = {k: v for k, v in sorted(counts.items(), reverse=True) if v > 0}, []
    while left:
        longest = next(iter(left))
        rest = [(k, v - (k == longest)) for k, v in left.items() if v > (k == longest)]
        use = Counter(dict(fullest(rest, capacity - longest)))
        use[longest] += 1
        bins = min(left[k] // m for k, m in use.items())
        out.append((bins, sorted(use.items(), reverse=True)))
        for k, m in use.items():
            left[k] -= bins * m
            if not left[k]:
                del left[k]
    return out


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table, PIECES) with sequence_id and offset.

    Pieces of a length are numbered without gaps: counts of (length, bucket of a
    hash) give each bucket its first number, and a bucket is numbered by itself, so
    that a length that very many pieces share is no single task. The driver sees
    the histogram (at most ``capacity`` rows) and plans patterns; a piece's length
    and number then say which bin of which pattern takes it, and where.
    """
    buckets = max(1024, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)).cast("int")
    pieces = pieces.withColumn("bucket", spread)
    counts = pieces.groupBy("length", "bucket").count()
    plan = slack_patterns({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    turn = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = pieces.withColumn("turn", turn).join(bases, ["length", "bucket"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("turn") - 1).alias("number"))

    # (length, first number, how many a bin, first bin, offset): at most capacity lengths in each of few patterns.
    taken: Counter = Counter()
    rows, bin_ = [], 0
    for bins, use in plan:
        offset = 0
        for length, m in use:
            rows.append((length, taken[length], m, bin_, offset))
            taken[length] += m * bins
            offset += length * m
        bin_ += bins
    rows.sort()
    shared = spark.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 5))

    def run(batches):
        slots = shared.value
        keys = slots[:, 0] * (1 << 48) + slots[:, 1]
        for batch in batches:
            length, number = (batch.column(k).to_numpy().astype(np.int64) for k in (3, 5))
            s = slots[np.searchsorted(keys, length * (1 << 48) + number, "right") - 1]
            bin_, slot = np.divmod(number - s[:, 1], s[:, 2])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(s[:, 3] + bin_), pa.array(s[:, 4] + slot * length)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Each piece of each document with its sequence and its offset there.

    Null and empty texts are a piece of one id; a long text is cut into as many pieces as it
    takes; strings like ``<|endoftext|>`` in a text are ordinary text. Repeated rows and
    repeated doc_ids are packed each for itself; pieces of equal length are interchangeable;
    other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "packing")
    return pack(spark, scratch.write(token_pieces(docs, file_bytes(tokenizer_path), capacity)), capacity)


def _path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"), _path())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sequences of what the other stages kept."""
    return pack_documents(spark, docs, _path())
