"""Spelling variants: words that differ by one letter, found by rolling hashes of their deletions."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunks, table

#: Words are runs of A-Z, a-z and U+00C0 to U+00FF, whose UTF-8 is C3 80 to C3 BF.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: A task's counts are passed on when it holds so many different words.
HELD = 200_000
#: One occurrence in NOISE of the contract's words loses a letter.
NOISE = 97

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def noisy(doc_id: int | None) -> Callable[[bytes], bytes]:
    """The contract's change of a run: where NOISE divides the crc32 h of ``<doc_id>:<run>``, its
    code point h % length goes. A null doc_id counts as an empty one."""
    seed = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)

    def change(run: bytes) -> bytes:
        h = zlib.crc32(run, seed)
        if h % NOISE:
            return run
        s = run.decode()
        k = h % len(s)
        return (s[:k] + s[k + 1 :]).encode()

    return change


def _count(change: Callable[[int | None], Callable[[bytes], bytes]] | None, least: int):
    def out(counts: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        counts: dict[bytes, int] = {}
        for batch in batches:
            for doc, cell in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                text = (cell.as_py() or b"").lower()  # bytes: ASCII letters only
                # A long text's runs aren't listed at once.
                found = RUN.findall(text) if len(text) < 1 << 20 else (m.group() for m in RUN.finditer(text))
                own = change(doc) if change else None
                for word, n in Counter(found).items():
                    if len(word) >= least:
                        word = own(word) if own else word
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > HELD:
                    yield out(counts)
                    counts = {}
        yield out(counts)

    return run


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, change: Callable[[int | None], Callable[[bytes], bytes]] | None = None) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text): lower-cased runs of at least ``least_length`` code
    points that occur ``least_count`` times or more. ``change(doc_id)`` gives what becomes of a run.

    Counts are summed in the tasks before they are dealt out by word.
    """
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_count(change, least_length), "word string, n long")
    return found.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _spread(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(32)
    x *= _MIX
    return x ^ (x >> np.uint64(29))


def deletion_keys(words: list[str], bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word's index, position, key) of every word and of every deletion of one code point.

    A key is the polynomial hash of the string that is left; the position is -1 for the word
    itself. It is put together from the hash of the prefix and that of the suffix moved down by one.
    """
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(size.max(initial=0)), _BASE, np.uint64)]), dtype=np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    pos = np.arange(len(flat)) - start[word]
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_spread(flat + np.uint64(1)) * power[pos], dtype=np.uint64)])
    before, whole = prefix[:-1] - prefix[start[word]], prefix[start + size] - prefix[start]
    after = prefix[(start + size)[word]] - prefix[1:]
    left = before + after * np.uint64(pow(_BASE, -1, 1 << 64))
    key = np.concatenate([whole, left]) ^ _spread(np.concatenate([size, size[word] - 1]).astype(np.uint64))
    key = _spread(key) >> np.uint64(64 - bits)
    return np.concatenate([np.arange(len(words)), word]), np.concatenate([np.full(len(words), -1), pos]), key.view(np.int64)


def _emit_keys(bits: int):
    def run(batches):
        for batch in batches:
            ids, counts = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            words = batch.column(1).to_pylist()
            for a, z in chunks(list(map(len, words)), 1 << 18):
                word, pos, key = deletion_keys(words[a:z], bits)
                for s in range(0, len(key), 1 << 16):
                    cut = slice(s, s + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array(ids[a:z][word[cut]]), pa.array(pos[cut], pa.int32()), pa.array(counts[a:z][word[cut]])], names=["key", "id", "pos", "n"])

    return run


def _shared(batches):
    """Of rows sorted by key those whose key another row has."""
    last = None
    for batch in itertools.chain(batches, [None]):
        now = pa.table({c: [] for c in ()}) if batch is None else pa.Table.from_batches([batch])
        if batch is not None and not batch.num_rows:
            continue
        held = now if last is None else last if batch is None else pa.concat_tables([last, now])
        if not held.num_rows:
            continue
        key = held.column("key").to_numpy()
        # The last row waits for what follows; with it goes the row before, which tells whether its key is shared.
        end = len(key) if batch is None else len(key) - 1
        same = key[1:] == key[:-1]
        many = np.zeros(len(key), bool)
        many[1:] |= same
        many[:-1] |= same
        begin = 0 if last is None or last.num_rows < 2 else 1
        yield from held.slice(begin, end - begin).filter(pa.array(many[begin:end])).to_batches()
        last = held.slice(max(0, len(key) - 2))


def _rest(word: str, pos: int) -> str:
    return word if pos < 0 else word[:pos] + word[pos + 1 :]


def near_in(rows: list[tuple[int, str, int, int]]) -> Iterator[tuple[int, int, int, str]]:
    """(id, number of near words, largest n among them, its word) from the rows (id, word, n,
    pos) that share a key. What is left of the words decides; a key that different strings share falls apart.

    Words with the same rest and position differ by that letter alone. A word that is
    another one's rest lacks one letter of it; of equal letters in a row the first counts.
    """
    by_rest: dict[str, list] = defaultdict(list)
    for row in rows:
        by_rest[_rest(row[1], row[3])].append(row)
    for group in by_rest.values():
        if len(group) < 2:
            continue
        at: dict[int, list] = defaultdict(list)
        for row in group:
            at[row[3]].append(row)
        whole = at.pop(-1, [])
        for same in at.values():
            if len(same) > 1:
                first, second = sorted(same, key=lambda r: (-r[2], r[1]))[:2]
                for r in same:
                    best = second if r[0] == first[0] else first
                    yield r[0], len(same) - 1, best[2], best[1]
        longer = [r for same in at.values() for r in same if not r[3] or r[1][r[3] - 1] != r[1][r[3]]]
        for w in whole:  # one at most, as words are distinct
            if longer:
                best = min(longer, key=lambda r: (-r[2], r[1]))
                yield w[0], len(longer), best[2], best[1]
            for r in longer:
                yield r[0], 1, w[2], w[1]


def _near(batches):
    """near_in over rows sorted by key; the rows of a key are few, as letters are."""
    kind = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def out(rows):
        return pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], kind)

    held, key, got, size = [], None, [], 0
    for batch in batches:
        for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "word", "n", "pos")), strict=True):
            if k != key:
                for r in near_in(held):
                    got.append(r)
                    size += len(r[3])
                held, key = [], k
                if len(got) > 1 << 14 or size > 1 << 22:
                    yield out(got)
                    got, size = [], 0
            held.append(tuple(row))
    yield out([*got, *near_in(held)])


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of the rows (word, form): forms are followed to the last, two, four, eight ...
    steps at once. n doubles at each step, so that six rounds reach the end of any long."""
    now = scratch.write(forms.select("word", F.col("form").alias("at")))
    while True:
        on = now.select(F.col("word").alias("at"), F.col("at").alias("on"))
        step = scratch.write(now.join(on, "at", "left").select("word", F.coalesce("on", "at").alias("at"), F.col("on").isNotNull().alias("moved")))
        scratch.drop(now)
        now = step.select("word", "at")
        now._scratch_path = step._scratch_path
        if step.where("moved").isEmpty():
            return now.select("word", F.col("at").alias("root"))


def spelling_variants(spark: SparkSession, words: DataFrame, ratio: float = RATIO, bits: int = 64) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n), each word once.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point.
    form is the near word of largest n (ties: the smallest in code-point order), if that n is
    ``ratio`` times the word's or more; root follows forms to the last. Every word and each of
    its deletions is filed under a 64-bit key; keys are dealt out and sorted, rows whose key no
    other has go, and the strings of the others decide. Rows hold no strings until then, so
    that a word of a million letters costs a million small rows. At most some ninety letters
    fit in a gap, so a key's rows are few, whatever the input. Words are any strings; a null
    word goes; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "spelling")
    held = scratch.write(words.where("word is not null").select(F.monotonically_increasing_id().alias("id"), F.col("word").cast("string"), F.col("n").cast("long")))
    keyed = held.mapInArrow(_emit_keys(bits), "key long, id long, pos int, n long")
    shared = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, id long, pos int, n long")
    spelt = shared.join(held.select("id", "word"), "id").select("key", "id", "word", "n", "pos")
    near = spelt.repartition("key").sortWithinPartitions("key").mapInArrow(_near, "id long, near long, best_n long, best string")
    least = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    best = near.groupBy("id").agg(F.sum("near").alias("n_near"), least.alias("best"))
    high = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    rows = held.join(best, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(high, F.col("best.word")).alias("form"), F.when(high, -F.col("best.less")).alias("form_n"))
    rows = scratch.write(rows)
    roots = _roots(rows.where("form is not null"), scratch)
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole texts, a letter lost here and there as the contract has it, with their forms.

    Null texts have no words; repeated rows count as often as they occur; other columns aren't read.
    """
    return spelling_variants(spark, word_counts(table(spark, sf_dir, "documents"), change=noisy))


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """What op12 returns, by comparing all words of about one length; for tests."""
    counts: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % NOISE == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= LEAST_LENGTH and n >= LEAST_COUNT}

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, others in found.items():
        if others and words[best := min(others, key=lambda v: (-words[v], v))] >= RATIO * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(found[w]), words[form[w]] if w in form else None))
    return out
