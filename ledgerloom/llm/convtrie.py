"""A trie of conversation prefixes: rolling fingerprints propose, turns decide, sums go up the branches."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Rows are passed on when they hold so many bytes of text, or so many rows.
HELD, ROWS = 4 << 20, 1 << 16
#: Ids of conversations that end at a node are joined by blocks of so many.
ENDS = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Heads:
    """Conversations that begin with turns of another one: ``base(conv_id)`` is whose, ``many(conv_id)``
    how many of them, ``most`` at most. The base of a base is itself."""

    base: Callable[[Column], Column]
    many: Callable[[int], int]
    most: int


#: The contract's: conversation c has the first crc32(c) % 9 turns of c - c % 5. A negative c has
#: SQL's remainder, of c's sign.
FIVES = Heads(lambda c: c - c % 5, lambda c: zlib.crc32(b"%d" % c) % 9, 8)


class _Rows:
    """Turns of rebuilt conversations in order, and the fingerprints of what they end."""

    def __init__(self, bits: int):
        self.bits = bits
        self.conv, self.depth, self.digest, self.texts = [], [], [], []
        self.size = 0
        self.carry, self.at = np.uint64(0), 0  # of the last conversation so far

    def add(self, conv: int, depth: int, role: bytes, text: bytes) -> None:
        self.conv.append(conv)
        self.depth.append(depth)
        self.digest.append(xxhash.xxh64_intdigest(text, xxhash.xxh64_intdigest(role)) if depth else 0)
        self.texts.append((role, text))
        self.size += len(role) + len(text)

    def full(self) -> bool:
        return self.size > HELD or len(self.conv) >= ROWS

    def flush(self) -> pa.RecordBatch:
        """The fingerprint of d turns is the sum of digest_i * base^i, i <= d: a running sum that
        starts anew with each conversation, the first of which may have begun in an earlier flush."""
        depth, digest = np.array(self.depth, np.int64), np.array(self.digest, np.uint64)
        first = depth == 0
        first[:1] = True
        start = np.flatnonzero(first)
        inner = np.arange(len(depth)) - np.repeat(start, np.diff(np.append(start, len(depth))))
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(depth), _BASE, np.uint64)]), dtype=np.uint64)[inner]
        goes_on = len(depth) > 0 and depth[0] > 0
        begun = np.zeros(len(start), np.uint64)
        if goes_on:
            power[: start[1] if len(start) > 1 else None] *= np.uint64(pow(int(_BASE), self.depth[0], 1 << 64))
            begun[0] = self.carry
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digest * power, dtype=np.uint64)])
        of = np.cumsum(first) - 1
        after = total[1:] - total[start][of] + begun[of]
        before = total[:-1] - total[start][of] + begun[of]
        mark = lambda f, d: self._mark(f + d.astype(np.uint64) * _MIX)
        if len(depth):
            self.carry = after[-1]
        batch = pa.RecordBatch.from_arrays([
            pa.array(self.conv, pa.int64()), pa.array(depth), pa.array(mark(before, np.maximum(depth - 1, 0))), pa.array(mark(after, depth)),
            pa.array([len(t) for _, t in self.texts], pa.int64()), pa.array([r for r, _ in self.texts], pa.binary()).cast(pa.string()), pa.array([t for _, t in self.texts], pa.binary()).cast(pa.string()),
        ], names=["conv_id", "depth", "before", "print", "bytes", "role", "text"])
        self.conv, self.depth, self.digest, self.texts, self.size = [], [], [], [], 0
        return batch

    def _mark(self, x: np.ndarray) -> np.ndarray:
        x = x ^ (x >> np.uint64(31))
        x = x * _MIX
        return ((x ^ (x >> np.uint64(29))) >> np.uint64(64 - self.bits)).view(np.int64) if self.bits else np.zeros(len(x), np.int64)


_PREFIX = "conv_id long, depth long, before long, print long, bytes long, role string, text string"


def _scan(heads: Heads | None, bits: int):
    """Sorted turns, a base before what begins with it. Of a base the first turns are held, of others none."""

    def run(batches):
        rows = _Rows(bits)
        base = conv = None
        head: list[tuple[bytes, bytes]] = []
        seen = depth = skip = 0
        for batch in batches:
            bases, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            roles, texts = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            for i, (b, c) in enumerate(zip(bases, convs, strict=True)):
                role, text = roles[i].as_py(), texts[i].as_py()
                if b != base:
                    base, head = b, []
                if c != conv:
                    conv, seen, depth, skip = c, 0, 0, 0
                    rows.add(c, 0, b"", b"")
                    if heads is not None and c != b:
                        skip = heads.many(c)
                        for r, t in head[:skip]:
                            depth += 1
                            rows.add(c, depth, r, t)
                if heads is not None and c == b and len(head) < heads.most:
                    head.append((role, text))
                if seen >= skip:
                    depth += 1
                    rows.add(c, depth, role, text)
                seen += 1
                if rows.full():
                    yield rows.flush()
        yield rows.flush()

    return run


def prefixes(conversations: DataFrame, heads: Heads | None = None, bits: int = 64) -> DataFrame:
    """(conv_id, depth, before, print, bytes, role, text): a row for each turn, one of depth 0 for
    each conversation, with the fingerprints of what ends before and with the turn."""
    c = F.col("conv_id").cast("long")
    base = c if heads is None else heads.base(c)
    turns = conversations.where("conv_id is not null").select(base.alias("base"), c.alias("conv_id"), *(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("role", "text")), "turn")
    order = turns.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return order.select("base", "conv_id", "role", "text").mapInArrow(_scan(heads, bits), _PREFIX)


_KEY = ["depth", "print", "fork"]


def _forked(rows: DataFrame, forks: DataFrame | None) -> DataFrame:
    """Rows with the forks that their conversation has taken up to them, and before them."""
    if forks is None:
        return rows.withColumns({"fork": F.lit(0).cast("long"), "fork_before": F.lit(0).cast("long")})
    taken = forks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "turn"))).alias("forks"))
    mark = lambda d: F.coalesce(F.when(F.exists("forks", lambda f: f["at"] <= d), F.xxhash64(F.filter("forks", lambda f: f["at"] <= d))), F.lit(0))
    return rows.join(taken, "conv_id", "left").withColumns({"fork": mark(F.col("depth")), "fork_before": mark(F.col("depth") - 1)}).drop("forks")


def _nodes(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows with their fork, nodes): each node is a group of equal fingerprints whose members all have
    the turn of its representative, the smallest conv_id, and what comes before it in one node too.

    By induction from the root that is equality turn by turn. Members with another turn take a
    fork, all of a group the same, and are grouped again, until no group differs. Turns of a
    group are compared in the tasks first, so that one copy of each leaves a task.
    """
    forks, turn = None, 0
    said = F.struct("before", "fork_before", "role", "text")
    while True:
        keyed = _forked(rows, forks)
        groups = keyed.groupBy(*_KEY).agg(F.min("conv_id").alias("first_id"), F.count("*").alias("n"), F.min("bytes").alias("bytes"), F.min("before").alias("before"), F.min("fork_before").alias("fork_before"), F.size(F.collect_set(said)).alias("kinds"))
        nodes = scratch.write(groups)
        if nodes.where("kinds > 1").isEmpty():
            return keyed, nodes
        turn += 1
        mixed = keyed.join(nodes.where("kinds > 1").select(*_KEY, "first_id"), _KEY)
        own = mixed.where("conv_id = first_id").select(*_KEY, said.alias("own"))
        others = mixed.join(own, _KEY).where(said != F.col("own")).groupBy("conv_id").agg(F.min("depth").alias("at")).withColumn("turn", F.lit(turn))
        forks = scratch.write(others if forks is None else forks.unionByName(others))


def _digests(batches):
    """One digest a node from its blocks of ids in order; nothing but the digest is held."""
    node, digest = None, None
    for batch in batches:
        out = []
        for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
            if (conv, depth) != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = (conv, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield _ended(out)
    if node is not None:
        yield _ended([(*node, digest.hexdigest())])


def _ended(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "depth", "ends_sha256"])


def prefix_trie(spark: SparkSession, conversations: DataFrame, heads: Heads | None = None, bits: int = 64) -> DataFrame:
    """The nodes of all prefixes of ``conversations`` (conv_id, turn, role, text), as op11 returns them.

    Turns are ordered by turn, null first; equal ones by role and text. A null role or text is
    empty; rows with a null conv_id belong to no conversation; repeated rows are turns of their
    own; an empty table has no nodes. A long conversation streams through its task, turn by turn.

    A node is known by its smallest member, so each conversation owns a stretch of its own
    prefixes, from where no smaller one shares them. What a stretch sums up goes at once to each stretch
    that it descends from, at the node where it leaves it; a running sum along each stretch then
    gives the subtrees. That is a row for each two stretches met on a path, at most one a turn.
    """
    scratch = Scratch(spark, "trie")
    rows = scratch.write(prefixes(conversations, heads, bits))
    keyed, nodes = _nodes(rows, scratch)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("print"), F.col("fork_before").alias("fork")).agg(F.count("*").alias("n_children"))
    known = scratch.write(nodes.join(children, _KEY, "left").select(*_KEY, "first_id", "n", "bytes", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children")))
    kept = keyed.select("conv_id", *_KEY)
    root = known.where("depth = 0").select("first_id", "n", "bytes", "n_children").first()
    at_root = kept.where("depth = 0").select("conv_id", "depth", *(F.lit(x).cast("long").alias(c) for c, x in zip(("first_id", "n", "bytes", "n_children"), root or [None] * 4, strict=True)))
    path = kept.where("depth > 0").join(known.where("depth > 0"), _KEY).select(*at_root.columns).unionByName(at_root)
    along, whole = Window.partitionBy("conv_id").orderBy("depth"), Window.partitionBy("conv_id")
    own = F.col("first_id") == F.col("conv_id")
    saved = (F.col("n") - 1) * F.col("bytes")
    leaf = (F.col("n_children") == 0).cast("long")
    path = scratch.write(path.select("*", F.lag("first_id").over(along).alias("parent"), F.lead("first_id").over(along).alias("next"), F.sum(F.when(own, saved).otherwise(0)).over(whole).alias("saved"), F.sum(F.when(own, leaf).otherwise(0)).over(whole).alias("leaves")))
    gained = path.where(~own & (F.col("next") != F.col("first_id"))).groupBy(F.col("first_id").alias("conv_id"), "depth").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda now, more: F.sum(now + F.coalesce(more, F.lit(0))).over(up)
    out = path.where(own).select("conv_id", "depth", "parent", "n", "n_children", saved.alias("s"), leaf.alias("l")).join(gained, ["conv_id", "depth"], "left")
    out = out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", total(F.col("l"), F.col("more_leaves")).alias("n_leaves"), total(F.col("s"), F.col("more_saved")).alias("saved_tokens"))
    ends = path.where("next is null").groupBy("first_id", "depth", F.floor(F.col("conv_id") / ENDS).alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    ends = ends.select(F.col("first_id").alias("conv_id"), "depth", "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    ends = ends.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block").mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")
    return out.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of the contract's rebuilt conversations. Other columns aren't read."""
    return prefix_trie(spark, table(spark, sf_dir, "conversations"), FIVES)


def brute_force(rows: list[tuple[int | None, int | None, str | None, str | None]]) -> list[tuple]:
    """What op11 returns, from whole prefixes in memory; for tests."""
    own: dict[int, list] = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    members: dict[tuple, list[int]] = defaultdict(list)
    ends: dict[tuple, list[int]] = defaultdict(list)
    for c in sorted(own):
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        turns = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    below: dict[tuple, list] = defaultdict(list)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in below[p]) or 1
        saved[p] = sum(saved[q] for q in below[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), leaves[p], saved[p], digest(sorted(ends[p]))) for p, m in members.items()]
