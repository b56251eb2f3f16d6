"""Suffix-array dedup: bytes of 50-byte strings that an earlier document has too.

All strings of ``span`` bytes are compared, over all documents, without dealing out
every suffix. A window of ``span`` bytes is filed under the smallest hash of its
``GRAM``-byte strings, so equal windows are filed alike, and consecutive windows
mostly share their key. The plan of one query, in packed blobs between groups of
documents (batches) and of keys (buckets), each dealt evenly:

1. a batch sends the different keys of its windows to their buckets;
2. a bucket answers with the keys that two documents or more have, and says which
   of them are hot, that is, have very many different regions;
3. a batch sends the regions of windows under those keys (each different region once);
   windows of a hot key are filed one by one, by a hash of the window itself;
4. a bucket sorts all windows of its regions by bucket-pointer refinement, a part of
   its keys after the other, and answers with the smallest doc_id of each window;
5. a batch cuts what its documents share with a smaller doc_id.

Batches are counted from the bytes of all texts, so that a task holds about BATCH bytes
of text, or the regions of a bucket, at a time. A blob has one key at least: blobs grow
with batches times buckets only until then. Texts are dealt out once; the three steps
that read them share that exchange. All functions give the same result when a lost task
runs again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, even_keys, parallelism, table

SPAN = 50
#: Bytes of text that a batch is meant to hold; there are as many buckets as batches.
BATCH = 4 << 20
#: Parts of a bucket, by key, that are sorted one after another; a power of two, 256 at most.
PARTS = 16
#: A key with more regions over all batches, of many kinds, is hot.
HOT = 1 << 15
#: Bytes of a string that is hashed to choose a window's key; 16 to 24.
GRAM = 20
BLOB = "batch int, bucket int, blob binary"
_K1, _K2, _K3, _K4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _loads(buf: np.ndarray, n: int, at: int) -> np.ndarray:
    """n unaligned little-endian 8-byte loads, one from each byte on, from ``at``."""
    return np.ndarray(n, "<u8", buf, at, (1,)).copy()


def window_keys(buf: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """The key of the window at each byte of ``buf`` (padded by ``span`` zero bytes or more),
    and the hash of the ``GRAM`` bytes there."""
    n = len(buf) - span
    m = n + span - GRAM
    words = _loads(buf, m + GRAM - 8, 0)
    h = words[:m] * _K1
    h += words[8 : m + 8] * _K2
    h += words[GRAM - 8 : m + GRAM - 8] * _K3
    h ^= h >> np.uint64(31)
    h *= _K4
    h ^= h >> np.uint64(29)
    grams = h
    width, have = span - GRAM + 1, 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < width:
        h = np.minimum(h[: -(width - have)], h[width - have :])
    return h[:n], grams


def _filed(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket << 32 | 32 bits of the key: what stands for a key from here on. Keys that
    agree in it are filed together, which costs comparisons and changes no result."""
    bucket = ((keys * _K2) >> np.uint64(33)) % np.uint64(n)
    return (bucket << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def _runs(texts: list[bytes], span: int, n: int):
    """Runs of windows of equal key: per chunk of documents the buffer, the documents'
    starts, and of each run the filed key, first window, number of windows, document
    and a byte that tells regions under a key apart (by their first and last bytes)."""
    for s, e in chunks([len(t) for t in texts], 1 << 18):
        part = texts[s:e]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
        buf = np.frombuffer(b"".join(part) + bytes(span + 8), np.uint8)
        total = int(starts[-1])
        if total < span:
            yield s, buf, starts, np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint8)
            continue
        keys, grams = window_keys(buf[: total + span + 8], span)
        keys = keys[:total]
        inside = np.zeros(total + 1, np.int8)
        long_ = np.diff(starts) >= span
        np.add.at(inside, starts[:-1][long_], 1)
        np.add.at(inside, starts[1:][long_] - span + 1, -1)
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (keys[1:] != keys[:-1])
        new[starts[:-1][long_]] = True
        first = np.flatnonzero(new)
        stop = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]])) + 1
        kind = ((grams[first] * _K3 ^ grams[stop + span - 1 - GRAM]) * _K1 >> np.uint64(56)).astype(np.uint8)
        yield s, buf, starts, _filed(keys[first], n), first, stop - first, np.searchsorted(starts, first, "right") - 1, kind


def _documents(group: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Positions of the rows with a doc_id by rising doc_id and text, and their texts: in each
    step the same order, however the rows arrive."""
    ids, texts = group.column("__doc").to_numpy(), group.column("__bytes")
    order = np.argsort(ids, kind="stable")
    sorted_ = ids[order]
    if len(ids) and (sorted_[1:] == sorted_[:-1]).any():
        order = np.array(sorted(order.tolist(), key=lambda i: (ids[i], texts[i].as_py())), np.int64)
    return order, [texts[int(i)].as_py() for i in order]


def _blobs(batch: list, bucket: list, blob: list) -> pa.Table:
    return pa.table({"batch": pa.array(batch, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "blob": pa.array(blob, pa.binary())})


def _parted(filed: np.ndarray, names: list[int]):
    """(name of the bucket, positions) for each bucket that occurs; positions by filed key."""
    if not len(filed):
        return
    order = np.argsort(filed, kind="stable")
    bucket = (filed[order] >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(_heads(bucket))
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        yield names[int(bucket[a])], order[a:z]


def _heads(x: np.ndarray) -> np.ndarray:
    """Where a sorted array has another value than before."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _packed(body: bytes) -> bytes:
    return np.uint64(len(body)).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int(np.frombuffer(blob, "<u8", 1)[0]), codec="zstd", asbytes=True)


def _sketch(names: list[int], span: int):
    """Step 1. A blob: number of keys, their 32 bits, and for each a byte with the bits of
    the number of its kinds of regions, 128 more if it has two documents, and one kind."""

    def run(group: pa.Table) -> pa.Table:
        order, texts = _documents(group)
        docs = group.column("__doc").to_numpy()[order]
        keys, owners, kinds = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint8)]
        for s, _, _, k, _, _, doc, kind in _runs(texts, span, len(names)):
            keys.append(k)
            owners.append(docs[doc + s])
            kinds.append(kind)
        keys, owners, kinds = np.concatenate(keys), np.concatenate(owners), np.concatenate(kinds)
        # Filed keys have at most 56 bits, so the kind fits below them.
        both = keys << np.uint64(8) | kinds
        by = np.argsort(both)
        both, owners = both[by], owners[by]
        keys = both >> np.uint64(8)
        first = np.flatnonzero(_heads(keys))
        out = []
        if len(first):
            many = np.minimum.reduceat(owners, first) != np.maximum.reduceat(owners, first)
            different = np.add.reduceat(_heads(both).astype(np.int64), first)
            code = np.ceil(np.log2(different + 1)).astype(np.uint8) | (many.astype(np.uint8) << 7)
            kind = (both[first] & np.uint64(0xFF)).astype(np.uint8)
            keys = keys[first]
            low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
            out = [(k, np.uint32(len(at)).tobytes() + low[at].tobytes() + code[at].tobytes() + kind[at].tobytes()) for k, at in _parted(keys, names)]
        batch = group.column("batch")[0].as_py()
        return _blobs([batch] * len(out), [k for k, _ in out], [b for _, b in out])

    return run


def _repeated(limit: int):
    """Step 2. The answer to each batch: its keys that two documents have, and a byte for
    each that tells if it is hot."""

    def run(group: pa.Table) -> pa.Table:
        sets, codes, kinds = [], [], []
        for blob in group.column("blob"):
            b = blob.as_py()
            n = int(np.frombuffer(b, "<u4", 1)[0])
            sets.append(np.frombuffer(b, "<u4", n, 4))
            codes.append(np.frombuffer(b, np.uint8, n, 4 + 4 * n))
            kinds.append(np.frombuffer(b, np.uint8, n, 4 + 5 * n))
        keys, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        codes, kinds = np.concatenate(codes), np.concatenate(kinds)
        twice = times > 1
        twice[at[codes >= 128]] = True
        bits = codes & 127
        regions = np.bincount(at, (1 << bits.astype(np.int64)) - 1, len(keys))
        hot = np.zeros(len(keys), bool)
        for k in np.flatnonzero(regions > limit).tolist():
            mine = at == k
            # Copies send the same region from many batches; that is no reason to split it.
            hot[k] = max(1 << bits[mine].max().astype(int), len(np.unique(kinds[mine]))) > min(64, limit)
        cuts = np.cumsum([len(s) for s in sets])[:-1]
        answers = []
        for s, i in zip(sets, np.split(at, cuts), strict=True):
            m = twice[i]
            answers.append(s[m].tobytes() + hot[i[m]].astype(np.uint8).tobytes())
        return _blobs(group.column("batch").to_pylist(), group.column("bucket").to_pylist(), answers)

    return run


def _singly(buf: np.ndarray, k, first, many, doc, hot: np.ndarray, span: int, n: int):
    """The runs with every window of a hot one as a run of its own, filed by its hash."""
    size = many[hot]
    at = np.repeat(first[hot] - np.cumsum(size) + size, size) + np.arange(size.sum())
    data = buf.tobytes()
    own = np.fromiter((xxhash.xxh64_intdigest(data[i : i + span]) for i in at.tolist()), np.uint64, len(at))
    order = np.argsort(np.concatenate([first[~hot], at]), kind="stable")
    ones = np.ones(len(at), np.int64)
    return tuple(np.concatenate(x)[order] for x in ((k[~hot], _filed(own, n)), (first[~hot], at), (many[~hot], ones), (doc[~hot], np.repeat(doc[hot], size))))


def _regions(texts: list[bytes], docs: np.ndarray, repeated: np.ndarray, hot: np.ndarray, span: int, n: int):
    """The different regions of the batch under repeated keys, with key and smallest
    document; and for each chunk where its runs and regions are."""
    found: dict[bytes, int] = {}
    keys: list[np.ndarray] = []
    owner: list[int] = []
    places = []
    for s, buf, starts, k, first, many, doc, _ in _runs(texts, span, n):
        at = np.minimum(np.searchsorted(repeated, k), max(len(repeated) - 1, 0))
        hit = repeated[at] == k if len(repeated) else np.zeros(len(k), bool)
        k, first, many, doc, at = k[hit], first[hit], many[hit], doc[hit], at[hit]
        if len(at) and hot[at].any():
            k, first, many, doc = _singly(buf, k, first, many, doc, hot[at], span, n)
        data, seen, ids = buf.tobytes(), [], docs[doc + s].tolist()
        fresh = []
        for i, (a, z) in enumerate(zip(first.tolist(), (first + many + span - 1).tolist(), strict=True)):
            region = data[a:z]
            j = found.get(region)
            if j is None:
                j = found[region] = len(owner)
                owner.append(ids[i])
                fresh.append(i)
            seen.append(j)
        keys.append(k[fresh])
        places.append((s, starts, first, many, doc, np.array(seen, np.int64)))
    return found, np.concatenate(keys) if keys else np.empty(0, np.uint64), np.array(owner, np.int64), places


def _answers(reply: pa.Table) -> dict[int, bytes]:
    return dict(zip(reply.column("bucket").to_pylist(), (b.as_py() for b in reply.column("blob")), strict=True))


def _repeated_keys(reply: pa.Table, names: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Repeated filed keys in order, and which of them are hot."""
    place = {k: i for i, k in enumerate(names)}
    keys, hot = [np.empty(0, np.uint64)], [np.empty(0, bool)]
    for k, b in _answers(reply).items():
        m = len(b) // 5
        keys.append(np.frombuffer(b, "<u4", m).astype(np.uint64) | np.uint64(place[k] << 32))
        hot.append(np.frombuffer(b, np.uint8, m, 4 * m).astype(bool))
    keys, hot = np.concatenate(keys), np.concatenate(hot)
    order = np.argsort(keys)
    return keys[order], hot[order]


def _emit(names: list[int], span: int):
    """Step 3. A blob: for each part of the bucket its number of regions; then documents,
    lengths and bytes of all regions."""

    def run(group: pa.Table, reply: pa.Table) -> pa.Table:
        if not group.num_rows or not reply.num_rows:
            return _blobs([], [], [])
        order, texts = _documents(group)
        docs = group.column("__doc").to_numpy()[order]
        found, keys, owner, _ = _regions(texts, docs, *_repeated_keys(reply, names), span, len(names))
        regions, out = list(found), []
        for k, at in _parted(keys, names):
            mine = [regions[i] for i in at.tolist()]
            sizes = np.bincount(_part(keys[at]), minlength=PARTS).astype("<u4")
            out.append((k, sizes.tobytes() + _packed(owner[at].tobytes() + np.array([len(r) for r in mine], "<u4").tobytes() + b"".join(mine))))
        batch = group.column("batch")[0].as_py()
        return _blobs([batch] * len(out), [k for k, _ in out], [b for _, b in out])

    return run


def _part(filed: np.ndarray) -> np.ndarray:
    """Of a bucket; rises with the filed key."""
    return ((filed & np.uint64(0xFFFFFFFF)) * np.uint64(PARTS) >> np.uint64(32)).astype(np.int64)


def refine(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Buckets of the positions of ``text`` (padded by ``depth`` bytes, 8 at least) by their first
    ``depth`` bytes, right for ``wanted`` positions; only equal strings share a bucket.

    Bucket-pointer refinement: the buckets of 8-byte strings come from one sort; then a
    bucket is refined by sorting its suffixes on the bucket pointers of the offset that
    its depth reaches, and those pointers are the ones that earlier rounds have already
    refined. A pointer is the place of the bucket's first suffix; a bucket of one
    suffix is never touched again.
    """
    n = len(text) - max(depth, 8)
    if n >= 1 << 32:
        raise ValueError("pointers have 32 bits: a part of a bucket holds less, as keys with many regions are split")
    # Offsets from a wanted position at which each round reads a pointer.
    rounds, have = [], min(8, depth)
    while have < depth:
        step = min(have, depth - have)
        rounds.append((have, step))
        have += step
    needs = [{0}]
    for _, step in reversed(rounds):
        needs.append(needs[-1] | {x + step for x in needs[-1]})
    needs.reverse()
    weight = (np.uint64(256) ** np.arange(7, -1, -1, dtype=np.uint64)) if depth < 8 else None
    code = _loads(text, n, 0)
    code = code.byteswap() if weight is None else (code.byteswap() >> np.uint64(8 * (8 - depth)))
    active = _at(wanted, needs[0], n)
    bucket = np.zeros(n, np.int64)
    sub = code[active]
    order = np.argsort(sub)
    active, sub = active[order], sub[order]
    bucket[active] = np.maximum.accumulate(np.where(np.concatenate([[True], sub[1:] != sub[:-1]])[: len(sub)], np.arange(len(sub)), 0)) if len(sub) else 0
    for i, (_, step) in enumerate(rounds):
        active = _at(wanted, needs[i + 1], n)
        own = bucket[active]
        size = np.bincount(own) if len(own) else np.zeros(1, np.int64)
        active, own = active[size[own] > 1], own[size[own] > 1]
        if not len(active):
            break
        later = bucket[active + step]
        order = np.argsort(own.astype(np.uint64) << np.uint64(32) | later.astype(np.uint64))
        active, own, later = active[order], own[order], later[order]
        head = np.concatenate([[True], own[1:] != own[:-1]])
        fresh = head | np.concatenate([[True], later[1:] != later[:-1]])
        place = np.arange(len(own))
        within = np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(head, place, 0))
        bucket[active] = own + within
    return bucket[wanted]


def _at(wanted: np.ndarray, offsets: set[int], n: int) -> np.ndarray:
    mark = np.zeros(n, bool)
    for x in offsets:
        mark[wanted + x] = True
    return np.flatnonzero(mark)


def _least(found: dict[bytes, int], owner: list[int], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of windows and first window of each region, and each window's smallest document."""
    many = np.fromiter((len(r) - span + 1 for r in found), np.int64, len(found))
    text = np.frombuffer(b"".join(found) + bytes(span + 8), np.uint8)
    starts = np.concatenate([[0], np.cumsum(many + span - 1)[:-1]])
    windows = np.concatenate([[0], np.cumsum(many)])
    wanted = np.repeat(starts - windows[:-1], many) + np.arange(windows[-1])
    bucket = refine(text, wanted, span)
    docs = np.repeat(np.array(owner, np.int64), many)
    order = np.argsort(bucket)
    head = np.flatnonzero(_heads(bucket[order]))
    least = np.empty(len(docs), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(docs[order], head), np.diff(np.concatenate([head, [len(order)]])))
    return many, windows[:-1], least


def _smallest(span: int):
    """Step 4. The answer to each batch: runs (first window, document) over the windows of
    its regions, in the order in which it sent them.

    Equal windows are in the same part of a bucket, so parts are sorted one by one."""

    def run(group: pa.Table) -> pa.Table:
        blobs = [b.as_py() for b in group.column("blob")]
        heads = [np.frombuffer(b, "<u4", PARTS) for b in blobs]
        at = [0] * len(blobs)  # regions of each blob that earlier parts had
        replies: list[list[np.ndarray]] = [[] for _ in at]
        for group_of_parts in _even(np.sum(heads, axis=0)):
            found: dict[bytes, int] = {}
            owner: list[int] = []
            sent = []
            for i, blob in enumerate(blobs):
                n = int(heads[i][group_of_parts].sum())
                if not n:
                    sent.append(None)
                    continue
                b, all_ = _unpacked(blob[4 * PARTS :]), int(heads[i].sum())
                docs = np.frombuffer(b, "<i8", n, 8 * at[i]).tolist()
                lengths = np.frombuffer(b, "<u4", all_, 8 * all_)
                begin = 12 * all_ + int(lengths[: at[i]].sum())
                ends = (np.cumsum(lengths[at[i] : at[i] + n]) + begin).tolist()
                at[i] += n
                mine = []
                for doc, end in zip(docs, ends, strict=True):
                    region, begin = b[begin:end], end
                    j = found.get(region)
                    if j is None:
                        j = found[region] = len(owner)
                        owner.append(doc)
                    elif doc < owner[j]:
                        owner[j] = doc
                    mine.append(j)
                sent.append(np.array(mine, np.int64))
            if not found:
                continue
            many, first, least = _least(found, owner, span)
            for reply, mine in zip(replies, sent, strict=True):
                if mine is not None:
                    n = many[mine]
                    step = np.concatenate([[0], np.cumsum(n)])
                    reply.append(least[np.repeat(first[mine] - step[:-1], n) + np.arange(step[-1])])
        answers = []
        for reply in replies:
            values = np.concatenate(reply)
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            answers.append(_packed(np.uint32(len(first)).tobytes() + first.astype("<u4").tobytes() + values[first].tobytes() + np.uint32(len(values)).tobytes()))
        return _blobs(group.column("batch").to_pylist(), group.column("bucket").to_pylist(), answers)

    return run


def _even(sizes: np.ndarray, regions: int = 1 << 14):
    """Slices of consecutive parts that are sorted together: one part at least, and no more
    than ``regions`` regions otherwise."""
    start = 0
    for i in range(1, PARTS + 1):
        if i == PARTS or sizes[start : i + 1].sum() > regions:
            yield slice(start, i)
            start = i


def _cut(names: list[int], columns: list[str], span: int, as_text: bool):
    """Step 5. The documents of a batch with what is left of them."""

    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        texts = [b.as_py() for b in group.column("__bytes")]
        n = len(texts)
        kept, removed, spans = list(texts), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if n and replies.num_rows:
            order, sorted_ = _documents(group)
            docs = group.column("__doc").to_numpy()[order]
            kinds = replies.column("kind").to_numpy()
            repeated = _repeated_keys(replies.filter(pa.array(kinds == 0)), names)
            least = _answers(replies.filter(pa.array(kinds == 1)))
            _, keys, owner, places = _regions(sorted_, docs, *repeated, span, len(names))
            many = np.zeros(len(owner), np.int64)
            for _, _, _, size, _, at in places:
                many[at] = size
            values, first = [np.empty(0, np.int64)], np.zeros(len(owner), np.int64)
            base = 0
            for k, at in _parted(keys, names):
                b = _unpacked(least[k])
                m = int(np.frombuffer(b, "<u4", 1)[0])
                begin, value = np.frombuffer(b, "<u4", m, 4).astype(np.int64), np.frombuffer(b, "<i8", m, 4 + 4 * m)
                total = int(np.frombuffer(b, "<u4", 1, 4 + 12 * m)[0])
                values.append(np.repeat(value, np.diff(np.concatenate([begin, [total]]))))
                first[at] = base + np.concatenate([[0], np.cumsum(many[at])[:-1]])
                base += total
            values = np.concatenate(values)
            for s, starts, begin, size, doc, at in places:
                if not len(at):
                    continue
                step = np.concatenate([[0], np.cumsum(size)])
                inner = np.arange(step[-1])
                hit = values[np.repeat(first[at] - step[:-1], size) + inner] < np.repeat(docs[doc + s], size)
                pos = (np.repeat(begin - step[:-1], size) + inner)[hit]
                if not len(pos):
                    continue
                edge = np.zeros(int(starts[-1]) + 1, np.int32)
                edge[pos] += 1
                edge[pos + span] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                rise = gone.copy()
                rise[1:] &= ~gone[:-1]
                inner_starts = starts[1:-1][starts[1:-1] < len(gone)]
                rise[inner_starts] = gone[inner_starts]
                total_gone, total_rise = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (gone, rise))
                lost = total_gone[starts[1:]] - total_gone[starts[:-1]]
                runs = total_rise[starts[1:]] - total_rise[starts[:-1]]
                for d in np.flatnonzero(lost).tolist():
                    row = int(order[s + d])
                    text = np.frombuffer(sorted_[s + d], np.uint8)
                    kept[row] = text[~gone[starts[d] : starts[d + 1]]].tobytes()
                    removed[row], spans[row] = lost[d], runs[d]
        out = {c: group.column(c) for c in columns}
        out |= {"__n_bytes": pa.array([len(t) for t in texts], pa.int64()), "__n_removed": pa.array(removed), "__n_spans": pa.array(spans), "__kept": pa.array([k.decode(errors="ignore") for k in kept] if as_text else kept, pa.string() if as_text else pa.binary())}
        return pa.table(out)

    return run


def cut_repeats(spark: SparkSession, docs: DataFrame, keep: list[str] | None = None, span: int = SPAN, as_text: bool = False, batch_bytes: int = BATCH, hot: int = HOT) -> DataFrame:
    """``docs`` (columns ``keep``) with n_bytes, n_removed, n_spans and the bytes kept.

    With ``as_text`` kept is a string, without the bytes of characters that a cut split.

    Removed is each byte of a ``span``-byte string that also starts in a document of
    smaller doc_id; strings are judged on the input. Null texts are empty. A row
    without doc_id is neither cut nor a source of cuts; rows that share a doc_id do not
    cut each other. Columns of ``keep`` with a result's name give way to it. A text
    longer than ``batch_bytes`` is a batch with whatever falls to it. An empty table gives
    an empty result.
    """
    results = ["n_bytes", "n_removed", "n_spans", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    got = _cut_repeats(spark, docs, keep, span, as_text, batch_bytes, hot)
    return got.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)), *(F.col(f"__{c}").alias(c) for c in results))


def _cut_repeats(spark: SparkSession, docs: DataFrame, keep: list[str], span: int, as_text: bool, batch_bytes: int, hot: int) -> DataFrame:
    """cut_repeats with the i-th column of ``keep`` named __i and underscores before results."""
    n = parallelism(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    chosen = docs.select(*(docs[f"`{c}`"].alias(f"__{i}") for i, c in enumerate(keep)), F.col("doc_id").cast("long").alias("__doc"), text.alias("__bytes"))
    keep = [f"__{i}" for i in range(len(keep))]
    total = chosen.agg(F.sum(F.length("__bytes").cast("long"))).first()[0] or 0
    names = even_keys(spark, n, max(1, -(-total // (n * batch_bytes))))
    if len(names) >= 1 << 24:
        raise ValueError("filed keys have 56 bits: use larger batches")
    named = chosen.where("__doc is not null")
    batch = F.element_at(F.lit(names), (F.pmod(F.xxhash64("__doc", F.length("__bytes")), F.lit(len(names))) + 1).cast("int"))
    dealt = named.withColumn("batch", batch).repartition(n, "batch")
    sketches = dealt.groupBy("batch").applyInArrow(_sketch(names, span), BLOB)
    repeated = sketches.repartition(n, "bucket").groupBy("bucket").applyInArrow(_repeated(hot), BLOB).repartition(n, "batch")
    regions = dealt.groupBy("batch").cogroup(repeated.groupBy("batch")).applyInArrow(_emit(names, span), BLOB)
    least = regions.repartition(n, "bucket").groupBy("bucket").applyInArrow(_smallest(span), BLOB)
    replies = repeated.withColumn("kind", F.lit(0)).unionByName(least.repartition(n, "batch").withColumn("kind", F.lit(1)))
    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    kept = "string" if as_text else "binary"
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"__n_bytes long, __n_removed long, __n_spans long, __kept {kept}"])
    cut = dealt.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(_cut(names, keep, span, as_text), schema)
    length, none = F.length("__bytes").cast("long"), F.lit(0).cast("long")
    rest = chosen.where("__doc is null").select(*keep, length.alias("__n_bytes"), none.alias("__n_removed"), none.alias("__n_spans"), F.col("__bytes").cast(kept).alias("__kept"))
    return cut.unionByName(rest)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cut_repeats(spark, table(spark, sf_dir, "documents"), ["doc_id"])
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without their repeats, n_chars counted anew.

    Where a cut leaves part of a character, its bytes go too. A null text stays null;
    other columns stay, whatever their names. See cut_repeats for null and shared
    doc_ids, long texts and empty tables.
    """
    columns = [c for c in docs.columns if c != "text"]
    place = {c: F.col(f"__{i}") for i, c in enumerate([*columns, "__null"])}
    got = _cut_repeats(spark, docs.withColumn("__null", F.col("text").isNull()), [*columns, "__null"], SPAN, True, BATCH, HOT)
    text = F.when(~place["__null"], F.col("__kept"))
    place["text"] = text
    if "n_chars" in columns:
        place["n_chars"] = F.when(F.col("__n_removed") == 0, place["n_chars"]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return got.select(*(place[c].alias(c) for c in docs.columns))


def brute_force(rows: list[tuple[int, str | None]], span: int = SPAN) -> dict[int, tuple[int, int, int, str]]:
    """What op7 returns, by a plain loop over all strings; for tests."""
    least: dict[bytes, int] = {}
    texts = {i: (t or "").encode() for i, t in rows}
    for i in sorted(texts):
        for k in range(len(texts[i]) - span + 1):
            least.setdefault(texts[i][k : k + span], i)
    out = {}
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - span + 1):
            if least[t[k : k + span]] < i:
                gone[k : k + span] = True
        left = bytes(b for b, g in zip(t, gone[:-1], strict=True) if not g)
        out[i] = (len(t), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0, hashlib.sha256(left).hexdigest())
    return out
