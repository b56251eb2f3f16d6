"""Binary tries of fingerprints, whose nodes are traversed in pairs within an error budget."""

from __future__ import annotations

import numpy as np


def trie_pairs(keys: np.ndarray, values: np.ndarray, bits: int, block: int = 1 << 20):
    """Index pairs (i, j) of equal keys that connect all values within ``bits``.

    ``values`` (uint64) has one or more words a row, the highest first; ``keys`` and
    ``values`` must be sorted together. Each key's values are a binary trie, whose nodes
    are ranges of the sorted array. Pairs of nodes are traversed together from the root,
    with their differing bits so far; a pair over budget is pruned, and so is one whose
    values are already connected through neighbours in the sorted order.
    """
    n = len(keys)
    if n < 2:
        return
    words = [np.ascontiguousarray(x) for x in values.reshape(n, -1).T]

    def differing(a, b):
        return sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int16) for w in words)

    near = (keys[1:] == keys[:-1]) & (differing(slice(1, None), slice(None, -1)) <= bits)
    at = np.flatnonzero(near)
    yield at, at + 1
    chain = np.concatenate([[0], np.cumsum(~near)])
    top = 64 * len(words) - 1
    ones = {}

    def split(lo, hi, bit):
        if bit not in ones:
            word = words[(top - bit) // 64]
            ones[bit] = np.concatenate([[0], np.cumsum((word >> np.uint64(bit % 64)) & np.uint64(1), dtype=np.int32)])
        return hi - (ones[bit][hi] - ones[bit][lo])

    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    last = np.concatenate([first[1:], [n]])
    zero = np.zeros(len(first), np.int64)
    stack = [(top, first, last, first, last, zero)]
    while stack:
        bit, al, ah, bl, bh, d = stack.pop()
        # A pair whose values all lie in one chain adds nothing; single nodes end here.
        live = (ah > al) & (bh > bl) & (d <= bits) & (chain[np.minimum(al, n - 1)] != chain[np.maximum(bh - 1, 0)])
        al, ah, bl, bh, d = (x[live] for x in (al, ah, bl, bh, d))
        # Below the last bit a node's values are equal, and its rows are in one chain: one pair is enough.
        leaf = (ah - al == 1) & (bh - bl == 1) | (bit < 0)
        if leaf.any():
            i, j = al[leaf], bl[leaf]
            ok = (i != j) & (differing(i, j) <= bits)
            if ok.any():
                yield i[ok], j[ok]
            al, ah, bl, bh, d = (x[~leaf] for x in (al, ah, bl, bh, d))
        if not len(al):
            continue
        if len(al) > block:
            for s in range(0, len(al), block):
                stack.append((bit, *(x[s : s + block] for x in (al, ah, bl, bh, d))))
            continue
        am, bm = split(al, ah, bit), split(bl, bh, bit)
        cross = al != bl  # not a node with itself, for which one mixed pair is enough
        stack.append((bit - 1, *(np.concatenate(x) for x in ((al, am, al, am[cross]), (am, ah, am, ah[cross]), (bl, bm, bm, bl[cross]), (bm, bh, bh, bm[cross]), (d, d, d + 1, d[cross] + 1)))))
