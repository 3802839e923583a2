"""Exact byte-pair encoding as a lattice: relax edges by position, one valid last token per prefix.

For greedy lowest-rank-first merging, the encoding of a prefix ends in exactly one token ``t`` whose predecessor
(the last token of the prefix without ``t``) is *compatible* with it: replaying the merges that made both, in
reverse, no merge across their border would have come first. So all prefixes of all words are encoded in one
forward pass over the edges (start, end, token) in order of their end.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable
from heapq import heapify, heappop, heappush

import numpy as np

NONE = np.int64(1) << 40  # rank of a merge that does not exist


class PairTable:
    """int64 keys to int64 values in an open-addressing numpy table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NONE, np.int64)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slot] == -1
            taken, first = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[taken] = keys[left[chosen]]
            self.values[taken] = values[left[chosen]]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            at = slot[open_]
            hit = self.keys[at] == keys[open_]
            found[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.keys[at] != -1)]
        return found


class Merges:
    """Ranks and splits of a merge vocabulary.

    ``rank[t]`` is -1 for tokens that no merge makes, ``left``/``right`` the two tokens of the merge that makes ``t``;
    ``pairs`` maps ``a * size + b`` to the rank of merging a and b.
    """

    #: Verdicts on pairs of tokens that are kept, one a slot.
    SLOT_BITS = 19

    def __init__(self, rank: np.ndarray, left: np.ndarray, right: np.ndarray, pairs: PairTable) -> None:
        self.rank, self.left, self.right, self.pairs = rank, left, right, pairs
        self.size = np.int64(len(rank))
        self.plain: tuple | None = None  # the same as Python objects, for single pairs
        self.asked = np.full(1 << self.SLOT_BITS, -1, np.int64)  # a pair's key times two, and the verdict

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves tokens a and b side by side, for arrays of pairs."""
        key = a.astype(np.int64) * self.size + b
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOT_BITS)).view(np.int64)
        known = self.asked[slot]
        ok = (known & 1).astype(bool)
        new = np.flatnonzero(known >> 1 != key)
        if len(new):
            ok[new] = self.replay(a[new], b[new])
            self.asked[slot[new]] = key[new] * 2 + ok[new]
        return ok

    def replay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NONE, np.int64)
        while len(live):
            bad = self.pairs.get(a * self.size + b) < limit
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok


    def one_compatible(self, a: int, b: int) -> bool:
        """:meth:`compatible` of one pair."""
        if self.plain is None:
            full = np.flatnonzero(self.pairs.keys >= 0)
            self.plain = (dict(zip(self.pairs.keys[full].tolist(), self.pairs.values[full].tolist())), self.rank.tolist(), self.left.tolist(), self.right.tolist())
        pairs, rank, left, right = self.plain
        size, limit = int(self.size), int(NONE)
        while True:
            if pairs.get(a * size + b, limit) < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, right[a]
            else:
                limit, b = rb + 1, left[b]


def relax(merges: Merges, starts: np.ndarray, sizes: np.ndarray, start: np.ndarray, end: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Last token, its start node and the token count of every prefix node.

    ``starts``: first node of each word; a word of n symbols (``sizes``) owns n + 1 nodes, and words follow each other.
    ``start``, ``end``, ``token``: edges. Nodes at a word's start have count 0 and last token -1. One round a depth, for
    all words at once, so words should be short (:func:`relax_long` is for others).
    """
    n_nodes = int(sizes.sum()) + len(sizes)
    last = np.full(n_nodes, -1, np.int32)
    source = np.full(n_nodes, -1, np.int32)
    count = np.zeros(n_nodes, np.int32)
    base = np.repeat(starts.astype(np.int32), sizes + 1)
    depth = (end - base[start]).astype(np.uint16 if int(sizes.max(initial=0)) < 1 << 16 else np.int64)
    order = np.argsort(depth, kind="stable")
    start, end, token, depth = start[order], end[order], token[order], depth[order]
    if not len(depth):
        return last, source, count
    first = start == base[start]
    bounds = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2))
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        s, e, t = start[lo:hi], end[lo:hi], token[lo:hi]
        ok = first[lo:hi].copy()
        inner = np.flatnonzero(~ok)
        ok[inner] = merges.compatible(last[s[inner]], t[inner])
        s, e, t = s[ok], e[ok], t[ok]
        last[e], source[e], count[e] = t, s, count[s] + 1
    return last, source, count


def relax_long(merges: Merges, n: int, blocks: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`relax` for one long word of ``n`` symbols, edge by edge: time and memory grow with ``n`` only.

    ``blocks``: its edges (start, end, token), every one with a start no less than those before it.
    """
    last, source, count = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int32)
    verdict: dict[int, bool] = {}
    size, ahead = int(merges.size), {0: (-1, -1, 0)}  # nodes that edges have reached: last token, source, count
    for start, end, token in blocks:
        before = -1
        for s, e, t in zip(start.tolist(), end.tolist(), token.tolist()):
            if s != before:
                before, here = s, ahead.pop(s, None)
                if here is not None:
                    last[s], source[s], count[s] = here
            if here is None:
                continue
            key = here[0] * size + t
            ok = s == 0 or verdict.get(key)
            if ok is None:
                if len(verdict) > 1 << 18:
                    verdict.clear()
                ok = verdict[key] = merges.one_compatible(here[0], t)
            if ok:
                ahead[e] = (t, s, here[2] + 1)
    for e, here in ahead.items():
        last[e], source[e], count[e] = here
    return last, source, count


def merge_literally(symbols: list[int], pairs: dict[tuple[int, int], tuple[float, int]]) -> list[int]:
    """Literal merging, lowest (rank, position) first, by a heap. ``pairs``: two tokens to the rank and token of their merge."""
    n = len(symbols)
    parts, after, before = list(symbols), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    heap = [(pairs[p][0], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in pairs]
    heapify(heap)
    while heap:
        _, i, p = heappop(heap)
        j = after[i] if parts[i] == p[0] else n
        if j >= n or parts[j] != p[1]:
            continue  # one of the two has been merged since
        parts[i], parts[j] = pairs[p][1], None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (q := (parts[i], parts[k])) in pairs:
                heappush(heap, (pairs[q][0], i, q))
        if (k := before[i]) >= 0 and (q := (parts[k], parts[i])) in pairs:
            heappush(heap, (pairs[q][0], k, q))
    return [x for x in parts if x is not None]
