"""Operator 7, suffix-array dedup of repeated 400-byte strings.

All suffixes of a corpus cannot be exchanged, so a sparse suffix array over content-defined places does the work:

1. Every 400-byte window of a document has an *anchor*, the least hash among its 64-byte grams (leftmost on ties).
   Equal windows have equal anchors at the same offset. A run of windows with one anchor is a *context*: the bytes from
   its first window's start to its last window's end.
2. Contexts are exchanged once, by anchor gram, and grouped by gram and content (128 bits); equal ones of one slice of
   texts go as one. A content that occurs twice repeats with all its windows and no text is moved. A content that is
   alone with its anchor does not repeat.
3. What is left (edges of repeated passages: one anchor, several contents) is settled by a distributed merge sort of
   suffixes: each task sorts the suffixes that begin at its anchors, and the reversed prefixes that end there, into
   runs, front-codes them (shared prefix length and rest) and exchanges the runs by anchor; receivers combine the runs
   with a loser tree that carries common-prefix lengths and never compares a known prefix again. The sorted runs' common
   prefixes give, for any two contexts, how far they agree right and left of the anchor, and so which windows repeat.
4. Repeated windows go back to their documents, where overlapping ones are merged and cut out.

A passage of over 50 words may be shorter than 400 bytes. Passages of at least ``PASSAGE_WORDS`` words that repeat, whatever
white space parts their words, are found in the same passes: anchors are grams of ``GRAM_WORDS`` words, windows and places
count words, suffixes are words with a space after each. They are reported beside the cut, which is by bytes alone. An
anchor gram's lowest bit tells the two kinds apart.

Groups of more than ``GROUP_ROWS`` different contents go another way: their windows are hashed (128 bits) and counted,
so no task ever holds such a group.

Defined results: null text is empty; texts shorter than a window lose nothing; repeated rows are documents of their own,
so their texts of at least a window repeat and go; null ids keep their row; an empty table gives an empty result;
further columns are ignored; bytes are removed wherever they are covered, inside characters too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmax.llm.common import SLICE_BYTES, flat_text, lean, row_key, shared_table, slices

LENGTH = 400
GRAM = 64
#: Words of a window and of a gram where passages of words are sought.
PASSAGE_WORDS = 50
GRAM_WORDS = 8
#: Different contents of one anchor that a task sorts; larger groups are settled by window hashes.
GROUP_ROWS = 20_000
#: Contents that are compared pair by pair; larger groups are compared by depth.
SMALL_GROUP = 12

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PLACE_BITS = 24  # of a key that holds a hash's upper bits and a place in a slice


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any substrings of a byte array, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, data: np.ndarray, base: np.uint64 = BASE, inverse: np.uint64 = BASE_INVERSE) -> None:
        n = len(data)
        power, self.back = np.full(n + 1, base), np.full(n + 1, inverse)
        power[0] = self.back[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(self.back, out=self.back)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.total[1:])

    def get(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.back[start])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by block prefix and suffix minima."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def contexts(data: np.ndarray, ends: np.ndarray, length: int, width: int) -> dict[str, np.ndarray] | None:
    """Contexts of a slice of bytes or words: ``row``, ``start`` (of the first window, in its document), ``last`` (windows - 1),
    ``anchor`` (its offset from start), the anchor gram's hash and the content's hash."""
    if not len(data) or int(np.diff(ends).max()) < length:
        return None
    roll = Rolling(data)
    grams = len(data) - width + 1
    places = np.arange(grams)
    gram = roll.get(places, places + width)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least((gram & ~low) | places.astype(np.uint64), length - width + 1)
    at = (least & low).astype(np.int64)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(at)]
    good = np.arange(len(at)) + length <= ends[row + 1]
    new = good.copy()
    new[1:] &= ~(good[:-1] & (at[1:] == at[:-1]) & (row[1:] == row[:-1]))
    start = np.flatnonzero(new)
    if not len(start):
        return None
    count = np.diff(np.concatenate([np.cumsum(good)[start] - 1, [np.count_nonzero(good)]]))
    anchor, last = at[start], count - 1
    content = roll.get(start, start + last + length)
    content = mix(content ^ (last.astype(np.uint64) << np.uint64(20)) ^ (anchor - start).astype(np.uint64))
    owner = row[start]
    return {"row": owner, "start": start - ends[owner], "last": last, "anchor": anchor - start, "gram": gram[anchor], "content": content}


def windows_of(size: int, length: int) -> Iterator[tuple[int, int]]:
    """Stretches of a slice that share no window and lose none; one, unless a single text is longer than a key's place."""
    limit = (1 << PLACE_BITS) - 1
    at = 0
    while at == 0 or at + length <= size:
        yield at, min(at + limit, size)
        at += limit - length + 1


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, what ASCII white space parts."""
    word = np.concatenate([[False], (data != 32) & ((data < 9) | (data > 13)), [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of a slice, and the n + 1 offsets of its rows among them; a text's end parts words too."""
    start, end = words_of(data)
    inner = np.setdiff1d(ends[1:-1], np.concatenate([start, end, [0, len(data)]]))
    inner = inner[np.searchsorted(start, inner, "right") > np.searchsorted(end, inner, "right")]
    start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):  # a long text is hashed a stretch of words at a time
        to = max(at + 1, int(np.searchsorted(start, start[at] + SLICE_BYTES)))
        out[at:to] = Rolling(data[start[at] : end[to - 1]]).get(start[at:to] - start[at], end[at:to] - start[at])
        at = to
    return out, np.searchsorted(start, ends)


#: ``place`` holds the start, the anchor's offset and ``last`` (9 bits each), the number of such contexts, 2 for more, and
#: whether words are counted. Where that number is 0 the row is a run of windows that repeat, and ``content`` is its ``last``.
CONTEXT = "id long, rk long, gram long, content long, place long"
START_BITS, ANCHOR_BITS, LAST_BITS = 21, 12, 3


@lean
def emit_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, rk, text) to contexts of bytes and of words. Equal contexts of one slice are one row, the first; the window
    runs of such repeats, merged in each document, follow as rows of their own."""

    def coded(data: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, ...] | None:
        length, width = (PASSAGE_WORDS, GRAM_WORDS) if words else (LENGTH, GRAM)
        found = []
        for a, b in windows_of(len(data), length):
            one = contexts(data[a:b], ends if b - a == len(data) else np.array([0, b - a]), length, width)
            if one is not None:
                one["start"] = one["start"] + a
                found.append(one)
        if not found:
            return None
        f = {k: np.concatenate([x[k] for x in found]) for k in found[0]}
        order = np.lexsort((f["start"], f["row"], f["content"], f["gram"]))
        f = {k: v[order] for k, v in f.items()}
        new = np.ones(len(order), bool)
        new[1:] = (f["gram"][1:] != f["gram"][:-1]) | (f["content"][1:] != f["content"][:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.concatenate([first, [len(order)]]))
        again = np.flatnonzero(np.repeat(n > 1, n))
        row, start, last = merged_runs(f["row"][again], f["start"][again], f["last"][again])
        place = f["start"] << START_BITS | f["anchor"] << ANCHOR_BITS | f["last"] << LAST_BITS | words
        gram = (f["gram"] & ~np.uint64(1) | np.uint64(words)).view(np.int64)
        spread = mix((start + (row << 32)).astype(np.uint64)).view(np.int64)  # runs go to any receiver
        return (
            np.concatenate([f["row"][first], row]), np.concatenate([gram[first], spread]), np.concatenate([f["content"][first].view(np.int64), last]),
            np.concatenate([place[first] | np.minimum(n, 2) << 1, start << START_BITS | words]),
        )

    for batch in batches:
        data, ends = flat_text(batch.column(2))
        ids, keys = pc.fill_null(batch.column(0).cast(pa.int64()), 0), batch.column(1)
        for i, j in slices(ends):
            base, part = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
            for words in (0, 1):
                found = coded(*(word_hashes(base, part) if words else (base, part)), words)
                if found is not None:
                    pick = pa.array(found[0] + i)
                    yield pa.RecordBatch.from_arrays([ids.take(pick), keys.take(pick), *map(pa.array, found[1:])], names=["id", "rk", "gram", "content", "place"])


#: ``kind``: 0, a run of windows that repeat; 1, a context for the merge sort, one of each content, with its number ``n``
#: (2 for more); 2, one whose windows are to be counted.
ACTED = "id long, rk long, start long, last long, words int, kind int, anchor int, gram long, n int"
ACTED_ROWS = 1 << 15


def settled_classes(group_rows: int):
    """Contexts, sorted by gram and content, to the runs and contexts of ``ACTED``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, enough = [], 0, ACTED_ROWS
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            rows += batch.num_rows
            if rows < enough:
                continue
            x = np.concatenate(held, axis=1)
            other = np.flatnonzero(x[2] != x[2, -1])
            to = int(other[-1]) + 1 if len(other) else 0
            if to:
                yield settled(x[:, :to])
            held, rows = [x[:, to:]], x.shape[1] - to
            enough = max(ACTED_ROWS, 2 * rows)
        if rows:
            yield settled(np.concatenate(held, axis=1))

    def settled(x: np.ndarray) -> pa.RecordBatch:
        counts = (x[4] >> 1 & 3) > 0
        known, x = x[:, ~counts], x[:, counts]
        id_, rk, gram, content, place = x
        n = place >> 1 & 3
        start, anchor, last, words = place >> START_BITS, place >> ANCHOR_BITS & 511, place >> LAST_BITS & 511, place & 1
        spans, marks, kind, total = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(gram):
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (content[1:] != content[:-1])
            first = np.flatnonzero(new)
            total = np.add.reduceat(n, first)
            spans = np.flatnonzero((total > 1)[np.cumsum(new) - 1])
            edge = np.ones(len(first), bool)
            edge[1:] = gram[first][1:] != gram[first][:-1]
            group = np.flatnonzero(edge)
            contents = np.diff(np.concatenate([group, [len(first)]]))
            mixed = (contents > 1) & (np.minimum.reduceat(total, group) == 1)
            of = np.cumsum(edge) - 1
            acted = np.flatnonzero(mixed[of])
            marks, kind, total = first[acted], 1 + (contents > group_rows)[of[acted]], np.minimum(total[acted], 2)
        none = np.zeros(known.shape[1] + len(spans), np.int64)
        columns = [
            np.concatenate([known[0], id_[spans], id_[marks]]), np.concatenate([known[1], rk[spans], rk[marks]]),
            np.concatenate([known[4] >> START_BITS, start[spans], start[marks]]), np.concatenate([known[3], last[spans], last[marks]]), np.concatenate([known[4] & 1, words[spans], words[marks]]),
            np.concatenate([none, kind]), np.concatenate([none, anchor[marks]]), np.concatenate([none, gram[marks]]), np.concatenate([none, total]),
        ]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, kinds)], names=[f.split(" ")[0] for f in ACTED.split(", ")])

    return lean(run)


def merged_runs(row: np.ndarray, start: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window runs of each row, joined where they touch."""
    if not len(row):
        return row, start, last
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], (start + last)[order]
    far = np.int64(1) << 40
    reach = np.maximum.accumulate(stop + row * far)
    new = np.ones(len(row), bool)
    new[1:] = start[1:] + row[1:] * far > reach[:-1] + 1
    first = np.flatnonzero(new)
    end = reach[np.concatenate([first[1:] - 1, [len(row) - 1]])] - row[first] * far
    return row[first], start[first], end - start[first]


def common(a: bytes, b: bytes, k: int = 0) -> int:
    """Length of the common prefix, known to be at least ``k``."""
    n, step = min(len(a), len(b)), 32
    while k < n and a[k : k + step] == b[k : k + step]:
        k += step
    if k >= n:
        return n
    while step > 1:
        step //= 2
        if a[k : k + step] == b[k : k + step]:
            k += step
    return min(k, n)


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Shared prefix lengths and rests of a sorted run."""
    shared, rest, before = [], [], b""
    for s in strings:
        k = common(before, s)
        shared.append(k)
        rest.append(s[k:])
        before = s
    return shared, rest


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, bytes, int]]:
    """Merge front-coded sorted runs: (run, place in it, string, prefix shared with the string before).

    A loser tree in which each run's head keeps its common prefix with the last winner: a longer one wins unseen, equal
    ones are compared from there on only.
    """
    k = 1
    while k < len(runs):
        k *= 2
    at, known = [0] * k, [0] * k
    head: list[bytes | None] = [r[1][0] if r[1] else None for r in runs] + [None] * (k - len(runs))
    loser = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = common(x, y, known[a])
        first = n == len(x) or n < len(y) and x[n] < y[n]
        if first and n == len(x) == len(y):
            first = a < b
        win, lose = (a, b) if first else (b, a)
        known[lose] = n
        return win, lose

    level = list(range(k))
    node = k // 2
    while len(level) > 1:
        up = []
        for i in range(0, len(level), 2):
            win, lose = play(level[i], level[i + 1])
            loser[node + i // 2] = lose
            up.append(win)
        level, node = up, node // 2
    win = level[0]
    while head[win] is not None:
        yield win, at[win], head[win], known[win]  # type: ignore[misc]
        at[win] += 1
        shared, rest = runs[win]
        if at[win] < len(rest):
            known[win] = shared[at[win]]
            head[win] = head[win][: known[win]] + rest[at[win]]  # type: ignore[index]
        else:
            head[win] = None
        node = (win + k) // 2
        while node >= 1:
            win, loser[node] = play(win, loser[node])
            node //= 2


RUN = "bucket int, id array<long>, rk array<long>, start array<long>, last array<int>, anchor array<int>, gram array<long>, n array<long>, right_shared array<int>, right_rest array<binary>, left_order array<int>, left_shared array<int>, left_rest array<binary>"
RUN_FIELDS = [f.split(" ")[0] for f in RUN.split(", ")]
FLUSH_MARKS = 50_000


def sorted_runs(buckets: int):
    """(doc_id, rk, text, marks) to front-coded runs, one row per exchange bucket and flush; even buckets hold bytes, odd ones words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            data, ends = flat_text(batch.column(2))
            raw, ids, keys = data.tobytes(), batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for d, marks in enumerate(batch.column(3).to_pylist()):
                text = raw[ends[d] : ends[d + 1]]
                said = text.split() if any(m["gram"] & 1 for m in marks) else []
                for m in marks:
                    a = m["start"]
                    mid = a + m["anchor"]
                    if m["gram"] & 1:
                        right, left = (b"".join(w + b" " for w in part) for part in (said[mid : a + m["last"] + PASSAGE_WORDS], said[a:mid][::-1]))
                    else:
                        right, left = text[mid : a + m["last"] + LENGTH], text[a:mid][::-1]
                    held.append((m["gram"] % buckets, right, left, ids[d] or 0, keys[d], a, m["last"], m["anchor"], m["gram"], m["n"]))
            if len(held) >= FLUSH_MARKS:
                yield from coded(held)
                held = []
        if held:
            yield from coded(held)

    def coded(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda h: (h[0], h[1]))
        rows: list[list] = []
        at = 0
        while at < len(held):
            to = at
            while to < len(held) and held[to][0] == held[at][0]:
                to += 1
            part = held[at:to]
            left = [h[8].to_bytes(8, "big", signed=True) + h[2] for h in part]
            order = sorted(range(len(part)), key=left.__getitem__)
            rows.append([part[0][0], *([h[k] for h in part] for k in range(3, 10)), *front_code([h[1] for h in part]), order, *front_code([left[o] for o in order])])
            at = to
        kinds = [pa.int32(), *(pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=RUN_FIELDS)

    return run


def settle_group(right: list[int], left: list[int], dmin: np.ndarray, dmax: np.ndarray, right_lcp: np.ndarray, left_lcp: np.ndarray, length: int | None = None, width: int | None = None) -> np.ndarray:
    """Which windows of a group's contexts repeat: a boolean per context and depth (bytes or words of the window left of the anchor).

    ``right``/``left``: contexts in the order of their suffixes and of their reversed prefixes, with the prefix lengths
    that neighbours share. Two contexts share the window of depth d if they agree d left and length - d
    right (a window of ``LENGTH`` bytes and a gram of ``GRAM``, unless given).
    """
    length = LENGTH if length is None else length
    n, depths = len(right), length - (GRAM if width is None else width) + 1
    out = np.zeros((n, depths), bool)
    if n <= SMALL_GROUP:
        place = np.empty(n, np.int64)
        place[left] = np.arange(n)
        for i in range(n):
            r = length
            for j in range(i + 1, n):
                r = min(r, int(right_lcp[j]))
                a, b = right[i], right[j]
                lo, hi = sorted((int(place[a]), int(place[b])))
                reach = int(left_lcp[lo + 1 : hi + 1].min())
                first, final = max(length - r, dmin[a], dmin[b], 0), min(reach, dmax[a], dmax[b])
                if first <= final:
                    out[a, first : final + 1] = out[b, first : final + 1] = True
        return out
    block = max(1, (1 << 20) // n)
    order_r, order_l = np.array(right), np.array(left)
    for d0 in range(0, depths, block):
        d = np.arange(d0, min(d0 + block, depths))[:, None]
        key = np.empty((len(d), n), np.int64)
        key[:, order_r] = np.cumsum(right_lcp[None, :] < length - d, axis=1) * n
        other = np.empty((len(d), n), np.int64)
        other[:, order_l] = np.cumsum(left_lcp[None, :] < d, axis=1)
        key += other
        fits = (d >= dmin[None, :]) & (d <= dmax[None, :])
        key[~fits] = -1 - np.broadcast_to(np.arange(n), key.shape)[~fits]
        order = np.argsort(key, axis=1, kind="stable")
        ordered = np.take_along_axis(key, order, axis=1)
        equal = ordered[:, 1:] == ordered[:, :-1]
        twin = np.zeros(key.shape, bool)
        twin[:, 1:] |= equal
        twin[:, :-1] |= equal
        back = np.zeros(key.shape, bool)
        np.put_along_axis(back, order, twin, axis=1)
        out[:, d0 : d0 + len(d)] = back.T
    return out


SPAN = "id long, rk long, start long, last long, words int"


@lean
def merge_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs, sorted by bucket, to the repeated window runs of contexts that occur once."""

    def settle(runs: list[dict]) -> pa.RecordBatch:
        offset = np.concatenate([[0], np.cumsum([len(r["gram"]) for r in runs])])
        gram = [g for r in runs for g in r["gram"]]
        words = runs[0]["bucket"] & 1
        right, right_lcp = [], []
        for run, place, s, shared in merge_runs([(r["right_shared"], r["right_rest"]) for r in runs]):
            right.append(int(offset[run]) + place)
            right_lcp.append(s.count(b" ", 0, shared) if words else shared)
        left, left_lcp = {}, {}
        for run, place, s, shared in merge_runs([(r["left_shared"], r["left_rest"]) for r in runs]):
            c = int(offset[run]) + runs[run]["left_order"][place]
            left.setdefault(gram[c], []).append(c)
            left_lcp.setdefault(gram[c], []).append(s.count(b" ", 8, shared) if words else shared - 8)
        groups: dict[int, tuple[list[int], list[int]]] = {}
        for c, shared in zip(right, right_lcp):
            held = groups.setdefault(gram[c], ([], []))
            held[0].append(c)
            held[1].append(shared)
        flat = {k: [v for r in runs for v in r[k]] for k in ("id", "rk", "start", "last", "anchor", "n")}
        out: list[tuple] = []
        for g, (members, shared) in groups.items():
            if len(members) < 2:
                continue
            local = {c: i for i, c in enumerate(members)}
            anchor, last = np.array([flat["anchor"][c] for c in members]), np.array([flat["last"][c] for c in members])
            r_lcp, l_lcp = np.array(shared), np.array(left_lcp[g])
            r_lcp[0] = l_lcp[0] = -1
            found = settle_group(list(range(len(members))), [local[c] for c in left[g]], anchor - last, anchor, r_lcp, l_lcp, *((PASSAGE_WORDS, GRAM_WORDS) if words else (LENGTH, GRAM)))
            for i in np.flatnonzero(found.any(axis=1)):
                c = members[i]
                if flat["n"][c] > 1:
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[0], found[i].astype(np.int8), [0]])))
                for d0, d1 in zip(edge[::2], edge[1::2] - 1):
                    out.append((flat["id"][c], flat["rk"][c], flat["start"][c] + int(anchor[i] - d1), int(d1 - d0)))
        return pa.RecordBatch.from_arrays([*(pa.array([o[k] for o in out], pa.int64()) for k in range(4)), pa.array([words] * len(out), pa.int32())], names=["id", "rk", "start", "last", "words"])

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield settle(held)
                held = []
            held.append(row)
    if held:
        yield settle(held)


@lean
def window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, rk, text, marks) to one row per window of the marked contexts, with its 128-bit hash."""
    for batch in batches:
        data, ends = flat_text(batch.column(2))
        ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for d, marks in enumerate(batch.column(3).to_pylist()):
            raw = data[ends[d] : ends[d + 1]]
            said = word_hashes(raw, np.array([0, len(raw)]))[0] if any(m["gram"] & 1 for m in marks) else raw
            for m in marks:
                words = m["gram"] & 1
                a, length = m["start"], PASSAGE_WORDS if words else LENGTH
                w = np.arange(m["last"] + 1)
                part = (said if words else raw)[a : a + m["last"] + length]
                one = Rolling(part).get(w, w + length)
                two = Rolling(part[::-1]).get(m["last"] - w, m["last"] - w + length)
                n = len(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([ids[d] or 0] * n, pa.int64()), pa.array([keys[d]] * n, pa.int64()), pa.array(w + a), pa.array([words] * n, pa.int32()), pa.array([m["n"]] * n, pa.int64())],
                    names=["h1", "h2", "id", "rk", "start", "words", "n"],
                )


def ranges_of(raw: np.ndarray, runs: list[dict]) -> list[dict]:
    """Byte ranges of the passages of window runs of words, joined where they share a word or touch."""
    start, last = np.array([s["start"] for s in runs]), np.array([s["last"] for s in runs])
    _, start, last = merged_runs(np.zeros(len(start), np.int64), start, last + PASSAGE_WORDS - 1)
    begin, end = words_of(raw)
    return [{"start": a, "length": b - a} for a, b in zip(begin[start].tolist(), end[start + last].tolist())]


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes long, kept_text string, n_passages long, passage_bytes long, removed array<struct<start:long,length:long>>, passages array<struct<start:long,length:long>>"
RANGES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


@lean
def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) to what is left, its digest, the byte ranges that went and those of the passages."""
    for batch in batches:
        data, ends = flat_text(batch.column(1))
        found = batch.column(2).to_pylist()
        for i, j in slices(ends):
            removed, marks, left, ranges, passages = [], [], [], [], []
            for d in range(i, j):
                raw = data[ends[d] : ends[d + 1]]
                spans = []
                by_word = [s for s in found[d] or [] if s["words"]]
                passages.append(ranges_of(raw, by_word) if by_word else [])
                if found[d] and len(by_word) < len(found[d]):
                    start, last = (np.array([s[k] for s in found[d] if not s["words"]]) for k in ("start", "last"))
                    _, start, last = merged_runs(np.zeros(len(start), np.int64), start, last + LENGTH - 1)
                    spans = [{"start": a, "length": n} for a, n in zip(start.tolist(), (last + 1).tolist())]
                    edges = [0, *(x for s in spans for x in (s["start"], s["start"] + s["length"])), len(raw)]
                    raw = np.concatenate([raw[a:b] for a, b in zip(edges[::2], edges[1::2])])
                kept = raw.tobytes()
                removed.append(int(ends[d + 1] - ends[d]) - len(kept))
                marks.append(hashlib.sha256(kept).hexdigest())
                left.append(kept.decode("utf-8", "replace"))
                ranges.append(spans)
            size = np.diff(ends[i : j + 1])
            columns = [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(size), pa.array(removed, pa.int64()), pa.array([len(r) for r in ranges], pa.int64()), pa.array(marks, pa.string())]
            columns += [pa.array(size - np.array(removed, np.int64)), pa.array(left, pa.string()), pa.array([len(p) for p in passages], pa.int64()), pa.array([sum(x["length"] for x in p) for p in passages], pa.int64())]
            columns += [pa.array(ranges, RANGES), pa.array(passages, RANGES)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in CUT.split(", ")])


def repeated_runs(src: DataFrame, group_rows: int = GROUP_ROWS, broadcast_rows: int = 500_000) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``id, rk, start, last, words``: runs of window starts (start to start + last) that repeat, of ``doc_id, rk, text``; and
    the hint for a side with at most a row for each document that has some.

    The runs are not written, so that one exchange of the documents serves the suffixes and whatever joins the runs.
    """
    found = src.mapInArrow(emit_contexts, CONTEXT).repartition("gram").sortWithinPartitions("gram", "content")
    acted = shared_table(found.mapInArrow(settled_classes(group_rows), ACTED), "acted")
    counts = {r["kind"]: r["n"] for r in acted.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    few = sum(counts.values()) <= broadcast_rows // 4

    def hinted(side: DataFrame) -> DataFrame:
        return F.broadcast(side) if few else side

    def marked(kind: int) -> DataFrame:
        mark = F.struct("start", "last", "anchor", "gram", "n")
        m = acted.where(F.col("kind") == kind).groupBy(F.col("id").alias("__id"), F.col("rk").alias("__rk")).agg(F.collect_list(mark).alias("marks"))
        return src.join(hinted(m), same_row()).select("doc_id", "rk", "text", "marks")

    out = acted.where("kind = 0").select("id", "rk", "start", "last", "words")
    if counts.get(1):
        # even, so that bytes and words part
        buckets = 2 * max(int(src.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2, counts[1] // 40_000, 1)
        runs = marked(1).mapInArrow(sorted_runs(buckets), RUN)
        out = out.unionByName(runs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(merge_buckets, SPAN))
    if counts.get(2):
        windows = marked(2).dropDuplicates(["doc_id", "rk"]).mapInArrow(window_hashes, "h1 long, h2 long, id long, rk long, start long, words int, n long")
        windows = shared_table(windows, "hot-windows")
        often = windows.groupBy("h1", "h2").agg(F.count("*").alias("times")).where("times > 1")
        out = out.unionByName(windows.where("n = 1").join(often, ["h1", "h2"]).select("id", "rk", "start", F.lit(0).cast("long").alias("last"), "words"))
    return out, hinted


def same_row() -> Column:
    """A document's ``doc_id`` (0 for null) and ``rk`` are ``__id`` and ``__rk``; ``rk`` differs for ids null and 0."""
    return (F.col("rk") == F.col("__rk")) & (F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")) == F.col("__id"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", group_rows: int = GROUP_ROWS, broadcast_rows: int = 500_000) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, then ``kept_bytes``, ``kept_text``, ``n_passages`` and
    ``passage_bytes`` (repeated passages of at least ``PASSAGE_WORDS`` words: number and size, removed or not), ``removed`` and
    ``passages`` (byte ranges of the input) for every row of ``docs``. ``kept_text`` has U+FFFD where a cut went through a character; the digest is of
    the bytes."""
    src = docs.select(F.col(key).alias("doc_id"), row_key(key, text).alias("rk"), F.coalesce(text, F.lit("")).alias("text"))
    runs, hinted = repeated_runs(src, group_rows, broadcast_rows)
    spans = runs.groupBy(F.col("id").alias("__id"), F.col("rk").alias("__rk")).agg(F.collect_list(F.struct("start", "last", "words")).alias("spans"))
    joined = src.join(hinted(spans), same_row(), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(cut, CUT)
