"""Operator 3, token counts: prefix dynamic programming over a byte-level BPE vocabulary.

Every pre-token is encoded once by :func:`glyphmax.llm.lattice.relax`, which stores the exact token count at *every*
prefix. A text's count is a sum of stored counts, and truncation or budget questions ("how many bytes fit in 512
tokens?") are answered from the stored prefix counts, without encoding anything again.

Defined results: null or empty text has 0 bytes and 0 tokens; texts of any length are read whole (a long one in
stretches that end between pre-tokens, a single giant pre-token edge by edge); repeated rows each get a row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from glyphmax.llm.common import SLICE_BYTES, flat_text, lean, slices, stretches
from glyphmax.llm.lattice import NONE, Merges, PairTable, relax, relax_long

#: Split of byte-level BPE before merging; white space by its Unicode property.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""

#: Pre-tokens of at most ``KEPT_CHARS`` characters whose counts a worker keeps; the older half goes first.
CACHE_ENTRIES, KEPT_CHARS = 300_000, 40
#: Bytes beyond which a pre-token is relaxed by itself, and of which the edges are found at a time.
LONG, BLOCK = 1 << 10, 1 << 16
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long"


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts at every prefix, for a ``tokenizers`` JSON file of a byte-level BPE."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_alphabet(), spec["model"]["vocab"]
        raw = {t: bytes(letters[c] for c in t) for t in vocab if all(c in letters for c in t)}
        size = max(vocab.values()) + 1
        rank, left, right = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        keys, ranks = [], []
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            keys.append(i * size + j)
            ranks.append(r)
            if rank[k] < 0:
                rank[k], left[k], right[k] = r, i, j
        self.merges = Merges(rank, left, right, PairTable(np.array(keys, np.int64), np.array(ranks, np.int64)))
        self.width = max(map(len, raw.values()))
        nodes: dict[bytes, int] = {b"": 0}
        steps: dict[int, int] = {}
        token = [-1]
        for t, b in raw.items():
            at = 0
            for i in range(1, len(b) + 1):
                nxt = nodes.get(b[:i])
                if nxt is None:
                    nxt = nodes[b[:i]] = len(token)
                    token.append(-1)
                    steps[at * 256 + b[i - 1]] = nxt
                at = nxt
            token[at] = vocab[t]
        self.trie = PairTable(np.fromiter(steps, np.int64, len(steps)), np.fromiter(steps.values(), np.int64, len(steps)))
        self.node_token = np.array(token, np.int64)
        self.split = regex.compile(PATTERN)
        special = [x["content"] for x in spec.get("added_tokens", ())]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cache: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def edges(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every token (start, end, token) in ``data`` that ends by the ``stop`` of its first byte."""
        begin = at = np.arange(len(data))
        state, found = np.zeros(len(data), np.int64), []
        while len(at):
            state = self.trie.get(state * 256 + data[at])
            go = state != NONE
            state, at, begin, stop = state[go], at[go] + 1, begin[go], stop[go]
            token = self.node_token[state]
            hit = token >= 0
            found.append((begin[hit], at[hit], token[hit]))
            go = at < stop
            state, at, begin, stop = state[go], at[go], begin[go], stop[go]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (at, at, at)  # type: ignore[return-value]

    def prefixes_of_long(self, raw: bytes) -> np.ndarray:
        """Token counts at all byte prefixes of one pre-token of any length."""
        data = np.frombuffer(raw, np.uint8)

        def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for a in range(0, len(data), BLOCK):
                part = data[a : a + BLOCK + self.width].astype(np.int64)
                start, end, token = self.edges(part, np.full(len(part), len(part)))
                ours = np.flatnonzero(start < BLOCK)
                ours = ours[np.argsort(start[ours], kind="stable")]
                yield start[ours] + a, end[ours] + a, token[ours]

        return relax_long(self.merges, len(data), blocks())[2]

    def prefixes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts at all byte prefixes of the words: one array, and each word's first place in it."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        word = np.repeat(np.arange(len(raw)), sizes)
        start, end, token = self.edges(data, np.repeat(np.cumsum(sizes), sizes))
        shift = word[start]
        _, _, count = relax(self.merges, starts, sizes, start + shift, end + shift, token)
        return count, starts

    def learn(self, words: set[str]) -> None:
        if len(self.cache) > CACHE_ENTRIES // 2:
            self.cache, self.old = {}, self.cache
        todo, old = [w for w in words if w not in self.cache], self.old
        self.cache.update((w, old[w]) for w in todo if w in old)
        todo = [w for w in todo if w not in old]
        for w in todo:
            if len(w) > LONG // 4:
                self.cache[w] = int(self.prefixes_of_long(w.encode())[-1])
        todo = [w for w in todo if len(w) <= LONG // 4]
        if todo:
            count, starts = self.prefixes(todo)
            sizes = np.fromiter((len(w.encode()) for w in todo), np.int64, len(todo))
            self.cache.update(zip(todo, count[starts + sizes].tolist()))

    def pieces(self, text: str) -> list[str | None]:
        """Pre-tokens; None stands for a special token."""
        if self.special is None or not self.special.search(text):
            return self.split.findall(text)
        out: list[str | None] = []
        at = 0
        for m in self.special.finditer(text):
            out += [*self.split.findall(text[at : m.start()]), None]
            at = m.end()
        return out + self.split.findall(text[at:])

    def counts(self, texts: list[str], limit: int) -> tuple[list[int], list[int]]:
        """Token counts, and the bytes of the longest prefix within ``limit`` tokens (see :func:`token_counts`)."""
        split = [self.pieces(t) for t in texts]
        words = set(chain.from_iterable(split))
        words.discard(None)
        self.learn(words)
        get = self.cache
        get[None] = 1  # type: ignore[index]
        totals = [sum(map(get.__getitem__, s)) for s in split]
        del get[None]  # type: ignore[arg-type]
        cuts = [len(t.encode()) for t in texts]
        over = [i for i, n in enumerate(totals) if n > limit]
        crossing, room, before = [], [], []
        for i in over:
            done = at = 0
            for w in split[i]:
                n = 1 if w is None else get[w]
                if done + n > limit:
                    break
                done += n
                at += 1
            head = split[i][:at]
            before.append(sum(len(w.encode()) if w is not None else 0 for w in head) + self._special_bytes(texts[i], head.count(None)))
            crossing.append(split[i][at] or "")
            room.append(limit - done)
        short = [k for k, w in enumerate(crossing) if len(w) <= LONG // 4]
        count, starts = self.prefixes([crossing[k] for k in short])
        at_place = dict(zip(short, starts.tolist()))
        for k, (i, w, free, first) in enumerate(zip(over, crossing, room, before)):
            s = at_place.get(k)
            cuts[i] = first + inner_cut(w, self.prefixes_of_long(w.encode()) if s is None else count[s : s + len(w.encode()) + 1], free)
        for w in words:
            if len(w) > KEPT_CHARS:
                del self.cache[w]
        return totals, cuts

    def counts_of_long(self, raw: bytes, limit: int) -> tuple[int, int]:
        """:meth:`counts` of one long text, a stretch at a time."""
        total, cut = 0, len(raw)
        for a, b in stretches(raw, SLICE_BYTES):
            (n,), (c,) = self.counts([raw[a:b].decode()], limit - total if total <= limit else 0)
            if total <= limit < total + n:
                cut = a + c
            total += n
        return total, cut

    def _special_bytes(self, text: str, n: int) -> int:
        return sum(len(m.group().encode()) for _, m in zip(range(n), self.special.finditer(text))) if n and self.special else 0


def inner_cut(word: str, count: np.ndarray, free: int) -> int:
    """Bytes of the longest prefix of a pre-token within ``free`` tokens, at a place where the prefix is split alike."""
    if not free or word.startswith("'") and word[1:].isalpha():
        return 0
    raw = word.encode()
    for n in range(len(raw) - 1, 0, -1):
        if count[n] <= free and raw[n] & 0xC0 != 0x80 and not (n == 1 and word[0].isspace() and not word.isspace()):
            return n
    return 0


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Exact token counts of whole texts.

    Returns ``doc_id, n_bytes, n_tokens, over_limit`` (n_tokens > limit) and ``cut_bytes``: the bytes of a text's
    longest prefix of at most ``limit`` tokens, of those that end between pre-tokens or inside the one that crosses.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            data, ends = flat_text(batch.column(1))
            totals, cuts = [], []
            for i, j in slices(ends):
                if ends[j] - ends[i] > SLICE_BYTES:
                    n, c = ([x] for x in count.counts_of_long(data[ends[i] : ends[j]].tobytes(), limit))
                else:
                    n, c = count.counts([data[ends[k] : ends[k + 1]].tobytes().decode() for k in range(i, j)], limit)
                totals += n
                cuts += c
            n = pa.array(totals, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(np.diff(ends), pa.int64()), n, pa.array([x > limit for x in totals], pa.bool_()), pa.array(cuts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_bytes"],
            )

    return docs.select(key, text).mapInArrow(run, SCHEMA)
