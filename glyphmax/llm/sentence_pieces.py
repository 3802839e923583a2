"""Operator 2, SentencePiece encoding and decoding by suffix-array matching.

The batch's distinct words are concatenated and indexed by a suffix array; every vocabulary piece is binary-searched
for the range of suffixes that it begins, so each range entry is an edge (start, end, piece) of the batch's lattice.
The edges are sorted by position and relaxed in one pass (:func:`glyphmax.llm.lattice.relax`). For a BPE model the
relaxation keeps, at each position, the one piece that score-ordered merging leaves there, which gives the ids of the
reference library; it is no highest-score path. Words with more than one leading space mark, whose pieces of spaces
only tie in score, are merged literally, by a heap. Words of over ``LONG`` characters are relaxed one at a time.

A word is what follows a space (written as its rest) or a newline (written with it); marks at its end that no piece
joins to what stands before are words of their own.

Defined results: null or empty text has no ids; unknown characters become byte pieces; U+2581 is a space, as in the
library; decoding returns the text with U+2581 replaced by a space. Repeated rows each get a row, an empty table an
empty result, further columns are ignored, texts of any length are encoded whole (a long one in stretches that end
between words, so that only its ids and its longest word are held).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glyphmax.llm.common import flat_text, lean, slices, stretches
from glyphmax.llm.lattice import Merges, PairTable, merge_literally, relax, relax_long

SPACE = "▁"
#: Words of at most ``KEPT_CHARS`` characters whose ids a worker keeps; the older half goes first.
CACHE_ENTRIES, KEPT_CHARS = 200_000, 40
#: Bytes of text whose new words are indexed together.
BATCH_BYTES = 2 << 20
#: Characters of new words in one suffix array.
INDEX_CHARS = 1 << 17
#: Characters beyond which a word is relaxed by itself.
LONG = 1 << 10
#: Characters by which suffixes are sorted.
HEAD = 8
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
SCHEMA = "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean"


class PieceModel:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = [0] * 256
        usable: dict[str, int] = {}
        spelled: list[bytes] = []
        for i, p in enumerate(text):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                spelled.append(bytes([int(p[3:5], 16)]))
                continue
            hidden = sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
            spelled.append(b"" if hidden else p.replace(SPACE, " ").encode())
            if not hidden:
                usable[p] = i
        if any(SPACE in p.strip(SPACE) or p.strip(SPACE) and p.endswith(SPACE) or "\n" in p and p != "\n" or "\0" in p for p in usable):
            raise ValueError("pieces of this model cross word borders")
        self.bytes_of = pa.array(spelled, pa.binary())
        score = {p: sp.get_score(i) for p, i in usable.items()}
        order = {p: r for r, p in enumerate(sorted((p for p in usable if len(p) > 1), key=lambda p: (-score[p], usable[p])))}
        self.unknown = n
        rank, left, right = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.pairs: dict[tuple[int, int], tuple[float, int]] = {}
        by_rank: dict[tuple[int, int], tuple[int, int]] = {}
        for p in order:
            for k in range(1, len(p)):
                a, b = usable.get(p[:k]), usable.get(p[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = (-score[p], usable[p])
                    by_rank[a, b] = (order[p], usable[p])
        edge = {}
        for p, i in usable.items():
            if len(p) == 1:
                edge[p] = i
                continue
            if any(c not in usable for c in p):
                continue
            parts = [usable[c] for c in p]
            while len(parts) > 2:
                k = min(((by_rank[x][0], j) for j, x in enumerate(zip(parts, parts[1:])) if x in by_rank), default=(0, -1))[1]
                if k < 0:
                    break
                parts[k : k + 2] = [by_rank[parts[k], parts[k + 1]][1]]
            if len(parts) == 2 and by_rank.get((parts[0], parts[1]), (0, -1))[1] == i:
                edge[p], rank[i], left[i], right[i] = i, order[p], parts[0], parts[1]
        keys = np.fromiter((a * (n + 1) + b for a, b in by_rank), np.int64, len(by_rank))
        self.merges = Merges(rank, left, right, PairTable(keys, np.fromiter((r for r, _ in by_rank.values()), np.int64, len(by_rank))))
        self.usable = usable
        pieces = sorted(edge)
        self.piece_id = np.array([edge[p] for p in pieces], np.int32)
        self.piece_len = np.array([len(p) for p in pieces], np.int32)
        self.width = int(self.piece_len.max())
        self.piece_chars = np.array(pieces, f"<U{self.width}").view(np.uint32).reshape(len(pieces), self.width)
        #: Characters that stand side by side in a piece: elsewhere a word can be cut.
        self.inner = {p[k : k + 2] for p in usable for k in range(len(p) - 1)}
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.newline = self.encode_words(["\n"])[0]
        self.words = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n[^{SPACE}\n]*")

    def edges(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence of every piece in ``chars`` (code points; 0 between words): its place and its piece."""
        alphabet, code = np.unique(chars, return_inverse=True)
        bits = max(1, int(len(alphabet)).bit_length())
        span = min(HEAD, 62 // bits)
        place = np.minimum(np.searchsorted(alphabet, self.piece_chars), len(alphabet) - 1)
        there = (alphabet[place] == self.piece_chars) | (self.piece_chars == 0)
        usable = np.flatnonzero(there.all(axis=1))
        letters = np.where(self.piece_chars[usable] == 0, -1, place[usable]).astype(np.int64) + 1  # 0: past the piece's end
        size = self.piece_len[usable]

        def packed(columns: np.ndarray) -> np.ndarray:
            key = np.zeros(columns.shape[0], np.int64)
            for k in range(columns.shape[1]):
                key = (key << bits) | columns[:, k]
            return key

        code = np.concatenate([code.astype(np.int64) + 1, np.zeros(self.width + span, np.int64)])
        key = np.zeros(len(chars) + self.width, np.int64)
        for k in range(span):
            key = (key << bits) | code[k : k + len(key)]
        suffixes = np.argsort(key[: len(chars)])
        heads = key[suffixes]
        shift = bits * np.maximum(0, span - size)
        low = packed(letters[:, :span])
        first, last = np.searchsorted(heads, low, "left"), np.searchsorted(heads, low | ((np.int64(1) << shift) - 1), "right")
        found = np.flatnonzero(last > first)
        sizes = (last - first)[found]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at, piece = suffixes[np.repeat(first[found], sizes) + within], np.repeat(found, sizes)
        for k in range(span, self.width, span):  # pieces beyond the sorted heads: the next characters at their places
            deep = np.flatnonzero(size[piece] > k)
            if not len(deep):
                break
            part = letters[:, k : k + span]
            rest = packed(part) << bits * (span - part.shape[1])
            mask = (np.int64(1) << bits * np.maximum(0, k + span - size)) - 1
            same = (key[at[deep] + k] | mask[piece[deep]]) == (rest[piece[deep]] | mask[piece[deep]])
            keep = np.ones(len(at), bool)
            keep[deep[~same]] = False
            at, piece = at[keep], piece[keep]
        return at, usable[piece]

    def lattice(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edges (start, end, token) of ``chars``, unknown characters among them, and the places of those."""
        start, piece = self.edges(chars)
        size = self.piece_len[piece]
        known = np.zeros(len(chars), bool)
        known[start[size == 1]] = True
        lone = np.flatnonzero(~known & (chars != 0))
        start = np.concatenate([start, lone])
        end = start + np.concatenate([size, np.ones(len(lone), np.int32)])
        return start, end, np.concatenate([self.piece_id[piece], np.full(len(lone), self.unknown, np.int32)]), lone

    def spell(self, ids: np.ndarray, at_char: np.ndarray, word: str) -> bytes:
        """Ids with unknown characters as byte pieces."""
        line: list[int] = []
        for t, c in zip(ids.tolist(), at_char.tolist()):
            line += [self.byte_id[x] for x in word[c].encode("utf-8", "surrogatepass")] if t == self.unknown else [t]
        return np.array(line, np.int32).tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Piece ids (int32 bytes) of words with at most one leading space mark and of at most ``LONG`` characters."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - (sizes + 1)  # a word of n characters owns n + 1 nodes; the last is its separator
        joined = "\0".join(w.replace("\0", "\U0010ffff") for w in words) + "\0"
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        start, end, token, lone = self.lattice(chars)
        last, source, count = relax(self.merges, starts, sizes, start, end, token)
        node = starts + sizes
        total = count[node].astype(np.int64)
        first = np.cumsum(total) - total
        ids, at_char = np.empty(int(total.sum()), np.int32), np.empty(int(total.sum()), np.int64)
        place, live = first + total - 1, np.flatnonzero(total > 0)
        node, place = node[live], place[live]
        while len(live):
            ids[place], at_char[place] = last[node], source[node]
            node, place = source[node], place - 1
            more = place >= first[live]
            node, place, live = node[more], place[more], live[more]
        raw = ids.tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(first.tolist(), (first + total).tolist())]
        for w in set((np.searchsorted(starts, lone, "right") - 1).tolist()):
            part = slice(int(first[w]), int(first[w] + total[w]))
            out[w] = self.spell(ids[part], at_char[part] - starts[w], words[w])
        return out

    def encode_long(self, word: str) -> bytes:
        """One word of any length, its edges found a stretch at a time."""

        def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for a in range(0, len(word), INDEX_CHARS):
                part = word[a : a + INDEX_CHARS + self.width]
                start, end, token, _ = self.lattice(np.frombuffer(part.replace("\0", "\U0010ffff").encode("utf-32-le", "surrogatepass"), np.uint32))
                ours = np.flatnonzero(start < INDEX_CHARS)
                ours = ours[np.argsort(start[ours], kind="stable")]
                yield start[ours] + a, end[ours] + a, token[ours]

        last, source, count = relax_long(self.merges, len(word), blocks())
        ids, at_char, node = np.empty(int(count[-1]), np.int32), np.empty(int(count[-1]), np.int64), len(word)
        for k in range(len(ids) - 1, -1, -1):
            ids[k], at_char[k] = last[node], source[node]
            node = int(source[node])
        return self.spell(ids, at_char, word) if (ids == self.unknown).any() else ids.tobytes()

    def encode_spaced(self, word: str) -> bytes:
        """A word after several spaces, by literal merging; the spaces before the last few merge among themselves."""
        symbols, spell = [], {}
        for c in word:
            i = self.usable.get(c)
            if i is None:
                i = -1 - len(spell)
                spell[i] = [self.byte_id[x] for x in c.encode("utf-8", "surrogatepass")]
            symbols.append(i)
        merged = merge_literally(symbols, self.pairs)
        return np.array(list(chain.from_iterable(spell[i] if i < 0 else [i] for i in merged)), np.int32).tobytes()

    def encode_all(self, words: list[str]) -> list[bytes]:
        """Ids of words, as many at a time as one suffix array should hold."""
        out: list[bytes] = []
        at = 0
        while at < len(words):
            size, to = 0, at
            while to < len(words) and len(words[to]) <= LONG and (size == 0 or size + len(words[to]) < INDEX_CHARS):
                size += len(words[to]) + 1
                to += 1
            out += self.encode_words(words[at:to]) if to > at else [self.encode_long(words[at])]
            at = max(to, at + 1)
        return out

    def learn(self, keys: set[str]) -> None:
        """Have the ids of words in the cache. A key is a word without its space mark, or one that starts with a newline,
        or with the marks that follow a space."""
        if len(self.cache) > CACHE_ENTRIES // 2:
            self.cache, self.old = {}, self.cache
        if len(self.tails) > CACHE_ENTRIES // 4:
            self.tails = {}
        cache, old, tails, inner = self.cache, self.old, self.tails, self.inner
        ask: dict[str, str] = {}  # what to encode, and how it is spelled
        cut: list[tuple[str, str, str]] = []
        for k in [k for k in keys if k not in cache]:
            if (v := old.get(k)) is not None:
                cache[k] = v
            elif k[:1] == SPACE:
                cache[k] = self.encode_spaced(k)
            elif k == "\n":
                cache[k] = self.newline
            else:
                core = k.rstrip(MARKS)
                if core and len(k) - KEPT_CHARS <= len(core) < len(k) and core != "\n" and core[-1] + k[len(core)] not in inner:
                    tail = k[len(core) :]
                    cut.append((k, core, tail))
                    if tail not in tails:
                        ask["\0" + tail] = tail
                    k = core
                    if k in cache:
                        continue
                ask[k] = k[1:] if k[:1] == "\n" else SPACE + k
        for k, v in zip(ask, self.encode_all(list(ask.values()))):
            if k[:1] == "\0" and ask[k][:1] != SPACE:
                tails[k[1:]] = v
            else:
                cache[k] = self.newline + v if k[:1] == "\n" else v
        for k, core, tail in cut:
            cache[k] = cache[core] + tails[tail]
        for core in {core for _, core, _ in cut if len(core) > KEPT_CHARS and core not in keys}:
            del cache[core]

    def split(self, text: str, first: bool = True) -> list[str]:
        """Keys of a text's words; a text that is not the ``first`` stretch of its document has no space in front."""
        if "  " in text or " \n" in text or SPACE in text or text[:1] == " " or text[-1:] == " ":
            keys = [w[1:] if w[0] == SPACE and w[1:2] != SPACE else w for w in self.words.findall(SPACE + text.replace(" ", SPACE))]
        else:
            keys = text.replace("\n", " \n").split(" ")
        return keys if first or keys[0] else keys[1:]

    def encode(self, texts: list[str], first: bool = True) -> list[bytes]:
        """Ids of each text, as the bytes of an int32 array."""
        split = [self.split(t, first) if t else [] for t in texts]
        keys = set(chain.from_iterable(split))
        self.learn(keys)
        out = [b"".join(map(self.cache.__getitem__, s)) for s in split]
        for k in keys:
            if len(k) > KEPT_CHARS:
                del self.cache[k]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids, the space that encoding puts in front included."""
        return self.bytes_of.take(pa.array(ids, pa.int32())).buffers()[2].to_pybytes() if len(ids) else b""


@lru_cache(maxsize=4)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encoded(pieces: PieceModel, raw: list[bytes]) -> tuple[list[bytes], list[bool]]:
    """Ids of texts (int32 bytes), and whether decoding gives them back (with U+2581 as a space)."""
    mark = SPACE.encode()
    if len(raw) == 1 and len(raw[0]) > BATCH_BYTES:
        out, same = [], True
        for n, (a, b) in enumerate(stretches(raw[0], BATCH_BYTES)):
            part = raw[0][a:b]
            if n and part[:1] == b" ":  # it ends the stretch before; encoding puts it back
                part = part[1:]
            ids = pieces.encode([part.decode()], n == 0 or part[:1] != b"\n")[0]
            back = pieces.decode(np.frombuffer(ids, np.int32))
            same = same and back == (b"" if n and part[:1] == b"\n" else b" ") + part.replace(mark, b" ")
            out.append(ids)
        return [b"".join(out)], [same]
    ids = pieces.encode([t.decode() for t in raw])
    want = b"".join(b" " + t for t in raw if t)
    if pieces.decode(np.frombuffer(b"".join(ids), np.int32)) == (want.replace(mark, b" ") if mark in want else want):
        return ids, [True] * len(raw)
    return ids, [pieces.decode(np.frombuffer(x, np.int32)) == (b" " + t.replace(mark, b" ") if t else b"") for x, t in zip(ids, raw)]


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Ids of whole texts, decoded again: ``doc_id, n_tokens, token_ids, round_trip``.

    ``round_trip``: the decoded ids are the text's bytes (with U+2581 as a space).
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            data, ends = flat_text(batch.column(1))
            for i, j in slices(ends, BATCH_BYTES):
                ids, back = encoded(pieces, [data[ends[k] : ends[k + 1]].tobytes() for k in range(i, j)])
                sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32))), pa.array(back, pa.bool_())],
                    names=["doc_id", "n_tokens", "token_ids", "round_trip"],
                )

    return docs.select(key, text).mapInArrow(run, SCHEMA)


def decode_documents(encoded: DataFrame, path: str, ids: str = "token_ids", key: str = "doc_id") -> DataFrame:
    """Texts of id arrays: ``doc_id, text``; null ids give an empty text, bytes that are no UTF-8 become U+FFFD."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            raw = [pieces.decode(np.array(x or [], np.int32)) for x in batch.column(1).to_pylist()]
            texts = [(x[1:] if x[:1] == b" " else x).decode("utf-8", "replace") for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(key, ids).mapInArrow(run, "doc_id long, text string")
