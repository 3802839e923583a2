"""Operator 4, quality rules as a short-circuit cascade.

The counters that every row reports are computed for whole texts in numpy, the base rule from them. The further rules
run as a cascade: each one's cost (seconds a document) and selectivity (share rejected) are measured on a sample, the
rules are ordered by rejection per cost, and a rule sees only documents that all before it let pass. The verdict is a
conjunction, so the order changes the work and never the result.

Defined results: a null or empty text has no words and fails the base rule; texts of any length are read whole;
repeated rows each get a row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmax.llm.common import SLICE_BYTES, flat_text, lean, slices

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
#: Documents on which rules are measured.
SAMPLE_ROWS = 400
WINDOW = 5

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
WHITE = re.compile(rb"[\x20\x09-\x0D]")
LEAD = (np.arange(256) & 0xC0) != 0x80


def per_row(mask: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return np.diff(total[ends])


@dataclass
class Counted:
    """Texts of a slice and their counters."""

    data: np.ndarray
    ends: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_lines: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray

    def text(self, i: int) -> np.ndarray:
        return self.data[self.ends[i] : self.ends[i + 1]]


def word_numbers(raw: bytes) -> np.ndarray:
    """A number for each word, the same for equal ones; words are split a stretch at a time."""
    seen: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(raw):
        found = WHITE.search(raw, at + SLICE_BYTES) if at + SLICE_BYTES < len(raw) else None
        to = found.start() if found else len(raw)
        words = raw[at:to].split()
        parts.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)))
        at = to
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def repeated_words(ids: np.ndarray) -> int:
    """Words (by number) in windows of five that are found at least twice."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)

    two = joined(ids[:-1], ids[1:])
    if int(two.max()) + 1 == len(two):
        return 0
    four = joined(two[:-2], two[2:])
    if int(four.max()) + 1 == len(four):
        return 0
    five = joined(four[:n], ids[4:])
    often = np.flatnonzero(np.bincount(five)[five] > 1)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, often, 1)
    np.add.at(cover, often + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(cover)))


def count(data: np.ndarray, ends: np.ndarray) -> Counted:
    space = SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    start[heads] = ~space[heads]
    n_lines, dups, repeats = np.zeros(len(ends) - 1, np.int64), np.zeros(len(ends) - 1, np.int64), np.zeros(len(ends) - 1, np.int64)
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        raw = data[a:b].tobytes()
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        n_lines[i], dups[i] = len(lines), len(lines) - len(set(lines))
        repeats[i] = repeated_words(word_numbers(raw))
    return Counted(data, ends, per_row(start, ends), per_row(~space & LEAD[data], ends), per_row(SYMBOL[data], ends), n_lines, dups, repeats)


def base_failed(c: Counted) -> np.ndarray:
    return (c.n_words < 10) | (100 * c.n_repeat_words > 20 * c.n_words)


def many_symbols(c: Counted, rows: np.ndarray) -> np.ndarray:
    return 100 * c.n_symbols[rows] > 10 * c.n_words[rows]


def many_dup_lines(c: Counted, rows: np.ndarray) -> np.ndarray:
    return 2 * c.n_dup_lines[rows] > c.n_lines[rows]


def odd_words(c: Counted, rows: np.ndarray) -> np.ndarray:
    return (c.word_chars[rows] < 2 * c.n_words[rows]) | (c.word_chars[rows] > 20 * c.n_words[rows])


def upper_case(c: Counted, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), bool)
    for k, i in enumerate(rows.tolist()):
        x = c.text(i)
        out[k] = 100 * int(np.count_nonzero((x >= 65) & (x <= 90))) > 40 * c.word_chars[i]
    return out


def shouting(c: Counted, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), bool)
    for k, i in enumerate(rows.tolist()):
        out[k] = 100 * int(np.count_nonzero(c.text(i) == 33)) > 50 * c.n_words[i]
    return out


#: A document that any of them rejects is not kept.
RULES: dict[str, Callable[[Counted, np.ndarray], np.ndarray]] = {f.__name__: f for f in (upper_case, shouting, odd_words, many_dup_lines, many_symbols)}


def cascade(c: Counted, order: list[str]) -> np.ndarray:
    """Kept rows; each rule sees the survivors of those before."""
    rows = np.flatnonzero(~base_failed(c))
    for name in order:
        if not len(rows):
            break
        rows = rows[~RULES[name](c, rows)]
    kept = np.zeros(len(c.n_words), bool)
    kept[rows] = True
    return kept


def best_order(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rules by rejection per cost on about ``sample_rows`` documents; rules that reject none come last, cheapest first."""

    @lean
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, n = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0), 0
        for batch in batches:
            data, ends = flat_text(batch.column(0))
            for i, j in slices(ends):
                c = count(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                rows = np.flatnonzero(~base_failed(c))
                n += len(rows)
                for name, rule in RULES.items():
                    began = time.perf_counter()
                    rejected[name] += int(np.count_nonzero(rule(c, rows)))
                    seconds[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(list(RULES)), pa.array([seconds[k] for k in RULES]), pa.array([rejected[k] for k in RULES]), pa.array([n] * len(RULES))], names=["rule", "seconds", "rejected", "n"])

    # a sample by hash of the row, so that it is the same however rows lie; what is drawn is about sample_rows of all
    share = max(1, docs.count() // sample_rows)
    some = docs.select(text).where(F.pmod(F.xxhash64(F.lit(3), key, text), F.lit(share)) == 0).mapInArrow(measure, "rule string, seconds double, rejected long, n long")
    found = some.groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r")).collect()
    gain = {x["rule"]: (-x["r"] / max(x["s"], 1e-9), x["s"]) for x in found}
    return sorted(RULES, key=lambda name: gain.get(name, (0.0, 0.0)))


def quality_rules(docs: DataFrame, text: str = "text", key: str = "doc_id", order: list[str] | None = None) -> DataFrame:
    """Counters, ``base_failed`` and ``kept`` for every row of ``docs``."""
    order = order or best_order(docs, text, key)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = flat_text(batch.column(1))
            for i, j in slices(ends):
                c = count(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), *(pa.array(x) for x in (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, base_failed(c), cascade(c, order)))],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
                )

    return docs.select(key, text).mapInArrow(run, SCHEMA)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS gram FROM d, unnest(range(1, len(w) - 3)) AS t(i) WHERE len(w) >= 5
), r AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) > 1 AS often FROM g
), p AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM r, unnest(range(0, 5)) AS t(k) WHERE often GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), c AS (
  SELECT d.doc_id, len(w) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(l.n_dup, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(replace(text, '!', '')) AS n_bang
  FROM d LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words
    OR word_chars > 20 * n_words OR 100 * n_upper > 40 * word_chars OR 100 * n_bang > 50 * n_words) AS kept
FROM b
"""
