"""Texts far longer than what an operator handles at once, runs of one character, and odd inputs of the pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from fixtures import documents, prose, texts

from glyphmax.llm import chat_format, common, line_dedup, quality_model, quality_rules, sentence_pieces, simhash_dedup, source_mix, substring_dedup, token_counts

BYTE_BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def long_texts():
    r = random.Random(3)
    base = prose(r, 4000) + "\n\n漢字 — é🙂\n" + "a  b \n c" * 50 + " "
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABC") for _ in range(60_000))
    return [base * 180, "a" * 300_000, " " * 300_000, letters, " " * 3000 + "word " + "#" * 100_000 + ".", "".join(chr(r.randint(0x4E00, 0x4F00)) for _ in range(50_000)), base]


def test_pieces_and_counts_equal_the_libraries(long_texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    pieces, counter = sentence_pieces.model(PIECES), token_counts.counter(BYTE_BPE)
    lib, other = SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BYTE_BPE)
    assert len(long_texts[0].encode()) > 2 * sentence_pieces.BATCH_BYTES > common.SLICE_BYTES
    for t in long_texts:
        raw = t.encode()
        (ids,), (same,) = sentence_pieces.encoded(pieces, [raw])
        assert same and np.frombuffer(ids, np.int32).tolist() == lib.encode(t)
        n, cut = counter.counts_of_long(raw, 512)
        assert n == len(other.encode(t, add_special_tokens=False).ids)
        assert len(other.encode(raw[:cut].decode(), add_special_tokens=False).ids) <= 512 or n <= 512
    assert all(len(k) <= sentence_pieces.KEPT_CHARS for k in pieces.cache) and all(len(k) <= token_counts.KEPT_CHARS for k in counter.cache)


def test_stretches_change_nothing(monkeypatch):
    pieces, counter = sentence_pieces.model(PIECES), token_counts.counter(BYTE_BPE)
    whole = [t.encode() for _, t in texts() if t] + ["x.\n\ny z\n漢字\nend. a  b \nq ▁ r <|endoftext|> s".encode() * 9]
    want = [(sentence_pieces.encoded(pieces, [t])[0], counter.counts([t.decode()], 20)) for t in whole]
    for name, module in (("BATCH_BYTES", sentence_pieces), ("SLICE_BYTES", token_counts)):
        monkeypatch.setattr(module, name, 40)
    for t, (ids, (n, cut)) in zip(whole, want):
        assert sentence_pieces.encoded(pieces, [t]) == (ids, [True])
        total, at = counter.counts_of_long(t, 20)
        assert total == n[0] and (n[0] <= 20 or at <= cut[0])


def test_memory_of_a_long_text():
    """A worker of its own reads 32 MB in one row."""
    import subprocess
    import sys

    code = f"""
import resource, sys
from glyphmax.llm import token_counts
raw = b'some words of a line, and 12 more\\n' * 1_000_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
c = token_counts.counter({BYTE_BPE!r})
n = c.counts_of_long(raw, 512)
print(n[0], (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300).stdout.split()
    assert int(out[0]) > 9_000_000 and int(out[1]) < 400


def slow_score(m, text):
    """The model's score of a text, passage by passage."""
    raw, size = text.encode(), quality_model.PASSAGE
    hidden, logits = [], []
    for p in range(max(1, -(-len(raw) // size))):
        part = raw[p * size : (p + 1) * size]
        counts = collections.Counter()
        for i in range(p * size, min((p + 1) * size, len(raw) - 2)):
            a, b, c = raw[i : i + 3]
            h = (((a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF)) + c & 0xFFFFFFFF) * 0xC2B2AE3D & 0xFFFFFFFF
            counts[h >> 23] += 1
        total = max(1, sum(counts.values()))
        x = np.zeros(quality_model.FEATURES)
        for k, n in counts.items():
            x[k] = (n / total) ** 0.5
        kinds = [str.isupper, str.isdigit, lambda c: 33 <= ord(c) < 127 and not c.isalnum() and c not in ".,", lambda c: c in "\t\n\x0b\x0c\r ", lambda c: ord(c) >= 128, lambda c: c in ",."]
        for k, kind in enumerate(kinds):
            x[quality_model.BUCKETS + k] = sum(bool(kind(chr(b))) and (b < 128 or k == 4) for b in part) / max(1, len(part))
        x[-1] = len(counts) / total
        h = np.tanh(x @ m.w + m.b)
        hidden.append(h)
        logits.append(float((np.tanh(h @ m.v) / (1 + np.exp(-(h @ m.u)))) @ m.a))
    weight = np.exp(np.array(logits) - max(logits))
    z = (weight / weight.sum()) @ np.array(hidden)
    return 1 / (1 + np.exp(-(z @ m.c + m.d[0])))


@pytest.mark.parametrize("stretch", [quality_model.STRETCH, 800])
def test_scores_equal_a_plain_forward_pass(monkeypatch, stretch):
    monkeypatch.setattr(quality_model, "STRETCH", stretch)
    r = np.random.default_rng(5)
    sizes = [(quality_model.FEATURES, 24), (24,), (24, 12), (24, 12), (12,), (24,), (1,)]
    m = quality_model.Weights(*(r.normal(0, 0.4, s) for s in sizes))
    for _, t in texts()[:6] + texts()[-10:]:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        got = quality_model.scores(m, raw, np.array([0, len(raw)]))[0]
        assert got == pytest.approx(slow_score(m, t or ""), abs=1e-5)
    both = [np.frombuffer((t or "").encode(), np.uint8) for _, t in texts()]
    ends = np.cumsum([0, *map(len, both)])
    assert quality_model.scores(m, np.concatenate(both), ends) == pytest.approx([quality_model.scores(m, b, np.array([0, len(b)]))[0] for b in both], abs=1e-6)


def test_document_features_in_stretches(monkeypatch, long_texts):
    for t in long_texts[1:]:
        raw = np.frombuffer(t.encode(), np.uint8)
        want = source_mix.document_features(raw, np.array([0, len(raw)]))
        monkeypatch.setattr(source_mix, "SLICE_BYTES", 5000)
        got = source_mix.document_features(raw, np.array([0, len(raw)]))
        monkeypatch.undo()
        assert np.allclose(got[0], want[0], atol=1e-5) and got[1].tolist() == want[1].tolist()


def test_operators_on_long_texts(spark, long_texts):
    rows = list(enumerate(long_texts)) + [(99, long_texts[0])]
    docs = documents(spark, rows)
    for r in quality_rules.quality_rules(docs).collect():
        t = dict(rows)[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)))
    marks = {r["doc_id"]: r for r in simhash_dedup.near_duplicates(docs).collect()}
    assert marks[0]["fingerprint"] == marks[99]["fingerprint"] and marks[99]["component_id"] == 0
    kept = {r["doc_id"]: r for r in substring_dedup.deduplicated(docs).collect()}
    assert kept[0]["n_removed"] == kept[99]["n_removed"] == len(long_texts[0].encode()) and kept[1]["kept_bytes"] == 0 and kept[3]["n_removed"] == 0
    lines = {r["doc_id"]: r for r in line_dedup.deduplicated(docs).collect()}
    assert lines[99]["n_removed"] > 0 and lines[1]["kept_text"] == long_texts[1]
    f = chat_format.format_conversations(spark.createDataFrame([(1, 0, "user", long_texts[0]), (1, 1, "assistant", long_texts[1])], "conv_id long, turn long, role string, text string")).first()
    assert f["round_trip"] and hashlib.sha256(f["turns"][1]["text"].encode()).hexdigest() == hashlib.sha256(long_texts[1].encode()).hexdigest()


def test_pipeline_of_odd_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    odd = documents(spark).withColumnsRenamed({"score": "rate", "spans": "n_removed", "lines": "row"})
    for docs in (odd, odd.limit(0)):
        given = docs
        for name, stage in pipeline.STAGES:
            out = stage(spark, given, str(tmp_path))
            if name != "sentence pieces":
                assert out.columns == docs.columns and {tuple(r) for r in out.select("n_removed", "rate", "row").distinct().toPandas().astype(str).itertuples(index=False)} <= {("3", "0.5", "['x']")}
                given = spark.createDataFrame(out.collect(), docs.schema)
        assert out.count() == given.count() and (given.count() > 0) == (docs.count() > 0)
