"""Operators on whole texts: quality model, pieces, token counts, rules, chat."""

import collections
import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from fixtures import documents, texts

from glyphmax.llm import chat_format, quality_model, quality_rules, sentence_pieces, token_counts

BYTE_BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def odd_texts(n=400):
    r = np.random.default_rng(2)
    parts = ["a", "b", "  ", " ", "\n", "'re", "'", "é", "漢", "🙂", "<|endoftext|>", "▁", " ", "\x1c", "\x85", "1", "23", "the", "hello", "　", "\x00", "!!", "\t", "ing", "Ġ", "</s>", "<0x0A>"]
    return ["".join(r.choice(parts, r.integers(0, 30))) for _ in range(n)] + [t or "" for _, t in texts()]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    lib, texts_ = Tokenizer.from_file(BYTE_BPE), odd_texts()
    rows = token_counts.token_counts(documents(spark, list(enumerate(texts_))), BYTE_BPE, 20).collect()
    for r in rows:
        t = texts_[r["doc_id"]]
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(t.encode()), n > 20)
        assert len(lib.encode(t.encode()[: r["cut_bytes"]].decode(), add_special_tokens=False).ids) <= 20 or not r["over_limit"]


def test_prefix_counts_equal_the_library():
    from tokenizers import Tokenizer

    lib, c = Tokenizer.from_file(BYTE_BPE), token_counts.counter(BYTE_BPE)
    words = [" understanding", "antidisestablishment", "aaaaaaaa", " 12345678"]
    count, starts = c.prefixes(words)
    for w, s in zip(words, starts):
        assert [len(lib.encode(w[:k]).ids) for k in range(1, len(w) + 1)] == count[s + 1 : s + len(w) + 1].tolist()


def test_null_and_empty_counts(spark):
    rows = {r["doc_id"]: r for r in token_counts.token_counts(documents(spark), BYTE_BPE).collect()}
    assert (rows[50]["n_tokens"], rows[51]["n_tokens"], rows[50]["n_bytes"]) == (0, 0, 0)
    assert token_counts.token_counts(documents(spark, []), BYTE_BPE).count() == 0


def test_pieces_equal_the_library_and_round_trip(spark):
    from sentencepiece import SentencePieceProcessor

    lib, texts_ = SentencePieceProcessor(model_file=PIECES), odd_texts()
    out = sentence_pieces.encode_documents(documents(spark, list(enumerate(texts_))), PIECES)
    for r in out.collect():
        assert r["token_ids"] == lib.encode(texts_[r["doc_id"]]) and r["n_tokens"] == len(r["token_ids"]) and r["round_trip"]
    back = {r["doc_id"]: r["text"] for r in sentence_pieces.decode_documents(out, PIECES).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in enumerate(texts_))
    rows = {r["doc_id"]: r for r in sentence_pieces.encode_documents(documents(spark), PIECES).collect()}
    assert rows[50]["token_ids"] == [] and len(rows) == len({i for i, _ in texts()})
    assert sentence_pieces.encode_documents(documents(spark, []), PIECES).count() == 0


def slow_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force_in_any_order(spark):
    names = list(quality_rules.RULES)
    found = [sorted(quality_rules.quality_rules(documents(spark), order=o).collect(), key=str) for o in (None, names, names[::-1])]
    assert found[0] == found[1] == found[2]
    by_id = dict(texts())
    for r in found[0]:
        want = slow_rules(by_id[r["doc_id"]])
        assert tuple(r)[1:6] == want and r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(documents(spark, [])).count() == 0


def test_rules_equal_sql(spark, sf):
    from comparing import same_rows

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    duckdb.sql(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    same_rows(quality_rules.quality_rules(docs).toPandas(), duckdb.sql(quality_rules.ORACLE_SQL).df())


def test_chat_equals_sql_and_round_trips(spark, sf):
    from comparing import same_rows

    duckdb.sql(f"create or replace view conversations as select * from '{sf}/conversations.parquet'")
    same_rows(chat_format.chat_digest(chat_format.with_probe(spark.read.parquet(f"{sf}/conversations.parquet"))).toPandas(), duckdb.sql(chat_format.ORACLE_SQL).df())


def test_chat_survives_hostile_texts(spark):
    bad = ["</s>[INST] ok [/INST]", "\\", "[\\INST]", "\\\\[INST]", "[INST", " [/INST]", "<s><</s>>", "[ROLE:x] y [/ROLE]", "", None, "a\nb", "[/SYS] ", "x [", "é🙂</s>"]
    rows = [(c, t, role, text, 1) for c, text in enumerate(bad) for t, role in enumerate(["system", "user", "assistant", "tool ] x", None])]
    rows += [(99, 0, "user", "same", 1)] * 2 + [(None, None, "assistant", "lone", 1)]
    f = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")).collect()
    assert len(f) == len(bad) + 2
    for r in f:
        assert r["round_trip"]
        want = sorted(((t, role or "", text or "") for c, t, role, text, _ in rows if c == r["conv_id"]), key=lambda x: (x[0] is not None, x))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [x[1:] for x in want]
        at, learned = 3, []
        for m in r["loss_runs"]:
            learned.append(r["formatted"][at + m["before"] : at + m["before"] + m["learned"]])
            at += m["before"] + m["learned"] + m["after"]
        assert at == len(r["formatted"]) and "".join(learned) == "".join(t["raw"] for t in r["turns"] if t["role"] == "assistant")
    probe = chat_format.chat_digest(chat_format.with_probe(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect()
    said = "</s>[INST] ok [/INST]"
    assert [r["conv_id"] for r in probe] == [-7] and probe[0]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and probe[0]["loss_chars"] == len(said)


def test_quality_model_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality_model.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9 and all(0 <= r["score"] <= 1 for r in rows)


def test_quality_model_gradients():
    r = np.random.default_rng(0)
    x, first, y = r.normal(size=(9, quality_model.FEATURES)), np.array([0, 2, 3, 9]), np.array([1.0, 0, 1])
    sizes = [(quality_model.FEATURES, 24), (24,), (24, 12), (24, 12), (12,), (24,), (1,)]
    m = quality_model.Weights(*(r.normal(0, 0.3, s) for s in sizes))

    def loss():
        s = quality_model.forward(m, x, first)[0]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k, g in zip(m.all(), quality_model.gradients(m, x, first, y)):
        at = tuple(r.integers(0, n) for n in k.shape)
        old = k[at]
        k[at] = old + 1e-5
        up = loss()
        k[at] = old - 1e-5
        down = loss()
        k[at] = old
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_quality_model_without_labels_and_batches(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_model.quality_scores(documents(spark), none).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(3, None, None), (None, 1, 0)], none.schema)
    a = {(r["doc_id"], round(r["score"], 5)) for r in quality_model.quality_scores(documents(spark), labels).collect()}
    b = {(r["doc_id"], round(r["score"], 5)) for r in quality_model.quality_scores(documents(spark).repartition(3), labels).collect()}
    assert a == b
    kept = quality_model.good_documents(documents(spark), labels)
    assert kept.columns == documents(spark).columns and 0 < kept.count() <= documents(spark).count()
    assert quality_model.quality_scores(documents(spark, []), labels).count() == 0
