"""Top-k search, near-duplicates, substrings, lines, mixing and the pipeline, against brute force."""

import ast
import collections
import hashlib
import re

import duckdb
import numpy as np
import pytest
import xxhash
from fixtures import documents, prose, texts
from pyspark.sql import functions as F

from glyphmax.llm import common, line_dedup, simhash_dedup, source_mix, substring_dedup, top_k
from glyphmax.llm.components import connected_components


@pytest.mark.parametrize("blocks", [{}, {"candidate_rows": 8, "query_rows": 2}, {"candidate_rows": 100, "round_queries": 3}])
def test_top_k_equals_sql_and_ties(spark, sf, blocks):
    from comparing import same_rows

    duckdb.sql(f"create or replace view embeddings as select * from '{sf}/embeddings.parquet'")
    same_rows(top_k.exact_top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), **blocks).toPandas(), duckdb.sql(top_k.ORACLE_SQL).df())


def test_top_k_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 3)]) for i in range(1, 9)] + [(50, [1.0, 1.0]), (50, [1.0, 1.0]), (50, [1.0, -2.0]), (100, [1.0]), (20, None), (21, [None, 1.0]), (22, [nan, 1.0]), (23, [inf, 0.0]), (None, [9.0, 9.0]), (7, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = sorted(map(tuple, top_k.exact_top_k(df).collect()))
    ok = [(i, np.floor(256 * np.array((v + [0.0])[:2]))) for i, v in rows if i is not None and i not in (20, 21, 22, 23)]
    want = []
    for n, (q, w) in enumerate(ok):  # every row of a repeated query is one, and no candidate of itself only
        if q % 50 == 0:
            best = sorted(((-int(w @ v), i) for m, (i, v) in enumerate(ok) if m != n))[:5]
            want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    assert got == sorted(want) and len(got) == 20
    assert top_k.exact_top_k(df.limit(0)).count() == 0


def slow_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 2]), 42) for i in range(max(1, len(w) - 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(ids, linked):
    comp = list(ids)
    while True:
        new = [min((comp[j] for j in np.flatnonzero(linked[i]) if comp[j] is not None), default=None) for i in range(len(ids))]
        if new == comp:
            return comp
        comp = new


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rows = texts()
    fp = np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
    linked = np.bitwise_count(fp[:, None] ^ fp[None]) <= 6
    want = sorted(map(str, zip([i for i, _ in rows], [f"{x:016x}" for x in fp], (linked.sum(1) - 1).tolist(), least_reachable([i for i, _ in rows], linked))))
    for size in (50_000, 1):  # whole buckets, and buckets split into sub-buckets
        monkeypatch.setattr(simhash_dedup, "BUCKET_ROWS", size)
        got = simhash_dedup.near_duplicates(documents(spark)).collect()
        assert sorted(str(tuple(r)) for r in got) == want
    assert simhash_dedup.near_duplicates(documents(spark, [])).count() == 0
    kept = simhash_dedup.one_of_each(documents(spark))
    assert kept.columns == documents(spark).columns
    comp = least_reachable([i for i, _ in rows], linked)
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == sorted({str(c) for c in comp})


def test_buckets_equal_all_pairs():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ np.bitwise_or.reduce([np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64) for _ in range(k)]) for k in range(1, 9)] + [base]))
    n, weight = len(fp), r.integers(1, 5, len(fp))
    near = collections.Counter()
    edges = set()
    rows = [(t << 16 | int(x >> np.uint64(8 * i) & np.uint64(255)) * 256 + int(x >> np.uint64(8 * j) & np.uint64(255)), x, w) for t, (i, j) in enumerate(simhash_dedup.TABLES) for x, w in zip(fp, weight)]
    key, value, w = (np.array(c) for c in zip(*rows))
    f, c, root = simhash_dedup.link_buckets(key.astype(np.int64), key.astype(np.int64) >> 16, value.astype(np.uint64).view(np.int64), w.astype(np.int64), np.zeros(len(key), np.int32), np.zeros(len(key), bool))
    for x, k in zip(f, c):
        near[int(x)] += int(k)
    linked = (np.bitwise_count(fp[:, None] ^ fp[None]) <= 6) & ~np.eye(n, dtype=bool)
    assert [near[int(x)] for x in fp.view(np.int64)] == (linked * weight).sum(1).tolist()
    assert len(edges) == 0 and set(root.tolist()) <= set(fp.view(np.int64).tolist())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 201), (201, 205), (205, 203)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 200 for i in (200, 201, 203, 205)}


def slow_cut(rows, size=400):
    raw = [(t or "").encode() for _, t in rows]
    n = collections.Counter(b[p : p + size] for b in raw for p in range(len(b) - size + 1))
    out = []
    for (i, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if n[b[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append(str((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"group_rows": 1}, {"broadcast_rows": 0}])
def test_substrings_equal_brute_force(spark, how):
    r = __import__("random").Random(9)
    core = prose(r, 120)
    rows = texts() + [(200 + k, prose(r, r.randint(0, 30)) + core[r.randint(0, 200) : r.randint(450, len(core))] + prose(r, r.randint(0, 20))) for k in range(40)]
    got = substring_dedup.deduplicated(documents(spark, rows), **how).collect()
    assert sorted(str(tuple(x)[:5]) for x in got) == slow_cut(rows)
    for x in got:
        assert x["kept_bytes"] == x["n_bytes"] - x["n_removed"] and sum(s["length"] for s in x["removed"]) == x["n_removed"] and len(x["removed"]) == x["n_spans"]
        assert "\ufffd" in x["kept_text"] or hashlib.sha256(x["kept_text"].encode()).hexdigest() == x["kept_sha256"]


@pytest.mark.parametrize("how", [{}, {"group_rows": 1, "broadcast_rows": 0}])
def test_passages_of_words_equal_brute_force(spark, how):
    r = __import__("random").Random(3)
    core = [r.choice("abcdefgé") + str(r.randint(0, 9)) for _ in range(70)]
    rows = texts() + [(200 + k, prose(r, r.randint(0, 9)) + " " + " \n"[k % 2].join(core[k % 5 : k % 5 + 46 + k]) + "\t" + prose(r, r.randint(0, 9))) for k in range(12)]
    words = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for _, t in rows]
    said = [[(t or "").encode()[a:b] for a, b in w] for (_, t), w in zip(rows, words)]
    n = collections.Counter(tuple(w[k : k + 50]) for w in said for k in range(len(w) - 49))
    want = []
    for (i, _), w, at in zip(rows, said, words):
        ins = {k + x for k in range(len(w) - 49) if n[tuple(w[k : k + 50])] > 1 for x in range(50)}
        first, last = [k for k in sorted(ins) if k - 1 not in ins], [k for k in sorted(ins) if k + 1 not in ins]
        want.append(str((i, len(first), sum(at[b][1] - at[a][0] for a, b in zip(first, last)))))
    got = substring_dedup.deduplicated(documents(spark, rows), **how).collect()
    assert sorted(str((x["doc_id"], x["n_passages"], x["passage_bytes"])) for x in got) == sorted(want)
    assert all(len(x["passages"]) == x["n_passages"] for x in got)
    short = [x for x in got if x["n_passages"] and not x["n_removed"]]
    assert len(short) >= 6  # of 50 words and more, under 400 bytes


def stages_of(spark):
    """Bytes that each stage so far wrote to shuffles and tables, by its number."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = context._jvm.java.util.ArrayList
    found = context._jsc.sc().statusStore().stageList(none(), False, False, context._gateway.new_array(context._jvm.double, 0), none())
    return {x.stageId(): x.shuffleWriteBytes() + x.outputBytes() for x in map(found.apply, range(found.size()))}


def test_substrings_move_little(spark, tmp_path):
    r = __import__("random").Random(21)
    core = prose(r, 3000)
    rows = [(k, prose(r, r.randint(100, 300)) + (core[(at := r.randint(0, 15_000)) : at + 900] if k % 3 == 0 else "")) for k in range(3000)]
    documents(spark, rows).select("doc_id", "text").coalesce(4).write.parquet(str(tmp_path / "docs"))
    size = sum(f.stat().st_size for f in (tmp_path / "docs").glob("*.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        began = max(stages_of(spark))
        got = substring_dedup.deduplicated(spark.read.parquet(str(tmp_path / "docs")), broadcast_rows=0)
        assert sum(x["n_removed"] > 0 for x in got.collect()) >= 900
        moved = sum(n for k, n in stages_of(spark).items() if k > began)
        assert moved < 3 * size  # nothing is broadcast, as in large tables
        assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()  # the documents are exchanged once
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_substrings_of_an_empty_table(spark):
    assert substring_dedup.deduplicated(documents(spark, [])).count() == 0


def test_merge_of_front_coded_runs():
    r = np.random.default_rng(4)
    runs = [sorted(bytes(r.integers(97, 99, r.integers(0, 12)).astype(np.uint8)) for _ in range(r.integers(0, 30))) for _ in range(7)]
    out = list(substring_dedup.merge_runs([substring_dedup.front_code(x) for x in runs]))
    assert [s for _, _, s, _ in out] == sorted(s for x in runs for s in x)
    for (_, _, a, _), (_, _, b, k) in zip(out, out[1:]):
        assert k == substring_dedup.common(a, b)
    assert all(runs[run][place] == s for run, place, s, _ in out)


def test_settling_by_depth_equals_pairs(monkeypatch):
    r = np.random.default_rng(6)
    left = [bytes(r.integers(97, 99, 6).astype(np.uint8)) for _ in range(40)]
    right = [bytes(r.integers(97, 99, 6).astype(np.uint8)) for _ in range(40)]
    monkeypatch.setattr(substring_dedup, "LENGTH", 8)
    monkeypatch.setattr(substring_dedup, "GRAM", 2)
    order = sorted(range(40), key=lambda i: right[i])
    left, right = [left[i] for i in order], [right[i] for i in order]
    by_left = sorted(range(40), key=lambda i: left[i])
    r_lcp = np.array([-1] + [substring_dedup.common(a, b) for a, b in zip(right, right[1:])])
    l_lcp = np.array([-1] + [substring_dedup.common(left[a], left[b]) for a, b in zip(by_left, by_left[1:])])
    dmin, dmax = np.full(40, 2), np.full(40, 6)
    found = []
    for size in (100, 1):
        monkeypatch.setattr(substring_dedup, "SMALL_GROUP", size)
        found.append(substring_dedup.settle_group(list(range(40)), by_left, dmin, dmax, r_lcp, l_lcp))
    want = np.zeros((40, 7), bool)
    for d in range(2, 7):
        n = collections.Counter((left[i][:d], right[i][: 8 - d]) for i in range(40))
        want[:, d] = [n[left[i][:d], right[i][: 8 - d]] > 1 for i in range(40)]
    assert (found[0] == want).all() and (found[1] == want).all()


def distance(a, b, most):
    """Edit distance, or more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = {j: j for j in range(most + 1)}
    for i in range(1, len(a) + 1):
        row = {j: i if not j else min(row.get(j, most + 1) + 1, row.get(j - 1, most + 1) + (a[i - 1] != b[j - 1])) for j in range(max(0, i - most), min(len(b), i + most) + 1)}
        for j in sorted(row):
            row[j] = min(row[j], row.get(j - 1, most + 1) + 1)
    return row[len(b)]


def slow_lines(rows, edits=3):
    """(doc_id, kept text, lines, removed lines) of documents in order of id (null first), each one once."""
    earlier, seen, out = [], set(), []
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines, kept = (t or "").split("\n"), []
        for x in lines:
            if len(x) < 16 and not re.search(r"[^\x20\x09-\x0D]", x):
                kept.append(x)
                continue
            bound = lambda y: max(1, min(edits, min(len(x), len(y)) // 16))
            if x not in seen and not (len(x) >= 16 and any(distance(x, y, bound(y)) <= bound(y) for y in earlier if len(y) >= 16)):
                kept.append(x)
            if x not in seen:
                earlier.append(x)
            seen.add(x)
        out.append(str((i, "\n".join(kept), len(lines), len(lines) - len(kept))))
    return sorted(out)


@pytest.mark.parametrize("edits", [1, 3])
def test_lines_equal_brute_force(spark, edits):
    r = __import__("random").Random(8)
    long = prose(r, 9)
    rows = [x for n, x in enumerate(texts()) if x[0] != 60 or n % 2]  # 60 is there twice
    rows += [(300, long), (301, long[:-1]), (302, long[1:]), (303, long[:9] + "#" + long[10:]), (304, long[:9] + "##" + long[10:]), (305, "short\nshort"), (306, long + "\nnew line of some length\n" + long)]
    rows += [(307, " " * 20 + "\n  \n  \n" + " " * 20), (308, "é漢🙂 " * 5 + "\n" + "é漢🙂 " * 4 + "é漢🙂"), (309, "é漢🙂" * 5), (310, "é漢🙂" * 5 + "x"), (311, "x" * 4999 + "y"), (312, "x" * 4996)]
    got = line_dedup.deduplicated(documents(spark, rows), edits=edits).select("doc_id", "kept_text", "n_lines", "n_removed").collect()
    assert sorted(str(tuple(x)) for x in got) == slow_lines(rows, edits)
    assert line_dedup.line_digest(documents(spark, [])).count() == 0


def test_lines_equal_sql_and_short_repeats_go(spark, sf, monkeypatch):
    from comparing import same_rows

    rows = [(1, "Les.\n\n \nLes."), (2, "Les.\nLet.\n "), (3, "Les.")]
    got = line_dedup.deduplicated(documents(spark, rows)).select("doc_id", "kept_text").collect()
    assert sorted(map(tuple, got)) == [(1, "Les.\n\n "), (2, "Let.\n "), (3, "")]
    duckdb.sql(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    want = duckdb.sql(line_dedup.ORACLE_SQL).df()
    same_rows(line_dedup.line_digest(spark.read.parquet(f"{sf}/documents.parquet")).toPandas(), want)
    for name, value in (("SENT_KEYS", 0), ("SEEN_LINES", 3), ("BUCKET_KEYS", 1000)):  # joined keys, forgetful scans, many buckets
        monkeypatch.setattr(line_dedup, name, value)
    monkeypatch.setattr(line_dedup.lines_of_edits, "__defaults__", (0,))
    same_rows(line_dedup.line_digest(spark.read.parquet(f"{sf}/documents.parquet").repartition(5)).toPandas(), want)


@pytest.mark.parametrize("sent_keys", [8_000_000, 0])
def test_byte_edits_equal_sql(spark, sent_keys, monkeypatch):
    from comparing import same_rows

    monkeypatch.setattr(line_dedup.lines_of_edits, "__defaults__", (sent_keys,))
    line = "é漢🙂 line of some length that is repeated with few edits, "
    lines = [line]
    for n, (a, b) in enumerate((("é", "è"), ("é", "e"), ("é", ""), ("漢", "字"), ("漢", "a"), ("🙂", "🙃"), ("🙂", ""), ("🙂", "#"), ("é漢", "éé漢"), ("line", "lïnë"), ("few", "fëw"))):
        lines += [2 * f"{n * 1111111} {line}", 2 * f"{n * 1111111} {line}".replace(a, b), f"{n * 1111111} {line}" + f"{n * 1111111} {line}".replace(a, b)]
    docs = documents(spark, list(enumerate(lines))).select("doc_id", "text")
    duckdb.sql("create or replace table byte_lines as select * from (values " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(lines)) + ") v(doc_id, text)")
    want = duckdb.sql(line_dedup.ORACLE_SQL.replace("FROM documents", "FROM byte_lines")).df()
    same_rows(line_dedup.line_digest(docs).toPandas(), want)
    gone = {n: sum(r["n_removed"] for r in line_dedup.deduplicated(docs, byte_edits=n).collect()) for n in (False, True)}
    assert gone[False] > gone[True] == want["n_removed"].sum() > 0


def test_columns_of_clashing_names(spark):
    odd = documents(spark, [(1, "a line of more than sixteen\na line of more than sixteen"), (2, None)]).withColumnsRenamed({"source": "n_removed", "lang": "gone_lines", "lines": "row"})
    odd = odd.withColumn("kept_text", F.lit(1)).withColumn("__rk", F.lit(2)).withColumn("__key", F.lit(2)).withColumn("text2", F.col("text"))
    out = line_dedup.deduplicated(odd)
    assert len(set(out.columns)) == len(out.columns) and {(r["doc_id"], r["kept_text"], r["n_removed"], r["gone_lines"]) for r in out.collect()} == {(1, "a line of more than sixteen", 1, "en"), (2, "", 0, "en")}
    assert simhash_dedup.one_of_each(odd).columns == odd.columns
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")
    assert source_mix.mixed(odd, labels).columns == odd.columns


@pytest.mark.parametrize("edits", [2, 3])
def test_lines_within_a_bound_equal_brute_force(spark, edits):
    r = __import__("random").Random(edits)
    lines = []
    for size in (16, 17, 31, 32, 33, 47, 48, 50, 90):
        base = "".join(r.choice("abcé🙂 ") for _ in range(size))
        for _ in range(12):
            x = list(base)
            for _ in range(r.randint(1, 5)):
                at = r.randrange(len(x))
                x[at : at + r.randint(0, 1)] = r.choice(["", "#", "a"])
            lines.append("".join(x))
    lines += ["ab" * 20, "ab" * 21, "ba" * 20, "x" * 60, "x" * 63, "x" * 64, "y" * 16, "y" * 15, "y" * 17]
    r.shuffle(lines)

    def gone(i):
        return len(lines[i]) >= 16 and any(
            x == lines[i] or len(x) >= 16 and distance(x, lines[i], m := max(1, min(edits, min(len(x), len(lines[i])) // 16))) <= m for x in lines[:i]
        )

    want = [int(gone(i) or lines[i] in lines[:i]) for i in range(len(lines))]
    assert 20 < sum(want) < 100
    got = line_dedup.deduplicated(documents(spark, list(enumerate(lines))), edits=edits).collect()
    assert [x["n_removed"] for x in sorted(got, key=lambda x: x["doc_id"])] == want


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a line of more than sixteen"), (1, "a line of more than sixteen"), (2, "a line of more than sixteen")]
    assert sorted((r["doc_id"], r["n_removed"]) for r in line_dedup.line_digest(documents(spark, rows)).collect()) == [(1, 0), (1, 0), (2, 1)]


def test_documents_are_cut_unsorted(spark):
    rows = [(None, "a line of more than sixteen\nx"), (None, "a line of more than sixteen\nx"), (1, "a line of more than sixteen\ny"), (1, None), (2, "x\nz")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = line_dedup.cleaned(documents(spark, rows))
        joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "gone_rk" in x]
        assert joins and all("ShuffledHashJoin" in x for x in joins)
        assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == [("1", ""), ("1", "y"), ("2", "z"), ("None", rows[0][1]), ("None", rows[0][1])]
        common.small_batches(spark)
        assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_rates_equal_a_driver_side_descent(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = source_mix.mix_rates(docs, labels).toPandas()
    names = list(source_mix.TARGETS)
    p, n = out[[f"p_{d}" for d in names]].to_numpy(), out["n_tokens"].to_numpy()
    assert p.sum(1) == pytest.approx(1) and (out["rate"] >= 0).all()
    goal = np.array([source_mix.TARGETS[d] for d in names]) * n.sum()
    r = np.ones(len(n))
    for _ in range(4000):
        g = (r * n) @ p / goal - 1
        r = np.maximum(0, r - 0.2 * (p @ g + source_mix.RIDGE * (r - 1)))
    assert (out["rate"] * n) @ p == pytest.approx((r * n) @ p, rel=0.02)
    assert (out["rate"] * n) @ p == pytest.approx(goal, rel=0.05)


@pytest.mark.parametrize("targets, scale, missed", [((0.93, 0.02, 0.05), 1, False), ((0.2, 0.1, 0.7), 1, True), ((0.93, 0.02, 0.05), 1e-3, True), ((1, 0, 0), 1, True)])
def test_rates_are_optimal(spark, targets, scale, missed):
    import warnings

    r = np.random.default_rng(2)
    p = r.dirichlet([8, 0.4, 0.4], 3000) * [1, scale, 1]
    p /= p.sum(1, keepdims=True)
    n = r.integers(0, 900, 3000)
    names = ["clean", "low", "toxic"]
    found = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n_tokens long, p_clean double, p_low double, p_toxic double")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        g = source_mix.fit_misses(found, dict(zip(names, targets)))
    rates = source_mix.rates(p, g)
    goal = np.maximum(np.array(targets), 1e-6) * n.sum()
    slope = p @ ((rates * n) @ p / goal - 1) + source_mix.RIDGE * (rates - 1)
    # zero for positive rates and none below zero for rates of zero
    assert np.abs(slope[rates > 0]).max() < 1e-6 and slope[rates == 0].min(initial=0) > -1e-6
    assert any("targets missed" in str(w.message) for w in said) == missed
    if targets[2] == 0.7:
        with pytest.raises(RuntimeError, match="not settled"):
            source_mix.fit_misses(found, dict(zip(names, targets)), steps=1)


def test_domains_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    names = list(source_mix.TARGETS)
    found = source_mix.posteriors(docs, source_mix.fit(docs, labels, names), names, ["doc_id"])
    rows = found.join(labels.withColumn("domain", source_mix.domain_of()), "doc_id").where(source_mix.held_out()).collect()
    assert np.mean([max(names, key=lambda k: r[f"p_{k}"]) == r["domain"] for r in rows]) > 0.75


def test_mix_of_odd_tables(spark):
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(30)] + [(3, None, None)], "doc_id long, quality int, toxic int")
    docs = documents(spark)
    assert source_mix.mix_rates(docs, labels).count() == docs.count()
    out = source_mix.mixed(docs, labels)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, source_mix.mixed(docs.repartition(3), labels).collect()))
    for d, l in ((documents(spark, []), labels), (docs, labels.limit(0)), (documents(spark, [(1, None), (2, "")]), labels)):
        assert source_mix.mix_rates(d, l).count() == d.count() and source_mix.mixed(d, l).columns == docs.columns


def test_pipeline_stages(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf).toPandas()
        if name == "quality classifier":
            assert 0.5 * before < len(out) < before
        if name == "line dedup":
            assert (out["n_chars"] == out["text"].str.len()).all()
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert sorted(map(str, zip(out["doc_id"], out["text"]))) == sorted(str(tuple(ast.literal_eval(x)[:2])) for x in slow_lines(rows))
        if name == "near-duplicates":
            fp = np.array([slow_fingerprint(t) for t in out["text"]], np.uint64)
            all_fp = np.array([slow_fingerprint(r["text"]) for r in docs.collect()], np.uint64)
            linked = np.bitwise_count(all_fp[:, None] ^ all_fp[None]) <= 6
            assert len(out) == len(set(least_reachable(list(range(len(all_fp))), linked))) == len(set(fp.tolist()))
        if name != "sentence pieces":
            assert list(out.columns) == docs.columns
            docs = spark.createDataFrame(out, docs.schema)
    assert out["round_trip"].all() and list(out["n_tokens"]) == [len(x) for x in out["token_ids"]]
    assert sorted(pipeline.run(spark, sf).toPandas()["doc_id"]) == sorted(out["doc_id"])
