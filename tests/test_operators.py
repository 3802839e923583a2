import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmax import catalog
from glyphmax.functions import vec
from glyphmax.operators import codecs, geometry, grid, metrics, prune, selectors, similarity, tokens


def vectors(spark, pages, dim=16, seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for page, n in enumerate(pages):
        for t in range(n):
            v = r.normal(size=dim)
            rows.append((page, t, False, [float(x) for x in v / np.linalg.norm(v)]))
    return spark.createDataFrame(rows, "page_id long, tok int, is_text boolean, v array<double>")


@pytest.mark.parametrize("dim", [8, 13, 64])
def test_sign_codes_round_trip(spark, dim):
    v = vectors(spark, [5], dim)
    out = v.select("v", vec.pack_bits(F.col("v"), dim).alias("code")).withColumn("back", vec.unpack_signs(F.col("code"), dim)).collect()
    for r in out:
        assert bytes(r["code"]) == np.packbits(np.array(r["v"]) > 0).tobytes() and len(r["code"]) == vec.code_bytes(dim)
        assert r["back"] == [1.0 if x > 0 else -1.0 for x in r["v"]]


def test_int8_and_unknown_method(spark):
    r = vectors(spark, [4]).select("v", vec.int8(F.col("v")).alias("c")).collect()
    for x in r:
        assert x["c"] == np.clip(np.rint(np.array(x["v"]) / 0.5 * 127), -127, 127).astype(int).tolist()
    with pytest.raises(ValueError):
        codecs.encode(F.col("v"), "nothing", 8)
    assert codecs.bytes_per_vector("binary", 13, True) == 6


def test_maxsim_plans_agree_and_empty_pages(spark):
    v = vectors(spark, [5, 1, 7, 3])
    q = v.where("page_id < 2").select(F.col("page_id").alias("qid"), F.col("tok").alias("qtok"), "v")
    a = {(r["qid"], r["page_id"]): r["score"] for r in similarity.maxsim(similarity.page_rows(v), q).collect()}
    b = {(r["qid"], r["page_id"]): r["score"] for r in similarity.maxsim_relational(v, q).collect()}
    assert a == pytest.approx(b)
    blocks = {(r["qid"], r["page_id"]): r["score"] for r in similarity.maxsim(similarity.page_rows(v), q, block_tokens=1).collect()}
    assert blocks == pytest.approx(a)
    empty = spark.createDataFrame([(9, 0, [])], "page_id long, n int, flat array<double>")
    assert similarity.maxsim(empty, q).first()["score"] == float("-inf")
    with pytest.raises(ValueError):
        similarity.ranked(similarity.maxsim(empty, q), 0)


def test_tau_extremes(spark):
    run = lambda order: spark.createDataFrame([(1, p, i + 1) for i, p in enumerate(order)], "qid long, page_id long, rank int")
    a, b = run([1, 2, 3, 4]), run([4, 3, 2, 1])
    assert metrics.tau_b(a, a).first()["tau"] == 1 and metrics.tau_b(a, b).first()["tau"] == -1
    assert metrics.tau_b(a, run([5, 6, 7, 8])).first()["tau"] < 0 and metrics.tau_shared(a, run([5, 6])).first()["tau"] == 1
    assert metrics.rbo(a, a).first()["rbo"] == pytest.approx(1) and metrics.tau_ap(a, b).first()["tau_ap"] == -1


def test_metrics_count_missing_queries(spark):
    run = spark.createDataFrame([(1, 10, 1)], "qid long, page_id long, rank int")
    qrels = spark.createDataFrame([(1, 10), (2, 11)], "qid long, page_id long")
    r = metrics.evaluate(run, qrels).first()
    assert r["ndcg_5"] == 0.5 and r["hit_1"] == 0.5 and r["n_queries"] == 2


def literal_clusters(x, threshold):
    leader = [-1] * len(x)
    for i in range(len(x)):
        if leader[i] < 0:
            leader[i] = i
            for j in range(i + 1, len(x)):
                if leader[j] < 0 and x[i] @ x[j] >= threshold:
                    leader[j] = i
    return leader


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.6, 1.0])
def test_greedy_clusters_equal_the_literal_loop(threshold):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 8)) if threshold < 0.5 else r.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = list(range(len(x))) if threshold >= 1 else literal_clusters(x, threshold)
    assert prune.greedy_clusters(x, threshold).tolist() == want


def test_merge_modes(spark):
    v = vectors(spark, [6, 4])
    c = prune.redundancy(v, 0.2)
    for merge in (True, False):
        rows = prune.merged(v, c, merge).collect()
        assert sum(r["size"] for r in rows) == 10 and all(abs(np.linalg.norm(r["v"]) - 1) < 1e-9 for r in rows)
        at_once = {(r["page_id"], r["tok"]): r for r in prune.clustered(v, 0.2, None, merge).collect()}
        assert len(at_once) == len(rows) and all(at_once[r["page_id"], r["tok"]]["size"] == r["size"] and np.allclose(at_once[r["page_id"], r["tok"]]["v"], r["v"]) for r in rows)


def test_codebooks_and_rotations(spark):
    v = vectors(spark, [30, 30])
    for source in ("random", "farthest", "kmeans"):
        book = prune.fit_codebook(v, 5, source)
        assert book.shape == (5, 16) and np.allclose(np.linalg.norm(book, axis=1), 1) and np.allclose(book, prune.fit_codebook(v, 5, source))
    with pytest.raises(ValueError):
        prune.fit_codebook(v, 5, "other")
    for m in (prune.random_rotation(16), prune.pca_rotation(v, 16), prune.itq_rotation(v, 16, 5)):
        assert np.allclose(m @ m.T, np.eye(16), atol=1e-8)
    back = prune.rotate(prune.rotate(v, m), m.T).orderBy("page_id", "tok").collect()
    assert np.allclose([r["v"] for r in back], [r["v"] for r in v.orderBy("page_id", "tok").collect()])
    assert {r["n"] for r in prune.pooled(v, 4).groupBy("page_id").agg(F.count("*").alias("n")).collect()} == {4}
    assert prune.pooled(v, 4, "average").count() == 8


def test_saliency_blank_and_ink():
    assert grid.saliency(grid.raster("")).max() == 0
    s = grid.saliency(grid.raster("word " * 40 + "\n" + " " * 2000))
    assert s[0].max() > 0.5 and s[-1].max() == 0
    with pytest.raises(ValueError):
        grid.saliency(np.zeros((3, 8)))


def test_keep_mask_floor_and_dilation(spark):
    cells = spark.createDataFrame([(1, r, c, 1.0 if (r, c) == (1, 1) else 0.0) for r in range(3) for c in range(3)], "page_id long, r int, c int, saliency double")
    kept = lambda **k: {(x["r"], x["c"]) for x in grid.keep_mask(cells, **k).where("keep").collect()}
    assert kept(min_keep=1) == {(1, 1), (0, 1), (1, 0), (1, 2), (2, 1)}
    assert len(kept(min_keep=7)) == 7 and len(kept(keep_ratio=0.5, min_keep=1)) == 4 and len(kept(min_keep=99)) == 9
    assert [r["line"] for r in grid.mask_text(grid.keep_mask(cells, min_keep=1)).orderBy("r").collect()] == [".#.", "###", ".#."]


def test_words_and_vectors(spark):
    r = spark.createDataFrame([("Hello, WORLD 42!",), (" ... ",), ("",)], "t string").select(tokens.query_words(F.col("t")).alias("w")).collect()
    assert [x["w"] for x in r] == [["hello", "world", "42"], ["__empty"], ["__empty"]]
    t = spark.createDataFrame([("abc",)], "token string")
    v = tokens.seeded_vectors(t, 8).first()["v"]
    assert np.allclose(v, tokens.seeded_vector("ABC", 8)) and abs(np.linalg.norm(v) - 1) < 1e-6
    docs = spark.createDataFrame([(1, "two words\nnext")], "doc_id long, text string")
    assert tokens.layout_grid(tokens.layout(docs), 4, 8).count() >= 2


def test_smaller_before_and_pages_in_parts():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 37, 200):
        x = r.permutation(n)
        assert metrics.smaller_before(x).tolist() == [int((x[:i] < x[i]).sum()) for i in range(n)]
    qid = np.repeat([1, 2, 3, 4], [700, 3, 600, 1])
    parts = list(similarity.products((qid, np.arange(len(qid)), np.zeros((len(qid), 2)))))
    assert [np.unique(p[0]).tolist() for p in parts] == [[1], [2], [3], [4]] or all(len(p[0]) for p in parts)
    assert np.concatenate([p[0] for p in parts]).tolist() == qid.tolist()


def test_masks_of_pages_equal_those_of_tables(spark):
    docs = spark.createDataFrame([(i, ("word " * (7 * i) + "\n") * 3) for i in range(8)], "page_id long, text string")
    for how in ({"blank_threshold": 0.4}, {"keep_ratio": 0.3}, {"keep_ratio": 0.1, "min_keep": 1}):
        a = grid.page_masks(docs, **how)
        assert sorted(a.collect()) == sorted(grid.keep_mask(grid.page_saliency(docs), **how).select(*a.columns).collect())


def test_rasters_change_size():
    x = np.arange(48.0).reshape(6, 8)
    assert np.allclose(grid.resized(x, 3, 4), x.reshape(3, 2, 4, 2).mean(axis=(1, 3))) and grid.resized(x, 4, 5).shape == (4, 5)
    assert grid.resized(x, 4, 5).mean() == pytest.approx(x.mean()) and grid.resized(x, 12, 8).shape == (12, 8)
    assert grid.downscaled(x, 99) is x and grid.downscaled(x, 4).shape == (3, 4) and grid.downscaled(np.ones((1, 500)), 5).shape == (1, 5)
    with pytest.raises(ValueError):
        grid.saliency_on_grid(x, 0, 3)


def test_scores_for_a_ranking_leave_out_what_is_beaten(spark):
    v = vectors(spark, [4] * 60)
    twins = v.unionByName(v.where("page_id < 20").withColumn("page_id", F.col("page_id") + 100))  # equal scores
    q = twins.where("page_id < 3").select(F.col("page_id").alias("qid"), F.col("tok").alias("qtok"), "v")
    rows = similarity.page_rows(twins).coalesce(1).cache()
    every, some = similarity.maxsim(rows, q), similarity.maxsim(rows, q, k=5)
    assert some.count() < 30 < every.count()
    assert sorted(similarity.ranked(every, 5).collect()) == sorted(similarity.ranked(some, 5).collect())
    assert sorted(similarity.ranked(every, 99).collect()) == sorted(similarity.ranked(similarity.maxsim(rows, q, k=99), 99).collect())


def test_polarity_of_pages_equals_that_of_tables(spark, sf):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["", None, "word " * 300, "a\n" * 700, "x" * 4000, "Tab\t, 中文 " * 90])], "page_id long, text string")
    of = geometry.saliency_overlap(grid.page_saliency(docs), grid.page_saliency(docs, negative=True))
    want = {r["page_id"]: (r["overlap"], r["r"]) for r in of.collect()}
    got = {r["page_id"]: (round(r["overlap"], 6), None if r["r"] is None else round(r["r"], 4)) for r in grid.page_polarity(docs).collect()}
    assert got == want and len(got) == 6 and got[0][1] is None and any(r is not None for _, r in got.values())
    assert "Exchange" not in catalog.queries()["polarity_check"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_correlation_with_a_constant(spark):
    noise = spark.createDataFrame([(1, 2.0), (2, 3.0)], "qid long, snr double")
    for taus, want in (((0.5, 0.5), float("nan")), ((0.5, 0.7), 1.0)):
        r = geometry.snr_correlation(noise, spark.createDataFrame([(1, taus[0]), (2, taus[1])], "qid long, tau double")).first()
        assert r["n"] == 2 and r["r"] == pytest.approx(want, nan_ok=True)


def test_rbo_of_long_rankings(spark):
    r = np.random.default_rng(5)
    for n, p in ((1, 0.9), (7, 0.9), (700, 0.9), (3000, 0.5)):
        order = r.permutation(n)
        a, b = (spark.createDataFrame([(1, int(x), i + 1) for i, x in enumerate(o)], "qid long, page_id long, rank int") for o in (range(n), order))
        depth = np.maximum(np.argsort(order), np.arange(n)) + 1
        want = sum((1 - p) * p ** (d - 1) * (depth <= d).sum() / d for d in range(1, n + 1)) + p**n
        out = metrics.rbo(a, b, p)
        assert out.first()["rbo"] == pytest.approx(want, abs=1e-6)
    assert "sequence(" not in out._jdf.queryExecution().analyzed().toString()  # no sum over all depths for every item


def test_winners_are_counted_in_the_page_pass(spark, sf):
    v = vectors(spark, [5, 1, 7, 3, 5, 5])
    twins = v.unionByName(v.where("page_id = 2").withColumn("tok", F.col("tok") + 7))  # equal similarities: the lower token wins
    q = v.where("page_id < 3").select(F.col("page_id").alias("qid"), F.col("tok").alias("qtok"), "v")
    want = prune.winners(twins, q).groupBy("page_id", "tok").agg(F.count("*").alias("wins"), F.countDistinct("qid").alias("n_queries"), F.min("qid").alias("first"))
    for block in (None, 4):
        assert sorted(similarity.winner_counts(twins, q, block).collect()) == sorted(want.collect())
    assert "qtok" not in catalog.queries()["winner_set"](spark, sf)._jdf.queryExecution().analyzed().toString()  # no row a query token and page
    n = {r["page_id"]: r["wins"] for r in want.where("tok = 0").collect()}
    found = {r["selector"]: r["recall"] for r in selectors.recalls({"a": v.where("tok = 0"), "none": v.where("page_id = 99")}, want).collect()}
    assert found == {"a": pytest.approx(sum(n.values()) / want.agg(F.sum("wins")).first()[0], abs=1e-6), "none": 0.0}


def test_stages_of_an_incomplete_page(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 26").write.parquet(str(tmp_path / "embeddings.parquet"))
    of = lambda name: {r["page_id"]: r.asDict() for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
    whole = {"n_before": 10, "n_patches": 8, "n_after_spatial": 5, "n_after": 7, "blank_fraction": 0.375}
    six = {"n_before": 6, "n_patches": 6, "n_after_spatial": 5, "n_after": 5, "blank_fraction": 0.166667}
    assert of("pruning_stages") == {0: {"page_id": 0} | whole, 1: {"page_id": 1} | whole, 2: {"page_id": 2} | six}
    assert of("spatial_pruning")[2] == {"page_id": 2, "n_before": 6, "n_after": 3, "keep_ratio": 0.5}
    assert {p: r["nbytes"] for p, r in of("upsert_pages").items()} == {0: 16, 1: 80, 2: 0}
