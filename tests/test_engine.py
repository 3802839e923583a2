import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmax import catalog, cli, encoders
from glyphmax.config import Config
from glyphmax.engine import Engine
from glyphmax.operators import compare, metrics, tokens
from glyphmax.operators.index import PageIndex
from glyphmax.plans.running import running
from glyphmax.plans.views import patches, query_tokens
from glyphmax.sources import documents, storage
from glyphmax.streaming import ingest


def config(path, **more):
    return Config().with_overrides(index={"path": str(path)}, pruning={"saliency": "codebook", "codebook_size": 8, "keep_ratio": 0.5, "min_keep": 2, "redundancy": 0.5, **more})


def test_config_is_strict(tmp_path):
    c = Config().with_overrides(search={"top_k": 9})
    c.dump(str(tmp_path / "c.yaml"))
    assert Config.load(str(tmp_path / "c.yaml")) == c and Config().search.top_k == 5
    for bad in ({"nope": {}}, {"search": {"nope": 1}}):
        with pytest.raises(ValueError):
            Config.from_dict(bad)


def test_build_search_reopen_and_upsert(spark, sf, tmp_path):
    p = patches(spark, sf)
    e = Engine(spark, config(tmp_path / "i"))
    stats = e.build(p).first()
    assert stats["n_pages"] == 50 and stats["token_reduction"] > 1.3 and stats["compression_ratio"] > 40
    q = query_tokens(p)
    hits = e.search(q, 3).collect()
    assert len(hits) == 15 and {h["rank"] for h in hits} == {1, 2, 3}
    again = Engine(spark, e.config)
    again.index = PageIndex.open(spark, str(tmp_path / "i"))
    assert sorted(again.search(q, 3).collect()) == sorted(hits)
    e.index.write(p.where("page_id < 5"), p.where("page_id < 5 AND is_text"))
    assert e.index.stats().first()["n_pages"] == 50 and e.index.codes.where("page_id < 5").count() == 10
    e.index.write(p.where("page_id = 0"), p.where("page_id = 0 AND is_text AND NOT is_text"))
    assert e.search(q, 50).where("page_id = 0").first()["score"] == float("-inf")
    with pytest.raises(ValueError):
        e.search(q, 0)
    with pytest.raises(ValueError):
        Engine(spark, config(tmp_path / "j", saliency="pixel")).build(p)


def test_a_fresh_engine_adds_to_the_index_on_disk(spark, sf, tmp_path):
    p = patches(spark, sf)
    c = config(tmp_path / "i", enabled=False)
    Engine(spark, c).build(p.where("page_id < 20"))
    assert Engine(spark, c).build(p.where("page_id >= 20 AND page_id < 30"), mode="append").first()["n_pages"] == 30
    e = Engine(spark, c)
    assert e.build(p.where("page_id >= 25"), mode="upsert").first()["n_pages"] == 50
    assert e.index.codes.count() == p.count() and e.index.codes.select("page_id").distinct().count() == 50
    assert {h["page_id"] for h in e.search(query_tokens(p), 50).collect()} == set(range(50))
    assert Engine(spark, c).build(p.where("page_id < 3")).first()["n_pages"] == 3
    assert Engine(spark, config(tmp_path / "new", enabled=False)).build(p.where("page_id < 3"), mode="append").first()["n_pages"] == 3


def test_rerank_finds_the_page_itself(spark, sf, tmp_path):
    p = patches(spark, sf)
    c = config(tmp_path / "i", enabled=False).with_overrides(search={"rerank": True, "top_k": 1, "prefilter_k": 10})
    e = Engine(spark, c)
    e.build(p)
    assert all(r["qid"] == r["page_id"] and r["rescored"] for r in e.search(query_tokens(p)).collect())
    assert e.search_many(query_tokens(p)).count() == 5


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.TXT").write_bytes(b"one\ftwo")
    (tmp_path / "y.pgm").write_bytes(b"P5 2 1 255\n\x00\xff")
    (tmp_path / "z.bin").write_bytes(b"?")
    files = documents.scan_files(spark, str(tmp_path))
    pages = sorted((r["page_id"], bytes(r["content"])) for r in documents.read_pages(files).collect())
    assert [p for p, _ in pages] == ["a/x::p1", "a/x::p2", "y::p1"] and documents.count_pages(files) == 3
    assert documents.read_pgm(pages[2][1]).tolist() == [[0.0, 1.0]] and documents.load_page(files, "a/x", 2) == b"two"
    with pytest.raises(ValueError):
        documents.load_page(files, "a/x", 3)
    (tmp_path / "q.json").write_text(json.dumps([{"qid": "q1", "query": "t", "relevant": ["a", "a", "b"]}]))
    assert documents.qrels(documents.read_queries(spark, str(tmp_path / "q.json"))).count() == 2
    (tmp_path / "l.json").write_text(json.dumps({"p1": [["word", [0, 0.1, 0.2, 0.3]]]}))
    r = documents.read_layout(spark, str(tmp_path / "l.json")).first()
    assert (r["page_id"], r["token"], r["x0"], r["y1"]) == ("p1", "word", 0.0, 0.3)
    assert "| a |" in documents.to_markdown(spark.createDataFrame([(1.0, None)], "a double, b double"), {"a": ".1f", "b": ".1f"})


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for i, part in enumerate(events.randomSplit([0.5, 0.5], 1)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.event_windows(ingest.read_events(spark, str(tmp_path / "in")))
    out = ingest.drain(stream, "windows", "complete", str(tmp_path / "cp"))
    assert sorted(out.collect()) == sorted(ingest.event_windows(events).collect())
    p = patches(spark, sf).select("page_id", "tok", "v")
    p.where("page_id < 6").coalesce(1).write.parquet(str(tmp_path / "p"))
    p.where("page_id >= 4 AND page_id < 9").coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    index = PageIndex(spark, str(tmp_path / "ix"), 64, "binary")
    source = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p"))
    ingest.index_stream(source, index, str(tmp_path / "cp2")).awaitTermination()
    assert index.stats().first()["n_pages"] == 9 and index.codes.count() == 90
    assert ingest.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_documents_to_search(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 30").select(F.col("doc_id").alias("page_id"), "text")
    c = Config().with_overrides(index={"path": str(tmp_path / "i")}, encoder={"dim": 32, "grid": 8}, pruning={"min_keep": 4}, search={"rerank": True, "top_k": 2, "prefilter_k": 9})
    words = tokens.layout(docs.withColumnRenamed("page_id", "doc_id")).select(F.col("doc_id").alias("page_id"), F.lower("word").alias("token"), "x0", "y0", "x1", "y1")
    e = Engine(spark, c, words)
    stats = e.build_documents(docs).first()
    assert stats["n_pages"] == 30 and 0 < stats["n_vectors"] < 30 * (64 + encoders.TAIL)
    rare = words.groupBy("token").agg(F.countDistinct("page_id").alias("n"), F.min("page_id").alias("page"), F.count("*").alias("m")).where("n = 1 AND token rlike '^[a-z]{6,}$'").orderBy("token").first()
    again = Engine(spark, c, words)
    again.open()
    hits = again.search_text(spark.createDataFrame([(0, rare["token"])], "qid long, query string")).collect()
    assert len(hits) == 2 and hits[0]["rescored"]
    e.build_documents(docs.where("page_id < 3").withColumn("page_id", F.col("page_id") + 100), "append")
    assert Engine(spark, c).open().pages.count() == 33
    with pytest.warns(RuntimeWarning, match="1 pages"):
        e.encoder().missing(spark.createDataFrame([(999, "x")], "page_id long, text string"))


def test_encoders(spark, tmp_path):
    pages = spark.createDataFrame([(1, "some words " * 40), (2, ""), (3, None)], "page_id long, text string")
    e = encoders.encoder("hashed", dim=8, grid=4)
    rows = e.encode_pages(pages).orderBy("page_id", "tok").collect()
    assert len(rows) == 3 * (16 + encoders.TAIL) and all(abs(sum(x * x for x in r["v"]) - 1) < 1e-9 for r in rows)
    assert sorted(e.encode_pages(pages.repartition(3)).collect()) == sorted(rows)
    assert [r["v"] for r in rows if r["page_id"] == 2][0] == [r["v"] for r in rows if r["page_id"] == 3][0]
    q = spark.createDataFrame([(1, "Two words"), (2, "!!")], "qid long, query string")
    first = sorted(encoders.cached_queries(e, q, str(tmp_path / "q")).collect())
    assert [(r["qid"], r["qtok"]) for r in first] == [(1, 0), (1, 1), (2, 0)] and sorted(encoders.cached_queries(e, q, str(tmp_path / "q")).collect()) == first
    encoders.cached_queries(e, q.where("qid = 1"), str(tmp_path / "q"))
    assert len(list((tmp_path / "q").iterdir())) == 2
    assert encoders.encoder("seeded", dim=8, grid=4).encode_queries(q).count() == 3
    with pytest.raises(ValueError):
        encoders.encoder("other")
    stored = storage.store_encodings(e.encode_pages(pages), str(tmp_path / "e"))
    assert sorted(stored.collect()) == sorted(rows)


def test_index_reports_errors_and_appends(spark, sf, tmp_path):
    p = patches(spark, sf)
    index = PageIndex(spark, str(tmp_path / "i"), 64, "binary")
    assert index.try_write(p, p)["ok"] and not index.try_write(p, p.drop("v"))["ok"] and index.stats().first()["n_pages"] == 50
    index.write(p, p, "append")
    assert len(index.versions) == 2 and PageIndex.open(spark, index.path).codes.count() == 1000
    with pytest.raises(ValueError):
        index.write(p, p, "other")


def test_commands(spark, sf, tmp_path, capsys):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 5").select(F.col("doc_id").alias("page_id"), "text")
    docs.write.parquet(str(tmp_path / "d.parquet"))
    Config().with_overrides(index={"path": str(tmp_path / "i")}, encoder={"dim": 16, "grid": 4}).dump(str(tmp_path / "c.yaml"))
    c = ["--config", str(tmp_path / "c.yaml")]
    for args in (["make-corpus", str(tmp_path / "m"), "--docs", "3"], ["index", str(tmp_path / "d.parquet"), *c], ["search", "any words", "--top-k", "2", *c], ["stats", *c], ["explain", str(tmp_path / "d.parquet"), "--page", "0", *c], ["init-config", str(tmp_path / "x.yaml")]):
        assert cli.main(args) == 0
    assert json.loads((tmp_path / "m" / "manifest.json").read_text())["n_pages"] == 6
    out = capsys.readouterr().out
    assert "n_pages" in out and "#" in out


def test_first_texts_and_restricted_judgements(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "t string, n int")
    assert sorted((r["t"], r["n"]) for r in documents.first_per_text(rows, "t", "n").collect()) == [("a", 1), ("b", 3)]
    judged = spark.createDataFrame([(1, 10), (2, 11)], "qid long, page_id long")
    assert metrics.restricted(judged, spark.createDataFrame([(10,)], "page_id long")).first()["qid"] == 1
    with pytest.raises(ValueError):
        metrics.restricted(judged, spark.createDataFrame([(12,)], "page_id long"))


def test_zip_claims_and_running(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, "z")], "k int, b string")
    with pytest.raises(Exception, match="differ in length"):
        compare.zipped(a, b, ["k"]).collect()
    rows = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("k"), F.lit(2).alias("x"))
    got = running(rows, ["k"], n=F.lit(1), s=F.col("x")).collect()
    assert all(r["n"] == r["k"] + 1 and r["s"] == 2 * r["n"] for r in got)
    report = spark.createDataFrame([("a", "baseline", 1.0, 0.8), ("a", "binary", 32.0, 0.6), ("a", "spatial+redundancy", 2.0, 0.78)], "regime string, variant string, compression_ratio double, ndcg_5 double")
    found = {r["claim"]: r["holds"] for r in compare.claims(report).collect()}
    assert found == {"pruning is nearly free": True, "the loss is the code's": True}


def test_words_are_laid_out_in_the_encoders_pass(spark, sf, monkeypatch):
    texts = ["two words\n\nnext", "", None, " \n ", "x" * 200 + "  tab\tand\u00e9 \u4e2d\u6587 \U0001f600", "many words here\n" * 60]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    table = tokens.layout(docs).cache()
    mine = [(i, w, line, c, n) for i, t in enumerate(texts) if t for line, n, words, cols in tokens.text_words(t) for w, c in zip(words, cols)]
    assert sorted(mine) == sorted((r["doc_id"], r["word"], r["line"], r["col"], round(1 / (r["y1"] - r["y0"]))) for r in table.collect())
    pages = docs.withColumnRenamed("doc_id", "page_id")
    assert {r["page_id"] for r in pages.where(tokens.has_words(F.col("text"))).collect()} == {m[0] for m in mine}
    boxes = table.select(F.col("doc_id").alias("page_id"), F.col("word").alias("token"), "x0", "y0", "x1", "y1")
    a, b = ({(r["page_id"], r["tok"]): r["v"] for r in encoders.HashedEncoder(8, 4, x).encode_pages(pages).collect()} for x in (boxes, 64))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-12) for k in a)
    with pytest.warns(RuntimeWarning, match="3 pages"):
        encoders.HashedEncoder(8, 4, 64).missing(pages)
    assert "Exchange" not in catalog.queries()["hashed_pages"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    words = [f"w{i % 7}" for i in range(50)]
    boxes = np.random.default_rng(1).uniform(0, 1, (50, 4)).cumsum(axis=1) / 4
    found = []
    for size in (1 << 16, 9):
        monkeypatch.setattr(encoders, "BATCH_WORDS", size)
        sums = encoders.WordSums(8, 4, encoders.word_vector)
        sums.begin(2)
        for at in range(0, 50, 5):
            sums.add(at // 25, words[at : at + 5], boxes[at : at + 5])
        sums.flush()
        found.append(sums.acc)
    assert np.allclose(*found)


def test_pages_are_encoded_once(spark, tmp_path):
    ran = spark.sparkContext.accumulator(0)

    class Counting(Engine):
        def encoder(self):
            model = super().encoder()
            encode = model.encode_pages

            def counted(batches):
                for b in batches:
                    ran.add(b.num_rows)
                    yield b

            model.encode_pages = lambda pages: encode(pages.select("page_id", "text").mapInArrow(counted, "page_id long, text string"))
            return model

    pages = spark.createDataFrame([(i, f"words of page {i}") for i in range(20)], "page_id long, text string")
    c = Config().with_overrides(index={"path": str(tmp_path / "i")}, encoder={"dim": 8, "grid": 4, "noise": 0.0}, pruning={"enabled": False})
    e = Counting(spark, c, 64)
    assert e.build_documents(pages).first()["n_pages"] == 20 and ran.value == 20
    assert not list((tmp_path / "i").glob("encoded-*"))
    assert e.search_text(spark.createDataFrame([(1, "page 7")], "qid long, query string"), 3).count() == 3
