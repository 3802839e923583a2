"""Registered queries of the retrieval engine and their DuckDB equivalents, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmax.functions import vec
from glyphmax.operators import ablation, codecs, geometry, grid, metrics, prune, similarity, tokens
from glyphmax.operators.index import index_stats, page_accounts, storage_summary, upserted
from glyphmax.plans.views import DIM, SCORES_SQL, SQL, judgements, patches, probes, query_tokens, table
from glyphmax.streaming.ingest import event_windows, sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

THRESHOLD = 0.3


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def coded(p: DataFrame, method: str) -> DataFrame:
    return codecs.decoded(codecs.compressed(p, method, DIM), method, DIM) if method != "none" else p


def scores(spark: SparkSession, d: str, method: str = "none", k: int | None = None) -> DataFrame:
    p = patches(spark, d)
    return similarity.maxsim(similarity.page_rows(coded(p, method)), query_tokens(p), k=k)


def run_of(spark: SparkSession, d: str, method: str = "none", k: int | None = None) -> DataFrame:
    return similarity.ranked(scores(spark, d, method, k), k)


def top_sql(score: str, rank: str) -> str:
    return SCORES_SQL + f"SELECT qid, page_id, {score} AS score, CAST({rank} AS INTEGER) AS rank FROM run WHERE {rank} <= 10"


@registered(top_sql("f", "rf"))
def maxsim_float_topk(spark: SparkSession, d: str) -> DataFrame:
    return run_of(spark, d, k=10)


@registered(top_sql("s", "rs"))
def maxsim_sign_topk(spark: SparkSession, d: str) -> DataFrame:
    return run_of(spark, d, "binary", 10)


@registered(top_sql("i8", "ri"))
def maxsim_int8_topk(spark: SparkSession, d: str) -> DataFrame:
    return run_of(spark, d, "int8", 10)


@registered(top_sql("h", "rh"))
def maxsim_hamming_topk(spark: SparkSession, d: str) -> DataFrame:
    codes = codecs.compressed(patches(spark, d), "binary", DIM).select("page_id", "tok", similarity.byte_array(F.col("code"), DIM).alias("v"))
    asked = query_tokens(codes)
    return similarity.ranked(similarity.hamming(similarity.page_rows(codes), asked, DIM), 10)


@registered(SCORES_SQL + """, c AS (SELECT * FROM run WHERE rs <= 20), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY f DESC, page_id) AS n FROM c)
SELECT qid, page_id, f AS score, true AS rescored, CAST(n AS INTEGER) AS rank FROM o WHERE n <= 5""")
def rerank_prefilter(spark: SparkSession, d: str) -> DataFrame:
    p = patches(spark, d)
    return similarity.rerank(run_of(spark, d, "binary", 20), similarity.page_rows(p), query_tokens(p), 5)


@registered(SQL + """SELECT page_id, tok, upper(string_agg(printf('%02x', b), '' ORDER BY i)) AS code FROM (
  SELECT page_id, tok, i, CAST(list_sum([CASE WHEN v[8 * i + k + 1] > 0 THEN 128 >> k ELSE 0 END FOR k IN range(0, 8)]) AS INTEGER) AS b
  FROM patch, unnest(range(0, 8)) AS t(i)) GROUP BY 1, 2""")
def sign_pack_bytes(spark: SparkSession, d: str) -> DataFrame:
    return codecs.compressed(patches(spark, d), "binary", DIM).select("page_id", "tok", F.hex("code").alias("code"))


@registered(SQL + "SELECT page_id, tok, array_to_string([CAST(greatest(-127, least(127, round_even(x / 0.5 * 127, 0))) AS INTEGER) FOR x IN v], ',') AS code FROM patch")
def int8_codes(spark: SparkSession, d: str) -> DataFrame:
    return codecs.compressed(patches(spark, d), "int8", DIM).select("page_id", "tok", F.array_join(F.transform("code", lambda x: x.cast("string")), ",").alias("code"))


@registered(SQL + """SELECT page_id, tok, array_to_string([CASE WHEN x < -0.9816 * 0.125 THEN -2 WHEN x < 0 THEN -1 WHEN x < 0.9816 * 0.125 THEN 0 ELSE 1 END FOR x IN v], ',') AS code FROM patch""")
def lloyd_max_codes(spark: SparkSession, d: str) -> DataFrame:
    return codecs.compressed(patches(spark, d), "two_bit", DIM).select("page_id", "tok", F.array_join(F.transform("code", lambda x: x.cast("string")), ",").alias("code"))


@registered(SQL + """, m AS (SELECT list(a ORDER BY k) AS mean FROM (SELECT k, avg(v[k]) AS a FROM patch, unnest(range(1, 65)) AS t(k) GROUP BY k))
SELECT page_id, tok, CAST(len([k FOR k IN range(1, 65) IF v[k] - mean[k] > 0]) AS BIGINT) AS n_positive FROM patch, m""")
def centred_sign_codes(spark: SparkSession, d: str) -> DataFrame:
    c = codecs.centred_signs(patches(spark, d))
    return c.select("page_id", "tok", F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("n_positive"))


STATS_SQL = """, s AS (SELECT count(DISTINCT page_id) AS n_pages, count(*) AS n FROM patch),
st AS (SELECT n_pages, n AS n_vectors, n AS tokens_before, round(n / n_pages, 6) AS vectors_per_page, n * 8 AS index_bytes, n * 256 AS raw_bytes,
  round(n * 8 / n_pages, 6) AS bytes_per_page, CAST(32.0 AS DOUBLE) AS compression_ratio, CAST(1.0 AS DOUBLE) AS token_reduction FROM s)
"""


def accounts(spark: SparkSession, d: str) -> DataFrame:
    p = patches(spark, d)
    return page_accounts(p, p, "binary", DIM)


@registered(SQL + STATS_SQL + "SELECT * FROM st")
def index_storage(spark: SparkSession, d: str) -> DataFrame:
    return index_stats(accounts(spark, d))


@registered(SQL + STATS_SQL + """SELECT round(index_bytes / 1e6, 6) AS index_mb, round(raw_bytes / 1e6, 6) AS raw_mb, round(index_bytes / n_pages / 1e3, 6) AS kb_per_page,
  compression_ratio, round(index_bytes / n_pages * 1e6 / 1e9, 6) AS gb_per_million_pages FROM st""")
def storage_report(spark: SparkSession, d: str) -> DataFrame:
    return storage_summary(index_stats(accounts(spark, d)))


def metrics_sql(rank: str) -> str:
    parts = []
    for k in (1, 3, 5, 10):
        ideal = " + ".join(f"CASE WHEN n_rel >= {i} THEN 1 / log2({i + 1}) ELSE 0 END" for i in range(1, k + 1))
        parts.append(f"round(avg(coalesce(g{k}, 0) / ({ideal})), 6) AS ndcg_{k}, round(avg(coalesce(h{k}, 0) / least(n_rel, {k})), 6) AS recall_{k}, round(avg(CASE WHEN h{k} > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_{k}")
    sums = ", ".join(f"sum(CASE WHEN {rank} <= {k} THEN 1 / log2({rank} + 1) ELSE 0 END) AS g{k}, count(*) FILTER (WHERE {rank} <= {k}) AS h{k}" for k in (1, 3, 5, 10))
    return SCORES_SQL + f""", n AS (SELECT qid, count(*) AS n_rel FROM qrels GROUP BY qid),
h AS (SELECT qid, {sums}, min({rank}) AS first FROM run JOIN qrels USING (qid, page_id) GROUP BY qid)
SELECT {', '.join(parts)}, round(avg(CASE WHEN first <= 10 THEN 1 / first ELSE 0.0 END), 6) AS mrr_10, count(*) AS n_queries FROM n LEFT JOIN h USING (qid)"""


@registered(metrics_sql("rf"))
def ndcg_recall_mrr_hit(spark: SparkSession, d: str) -> DataFrame:
    return metrics.evaluate(run_of(spark, d, k=10), judgements(patches(spark, d)))


@registered(metrics_sql("rs"))
def ndcg_recall_mrr_hit_sign(spark: SparkSession, d: str) -> DataFrame:
    return metrics.evaluate(run_of(spark, d, "binary", 10), judgements(patches(spark, d)))


TOP_SQL = SCORES_SQL + """, a AS (SELECT qid, page_id, rf AS ra FROM run WHERE rf <= 10), b AS (SELECT qid, page_id, rs AS rb FROM run WHERE rs <= 10)"""


@registered(TOP_SQL + """, u AS (SELECT qid, page_id, coalesce(ra, 11) AS ra, coalesce(rb, 11) AS rb FROM a FULL JOIN b USING (qid, page_id)),
p AS (SELECT x.qid, sign(x.ra - y.ra) AS s, sign(x.rb - y.rb) AS t FROM u x JOIN u y ON x.qid = y.qid AND x.page_id < y.page_id),
n AS (SELECT qid, count(*) FILTER (WHERE s * t > 0) AS c, count(*) FILTER (WHERE s * t < 0) AS d, count(*) FILTER (WHERE s = 0 AND t <> 0) AS ta, count(*) FILTER (WHERE t = 0 AND s <> 0) AS tb FROM p GROUP BY qid)
SELECT qid, round(CASE WHEN (c + d + ta) * (c + d + tb) = 0 THEN 1.0 ELSE (c - d) / sqrt(CAST((c + d + ta) * (c + d + tb) AS DOUBLE)) END, 6) AS tau FROM n""")
def tau_pool(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tau_b(run_of(spark, d, k=10), run_of(spark, d, "binary", 10))


@registered(TOP_SQL + """, u AS (SELECT * FROM a JOIN b USING (qid, page_id)),
n AS (SELECT x.qid, avg(sign((x.ra - y.ra) * (x.rb - y.rb))) AS s FROM u x JOIN u y ON x.qid = y.qid AND x.page_id < y.page_id GROUP BY x.qid)
SELECT q.qid, round(coalesce(s, 1.0), 6) AS tau FROM (SELECT DISTINCT qid FROM a) q LEFT JOIN n USING (qid)""")
def tau_shared(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tau_shared(run_of(spark, d, k=10), run_of(spark, d, "binary", 10))


@registered(SCORES_SQL + """, s AS (SELECT x.qid, x.rf, count(*) FILTER (WHERE y.rs < x.rs) / (x.rf - 1) AS share FROM run x JOIN run y ON x.qid = y.qid AND y.rf < x.rf GROUP BY x.qid, x.rf)
SELECT qid, round(2 * avg(share) - 1, 6) AS tau_ap FROM s GROUP BY qid""")
def tau_ap(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tau_ap(run_of(spark, d), run_of(spark, d, "binary"))


@registered(SCORES_SQL + """, n AS (SELECT count(DISTINCT page_id) AS size FROM patch),
o AS (SELECT r.qid, t.d, size, count(*) FILTER (WHERE greatest(rf, rs) <= t.d) AS k FROM run r, n, unnest(range(1, size + 1)) AS t(d) GROUP BY 1, 2, 3)
SELECT qid, round(sum(0.1 * pow(0.9, d - 1) * k / d) + pow(0.9, any_value(size)), 6) AS rbo FROM o GROUP BY qid""")
def rbo(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rbo(run_of(spark, d), run_of(spark, d, "binary"))


@registered(SCORES_SQL + """, x AS (SELECT qid, count(*) FILTER (WHERE rf <= 5 AND rs <= 5) AS n, max(CASE WHEN rf = 1 THEN page_id END) AS a, max(CASE WHEN rs = 1 THEN page_id END) AS b FROM run GROUP BY qid)
SELECT round(avg(CASE WHEN a = b THEN 1 ELSE 0 END), 6) AS top1, round(avg(n / 5), 6) AS overlap,
  round(avg(CASE WHEN a = b THEN 1 ELSE 0 END) FILTER (WHERE EXISTS (SELECT 1 FROM qrels j WHERE j.qid = x.qid AND j.page_id = x.a)), 6) AS gold_kept FROM x""")
def overlap_top1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.agreement(run_of(spark, d, k=5), run_of(spark, d, "binary", 5), judgements(patches(spark, d)))


def ndcg_sql(name: str, rank: str) -> str:
    """Tables ``name`` (qid, x): nDCG@5 of a run."""
    ideal = " + ".join(f"CASE WHEN n_rel >= {i} THEN 1 / log2({i + 1}) ELSE 0 END" for i in range(1, 6))
    return f"""{name} AS (SELECT n.qid, coalesce(g, 0) / ({ideal}) AS x FROM (SELECT qid, count(*) AS n_rel FROM qrels GROUP BY qid) n
  LEFT JOIN (SELECT qid, sum(CASE WHEN {rank} <= 5 THEN 1 / log2({rank} + 1) ELSE 0 END) AS g FROM run JOIN qrels USING (qid, page_id) GROUP BY qid) h USING (qid))"""


BOOT_SQL = SCORES_SQL + ", " + ndcg_sql("na", "rf") + ", " + ndcg_sql("nb", "rs") + """,
dd AS (SELECT row_number() OVER (ORDER BY qid) AS i, nb.x - na.x AS d FROM na JOIN nb USING (qid)),
dr AS (SELECT r, CAST(('0x' || left(md5('7:' || r || ':' || i), 8)) AS BIGINT) % (SELECT count(*) FROM dd) + 1 AS i FROM dd, unnest(range(1, 2001)) AS t(r)),
mm AS (SELECT r, round(avg(d), 9) AS m FROM dr JOIN dd USING (i) GROUP BY r)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(CASE WHEN m > 0 THEN 1 ELSE 0 END), 6) AS above_zero FROM mm"""


@registered(BOOT_SQL)
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    q = judgements(patches(spark, d))
    return metrics.bootstrap(metrics.per_query(run_of(spark, d, k=10), q), metrics.per_query(run_of(spark, d, "binary", 10), q), "ndcg_5")


@registered(SCORES_SQL + """, f AS (SELECT qid, min(rs) AS first FROM run JOIN qrels USING (qid, page_id) WHERE rs <= 5 GROUP BY qid)
SELECT q.qid, round(coalesce(1 / log2(first + 1), 0), 6) AS gain FROM (SELECT DISTINCT qid FROM qrels) q LEFT JOIN f USING (qid)""")
def first_hit_gain(spark: SparkSession, d: str) -> DataFrame:
    return metrics.first_hit_gain(run_of(spark, d, "binary", 5), judgements(patches(spark, d)))


CHANCE_SQL = """WITH c AS (SELECT n, r, i, row_number() OVER (PARTITION BY n, r ORDER BY md5('0:' || n || ':' || r || ':' || i), i) AS o
  FROM (SELECT unnest([20, 60]) AS n), unnest(range(1, 51)) AS a(r), unnest(range(1, n + 1)) AS b(i)),
p AS (SELECT x.n, x.r, x.i, count(*) FILTER (WHERE y.o < x.o) AS k FROM c x JOIN c y ON x.n = y.n AND x.r = y.r AND y.i < x.i GROUP BY 1, 2, 3),
t AS (SELECT n, r, 4 * sum(k) / (n * (n - 1)) - 1 AS tau, 2 * avg(k / (i - 1)) - 1 AS tau_ap FROM p GROUP BY 1, 2),
b AS (SELECT n, r, d, count(*) FILTER (WHERE greatest(i, o) <= d) AS k FROM c, unnest(range(1, n + 1)) AS t(d) GROUP BY 1, 2, 3),
z AS (SELECT n, r, sum(0.1 * pow(0.9, d - 1) * k / d) + pow(0.9, n) AS rbo FROM b GROUP BY 1, 2),
o AS (SELECT n, r, count(*) FILTER (WHERE i <= 5 AND o <= 5) / 5 AS overlap FROM c GROUP BY 1, 2)
SELECT n AS size, round(avg(round(tau, 6)), 4) AS tau, round(avg(round(rbo, 6)), 4) AS rbo, round(avg(round(tau_ap, 6)), 4) AS tau_ap, round(avg(overlap), 4) AS overlap FROM t JOIN z USING (n, r) JOIN o USING (n, r) GROUP BY n"""


@registered(CHANCE_SQL)
def chance_levels(spark: SparkSession, d: str) -> DataFrame:
    return metrics.chance_levels(spark, (20, 60), 50)


def patch_saliency(spark: SparkSession, d: str) -> DataFrame:
    p = patches(spark, d)
    return prune.probe_saliency(p, probes(p))


@registered()
def ablation_table(spark: SparkSession, d: str) -> DataFrame:
    p = patches(spark, d)
    return ablation.run_variants(p, query_tokens(p), judgements(p), patch_saliency(spark, d), ablation.default_variants(), DIM)


CELLS_SQL = """
WITH d AS (SELECT doc_id AS page_id, coalesce(text, '') AS t, CAST(greatest(1, ceil(length(coalesce(text, '')) / 512.0)) AS BIGINT) AS cells FROM documents),
ch AS (SELECT page_id, unnest(generate_series(0, length(t) - 1)) AS i, unnest(string_split(t, '')) AS c FROM d WHERE t <> ''
  UNION ALL SELECT page_id, unnest(range(length(t), cells * 512)) AS i, ' ' AS c FROM d),
px AS (SELECT page_id, i // 64 AS y, i % 64 AS x, CASE WHEN unicode(c) IN (9, 10, 11, 12, 13, 32) THEN 1.0::DOUBLE
  WHEN unicode(c) BETWEEN 48 AND 57 OR unicode(c) BETWEEN 65 AND 90 OR unicode(c) BETWEEN 97 AND 122 THEN 0.25 ELSE 0.6 END AS gray FROM ch),
pl AS (SELECT page_id, quantile_cont(gray, 0.95) AS level FROM px GROUP BY 1),
e AS (SELECT px.page_id, y // 8 AS r, x // 8 AS c, greatest(level - gray, 0) AS ink,
  coalesce(abs(gray - lag(gray) OVER (PARTITION BY px.page_id, x ORDER BY y)), 0) + coalesce(abs(gray - lag(gray) OVER (PARTITION BY px.page_id, y ORDER BY x)), 0) AS edge
  FROM px JOIN pl USING (page_id)),
b AS (SELECT page_id, r, c, avg(ink) AS ink, avg(edge) AS edge FROM e GROUP BY 1, 2, 3),
h AS (SELECT page_id, quantile_cont(ink, 0.99) AS hi, quantile_cont(edge, 0.99) AS he FROM b GROUP BY 1),
cell AS (SELECT page_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round(0.6 * CASE WHEN hi > 1e-8 THEN greatest(0, least(1, ink / hi)) ELSE 0 END
  + 0.4 * CASE WHEN he > 1e-8 THEN greatest(0, least(1, edge / he)) ELSE 0 END, 6) AS saliency FROM b JOIN h USING (page_id))
"""


#: Rows of an Arrow batch of page texts: 10,000 of them, the default, are hundreds of MB in a worker.
TEXT_ROWS = 2000


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text")


def cells(spark: SparkSession, d: str) -> DataFrame:
    return grid.page_saliency(page_texts(spark, d))


@registered(CELLS_SQL + "SELECT page_id, r, c, saliency FROM cell")
def raster_saliency(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d)


@registered(CELLS_SQL + """, m AS (SELECT *, saliency > 0.5 AS m0 FROM cell),
g AS (SELECT *, m0 OR coalesce(lag(m0) OVER a, false) OR coalesce(lead(m0) OVER a, false) OR coalesce(lag(m0) OVER b, false) OR coalesce(lead(m0) OVER b, false) AS m1
  FROM m WINDOW a AS (PARTITION BY page_id, r ORDER BY c), b AS (PARTITION BY page_id, c ORDER BY r)),
k AS (SELECT *, least(16, count(*) OVER (PARTITION BY page_id)) - count(*) FILTER (WHERE m1) OVER (PARTITION BY page_id) AS missing,
  row_number() OVER (PARTITION BY page_id, m1 ORDER BY saliency DESC, r, c) AS turn FROM g)
SELECT page_id, r, c, saliency, m1 OR turn <= missing AS keep FROM k""")
def keep_mask_threshold(spark: SparkSession, d: str) -> DataFrame:
    return grid.page_masks(page_texts(spark, d), blank_threshold=0.5)


@registered(CELLS_SQL + """, k AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY saliency DESC, r, c) AS o FROM cell)
SELECT page_id, r, c, saliency, o <= greatest(greatest(1, least(n, round_even(n * 0.3, 0))), least(16, n)) AS keep FROM k""")
def keep_mask_budget(spark: SparkSession, d: str) -> DataFrame:
    return grid.page_masks(page_texts(spark, d), keep_ratio=0.3)


@registered(CELLS_SQL + "SELECT page_id, floor(sum(CAST(round(saliency * 1e6) AS BIGINT)) / count(*)) / 1e6 AS mean_saliency, floor(sum(CAST(round(saliency * 1e6) AS BIGINT)) / count(*)) / 1e6 < 0.004 AS blank FROM cell GROUP BY page_id")
def blank_pages(spark: SparkSession, d: str) -> DataFrame:
    return grid.blank_pages(cells(spark, d))


CLUSTER_SQL = SQL + f""", unit AS (SELECT page_id, tok, [x / greatest(sqrt(list_dot_product(v, v)), 1e-12) FOR x IN v] AS u, v FROM patch),
nb AS (SELECT a.page_id, a.tok, list(b.tok) FILTER (WHERE b.tok < a.tok AND list_dot_product(a.u, b.u) >= {THRESHOLD}) AS near FROM unit a JOIN unit b USING (page_id) GROUP BY 1, 2),
walk AS (
  SELECT page_id, 0 AS tok, 0 AS leader, [0] AS leaders FROM nb WHERE tok = 0
  UNION ALL
  SELECT n.page_id, n.tok, coalesce(list_min(list_intersect(leaders, coalesce(near, []))), n.tok),
    CASE WHEN len(list_intersect(leaders, coalesce(near, []))) > 0 THEN leaders ELSE list_append(leaders, n.tok) END
  FROM walk w JOIN nb n ON n.page_id = w.page_id AND n.tok = w.tok + 1
)"""


@registered(CLUSTER_SQL + " SELECT page_id, tok, leader FROM walk")
def redundancy_clusters(spark: SparkSession, d: str) -> DataFrame:
    return prune.redundancy(patches(spark, d), THRESHOLD)


@registered(CLUSTER_SQL + """, s AS (SELECT w.page_id, w.leader, k, avg(v[k]) AS x FROM walk w JOIN patch p USING (page_id, tok), unnest(range(1, 65)) AS t(k) GROUP BY 1, 2, 3),
z AS (SELECT page_id, leader, list(x ORDER BY k) AS m FROM s GROUP BY 1, 2)
SELECT z.page_id, CAST(z.leader AS INTEGER) AS tok, CAST((SELECT count(*) FROM walk w WHERE w.page_id = z.page_id AND w.leader = z.leader) AS INTEGER) AS size,
  round(m[1] / sqrt(list_dot_product(m, m)), 6) AS first, round(m[64] / sqrt(list_dot_product(m, m)), 6) AS last FROM z""")
def redundancy_merge(spark: SparkSession, d: str) -> DataFrame:
    p = patches(spark, d)
    m = prune.merged(p, prune.redundancy(p, THRESHOLD))
    return m.select("page_id", "tok", "size", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", DIM), 6).alias("last"))


PROBE_SQL = SQL + """, sm AS (SELECT page_id, tok, probe, round(list_dot_product(p.v, c.v), 9) AS sim FROM patch p, probe c),
won AS (SELECT page_id, tok, count(*) AS wins FROM (SELECT *, row_number() OVER (PARTITION BY page_id, probe ORDER BY sim DESC, tok) AS o FROM sm) WHERE o = 1 GROUP BY 1, 2),
bs AS (SELECT page_id, tok, max(sim) AS best FROM sm GROUP BY 1, 2),
j AS (SELECT page_id, tok, coalesce(wins, 0) AS wins, best FROM bs LEFT JOIN won USING (page_id, tok)),
t AS (SELECT *, wins / greatest(max(wins) OVER w, 1) + 0.5 / (SELECT count(*) FROM probe) * CASE WHEN max(best) OVER w > min(best) OVER w
  THEN (best - min(best) OVER w) / (max(best) OVER w - min(best) OVER w) ELSE 0 END AS s FROM j WINDOW w AS (PARTITION BY page_id)),
sal AS (SELECT page_id, tok, wins, round(CASE WHEN max(s) OVER (PARTITION BY page_id) > 0 THEN s / max(s) OVER (PARTITION BY page_id) ELSE 0 END, 6) AS saliency FROM t)
"""


@registered(PROBE_SQL + "SELECT * FROM sal")
def probe_saliency(spark: SparkSession, d: str) -> DataFrame:
    return patch_saliency(spark, d)


@registered(PROBE_SQL + """, k AS (SELECT page_id, tok, row_number() OVER (PARTITION BY page_id ORDER BY saliency DESC, tok) AS o, count(*) OVER (PARTITION BY page_id) AS n FROM sal WHERE tok < 8)
SELECT page_id, 10 AS n_before, count(*) + 2 AS n_after, round((count(*) + 2) / 10, 6) AS keep_ratio FROM k WHERE o <= round_even(n * 0.5, 0) GROUP BY page_id""")
def spatial_pruning(spark: SparkSession, d: str) -> DataFrame:
    p = patches(spark, d)
    return prune.pruning_stats(p, prune.pruned(p, patch_saliency(spark, d), keep_ratio=0.5)).select("page_id", F.col("n_before").cast("int").alias("n_before"), "n_after", "keep_ratio")


WIN_SQL = SQL + """, sm AS (SELECT qid, qtok, page_id, tok, round(list_dot_product(q.v, p.v), 9) AS sim FROM query_tok q, patch p),
win AS (SELECT qid, qtok, page_id, tok FROM (SELECT *, row_number() OVER (PARTITION BY qid, qtok, page_id ORDER BY sim DESC, tok) AS o FROM sm) WHERE o = 1)
"""


@registered(WIN_SQL + "SELECT page_id, tok, count(*) AS wins, count(DISTINCT qid) AS n_queries FROM win GROUP BY 1, 2")
def winner_set(spark: SparkSession, d: str) -> DataFrame:
    p = patches(spark, d)
    return similarity.winner_counts(p, query_tokens(p)).drop("first")


@registered(WIN_SQL + """, f AS (SELECT page_id, tok, min(qid) AS qid FROM win GROUP BY 1, 2), n AS (SELECT q.qid, count(f.tok) AS n FROM (SELECT DISTINCT qid FROM win) q LEFT JOIN f USING (qid) GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY qid) AS INTEGER) AS n_queries, CAST(sum(n) OVER (ORDER BY qid) AS BIGINT) AS n_winners FROM n""")
def winner_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = patches(spark, d)
    q = query_tokens(p)
    return prune.winner_coverage(similarity.winner_counts(p, q), q)


def farthest_sql(k: int) -> str:
    parts = ["u AS (SELECT page_id, tok, [x / greatest(sqrt(list_dot_product(v, v)), 1e-12) FOR x IN v] AS u FROM patch)", "k0 AS (SELECT u FROM u ORDER BY page_id, tok LIMIT 1)", "d0 AS (SELECT u.*, list_dot_product(u.u, k0.u) AS best FROM u, k0)"]
    for i in range(1, k):
        parts += [f"k{i} AS (SELECT u FROM d{i - 1} ORDER BY round(best, 9), page_id, tok LIMIT 1)", f"d{i} AS (SELECT page_id, tok, d.u, greatest(best, list_dot_product(d.u, k{i}.u)) AS best FROM d{i - 1} d, k{i})"]
    return SQL + ", " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {i} AS probe, round(u[1], 6) AS first, round(u[64], 6) AS last FROM k{i}" for i in range(k))


@registered(farthest_sql(8))
def farthest_probes(spark: SparkSession, d: str) -> DataFrame:
    book = prune.farthest_first(patches(spark, d), 8)
    return spark.createDataFrame([(i, round(float(p[0]), 6), round(float(p[-1]), 6)) for i, p in enumerate(book)], "probe int, first double, last double")


ASSIGN_SQL = SQL + """, sm AS (SELECT page_id, tok, probe, round(list_dot_product(p.v, c.v), 9) AS sim FROM patch p, probe c),
near AS (SELECT page_id, tok, probe FROM (SELECT *, row_number() OVER (PARTITION BY page_id, tok ORDER BY sim DESC, probe) AS o FROM sm) WHERE o = 1)
"""


@registered(ASSIGN_SQL + """, s AS (SELECT probe, k, avg(v[k]) AS x FROM near JOIN patch USING (page_id, tok), unnest(range(1, 65)) AS t(k) GROUP BY 1, 2), z AS (SELECT probe, list(x ORDER BY k) AS m FROM s GROUP BY 1)
SELECT probe, (SELECT count(*) FROM near WHERE near.probe = z.probe) AS n, round(m[1] / sqrt(list_dot_product(m, m)), 6) AS first FROM z""")
def kmeans_step(spark: SparkSession, d: str) -> DataFrame:
    p = patches(spark, d)
    return prune.kmeans_step(p.select("page_id", "tok", "v"), probes(p)).select("probe", "n", F.round(F.element_at("v", 1), 6).alias("first"))


@registered(ASSIGN_SQL + """, x AS (SELECT n.page_id, n.tok, n.probe, [p.v[k] - c.v[k] FOR k IN range(1, 65)] AS rest FROM near n JOIN patch p USING (page_id, tok) JOIN probe c USING (probe)),
b AS (SELECT avg(abs(r)) AS beta FROM (SELECT unnest(rest) AS r FROM x))
SELECT page_id, tok, probe, CAST(len([r FOR r IN rest IF r > 0]) AS INTEGER) AS n_up, round(beta, 6) AS beta FROM x, b""")
def residual_code(spark: SparkSession, d: str) -> DataFrame:
    p, c = patches(spark, d), probes(patches(spark, d))
    r = codecs.residual_codes(prune.assigned(p, c), c)
    return r.select("page_id", "tok", "probe", F.size(F.filter("bits", lambda x: x)).alias("n_up"), F.round("beta", 6).alias("beta"))


@registered(SQL + """, r AS (SELECT list_sum([abs(x) FOR x IN v]) / (sqrt(list_dot_product(v, v)) * 8) AS rho,
  1 + len([i FOR i IN range(1, 65) IF list_sum(list_reverse_sort([abs(x) FOR x IN v])[1:i]) / list_sum([abs(x) FOR x IN v]) < 0.5]) AS dims FROM patch)
SELECT round(avg(rho), 6) AS mean, round(stddev_pop(rho), 6) AS std, round(quantile_cont(rho, 0.05), 6) AS p05, round(quantile_cont(rho, 0.95), 6) AS p95,
  round(avg(CASE WHEN rho > sqrt(2 / pi()) THEN 1 ELSE 0 END), 6) AS above_gauss, round(avg(dims), 6) AS half_mass_dims FROM r""")
def geometry_rho(spark: SparkSession, d: str) -> DataFrame:
    return geometry.rho_stats(patches(spark, d))


@registered(SQL + """, x AS (SELECT k - 1 AS k, avg(CASE WHEN v[k] > 0 THEN 1 ELSE 0 END) AS p, avg(v[k]) AS mean, stddev_pop(v[k]) AS std FROM patch, unnest(range(1, 65)) AS t(k) GROUP BY 1),
h AS (SELECT *, least(1 - 1e-9, greatest(1e-9, p)) AS q FROM x), e AS (SELECT *, -q * log2(q) - (1 - q) * log2(1 - q) AS h FROM h)
SELECT CAST(k AS INTEGER) AS k, round(p, 6) AS p, round(h, 6) AS entropy, round(mean, 6) AS mean, round(std, 6) AS std, h < 0.5 AS dead FROM e""")
def sign_entropy(spark: SparkSession, d: str) -> DataFrame:
    return geometry.sign_entropy(patches(spark, d))


@registered(SQL + """, c AS (SELECT i, j, avg(v[i] * v[j]) - avg(v[i]) * avg(v[j]) AS c FROM patch, unnest(range(1, 65)) AS a(i), unnest(range(1, 65)) AS b(j) GROUP BY 1, 2)
SELECT round(pow(sum(c) FILTER (WHERE i = j), 2) / sum(c * c), 4) AS participation_ratio FROM c""")
def participation_ratio(spark: SparkSession, d: str) -> DataFrame:
    return geometry.participation_ratio(patches(spark, d), DIM).select("participation_ratio")


@registered(SQL + """, u AS (SELECT label, [x / greatest(sqrt(list_dot_product(v, v)), 1e-12) FOR x IN v] AS u FROM patch),
s AS (SELECT label, sum(x * x) AS s FROM (SELECT label, k, sum(u[k]) AS x FROM u, unnest(range(1, 65)) AS t(k) GROUP BY 1, 2) GROUP BY 1), n AS (SELECT label, count(*) AS n FROM u GROUP BY 1)
SELECT label, n, round(CASE WHEN n > 1 THEN (s - n) / (n * (n - 1)) END, 6) AS cosine FROM s JOIN n USING (label)""")
def pairwise_cosine(spark: SparkSession, d: str) -> DataFrame:
    return geometry.mean_pairwise_cosine(patches(spark, d), "label")


FLIP_SQL = SCORES_SQL + """, b AS (SELECT qid, qtok, page_id, max(tok) FILTER (WHERE o = 1) AS bf, max(tok) FILTER (WHERE u = 1) AS bs FROM (
  SELECT *, row_number() OVER (PARTITION BY qid, qtok, page_id ORDER BY round(f, 9) DESC, tok) AS o, row_number() OVER (PARTITION BY qid, qtok, page_id ORDER BY round(s, 9) DESC, tok) AS u FROM sim) GROUP BY 1, 2, 3)
"""


def matches(spark: SparkSession, d: str) -> DataFrame:
    p = patches(spark, d)
    return similarity.token_matches(p, query_tokens(p))


@registered(FLIP_SQL + "SELECT count(*) AS n, round(avg(CASE WHEN bf <> bs THEN 1 ELSE 0 END), 6) AS flip_rate FROM b")
def argmax_flips(spark: SparkSession, d: str) -> DataFrame:
    return geometry.argmax_flips(matches(spark, d))


@registered(FLIP_SQL + "SELECT round(avg(CASE WHEN bf >= 8 THEN 1 ELSE 0 END), 6) AS float_share, round(avg(CASE WHEN bs >= 8 THEN 1 ELSE 0 END), 6) AS sign_share FROM b")
def distractor_promotion(spark: SparkSession, d: str) -> DataFrame:
    return geometry.distractor_promotion(matches(spark, d))


@registered(SCORES_SQL + """, g AS (SELECT qid, regr_slope(s, f) AS slope, regr_intercept(s, f) AS intercept, stddev_pop(s) * sqrt(greatest(0, 1 - regr_r2(s, f))) AS noise, stddev_pop(f) AS sd FROM score GROUP BY qid)
SELECT qid, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(noise, 4) AS noise, round(abs(slope) * sd / noise, 3) AS snr FROM g""")
def regression_snr(spark: SparkSession, d: str) -> DataFrame:
    f, s = scores(spark, d), scores(spark, d, "binary").withColumnRenamed("score", "s")
    return geometry.score_noise(f.withColumnRenamed("score", "f").join(s, ["qid", "page_id"]))


@registered(SCORES_SQL + """, m AS (SELECT qid, qtok, page_id, max(f) AS m, arg_min(tok, (-round(f, 9), tok)) >= 8 AS text FROM sim GROUP BY 1, 2, 3),
n AS (SELECT qid, qtok, page_id, any_value(m) AS m, any_value(text) AS text, count(*) FILTER (WHERE round(f, 9) >= round(m - 0.05, 9)) AS n FROM sim JOIN m USING (qid, qtok, page_id) GROUP BY 1, 2, 3)
SELECT qid, qtok, round(min(m), 6) AS floor, round(avg(m), 6) AS mean_best, round(avg(n), 6) AS near_best, round(sum(CASE WHEN text THEN m ELSE 0 END) / sum(m), 6) AS text_share FROM n GROUP BY 1, 2""")
def score_floor(spark: SparkSession, d: str) -> DataFrame:
    return geometry.score_floor(matches(spark, d))


@registered(FLIP_SQL + """, k AS (SELECT b.qid, b.qtok, b.page_id, bf, f, CASE WHEN bf >= 8 THEN 'marker' ELSE 'grid' END AS kind FROM b JOIN sim ON sim.qid = b.qid AND sim.qtok = b.qtok AND sim.page_id = b.page_id AND sim.tok = b.bf),
g AS (SELECT kind, count(*) AS wins, sum(f) AS score FROM k GROUP BY kind)
SELECT kind, wins, round(wins / sum(wins) OVER (), 6) AS win_share, round(score / sum(score) OVER (), 6) AS score_share FROM g""")
def winner_shares(spark: SparkSession, d: str) -> DataFrame:
    return geometry.winner_shares(matches(spark, d), tokens.token_kinds(patches(spark, d)))


@registered(FLIP_SQL + """SELECT b.qtok, round(avg(CASE WHEN bf >= 8 THEN 1 ELSE 0 END), 6) AS text_share, round(avg(f), 6) AS mean_best
FROM b JOIN sim ON sim.qid = b.qid AND sim.qtok = b.qtok AND sim.page_id = b.page_id AND sim.tok = b.bf GROUP BY b.qtok""")
def winners_by_position(spark: SparkSession, d: str) -> DataFrame:
    return geometry.winners_by_position(matches(spark, d))


@registered(TOP_SQL + """, g AS (SELECT qid, abs(regr_slope(s, f)) * stddev_pop(f) / (stddev_pop(s) * sqrt(greatest(0, 1 - regr_r2(s, f)))) AS snr FROM score GROUP BY qid),
u AS (SELECT * FROM a JOIN b USING (qid, page_id)),
w AS (SELECT x.qid, avg(sign((x.ra - y.ra) * (x.rb - y.rb))) AS s FROM u x JOIN u y ON x.qid = y.qid AND x.page_id < y.page_id GROUP BY x.qid),
t AS (SELECT q.qid, round(coalesce(s, 1.0), 6) AS tau FROM (SELECT DISTINCT qid FROM a) q LEFT JOIN w USING (qid))
SELECT count(*) AS n, round(corr(ln(round(snr, 3)), tau), 4) AS r FROM g JOIN t USING (qid) WHERE round(snr, 3) > 0""")
def snr_correlation(spark: SparkSession, d: str) -> DataFrame:
    return geometry.snr_correlation(regression_snr(spark, d), tau_shared(spark, d))


@registered("""WITH p AS (SELECT label, vec_id, vec_id - row_number() OVER (PARTITION BY label ORDER BY vec_id) AS island FROM embeddings)
SELECT label, min(vec_id) AS start, count(*) AS length FROM p GROUP BY label, island""")
def token_runs(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_runs(table(spark, d, "embeddings"), "label", "vec_id")


@registered("""SELECT vec_id, CAST((vec_id // 16 // 4) * 4 + (vec_id % 16) // 4 AS INTEGER) AS r, CAST((vec_id // 16 % 4) * 4 + vec_id % 4 AS INTEGER) AS c FROM embeddings""")
def tile_stitch(spark: SparkSession, d: str) -> DataFrame:
    r, c = tokens.stitched(F.floor(F.col("vec_id") / 16), F.col("vec_id") % 16, F.lit(4), F.lit(4))
    return table(spark, d, "embeddings").select("vec_id", r.alias("r"), c.alias("c"))


@registered("""WITH p AS (SELECT doc_id AS page_id, doc_id % 97 + 4 AS n, doc_id % 7 + 3 AS width, doc_id % 5 + 3 AS height FROM documents),
f AS (SELECT page_id, n, k, round(abs(k / (n / k) - height / width), 9) AS e FROM p, unnest(range(1, n + 1)) AS t(k) WHERE n % k = 0)
SELECT page_id, CAST(arg_min(k, (e, k)) AS INTEGER) AS rows, CAST(any_value(n) // arg_min(k, (e, k)) AS INTEGER) AS cols FROM f GROUP BY page_id""")
def aspect_factor(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return tokens.grid_factors(table(spark, d, "documents").select(i.alias("page_id"), (i % 97 + 4).alias("n"), (i % 7 + 3).alias("width"), (i % 5 + 3).alias("height")))


KIND_SQL = "['invoice', 'contract', 'report', 'memo', 'manual', 'receipt']"
SUBJECT_SQL = "['audit', 'budget', 'energy', 'freight', 'health', 'housing', 'logistics', 'payroll', 'pension', 'safety', 'travel', 'water']"
PAGES_SQL = f"""WITH n AS (SELECT unnest(range(0, (SELECT count(*) FROM documents) * 2)) AS i),
k AS (SELECT i, i // 2 AS d, i % 2 AS p, ({KIND_SQL})[i // 2 % 6 + 1] AS kind, ({SUBJECT_SQL})[i % 12 + 1] AS subject FROM n),
pg AS (SELECT kind || '_' || printf('%03d', d) AS doc_id, CAST(p + 1 AS INTEGER) AS page_no, kind || '_' || printf('%03d', d) || '::p' || (p + 1) AS page_id, kind,
  upper(left(kind, 3)) || '07' || printf('%03d', d) || (p + 1) AS code, subject FROM k)
"""


@registered(PAGES_SQL + "SELECT * FROM pg")
def page_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return tokens.page_catalogue(spark, table(spark, d, "documents").count(), 2)


@registered(PAGES_SQL + """, q AS (SELECT 0 AS part, page_id AS key, 'precise' AS kind, kind || ' ' || code AS query, page_id AS relevant FROM pg
  UNION ALL SELECT 1, subject, 'topical', 'documents about ' || subject, string_agg(page_id, ' ' ORDER BY page_id) FROM pg GROUP BY subject)
SELECT 'q' || printf('%04d', row_number() OVER (ORDER BY part, key)) AS qid, kind, query, relevant FROM q""")
def query_builder(spark: SparkSession, d: str) -> DataFrame:
    q = tokens.query_set(page_catalogue(spark, d))
    return q.select("qid", "kind", "query", F.array_join("relevant", " ").alias("relevant"))


@registered(r"""WITH t AS (SELECT conv_id, turn, [x FOR x IN [regexp_replace(w, '[^\p{L}\p{N}]', '', 'g') FOR w IN regexp_split_to_array(lower(text), '\s+')] IF x <> ''] AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE '__empty' END AS words FROM t""")
def tokenise_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(tokens.query_words(F.col("text")), " ").alias("words"))


@registered("""WITH t AS (SELECT DISTINCT source AS token FROM documents), x AS (SELECT token, [CAST(('0x' || left(md5(token || ':' || k), 8)) AS BIGINT) / 4294967296 - 0.5 FOR k IN range(0, 16)] AS v FROM t)
SELECT token, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[16] / sqrt(list_dot_product(v, v)), 6) AS last FROM x""")
def hash_encode(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.col("source").alias("token")).distinct().withColumn("v", tokens.hash_vector(F.col("token"), 16))
    return t.select("token", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", 16), 6).alias("last"))


@registered("""WITH l AS (SELECT doc_id, i, ls[i] AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)),
q AS (SELECT doc_id, i, q, substr(t, q * 64 + 1, 64) AS t FROM l, unnest(range(0, CAST(greatest(1, ceil(length(t) / 64.0)) AS BIGINT))) AS u(q)),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, q) - 1 AS line, count(*) OVER (PARTITION BY doc_id) AS n, t FROM q)
SELECT doc_id, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS n_chars, CAST(sum(line) AS BIGINT) AS line_sum, max(n) AS n_lines FROM (
  SELECT doc_id, line, n, unnest([x FOR x IN string_split(t, ' ') IF x <> '']) AS w FROM r) GROUP BY doc_id""")
def layout_boxes(spark: SparkSession, d: str) -> DataFrame:
    w = tokens.layout(table(spark, d, "documents"))
    lines = F.round(1 / (F.col("y1") - F.col("y0"))).cast("long")
    return w.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum(F.length("word")).alias("n_chars"), F.sum("line").alias("line_sum"), F.max(lines).alias("n_lines"))


@registered(SQL + "SELECT count(*) AS n_pages, CAST(sum(n) * 8 AS BIGINT) AS nbytes, round(avg(n), 6) AS mean_tokens FROM (SELECT page_id, count(*) AS n FROM patch GROUP BY 1)")
def incremental_equals_single(spark: SparkSession, d: str) -> DataFrame:
    p = patches(spark, d)
    parts = [p.where(F.col("page_id") % 3 == r) for r in range(3)]
    added = page_accounts(parts[0], parts[0], "binary", DIM)
    for part in parts[1:]:
        added = added.unionByName(page_accounts(part, part, "binary", DIM))
    return added.agg(F.count("*").alias("n_pages"), F.sum("nbytes").alias("nbytes"), F.round(F.avg("n_after"), 6).alias("mean_tokens"))


@registered(SQL + "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 16 ELSE 80 END AS nbytes FROM (SELECT DISTINCT page_id FROM patch)")
def upsert_pages(spark: SparkSession, d: str) -> DataFrame:
    p = patches(spark, d)
    new = p.where(F.col("page_id") % 2 == 0)
    out = upserted(page_accounts(p, p, "binary", DIM), page_accounts(new, new.where("is_text"), "binary", DIM))
    return out.select("page_id", F.col("nbytes").cast("int").alias("nbytes"))


@registered("""WITH d AS (SELECT doc_id FROM documents), l AS (SELECT doc_id, quality FROM labels)
SELECT (SELECT count(*) FROM d WHERE doc_id IN (SELECT doc_id FROM l)) AS labelled, (SELECT count(*) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM l)) AS unlabelled""")
def label_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    a = docs.join(labels, "doc_id", "left_semi").agg(F.count("*").alias("labelled"))
    return a.crossJoin(docs.join(labels, "doc_id", "left_anti").agg(F.count("*").alias("unlabelled")))


@registered("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return event_windows(table(spark, d, "events"))


@registered("""WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "events"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Sign-code MaxSim of every query and page, top five, and nDCG@5 per query."""
    run = run_of(spark, d, "binary", 5)
    return run.join(metrics.per_query(run, judgements(patches(spark, d)), (5,)).select("qid", F.round("ndcg_5", 6).alias("ndcg_5")), "qid", "left")


from glyphmax import catalog_more  # noqa: E402, F401  (registers its queries)
