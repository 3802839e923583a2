"""Views of the shared tables: pages of patches, query tokens, judgements, probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmax.functions import vec

DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, tok, r, c, is_text, label, v``: ten vectors a page on a 2 x 5 grid, the last two structural."""
    e = table(spark, sf_dir, "embeddings")
    page, tok = F.floor(F.col("vec_id") / 10).cast("long"), (F.col("vec_id") % 10).cast("int")
    return e.select(page.alias("page_id"), tok.alias("tok"), F.floor(tok / 5).cast("int").alias("r"), (tok % 5).alias("c"), (tok >= 8).alias("is_text"), "label", vec.doubles(F.col("embedding")).alias("v"))


def query_tokens(p: DataFrame) -> DataFrame:
    """``qid, qtok, v``: every page that holds a vector whose id is divisible by 100 is a query."""
    return p.where(F.col("page_id") % 10 == 0).select(F.col("page_id").alias("qid"), F.col("tok").alias("qtok"), "v")


def judgements(p: DataFrame) -> DataFrame:
    """``qid, page_id``: pages with at least two patches of the label of the query's first patch."""
    q = p.where((F.col("page_id") % 10 == 0) & (F.col("tok") == 0)).select(F.col("page_id").alias("qid"), "label")
    labelled = p.groupBy("page_id", "label").agg(F.count("*").alias("n")).where("n >= 2")
    return labelled.join(q, "label").select("qid", "page_id")


def probes(p: DataFrame) -> DataFrame:
    """``probe, v``: the first patch of every page is a probe of its own label's codebook entry (the least page's)."""
    return p.where("tok = 0").groupBy("label").agg(F.min_by("v", "page_id").alias("v")).select(F.col("label").alias("probe"), "v")


SQL = """
WITH RECURSIVE patch AS (
  SELECT vec_id // 10 AS page_id, CAST(vec_id % 10 AS INTEGER) AS tok, CAST((vec_id % 10) // 5 AS INTEGER) AS r, CAST((vec_id % 10) % 5 AS INTEGER) AS c,
    vec_id % 10 >= 8 AS is_text, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
),
query_tok AS (SELECT page_id AS qid, tok AS qtok, v FROM patch WHERE page_id % 10 = 0),
qrels AS (
  SELECT q.page_id AS qid, p.page_id FROM (SELECT page_id, label, count(*) AS n FROM patch GROUP BY 1, 2 HAVING count(*) >= 2) p
  JOIN (SELECT page_id, label FROM patch WHERE page_id % 10 = 0 AND tok = 0) q USING (label)
),
probe AS (SELECT label AS probe, arg_min(v, page_id) AS v FROM patch WHERE tok = 0 GROUP BY label)
"""

#: Float, sign and 8-bit scores of every query and page, and their rankings.
SCORES_SQL = SQL + """,
coded AS (
  SELECT *, [CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END FOR x IN v] AS s,
    [greatest(-127.0, least(127.0, CAST(round_even(x / 0.5 * 127, 0) AS DOUBLE))) * (0.5 / 127) FOR x IN v] AS i8 FROM patch
),
sim AS (
  SELECT q.qid, q.qtok, p.page_id, p.tok, list_dot_product(q.v, p.v) AS f, list_dot_product(q.v, CAST(p.s AS DOUBLE[])) AS s,
    list_dot_product(q.v, CAST(p.i8 AS DOUBLE[])) AS i8,
    list_dot_product([CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END FOR x IN q.v]::DOUBLE[], CAST(p.s AS DOUBLE[])) / 64 AS h
  FROM query_tok q, coded p
),
best AS (SELECT qid, qtok, page_id, max(f) AS f, max(s) AS s, max(i8) AS i8, max(h) AS h FROM sim GROUP BY 1, 2, 3),
score AS (SELECT qid, page_id, round(sum(f), 6) AS f, round(sum(s), 6) AS s, round(sum(i8), 6) AS i8, round(sum(h), 6) AS h FROM best GROUP BY 1, 2),
run AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY f DESC, page_id) AS rf, row_number() OVER (PARTITION BY qid ORDER BY s DESC, page_id) AS rs,
    row_number() OVER (PARTITION BY qid ORDER BY i8 DESC, page_id) AS ri, row_number() OVER (PARTITION BY qid ORDER BY h DESC, page_id) AS rh FROM score
)
"""
