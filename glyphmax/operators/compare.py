"""Reports against each other: regimes, claims, projections; and joins that must not lose a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retention(report: DataFrame, baseline: str = "baseline") -> DataFrame:
    """``regime, variant, compression_ratio, retention, cost`` of report rows: percent of the regime's baseline, and what is
    missing to 100."""
    base = report.where(F.col("variant") == baseline).select("regime", F.col("ndcg_5").alias("base"))
    kept = 100 * F.col("ndcg_5") / F.col("base")
    return report.join(F.broadcast(base), "regime").select("regime", "variant", "compression_ratio", F.round(kept, 6).alias("retention"), F.round(100 - kept, 6).alias("cost"))  # a row a regime


def regime_changes(report: DataFrame, a: str, b: str, baseline: str = "baseline") -> DataFrame:
    """``variant, cost_a, cost_b, change``: what a variant costs under two regimes; only variants that both have."""
    r = retention(report, baseline)
    x, y = (r.where(F.col("regime") == n).select("variant", F.col("cost").alias(c)) for n, c in ((a, "cost_a"), (b, "cost_b")))
    return x.join(y, "variant").withColumn("change", F.round(F.col("cost_b") - F.col("cost_a"), 6))


def claims(report: DataFrame, pruned: str = "spatial+redundancy", coded: str = "binary", sweep: str = "keep-", baseline: str = "baseline", most: float = 6, factor: float = 2, span: float = 2) -> DataFrame:
    """``regime, claim, value, holds``: pruning costs under ``most`` points; coding costs over ``factor`` times as much;
    the keep-ratio sweep spans under ``span`` points. A claim whose variants are missing has no row."""
    r = retention(report, baseline).groupBy("regime").agg(
        F.max(F.when(F.col("variant") == pruned, F.col("cost"))).alias("p"), F.max(F.when(F.col("variant") == coded, F.col("cost"))).alias("c"),
        (F.max(F.when(F.col("variant").startswith(sweep), F.col("retention"))) - F.min(F.when(F.col("variant").startswith(sweep), F.col("retention")))).alias("s"),
    )
    found = F.array(
        F.struct(F.lit("pruning is nearly free").alias("claim"), F.col("p").alias("value"), (F.col("p") < most).alias("holds")),
        F.struct(F.lit("the loss is the code's").alias("claim"), F.col("c").alias("value"), (F.col("c") > factor * F.col("p")).alias("holds")),
        F.struct(F.lit("the budget hardly matters").alias("claim"), F.round("s", 6).alias("value"), (F.col("s") < span).alias("holds")),
    )
    return r.select("regime", F.explode(found).alias("x")).select("regime", "x.*").where("value IS NOT NULL AND holds IS NOT NULL")


def tradeoff(report: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Points of the trade-off figure: ``regime, variant, compression_ratio, retention`` by rising compression."""
    return retention(report, baseline).select("regime", "variant", "compression_ratio", "retention").orderBy("regime", "compression_ratio", "variant")


def zipped(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of two tables side by side by key; an error (when it is run) where either lacks a key of the other."""
    rows = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), on, "full")
    short = F.when(F.col("in_a") & F.col("in_b"), F.lit(True)).otherwise(F.raise_error(F.lit("tables to be zipped differ in length")).cast("boolean"))
    return rows.where(short).drop("in_a", "in_b")


def group_flags(rows: DataFrame, by: str, flag: str) -> DataFrame:
    """Whether any, and whether every row of a group has a flag."""
    return rows.groupBy(by).agg(F.bool_or(flag).alias("some"), F.bool_and(flag).alias("every"))


def merged_notes(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Two maps of notes per key (``notes``) as one; the second's entries win, and a missing map is empty."""
    none = F.create_map().cast("map<string,string>")
    y = b.select(on, F.col("notes").alias("later"))
    earlier = F.map_filter(F.coalesce("notes", none), lambda k, v: ~F.coalesce(F.map_contains_key("later", k), F.lit(False)))
    return a.join(y, on, "full").select(on, F.map_concat(earlier, F.coalesce("later", none)).alias("notes"))
