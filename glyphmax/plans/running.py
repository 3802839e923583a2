"""Running sums over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCHES = 64


def running(rows: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """``rows`` with a running sum of each of ``sums`` in the order of columns ``order`` (unique, without nulls).

    The order is cut at up to ``STRETCHES`` keys, drawn by hash and so the same whenever they are drawn; a stretch is summed
    by a window, and what stands before it is the sum of whole stretches.
    """
    kinds = [rows.schema[c].dataType for c in order]
    drawn = sorted(tuple(r) for r in rows.select(*order).orderBy(F.xxhash64(*order), *order).limit(8 * STRETCHES).collect())
    cuts = drawn[8::8]
    key = F.struct(*order)
    stretch = F.lit(0)
    if cuts:
        borders = F.array(*[F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(cut, kinds, order)]) for cut in cuts])
        stretch = F.size(F.filter(borders, lambda b: b <= key))
    rows = rows.select("*", stretch.alias("running_stretch"), *[s.alias(f"running_{n}") for n, s in sums.items()])
    whole = rows.groupBy("running_stretch").agg(*[F.sum(f"running_{n}").alias(f"whole_{n}") for n in sums])
    before = Window.partitionBy().orderBy("running_stretch").rowsBetween(Window.unboundedPreceding, -1)  # over at most STRETCHES rows
    whole = whole.select("running_stretch", *[F.coalesce(F.sum(f"whole_{n}").over(before), F.lit(0)).alias(f"before_{n}") for n in sums])
    inside = Window.partitionBy("running_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    mine = [c for c in rows.columns if c != "running_stretch" and c not in {f"running_{n}" for n in sums}]
    return rows.join(F.broadcast(whole), "running_stretch").select(*mine, *[(F.sum(f"running_{n}").over(inside) + F.col(f"before_{n}")).alias(n) for n in sums])
