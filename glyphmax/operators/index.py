"""Index tables: codes one row a vector and page accounting, with append, upsert, statistics and reopening."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmax.operators import codecs
from glyphmax.sources.storage import exists, read_text, write_text


def page_accounts(before: DataFrame, after: DataFrame, method: str, dim: int, norms: bool = False) -> DataFrame:
    """``page_id, n_before, n_after, nbytes, raw_nbytes`` of every page, also of those that kept nothing."""
    b = before.groupBy("page_id").agg(F.count("*").alias("n_before"))
    a = after.groupBy("page_id").agg(F.count("*").alias("n_after"))
    n = F.coalesce("n_after", F.lit(0)).cast("long")
    return b.join(a, "page_id", "left").select("page_id", F.col("n_before").cast("long").alias("n_before"), n.alias("n_after"), (n * codecs.bytes_per_vector(method, dim, norms)).alias("nbytes"), (F.col("n_before") * 4 * dim).cast("long").alias("raw_nbytes"))


def index_stats(pages: DataFrame) -> DataFrame:
    """Totals and ratios of page accounts; zero where a denominator is."""

    def ratio(a: str, b: str):
        return F.round(F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b)), 6)

    t = pages.agg(F.count("*").alias("n_pages"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_after", "n_before", "nbytes", "raw_nbytes")])
    return t.select(
        "n_pages", F.col("n_after").alias("n_vectors"), F.col("n_before").alias("tokens_before"), ratio("n_after", "n_pages").alias("vectors_per_page"), F.col("nbytes").alias("index_bytes"),
        F.col("raw_nbytes").alias("raw_bytes"), ratio("nbytes", "n_pages").alias("bytes_per_page"), ratio("raw_nbytes", "nbytes").alias("compression_ratio"), ratio("n_before", "n_after").alias("token_reduction"),
    )


def storage_summary(stats: DataFrame) -> DataFrame:
    """Sizes in decimal units: MB, KB a page, ratio, GB a million pages."""
    per_page = F.col("index_bytes") / F.greatest("n_pages", F.lit(1))
    return stats.select(F.round(F.col("index_bytes") / 1e6, 6).alias("index_mb"), F.round(F.col("raw_bytes") / 1e6, 6).alias("raw_mb"), F.round(per_page / 1e3, 6).alias("kb_per_page"), "compression_ratio", F.round(per_page * 1e6 / 1e9, 6).alias("gb_per_million_pages"))


def upserted(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Pages of ``new`` replace those of ``existing``; the rest stays."""
    return existing.join(new.select("page_id").distinct(), "page_id", "left_anti").unionByName(new)


def page_summary(accounts: DataFrame, dim: int) -> DataFrame:
    """Per page: tokens dropped in percent, bytes by which it shrank, bits a component of what is kept, and KiB."""
    n, raw, code = F.col("n_after"), F.col("raw_nbytes"), F.col("nbytes")
    return accounts.select(
        "page_id", "n_before", "n_after", F.round((F.col("n_before") - n) / F.greatest("n_before", F.lit(1)) * 100, 6).alias("token_reduction_percent"),
        F.round(raw / F.greatest(code, F.lit(1)), 6).alias("storage_factor"), F.round(code * 8 / F.greatest(n * dim, F.lit(1)), 6).alias("bits_per_dimension"), F.round(code / 1024, 6).alias("kib"),
    )


class PageIndex:
    """Codes and accounts under a path, in any storage that Spark reads.

    A version is a pair of tables; the manifest lists those in force and is replaced after they are written. Append adds a
    version and touches none before it (pages may repeat); upsert writes one that takes the place of all. With ``full`` the
    vectors that were kept are stored beside the codes, for re-ranking.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int, method: str, norms: bool = False, full: bool = False) -> None:
        self.spark, self.path, self.dim, self.method, self.norms, self.full = spark, path.rstrip("/"), dim, method, norms, full
        self.versions: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PageIndex:
        """Reopen; dimension and method come from the manifest."""
        meta = json.loads(read_text(spark, f"{path.rstrip('/')}/manifest.json"))
        out = cls(spark, path, meta["dim"], meta["method"], meta["norms"], meta["full"])
        out.versions = meta["versions"]
        return out

    @classmethod
    def there(cls, spark: SparkSession, path: str) -> bool:
        return exists(spark, f"{path.rstrip('/')}/manifest.json")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{v}/{name}" for v in self.versions])

    @property
    def codes(self) -> DataFrame:
        return self._table("codes")

    @property
    def pages(self) -> DataFrame:
        return self._table("pages")

    @property
    def floats(self) -> DataFrame | None:
        """The stored vectors ``page_id, tok, v``, where the index keeps them."""
        return self._table("full").select("page_id", "tok", F.transform("v", lambda x: x.cast("double")).alias("v")) if self.full and self.versions else None

    def write(self, before: DataFrame, after: DataFrame, mode: str = "upsert") -> None:
        """Add pages: ``before`` their tokens, ``after`` the vectors kept. Modes: overwrite, append, upsert."""
        if mode not in ("overwrite", "append", "upsert"):
            raise ValueError(f"unknown mode {mode!r}")
        tables = {"codes": codecs.compressed(after, self.method, self.dim, self.norms), "pages": page_accounts(before, after, self.method, self.dim, self.norms)}
        if self.full:
            tables["full"] = after.select("page_id", "tok", F.transform("v", lambda x: x.cast("float")).alias("v"))
        if self.versions and mode == "upsert":
            new = tables["pages"].select("page_id")
            tables = {k: self._table(k).join(new, "page_id", "left_anti").unionByName(t) for k, t in tables.items()}
        version = uuid.uuid4().hex
        for name, rows in tables.items():
            if name != "pages":
                rows = rows.repartitionByRange("page_id").sortWithinPartitions("page_id", "tok")
            rows.write.parquet(f"{self.path}/{version}/{name}")
        self.versions = [*self.versions, version] if mode == "append" else [version]
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps({"dim": self.dim, "method": self.method, "norms": self.norms, "full": self.full, "versions": self.versions}))

    def try_write(self, before: DataFrame, after: DataFrame, mode: str = "upsert") -> dict:
        """:meth:`write` that reports instead of raising: ``{"ok": True}``, or False and the error."""
        try:
            self.write(before, after, mode)
        except Exception as error:  # whatever storage or data raise is the report
            return {"ok": False, "error": str(error)[:500]}
        return {"ok": True}

    def vectors(self) -> DataFrame:
        return codecs.decoded(self.codes, self.method, self.dim)

    def stats(self) -> DataFrame:
        return index_stats(self.pages)
