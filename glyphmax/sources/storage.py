"""Small files and checks in whatever storage Spark's paths name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def located(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = located(spark, path)
    return system.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it, if it is there."""
    system, at = located(spark, path)
    system.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    system, at = located(spark, path)
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name and move it into place, so that readers never see a part of it."""
    system, at = located(spark, path)
    _, beside = located(spark, path + ".new")
    stream = system.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    system.delete(at, False)
    if not system.rename(beside, at):
        raise OSError(f"cannot write {path}")


def encodings(spark: SparkSession, path: str) -> DataFrame:
    """Stored patch rows of :func:`store_encodings`."""
    return spark.read.parquet(path)


def store_encodings(patches: DataFrame, path: str) -> DataFrame:
    """Write encoded pages (one row a patch, whole pages together) and read them back."""
    patches.repartitionByRange("page_id").sortWithinPartitions("page_id", "tok").write.mode("overwrite").parquet(path)
    return encodings(patches.sparkSession, path)
