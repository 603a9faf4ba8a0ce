"""A corpus of change scripts as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import parse_script


def file_name() -> Column:
    """Name of the script a row was read from.

    Spark writes files under names of its own, so a corpus written by Spark keeps the script
    name as the partition folder ``file=<name>``; otherwise it is the name of the file.
    """
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, r"/file=([^/]+)/[^/]+\z", 1)
    return F.url_decode(F.when(folder != "", folder).otherwise(F.element_at(F.split(path, "/"), -1)))


def write_scripts(scripts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write (file, line) rows, one folder per script; lines keep their ``at`` order."""
    (
        scripts.repartition("file").sortWithinPartitions("file", "at").select("file", "line")
        .write.mode(mode).partitionBy("file").text(path)
    )


def scan_scripts(spark: SparkSession, path: str, direction: str | None = "up",
                 now: Column | None = None, strict: bool = True) -> DataFrame:
    """Scripts below a folder as (file, body, version, name, safe, direction).

    One bad name fails the whole listing when ``strict``; otherwise see :func:`rejected`. Only
    files of the wanted direction are opened.
    """
    rows = _named(spark, path, now)
    if direction is not None:
        rows = rows.filter(F.col("file").endswith(f".{direction}.sql"))
    if strict:
        message = F.concat(F.lit("bad script name: "), F.col("file"))
        # A condition is evaluated whatever columns are read later.
        rows = rows.filter(F.when(F.col("script.valid"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    else:
        rows = rows.filter("script.valid")
    return rows.select("file", "body", "script.version", "script.name", "script.safe", "script.direction")


def rejected(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    return _named(spark, path, now).filter("not script.valid").select("file", "script.reason")


def _named(spark: SparkSession, path: str, now: Column | None) -> DataFrame:
    return (
        spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
        .select(file_name().alias("file"), F.col("value").alias("body"))
        .withColumn("script", parse_script("file", now))
    )


def choose_variant(scripts: DataFrame, force_safe: bool = False) -> DataFrame:
    """One script per version and direction: the plain one, or the safe one if that is all there is."""
    rank = F.col("safe").cast("int") * (-1 if force_safe else 1)
    best = F.min_by(F.struct("file", "body", "name", "safe"), F.struct(rank, "file")).alias("best")
    return scripts.groupBy("version", "direction").agg(best).select("version", "direction", "best.*")
