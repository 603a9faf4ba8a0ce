"""Session settings, table loading and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .sources.files import remove

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.fieldId.write.enabled": "true",
    "spark.sql.parquet.fieldId.read.enabled": "true",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}

# Folders made for local sessions only; removed when the interpreter ends.
_LOCAL_FOLDERS: list[tempfile.TemporaryDirectory] = []

#: Removes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PASSING: ContextVar[list[tuple[str, str]] | None] = ContextVar("passing", default=None)


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime settings the operators rely on. Safe to call again."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark. On a cluster, pass your own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh path for written tables, below the folder named by ``spark.checkpoint.dir``.

    Executors come and go, so anything written between jobs has to be visible to all of
    them. Only a local session may fall back to a temporary folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tidemark/{label}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.TemporaryDirectory(prefix=f"tidemark-{label}-", ignore_cleanup_errors=True)
    _LOCAL_FOLDERS.append(folder)
    return f"{folder.name}/data"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives Catalyst the real
    size, so a later join broadcasts this side only when it is under the session threshold. Nothing reads the
    shuffle files behind it again, so they go when it is written.
    """
    spark = df.sparkSession
    path = workspace(spark, label)
    if _PASSING.get() is not None:
        _PASSING.get().append((label, path))
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession, but: Sequence[str]) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are removed at the end. Those with a label of ``but`` stay, or go with an outer one."""
    outer, written = _PASSING.get(), []
    token = _PASSING.set(written)
    try:
        yield
    finally:
        _PASSING.reset(token)
        for label, path in written:
            if label not in but:
                remove(spark, path)
            elif outer is not None:
                outer.append((label, path))


def local_frame(spark: SparkSession, schema: T.StructType | str,
                columns: Mapping[str, Sequence] | None = None) -> DataFrame:
    """A short list of the driver as a frame whose size Catalyst knows; empty without columns."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    rows = pa.table(dict(columns), schema=arrow) if columns else arrow.empty_table()
    return spark.createDataFrame(rows, schema)
