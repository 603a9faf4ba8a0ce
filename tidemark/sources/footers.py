"""What Parquet files hold, read from their footers on executors, and how that differs from a declared schema."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_type

from ..operators.schema import FIELD_ID, TableSchema
from ..session import local_frame

# Executors get the reader by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "tidemark_footers"
INVENTORY = "file string, n_bytes long, n_rows long, field_id int, column_name string, column_type string"
#: Files whose footers one task reads.
FILES_PER_TASK = 64


@dataclass
class Files(InputPartition):
    paths: list


class FooterSource(DataSource):
    """One row per file and top-level column below the folder given as ``path``. Only footers are read."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return INVENTORY

    def reader(self, schema) -> DataSourceReader:
        return FooterReader(self.options["path"])


class FooterReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Files]:
        system, root = pfs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(pfs.FileSelector(root, recursive=True, allow_not_found=True))
        paths = sorted(f.path for f in found if f.path.endswith(".parquet") and not _hidden(f.path[len(root):]))
        return [Files(paths[i:i + FILES_PER_TASK]) for i in range(0, len(paths), FILES_PER_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = pfs.FileSystem.from_uri(self.folder)
        for path in partition.paths:
            with system.open_input_file(path) as f:
                footer = pq.read_metadata(f)
                size = f.size()
            for field in footer.schema.to_arrow_schema():
                number = (field.metadata or {}).get(b"PARQUET:field_id")
                kind = from_arrow_type(field.type, prefer_timestamp_ntz=True).simpleString()
                yield path, size, footer.num_rows, None if number is None else int(number), field.name, kind


def _hidden(path: str) -> bool:
    """Files that Spark does not read either."""
    return any(part.startswith(("_", ".")) and "=" not in part for part in path.split("/") if part)


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(file, n_bytes, n_rows, field_id, column_name, column_type) of every Parquet file below a folder; none if there is no such folder.

    The folder must be in a store that pyarrow opens: local, HDFS, S3 or GCS.
    """
    spark.dataSource.register(FooterSource)
    return spark.read.format(NAME).option("path", folder if "://" in folder else f"file://{folder}").load()


def drift_of_files(inventory: DataFrame, schema: TableSchema) -> DataFrame:
    """(file, n_rows, field_id, change, file_name, file_type, column_name, column_type): where a file differs from ``schema``.

    Columns are matched by field id. ``added``: the file has none of it; ``dropped``: only the file has it; ``renamed``, ``retyped`` or
    both; ``unnumbered``: a column without an id. One pass over the inventory.
    """
    fields = schema.columns.fields
    declared = local_frame(inventory.sparkSession, "field_id int, column_name string, column_type string", {
        "field_id": [f.metadata[FIELD_ID] for f in fields], "column_name": schema.names, "column_type": [f.dataType.simpleString() for f in fields]})
    files = inventory.groupBy("file").agg(F.first("n_rows").alias("n_rows"), F.collect_list(
        F.struct("field_id", F.col("column_name").alias("file_name"), F.col("column_type").alias("file_type"))).alias("held"))
    # As many rows as the table has columns.
    whole = files.crossJoin(F.broadcast(declared.agg(F.collect_list(F.struct("field_id", "column_name", "column_type")).alias("want"))))
    missing = F.filter("want", lambda w: ~F.exists("held", lambda h: h["field_id"].eqNullSafe(w["field_id"])))
    pairs = F.concat(
        F.transform("held", lambda h: F.struct(h.alias("h"), F.get(F.filter("want", lambda w: w["field_id"] == h["field_id"]), F.lit(0)).alias("w"))),
        F.transform(missing, lambda w: F.struct(F.lit(None).cast("struct<field_id:int,file_name:string,file_type:string>").alias("h"), w.alias("w"))))
    rows = whole.select("file", "n_rows", F.explode(pairs).alias("p")).select("file", "n_rows", "p.h", "p.w")
    renamed, retyped = F.col("h.file_name") != F.col("w.column_name"), F.col("h.file_type") != F.col("w.column_type")
    change = (F.when(F.col("h").isNull(), "added").when(F.col("h.field_id").isNull(), "unnumbered").when(F.col("w").isNull(), "dropped")
              .when(renamed & retyped, "renamed and retyped").when(renamed, "renamed").when(retyped, "retyped"))
    return rows.select("file", "n_rows", F.coalesce("h.field_id", "w.field_id").alias("field_id"), change.alias("change"), "h.file_name", "h.file_type",
                       "w.column_name", "w.column_type").filter("change is not null")
