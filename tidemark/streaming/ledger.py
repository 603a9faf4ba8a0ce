"""Streaming ledger state, change application, script detection and deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger_state import latest
from ..session import local_frame
from ..sources import files
from ..sources.batches import BatchStore
from ..sources.ledger import ROWS
from ..sources.scripts import file_name


def merge_log(stream: DataFrame, path: str, checkpoint: str, compact_every: int = 100) -> StreamingQuery:
    """Keep the latest state of a ledger stream.

    Each epoch writes only its own newest rows, to a folder named by the epoch, so a replay
    overwrites itself. Latest-of-latest is the latest of all, so readers and the occasional
    compaction merge the folders without the raw log.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        latest(batch).write.mode("overwrite").parquet(f"{path}/epochs/epoch={epoch}")
        # A finished compaction is never written again: a replay would overwrite what it reads.
        if epoch and epoch % compact_every == 0 and epoch not in _finished(spark, path, "merged"):
            read_merged(spark, path, epoch).write.mode("overwrite").parquet(f"{path}/merged/upto={epoch}")

    return _start(stream, write, checkpoint)


def _finished(spark: SparkSession, path: str, kind: str) -> list[int]:
    return [
        int(n.split("=")[1]) for n in files.names(spark, f"{path}/{kind}")
        if "=" in n and files.exists(spark, f"{path}/{kind}/{n}/_SUCCESS")
    ]


def read_merged(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Latest state over the newest compaction and the epochs after it, up to an epoch if given."""
    def wanted(kind: str) -> list[int]:
        return [e for e in _finished(spark, path, kind) if upto is None or e <= upto]

    base = max(wanted("merged"), default=None)
    paths = [f"{path}/epochs/epoch={e}" for e in wanted("epochs") if base is None or e > base]
    if base is not None:
        paths.append(f"{path}/merged/upto={base}")
    if not paths:
        return local_frame(spark, ROWS)
    return latest(spark.read.schema(ROWS).parquet(*paths))


def apply_change_stream(stream: DataFrame, store: BatchStore, table: str, name: str, checkpoint: str) -> StreamingQuery:
    """Publish each epoch of a change stream as one batch, exactly once.

    The batch id is made of the query name and the epoch; a replay of a committed epoch does nothing.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch_id = f"{name}-{epoch:08d}"
        if not store.is_committed(batch_id):
            store.stage(table, batch, batch_id)
            store.commit([batch_id], epoch, strict=False)

    return _start(stream, write, checkpoint)


def new_scripts(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Record scripts that appeared below a folder since the last run, with the epoch they came in."""
    found = (
        spark.readStream.option("recursiveFileLookup", True).text(path, wholetext=True)
        .select(file_name().alias("file"), F.length("value").alias("n_chars"))
    )

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return _start(found, write, checkpoint)


def drop_redelivered(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str,
                     hot_keys: bool = False) -> DataFrame:
    """First delivery of each key. State older than the delay is given up, so it stays bounded.

    With ``hot_keys`` each input partition drops its own repetitions first, so a key that makes up
    much of a micro-batch reaches the deciding task once per partition. It costs a second state.
    """
    marked = stream.withWatermark(event_time, delay)
    if hot_keys:
        # The partition number is the same when a task runs again, unlike a random salt.
        marked = marked.withColumn("_part", F.spark_partition_id()).dropDuplicatesWithinWatermark(
            [*keys, "_part"]
        ).drop("_part")
    return marked.dropDuplicatesWithinWatermark(list(keys))


def _start(stream: DataFrame, write, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
