"""Incremental scans by Structured Streaming: new files become blocks and go into the store, batch by batch. An extension of the batch scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import decoded
from ..sources.python_blocks import extract
from ..sources.store import Store


def watch(spark: SparkSession, root: str, store: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Reads files that appear under root (one folder level below a glob is fine) and upserts their blocks; batches that repeat give the same tables."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)

    def save(batch: DataFrame, number: int) -> None:
        files = decoded(batch.select("path", "content", "modificationTime"))
        store.save_index(files, extract(files), f"stream-{number}")

    writer = raw.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
