"""Incremental merge: a file stream of catalog rows folded into a keyed store, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lokalith.operators.catalog import collapse_old, merge
from lokalith.streaming.store import Store

CATALOG_ROWS = "key string, source string, translation string"


def catalog_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    return Store(spark, path, CATALOG_ROWS, ["key"], buckets)


def merge_stream(stream: DataFrame, store: str, checkpoint: str, buckets: int = 64):
    """Start a query that merges each micro-batch of ``key, source, translation`` with the catalog below ``store``.

    A batch reads and writes the buckets of its keys. It is committed with its number under the name of the checkpoint, so
    a repeated batch counts once, and a new checkpoint goes on from what the store holds. Of repeated keys in a batch the
    first source and the last translation count. :meth:`Store.vacuum` removes old versions.

    Rows of the batch and of the store are shuffled once each, by the key: grouping, join and buckets share that partitioning.
    """

    def fold(batch: DataFrame, number: int) -> None:
        kept = catalog_store(batch.sparkSession, store, buckets)
        batch.sparkSession.conf.set("spark.sql.shuffle.partitions", kept.partitions())  # the stream's own session
        kept.commit(collapse_old(batch.withColumn("ord", F.monotonically_increasing_id())), merge, checkpoint, number, dealt=True)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
