"""The write log as a stream: replay into a store, newest value per key, throughput samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keystrand.operators.merge import DELETE, PUT
from keystrand.sources.store import KVStore


def read_log(spark: SparkSession, path: str, value_type: str = "double", files_per_batch: int = 64) -> DataFrame:
    """Stream of ``seq, op, key, value`` from a folder of Parquet files; rows of unknown op are skipped."""
    rows = spark.readStream.schema(f"seq long, op string, key long, value {value_type}").option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.where(F.col("op").isin(PUT, DELETE))


def apply_to_store(stream: DataFrame, store: KVStore, checkpoint: str, *, flush_every: int = 16) -> StreamingQuery:
    """Appends each micro-batch to the store once and compacts after every ``flush_every`` of them.

    The store keeps the number of the last batch it took, so a batch that is replayed after a failure
    is skipped.  Within a batch the newest ``seq`` of a key wins; order is that of the log.
    """

    def apply(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("w")).select("key", "w.op", "w.value")
        store.write(newest, streamed=number)
        if (number + 1) % flush_every == 0:
            store.flush()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_values(stream: DataFrame) -> DataFrame:
    """Streaming newest write per key, ordered by ``seq``; an older arrival changes nothing.

    For output mode ``update`` or ``complete``; the state has a row per key.
    """
    return stream.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("w")).select("key", "w.seq", "w.op", "w.value")


def throughput_samples(stream: DataFrame, every: int) -> DataFrame:
    """Streaming count of requests by sample of ``every`` sequence numbers."""
    return stream.groupBy(F.floor(F.col("seq") / every).alias("sample")).agg(F.count("*").alias("n"))
