"""The incremental job: discovered ids, their messages, the extraction, the commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jobs.tables import bucket_of
from ..operators.sync import pending_messages


def discover(feed: DataFrame, watermark: str | None = None, at: str = "ts") -> DataFrame:
    """Distinct message ids of a stream of changes (message_id, ts).

    State holds every id once, or with a ``watermark`` those of that time; the completion cache catches what
    comes back later.
    """
    if watermark is None:
        return feed.dropDuplicates(["message_id"])
    return feed.withWatermark(at, watermark).dropDuplicatesWithinWatermark(["message_id"])


def bodies_of(bodies: DataFrame, ids: DataFrame, buckets: int | None) -> DataFrame:
    """The bodies in the folders of ``ids``, where they are stored by ``bucket`` of their message_id; all of them else."""
    if buckets is None:
        return bodies
    key = ids.select(F.col("message_id").cast(bodies.schema["message_id"].dataType).alias("message_id"))
    held = [r[0] for r in key.select(bucket_of("message_id", buckets)).distinct().collect()]
    return bodies.filter(F.col("bucket").isin(held)).drop("bucket")


def run_incremental(ids: DataFrame, bodies: DataFrame, read_processed: Callable[[], DataFrame], commit: Callable[[DataFrame, int], None], checkpoint: str, version: int, once: bool = True, buckets: int | None = None):
    """Join each micro-batch of ids to the message bodies, leave out what is processed, and hand the rest to ``commit``.

    The checkpoint is the cursor: it moves on only after ``commit`` returns. ``commit`` must be idempotent by batch
    number, as a batch may run again after a failure. Where bodies are stored by ``bucket`` (``bucket_of`` message_id, so
    many ``buckets``), a batch reads only the folders that its ids are in.
    """

    def batch(found: DataFrame, number: int) -> None:
        ids = found.select("message_id").distinct()
        commit(pending_messages(bodies_of(bodies, ids, buckets).join(ids, "message_id", "left_semi"), read_processed(), version), number)

    writer = ids.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 minutes")).start()


def event_feed(spark: SparkSession, sf_dir: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """The events table as a stream of changes: one file or folder of files, in bounded batches.

    A pattern, as a stream takes a plain path for a folder.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/event[s].parquet").select(F.col("event_id").alias("seq"), F.col("user_id").alias("message_id"), "ts")
