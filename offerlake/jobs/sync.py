"""The job that keeps offers up to date: it follows the change feed, lists the window where that has lost its place, and purges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import EXTRACTOR_VERSION
from ..streaming.history import LogFeed, follow_history
from ..streaming.incremental import bodies_of
from .backfill import Model, process_ids, purge, run_backfill, waiting


def sync(spark: SparkSession, feed: LogFeed, messages: Callable[[], DataFrame], root: str, now_ms: Callable[[], int], days: int = 45, version: int = EXTRACTOR_VERSION, model: Model | None = None, ocr: Callable[[DataFrame], DataFrame] | None = None, buckets: int | None = None, once: bool = True, per_batch: int = 1 << 20) -> None:
    """Process what the feed reports, batch by batch; ``messages`` gives the mailbox as it is now.

    Each batch also takes the messages whose next attempt is due. Without a cursor, or with an expired one, the window is listed again. Every batch
    is committed before the feed's offset moves on, and is not committed twice: the feed's numbers are doubled, even ones for commits and odd ones for purges. Where the mailbox is
    stored by ``bucket`` (so many ``buckets``), only the folders of a batch's ids are read.
    """

    def on_batch(changes: DataFrame, number: int) -> None:
        now, ids = now_ms(), changes.select("message_id")
        late = waiting(spark, root, now, due=True)
        if late is not None:
            ids = ids.unionByName(late.select(F.col("message_id").cast("string").alias("message_id")))
        if ids.isEmpty():
            return
        process_ids(bodies_of(messages(), ids, buckets), ids, root, 2 * number, now, version, model, ocr)
        purge(spark, root, 2 * number + 1, now)

    def relist(number: int) -> None:
        now, all_ = now_ms(), messages()
        run_backfill(all_ if buckets is None else all_.drop("bucket"), root, 2 * number, now, days, version, model=model, ocr=ocr)
        purge(spark, root, 2 * number + 1, now)

    follow_history(spark, feed, f"{root}/feed", on_batch, relist, once, per_batch=per_batch)
