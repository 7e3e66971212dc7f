"""The change feed as a streaming source of its own, with offsets that expire, and the job that follows it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..jobs.tables import read_if_there

#: Stands in the message of the error of a cursor before the oldest change that is kept.
EXPIRED = "HISTORY_CURSOR_EXPIRED"
GENERATION = 1 << 32
CHANGES = "seq bigint, message_id string, kind string"
_GENERATIONS = "generation bigint, cursor bigint"


class ExpiredCursor(Exception):
    def __init__(self, cursor: int, oldest: int | None):
        super().__init__(f"{EXPIRED}: changes after {cursor} are no longer kept, the oldest one is {oldest}")


def append_changes(changes: DataFrame, folder: str, files: int | None = None, schema: str = CHANGES) -> None:
    """Adds rows with a ``seq`` to a log, by ranges of it, so that readers open few row groups."""
    files = files or max(1, changes.sparkSession.sparkContext.defaultParallelism)
    rows = changes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])
    rows.repartitionByRange(files, "seq").sortWithinPartitions("seq").write.mode("append").parquet(folder)


class LogFeed:
    """A folder of Parquet files with changes (``seq`` and what else ``schema`` has). What is removed from it counts as no longer kept.

    ``bounds`` and ``splits`` read the footers only, those of a file once.
    """

    def __init__(self, folder: str, schema: str = CHANGES):
        self.folder, self.schema = folder, schema
        self.arrow = to_arrow_schema(StructType.fromDDL(schema))  # here, as tasks have no session
        self.known: dict[str, list[tuple[int, int, int]]] = {}

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder)

    def _row_groups(self) -> list[tuple[str, int, int, int]]:
        """(path, row group, least seq, largest seq) of what is there now."""
        store, base = self._store()
        files = [f.path for f in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if f.path.endswith(".parquet") and not any(part[:1] in "_." for part in f.path[len(base) :].split("/") if part)]
        for path in [p for p in files if p not in self.known]:
            footer = pq.ParquetFile(path, filesystem=store).metadata
            at = footer.schema.names.index("seq")
            stats = [(k, footer.row_group(k).column(at).statistics) for k in range(footer.num_row_groups) if footer.row_group(k).num_rows]
            self.known[path] = [(k, s.min, s.max) for k, s in stats]
        return sorted((p, *g) for p in files for g in self.known[p])

    def bounds(self) -> tuple[int | None, int | None]:
        """The oldest and the newest change that is kept."""
        found = self._row_groups()
        return (min((g[2] for g in found), default=None), max((g[3] for g in found), default=None))

    def splits(self, after: int, upto: int) -> list[tuple]:
        return [(path, k, after, upto) for path, k, low, high in self._row_groups() if high > after and low <= upto]

    def read(self, split: tuple) -> Iterator[pa.RecordBatch]:
        path, k, after, upto = split
        try:
            rows = pq.ParquetFile(path, filesystem=self._store()[0]).read_row_group(k, columns=self.arrow.names)
        except FileNotFoundError:
            raise ExpiredCursor(after, None) from None
        rows = rows.filter(pc.and_(pc.greater(rows["seq"], after), pc.less_equal(rows["seq"], upto))).cast(self.arrow)
        yield from rows.to_batches()


class _Split(InputPartition):
    def __init__(self, split: tuple):
        self.split = split


class HistoryReader(DataSourceStreamReader):
    """Offsets are ``{"seq": n}``: all changes up to ``n`` are read.

    A batch has a range of at most ``per_batch`` numbers. Spark does not say where a restarted query stands before it
    asks how far to go, so the last planned offset is an option (``resume``); it only bounds the range.
    """

    def __init__(self, feed: LogFeed, options: dict):
        self.feed = feed
        self.cursor = int(options["cursor"]) if "cursor" in options else None
        self.per_batch = int(options.get("per_batch", 1 << 62))
        self.planned = int(options["resume"]) if "resume" in options else None

    def initialOffset(self) -> dict:
        """The cursor, or where what is kept begins."""
        if self.cursor is not None:
            return {"seq": self.cursor}
        oldest, _ = self.feed.bounds()
        return {"seq": 0 if oldest is None else oldest - 1}

    def latestOffset(self) -> dict:
        if self.planned is None:
            self.planned = self.initialOffset()["seq"]
        oldest, newest = self.feed.bounds()
        if newest is not None and newest > self.planned:
            # numbers that are kept no longer count for nothing
            self.planned = min(newest, max(self.planned, oldest - 1) + self.per_batch)
        return {"seq": self.planned}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        oldest, _ = self.feed.bounds()
        self.planned = max(self.planned or end["seq"], end["seq"])
        if end["seq"] > start["seq"] and (oldest is None or oldest > start["seq"] + 1):
            raise ExpiredCursor(start["seq"], oldest)
        return [_Split(s) for s in self.feed.splits(start["seq"], end["seq"])]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        return self.feed.read(partition.split)


def history(spark: SparkSession, feed: LogFeed, **options: int) -> DataFrame:
    """The changes of ``feed`` as a stream, from ``cursor`` on, at most ``per_batch`` numbers a batch.

    A feed has a ``schema``, ``bounds()``, ``splits(after, upto)`` and ``read(split)``, and can be pickled. A cursor before the oldest change
    that is kept ends the query with an error that says ``EXPIRED``, at its start or later.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "offerlake_history"

        def schema(self) -> str:
            return feed.schema

        def streamReader(self, schema) -> HistoryReader:
            return HistoryReader(feed, self.options)

    spark.dataSource.register(Source)
    return spark.readStream.format("offerlake_history").options(**{k: str(v) for k, v in options.items()}).load()


def planned_offset(spark: SparkSession, checkpoint: str) -> int | None:
    """The last offset that a query with this checkpoint has planned; the folder keeps about a hundred."""
    lines = read_if_there(lambda: spark.read.text(f"{checkpoint}/offsets"))
    return None if lines is None else lines.select(F.max(F.regexp_extract("value", r'"seq"\s*:\s*(-?[0-9]+)', 1).try_cast("bigint"))).first()[0]


def follow_history(spark: SparkSession, feed: LogFeed, root: str, on_batch: Callable[[DataFrame, int], None], relist: Callable[[int], None], once: bool = True, every: str = "5 minutes", per_batch: int = 1 << 20) -> None:
    """Hand every micro-batch of changes to ``on_batch(changes, number)``; where the cursor has expired, or there is none yet,
    call ``relist(number)`` and go on from what was newest before that.

    The offsets of a checkpoint that survive a restart are the cursor. Each relisting begins a new checkpoint, which counts only once
    the relisting has returned: one that breaks off is done again. Numbers ascend over all of it and come again
    after a failure, so both functions must be idempotent by number. Returns where ``once`` and all is read.
    """
    while True:
        known = read_if_there(lambda: spark.read.schema(_GENERATIONS).parquet(f"{root}/generations"))
        last = None if known is None else known.orderBy(F.desc("generation")).first()
        if last is not None:
            first, checkpoint = last["generation"] * GENERATION + 1, f"{root}/history-{last['generation']}"
            resume = planned_offset(spark, checkpoint)
            options = {"cursor": last["cursor"], "per_batch": per_batch} | ({} if resume is None else {"resume": resume})
            writer = history(spark, feed, **options).writeStream.foreachBatch(lambda df, n, first=first: on_batch(df, first + n)).option("checkpointLocation", checkpoint)
            try:
                (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start().awaitTermination()
            except StreamingQueryException as e:
                if EXPIRED not in str(e):
                    raise
            else:
                # a run for all available is one batch of this source, so there may be more
                if planned_offset(spark, checkpoint) in (None, resume):
                    return
                continue
        generation = 0 if last is None else last["generation"] + 1
        newest = feed.bounds()[1]
        relist(generation * GENERATION)
        # from the newest change before the listing, so that what came meanwhile is read too
        cursor = newest if newest is not None else last["cursor"] if last is not None else 0
        spark.createDataFrame([(generation, cursor)], _GENERATIONS).coalesce(1).write.mode("append").parquet(f"{root}/generations")
