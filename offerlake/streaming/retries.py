"""Retries inside the stream: a state for each message with a timer for its next attempt."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.sync import BASE_DELAY, MAX_ATTEMPTS, RETRYABLE

OUTCOMES = "seq bigint, message_id string, at bigint, error string, retry_after_ms bigint, jitter double"
LEDGER = "message_id string, seq bigint, attempts int, next_at bigint, terminal boolean, event string"
#: Rows that are looked at together before the shuffle.
WINDOW = 1 << 18
_OUTCOME = ("message_id", "seq", "at", "error", "retry_after_ms", "jitter")
_ROW = Row("message_id", "seq", "attempts", "next_at", "terminal", "event")
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Retries(StatefulProcessor):
    """The ledger row of a message, folded over its outcomes in order of ``seq``; gives the row as it is after a batch.

    ``event`` says why: ``cleared`` (success), ``waiting`` (until next_at), ``terminal``, and ``due`` when the timer fires.
    """

    def __init__(self, base_delay: int = BASE_DELAY, most: int = MAX_ATTEMPTS):
        self.base_delay, self.most = base_delay, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ledger = handle.getValueState("ledger", "seq bigint, attempts int, next_at bigint, terminal boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # each call of the state is a message to the JVM, so there are few
        held = self.ledger.get()
        attempts, next_at, terminal = (0, None, False) if held is None else held[1:]
        timer = next_at
        last, event = None, None
        # by position, as a name is looked for in each row anew
        for _, last, at, error, retry_after, jitter in sorted((row[: len(_OUTCOME)] for row in rows), key=itemgetter(1)):
            if error is None:
                attempts, next_at, terminal, event = 0, None, False, "cleared"
                continue
            attempts += 1
            terminal = error not in RETRYABLE or attempts > self.most
            next_at = None if terminal else at + int(max(self.base_delay * 2.0 ** (attempts - 1) * jitter, float(retry_after or 0)))
            event = "terminal" if terminal else "waiting"
        if timer is not None and timer != next_at:
            self.handle.deleteTimer(timer)
        if event != "cleared":
            self.ledger.update((last, attempts, next_at, terminal))
        elif held is not None:
            self.ledger.clear()
        if next_at is not None:
            self.handle.registerTimer(next_at)
        yield _ROW(key[0], last, attempts, next_at, terminal, event)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.ledger.get()
        if held is not None:
            seq, attempts, next_at, terminal = held
            if not terminal and next_at == expiredTimerInfo.getExpiryTimeInMs():
                yield _ROW(key[0], seq, attempts, next_at, terminal, "due")

    def close(self) -> None:
        pass


def _ages(column: pa.ChunkedArray, missing: int) -> np.ndarray:
    return column.fill_null(missing).to_numpy()


def without_settled(batches: Iterator[pa.RecordBatch], window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """Leaves out outcomes that a success of the same message makes of no account: one that comes after them and is not of an earlier time.

    The fold begins anew with a success, so the ledger stays the same wherever the others come from; where the success is too late for a
    watermark, what it settles is too. No message's latest time is lost. Only outcomes within ``window`` rows of a task are compared.
    """
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def left(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        ids = rows["message_id"].combine_chunks().dictionary_encode()
        # the last slot is that of the id null
        key = ids.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        # without a time, nothing is settled, neither by it nor itself
        seq, at, until = _ages(rows["seq"], most), _ages(rows["at"], most), _ages(rows["at"], least)
        good = np.flatnonzero(rows["error"].is_null().to_numpy())
        good = good[np.argsort(seq[good], kind="stable")]
        cleared, when = np.full(len(ids.dictionary) + 1, least), np.full(len(ids.dictionary) + 1, least)
        cleared[key[good]], when[key[good]] = seq[good], until[good]
        yield from rows.filter(pa.array(~((seq < cleared[key]) & (at <= when[key])))).to_batches()

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= window:
            yield from left(held)
            held, n = [], 0
    if held:
        yield from left(held)


def retry_ledger(outcomes: DataFrame, watermark: str | None = None, base_delay: int = BASE_DELAY) -> DataFrame:
    """Changes of the ledger for a stream of outcomes (seq, message_id, at, error (null: success), retry_after_ms, jitter).

    As ``update_ledger`` for the same outcomes: a retryable failure waits 30 s doubled each time, times the jitter, or as long as the
    provider says, at most four times; any other is terminal; a success clears the row. ``at`` is the time of the outcome in ms. Timers go
    by the machine's clock, or by the outcomes' own with a ``watermark``; outcomes later than that are left out then.
    State holds one row for each message that is waiting or terminal. Outcomes that a later success settles do not reach it.
    """
    rows = outcomes.select(*_OUTCOME)
    rows = rows.mapInArrow(without_settled, rows.schema)
    if watermark is not None:
        rows = rows.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", watermark)
    mode = "ProcessingTime" if watermark is None else "EventTime"
    return rows.groupBy("message_id").transformWithState(Retries(base_delay), LEDGER, "Update", mode)


@contextmanager
def durable_state(spark: SparkSession):
    """State of queries started in here lies in RocksDB, which such states need and which spills to disk."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def run_retries(outcomes: DataFrame, on_change: Callable[[DataFrame, int], None], checkpoint: str, watermark: str | None = None, once: bool = True, every: str = "30 seconds", base_delay: int = BASE_DELAY):
    """Start the ledger's query: ``on_change(rows, number)`` gets what changed and what is due, and must be idempotent by number."""
    with durable_state(outcomes.sparkSession):
        writer = retry_ledger(outcomes, watermark, base_delay).writeStream.outputMode("update").foreachBatch(on_change).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
