"""The change feed as a source: restarts, bounded batches, expired cursors."""

import glob
import os

import pytest
from pyspark.errors import StreamingQueryException

from offerlake.streaming.history import EXPIRED, LogFeed, append_changes, follow_history, history, planned_offset


def changes(spark, seqs):
    return spark.createDataFrame([(n, f"m{n % 7}", "added") for n in seqs], "seq long, message_id string, kind string")


def read_all(spark, feed, folder, **options):
    """What one run for all available appends to ``folder``."""
    resume = planned_offset(spark, f"{folder}/state")
    options |= {} if resume is None else {"resume": resume}
    writer = history(spark, feed, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return sorted(r.seq for r in spark.read.schema("seq long").parquet(f"{folder}/out").collect())


def test_offsets_survive_a_restart_and_bound_each_batch(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "o")
    append_changes(changes(spark, range(100, 160)), log, 3)
    assert LogFeed(log).bounds() == (100, 159) and LogFeed(str(tmp_path / "none")).bounds() == (None, None)
    assert read_all(spark, LogFeed(log), out, per_batch=25) == list(range(100, 125))
    append_changes(changes(spark, range(160, 170)), log, 1)
    # a new process: another feed object, the same checkpoint
    assert read_all(spark, LogFeed(log), out, per_batch=25) == list(range(100, 150))
    assert read_all(spark, LogFeed(log), out) == list(range(100, 170))
    assert read_all(spark, LogFeed(log), out) == list(range(100, 170))
    assert read_all(spark, LogFeed(log), str(tmp_path / "p"), cursor=165) == [166, 167, 168, 169]


def test_an_expired_cursor_ends_the_query(spark, tmp_path):
    log = str(tmp_path / "log")
    append_changes(changes(spark, range(50, 60)), log, 1)
    with pytest.raises(StreamingQueryException, match=EXPIRED):
        read_all(spark, LogFeed(log), str(tmp_path / "o"), cursor=40)
    assert read_all(spark, LogFeed(log), str(tmp_path / "p"), cursor=49) == list(range(50, 60))


def test_following_lists_again_where_the_cursor_is_lost(spark, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "root")
    seen, listed, numbers = [], [], []

    def on_batch(df, number):
        rows = [r.seq for r in df.collect()]
        if number in numbers or not rows:
            return
        numbers.append(number)
        seen.extend(rows)

    def follow(**options):
        follow_history(spark, LogFeed(log), root, on_batch, lambda number: listed.append(number), **options)

    append_changes(changes(spark, range(1, 11)), log, 1)
    follow()  # no cursor yet: the window is listed, the feed goes on from 10
    assert len(listed) == 1 and seen == []
    append_changes(changes(spark, range(11, 31)), log, 2)
    follow(per_batch=6)
    assert sorted(seen) == list(range(11, 31)) and len(listed) == 1 and numbers == sorted(numbers) and len(numbers) == 4
    for path in glob.glob(f"{log}/*.parquet"):
        os.remove(path)
    append_changes(changes(spark, range(40, 45)), log, 1)
    follow()
    assert len(listed) == 2 and 40 not in seen
    append_changes(changes(spark, range(45, 48)), log, 1)
    follow()
    assert sorted(seen) == [*range(11, 31), 45, 46, 47] and len(listed) == 2
    assert numbers == sorted(numbers) and listed[1] > numbers[3] and listed[1] < numbers[4]


def test_a_relisting_that_breaks_off_is_done_again(spark, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "root")
    append_changes(changes(spark, range(5)), log, 1)
    calls = []

    def broken(number):
        calls.append(number)
        if len(calls) == 1:
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        follow_history(spark, LogFeed(log), root, lambda df, n: None, broken)
    follow_history(spark, LogFeed(log), root, lambda df, n: None, broken)
    assert calls == [0, 0]
