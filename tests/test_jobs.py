"""Backfill and the incremental job come to the same tables, and a replay changes nothing."""

from pyspark.sql import functions as F

import pytest

from offerlake.jobs import backfill, tables
from offerlake.jobs.backfill import catch_up, processed_messages, run_backfill
from offerlake.jobs.tables import commit_batch, current
from offerlake.operators.sync import update_ledger
from offerlake.streaming.incremental import discover, run_incremental

NOW = 1_700_000_000_000
SCHEMA = "message_id long, thread_id long, label string, sender string, subject string, text string, html string, internal_date long"


def mails(spark, ids):
    rows = [(i, i, "CATEGORY_PROMOTIONS" if i % 5 else "OTHER", f"Shop <a@mail.shop{i % 3}.co.uk>", "News", "enter code SPOON64 now", f'<a href="https://s.example/?coupon=CODE{i % 4}X">x</a>', NOW - i * 1000) for i in ids]
    return spark.createDataFrame(rows, SCHEMA)


def offers(spark, root):
    ids = current(spark, root, "sources").groupBy("brand_key", "normalized_code").agg(F.sort_array(F.collect_list("message_id")).alias("ids"))
    return sorted((r.brand_key, r.normalized_code, tuple(r.ids)) for r in current(spark, root, "offers").join(ids, ["brand_key", "normalized_code"]).collect())


def test_backfill_in_steps_and_again(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    run_backfill(mails(spark, range(30)), one, 0, NOW)
    run_backfill(mails(spark, range(12)), two, 0, NOW)
    run_backfill(mails(spark, range(30)), two, 1, NOW)
    assert offers(spark, one) == offers(spark, two) and processed_messages(spark, two).count() == 24
    run_backfill(mails(spark, range(30)), two, 2, NOW)
    assert offers(spark, one) == offers(spark, two)


def test_incremental_equals_backfill(spark, tmp_path):
    feed = spark.createDataFrame([(i % 20,) for i in range(40)], "message_id long")
    feed.repartition(2).write.parquet(str(tmp_path / "feed"))
    root = str(tmp_path / "tables")
    mails(spark, range(30)).withColumn("bucket", tables.bucket_of("message_id", 8)).write.partitionBy("bucket").parquet(str(tmp_path / "bodies"))
    bodies = spark.read.parquet(str(tmp_path / "bodies"))

    def processed():
        done = processed_messages(spark, root)
        return spark.createDataFrame([], "message_id long, extractor_version int, status string, llm_processed boolean") if done is None else done

    stream = discover(spark.readStream.schema("message_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed")))
    run_incremental(stream, bodies, processed, lambda df, n: run_backfill(df, root, n, NOW), str(tmp_path / "state"), 5, buckets=8).awaitTermination()
    run_backfill(mails(spark, range(20)), str(tmp_path / "whole"), 0, NOW)
    assert offers(spark, root) == offers(spark, str(tmp_path / "whole"))


def test_a_batch_that_breaks_off_or_runs_again_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    run_backfill(mails(spark, range(12)), root, 0, NOW)
    before = offers(spark, root)

    def broken(appended, replaced, root_, batch_id):
        for df in appended.values():
            df.write.parquet(f"{root_}/batch-{batch_id}-half/processed")
        raise RuntimeError("lost")

    monkeypatch.setattr(backfill, "commit_batch", broken)
    with pytest.raises(RuntimeError):
        run_backfill(mails(spark, range(30)), root, 1, NOW)
    assert offers(spark, root) == before and processed_messages(spark, root).count() == 9
    monkeypatch.setattr(backfill, "commit_batch", commit_batch)
    run_backfill(mails(spark, range(30)), root, 1, NOW)
    after = offers(spark, root)
    # the same number again, with other messages: it is committed already
    run_backfill(mails(spark, range(300, 330)), root, 1, NOW)
    assert offers(spark, root) == after != before and processed_messages(spark, root).count() == 24


def test_a_batch_rewrites_only_the_buckets_of_its_brands(spark, tmp_path):
    root = str(tmp_path / "t")
    run_backfill(mails(spark, range(30)), root, 0, NOW)
    run_backfill(mails(spark, [33]), root, 1, NOW, complete=False)
    rewritten = tables._commits(spark, root).filter("batch = 1 and name = 'offers'").count()
    assert rewritten == 1 and len(offers(spark, root)) == len({(i % 3, i % 4) for i in range(30) if i % 5})


def test_expired_cursor_lists_the_window_again(spark, tmp_path):
    changes = lambda ids: spark.createDataFrame([(i, i) for i in ids], "seq long, message_id long")
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    for root, second in ((one, range(10, 40)), (two, range(25, 40))):
        assert catch_up(changes(range(15)), mails(spark, range(15)), root, 0, None, NOW) == 14
        # in the second case the feed has lost 15 to 24: only listing finds them
        assert catch_up(changes(second), mails(spark, range(40)), root, 1, 14, NOW) == 39
    done = lambda root: sorted((r.message_id, r.status) for r in processed_messages(spark, root).collect() if r.status != "ignored")
    assert offers(spark, one) == offers(spark, two) and done(one) == done(two)
    # by its id, a message without the label is found and ignored
    assert {r.message_id for r in processed_messages(spark, one).filter("status = 'ignored'").collect()} == {15, 20, 25, 30, 35}


def test_a_new_version_keeps_old_offers_until_its_scan_is_complete(spark, tmp_path):
    root = str(tmp_path / "t")
    run_backfill(mails(spark, range(30)), root, 0, NOW, version=4)
    versions = lambda: sorted(r.extractor_version for r in current(spark, root, "offers").collect())
    n = len(versions())
    run_backfill(mails(spark, [1, 2]), root, 1, NOW, complete=False)
    assert versions() == [4] * (n - 2) + [5] * 2
    run_backfill(mails(spark, [1, 2, 3]), root, 2, NOW)
    assert versions() == [5] * 3
    assert {r.llm_processed for r in processed_messages(spark, root).collect()} == {False}


def test_ledger(spark):
    ledger = spark.createDataFrame([("a", 1, 5, False), ("b", 4, 6, False), ("c", 2, 7, False)], "message_id string, attempts int, next_at long, terminal boolean")
    outcomes = spark.createDataFrame([("a", "network", 90_000, 1.0), ("b", "server", None, 1.0), ("c", None, None, 1.0), ("d", "schema", None, 1.0)], "message_id string, error string, retry_after_ms long, jitter double")
    got = {r.message_id: (r.attempts, r.next_at, r.terminal) for r in update_ledger(ledger, outcomes, 1000).collect()}
    assert got == {"a": (2, 91_000, False), "b": (5, None, True), "d": (1, None, True)}
    assert update_ledger(ledger, outcomes.limit(0), 1000).filter(F.col("terminal")).count() == 0
