"""The job that follows the feed comes to what a backfill of everything gives."""

import glob
import os

from pyspark.sql import functions as F

from offerlake.jobs import tables
from offerlake.jobs.backfill import processed_messages, run_backfill
from offerlake.jobs.sync import sync
from offerlake.jobs.tables import current
from offerlake.streaming.history import LogFeed, append_changes
from test_jobs import NOW, mails, offers
from test_whole_job import LINK, mail, model
from test_whole_job import mails as whole_mails


def states(spark, root):
    return sorted((r.message_id, r.status) for r in processed_messages(spark, root).collect() if r.status != "ignored")


def test_following_the_feed_equals_a_backfill(spark, tmp_path):
    log, root, box = str(tmp_path / "log"), str(tmp_path / "t"), str(tmp_path / "box")

    def store(ids):
        mails(spark, ids).withColumn("bucket", tables.bucket_of("message_id", 4)).write.mode("append").partitionBy("bucket").parquet(box)
        append_changes(mails(spark, ids).select(F.col("message_id").alias("seq"), "message_id", F.lit("added").alias("kind")), log, 1)

    def run():
        sync(spark, LogFeed(log), lambda: spark.read.parquet(box), root, lambda: NOW, buckets=4, per_batch=8)

    store(range(10))
    run()  # no cursor yet: the window
    store(range(10, 22))
    run()  # two batches of the feed
    for path in glob.glob(f"{log}/*.parquet"):
        os.remove(path)
    store(range(40, 43))
    run()  # the cursor is lost: the window again
    run_backfill(mails(spark, [*range(22), *range(40, 43)]), str(tmp_path / "whole"), 0, NOW)
    assert offers(spark, root) == offers(spark, str(tmp_path / "whole")) and states(spark, root) == states(spark, str(tmp_path / "whole"))
    batches = {r.batch for r in tables._commits(spark, root).filter("name = 'processed'").collect()}
    assert len(batches) == 4 and all(b % 2 == 0 for b in batches)


def test_a_message_that_waits_is_asked_again_when_due(spark, tmp_path):
    log, root, folder = str(tmp_path / "feed"), str(tmp_path / "t"), str(tmp_path)
    box = [mail(3, "busy", html=LINK)]
    change = lambda n: append_changes(spark.createDataFrame([(n, str(n), "added")], "seq long, message_id string, kind string"), log, 1)
    change(3)
    sync(spark, LogFeed(log), lambda: whole_mails(spark, box), root, lambda: NOW, model=model(folder))
    assert processed_messages(spark, root).isEmpty() and current(spark, root, "ledger").count() == 1
    box.append(mail(4, html=LINK))
    change(4)
    sync(spark, LogFeed(log), lambda: whole_mails(spark, box), root, lambda: NOW + 600_000, model=model(folder, busy=False))
    assert states(spark, root) == [(3, "candidates"), (4, "candidates")] and current(spark, root, "ledger").isEmpty()
