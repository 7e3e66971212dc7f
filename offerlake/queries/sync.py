"""Queries on incremental work."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jobs.tables import shared_dir
from ..operators import sync as S
from ..streaming.history import LogFeed, append_changes, history, planned_offset
from ..streaming.incremental import discover, event_feed
from ..streaming.retries import LEDGER, OUTCOMES, run_retries
from .adapters import MESSAGES_CTE, messages, table

NOW = 1_704_000_000_000
_PROCESSED = """SELECT event_id AS message_id, CASE WHEN event_id % 11 = 0 THEN 4 ELSE 5 END AS extractor_version,
  CASE event_id % 4 WHEN 0 THEN 'candidates' WHEN 1 THEN 'no-code' WHEN 2 THEN 'failed' ELSE 'ignored' END AS status,
  event_id % 3 = 0 AS llm_processed, event_id % 5 AS n_candidates FROM {events}"""
_FAILURES = """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 408 WHEN 4 THEN 404 WHEN 5 THEN 400 WHEN 6 THEN 400 WHEN 7 THEN 503 ELSE 422 END AS status,
  CASE event_id % 9 WHEN 5 THEN 'unknown Model x' WHEN 6 THEN 'remodel' ELSE props END AS body, event_id % 6 + 1 AS attempt,
  CASE event_id % 2 WHEN 0 THEN 'user_rate-limitExceeded' ELSE 'forbidden' END AS reason FROM {events}"""
_LEDGER = "SELECT user_id AS message_id, cast(count(*) % 5 AS int) AS attempts, cast(max(event_id) AS bigint) AS next_at, count(*) % 7 = 0 AS terminal FROM {events} GROUP BY user_id"
_OUTCOMES = """SELECT user_id + 40 AS message_id, CASE user_id % 6 WHEN 0 THEN 'network' WHEN 1 THEN 'schema' WHEN 2 THEN 'rate-limit' WHEN 3 THEN 'server' WHEN 4 THEN 'refusal' END AS error,
  CASE WHEN user_id % 4 = 0 THEN 90000 END AS retry_after_ms, 0.75 + cast(user_id % 3 AS double) * 0.25 AS jitter FROM {events} GROUP BY user_id"""

_STREAM = """SELECT event_id AS seq, cast(user_id AS string) AS message_id, 1700000000000 + event_id * 1000 AS at,
  CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'network' WHEN 2 THEN 'rate-limit' WHEN 3 THEN 'schema' WHEN 4 THEN 'server' WHEN 5 THEN NULL ELSE 'server' END AS error,
  CASE WHEN event_id % 4 = 0 THEN 90000 END AS retry_after_ms, 0.75 + cast(event_id % 3 AS double) * 0.25 AS jitter FROM {events}"""


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, events=table(spark, sf_dir, "events"))


def _sql(sql: str) -> str:
    return sql.replace("{events}", "events")


def a2_list_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.list_window(messages(spark, sf_dir), NOW, 45).select("message_id", "internal_date")


def a3_feed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = table(spark, sf_dir, "events").select(F.array(F.col("user_id").cast("string"), F.lit(None).cast("string")).alias("messages_added"), F.when(F.col("event_id") % 2 == 0, F.array((F.col("user_id") + 7).cast("string"))).alias("labels_added"))
    return S.feed_ids(feed)


def a3_read_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of changes, read through the streaming source in two runs: the second starts from the first one's offsets."""
    root = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("message_id"), F.col("event_type").alias("kind"))
    append_changes(log, f"{root}/log")
    feed = LogFeed(f"{root}/log")
    oldest, newest = feed.bounds()
    for options in ({"per_batch": (newest - oldest) // 2 + 1}, {}) if newest is not None else ({},):
        resume = planned_offset(spark, f"{root}/state")
        found = history(spark, feed, **options, **({} if resume is None else {"resume": resume}))
        found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("seq bigint, message_id string, kind string").parquet(f"{root}/out")


def j1_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("message_id"))
    return S.pending_messages(listed, _view(spark, sf_dir, _PROCESSED), model=True)


def j2_take_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.take_slice(messages(spark, sf_dir), 15).select("message_id", "internal_date")


def j3_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", S.processed_status(n % 5 == 0, n % 3 == 0, n % 7 == 0, n % 11 == 0).alias("status"))


def j4_discover_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids of the events as a stream, run until it is used up."""
    schema = table(spark, sf_dir, "events").schema.simpleString()[7:-1].replace(":", " ")
    root = f"{shared_dir(spark)}/discover-{uuid.uuid4().hex}"
    found = discover(event_feed(spark, sf_dir, schema)).select("message_id")
    found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


def i5_classify_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = S.classify_error(F.col("status"), F.col("body"))
    return _view(spark, sf_dir, _FAILURES).select("event_id", kind.alias("kind"), S.is_retryable(kind).alias("retryable"))


def j9_route_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _view(spark, sf_dir, _FAILURES)
    model, mail = F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1
    kind = F.when(model, S.classify_error(F.col("status"), F.col("body"))).otherwise("none")
    return rows.select("event_id", S.route_failure(kind, F.when(mail, F.col("status")).otherwise(0)).alias("route"))


def j10_batch_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _FAILURES).select("event_id", S.batch_retry_delay(F.col("attempt"), F.col("status"), F.col("reason")).alias("delay_ms"))


def j8_retry_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.update_ledger(_view(spark, sf_dir, _LEDGER), _view(spark, sf_dir, _OUTCOMES), NOW).withColumn("attempts", F.col("attempts").cast("bigint"))


def j8_stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger that a stream of outcomes leaves, read in two batches by two queries that share their state."""
    root = f"{shared_dir(spark)}/retries-{uuid.uuid4().hex}"
    # each batch reads half of the files
    append_changes(_view(spark, sf_dir, _STREAM), f"{root}/log", 2 * spark.sparkContext.defaultParallelism, OUTCOMES)
    feed = LogFeed(f"{root}/log", OUTCOMES)
    oldest, newest = feed.bounds()

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    for options in ({"per_batch": (newest - oldest) // 2 + 1}, {}) if newest is not None else ({},):
        resume = planned_offset(spark, f"{root}/state")
        outcomes = history(spark, feed, **options, **({} if resume is None else {"resume": resume}))
        run_retries(outcomes, keep, f"{root}/state", watermark="10 years").awaitTermination()
    rows = spark.read.schema(LEDGER).parquet(f"{root}/out").filter("event <> 'due'")
    last = rows.groupBy("message_id").agg(F.max_by(F.struct("attempts", "next_at", "terminal", "event"), "seq").alias("l")).select("message_id", "l.*")
    return last.filter("event <> 'cleared'").select("message_id", F.col("attempts").cast("bigint").alias("attempts"), "next_at", "terminal")


def j11_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("message_id"))
    return S.progress(_view(spark, sf_dir, _PROCESSED), _view(spark, sf_dir, _LEDGER), listed)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (a2_list_window, a3_feed_ids, a3_read_history, i5_classify_error, j1_pending, j2_take_slice, j3_status, j4_discover_stream, j8_retry_ledger, j8_stream_ledger, j9_route_failure, j10_batch_delay, j11_progress)}
_KIND = "CASE WHEN status IN (401, 403) THEN 'auth' WHEN status = 429 THEN 'rate-limit' WHEN status = 408 THEN 'network' WHEN status = 404 OR (status = 400 AND regexp_matches(body, '(?i)\\b(model|unsupported parameter)\\b')) THEN 'model' WHEN status >= 500 THEN 'server' ELSE 'schema' END"
_DONE = f"o_orderkey IN (SELECT message_id FROM ({_sql(_PROCESSED)}) WHERE extractor_version = 5)"
ORACLE_SQL = {
    "a2_list_window": f"WITH {MESSAGES_CTE} SELECT message_id, internal_date FROM messages WHERE label = 'CATEGORY_PROMOTIONS' AND internal_date >= {NOW - 45 * 86_400_000}",
    "a3_feed_ids": "SELECT DISTINCT message_id FROM (SELECT CAST(user_id AS VARCHAR) AS message_id FROM events UNION ALL SELECT CAST(user_id + 7 AS VARCHAR) FROM events WHERE event_id % 2 = 0)",
    "a3_read_history": "SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS message_id, event_type AS kind FROM events",
    "i5_classify_error": f"SELECT event_id, {_KIND} AS kind, {_KIND} IN ('rate-limit', 'network', 'server') AS retryable FROM ({_sql(_FAILURES)})",
    "j1_pending": f"SELECT o_orderkey AS message_id FROM orders WHERE o_orderkey NOT IN (SELECT message_id FROM ({_sql(_PROCESSED)}) WHERE extractor_version = 5 AND NOT (status = 'candidates' AND NOT llm_processed))",
    "j2_take_slice": f"WITH {MESSAGES_CTE} SELECT message_id, internal_date FROM messages ORDER BY internal_date DESC, message_id LIMIT 15",
    "j3_status": "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 5 = 0 THEN 'ignored' WHEN event_id % 3 = 0 OR event_id % 7 = 0 THEN 'candidates' ELSE 'no-code' END AS status FROM events",
    "j4_discover_stream": "SELECT DISTINCT user_id AS message_id FROM events",
    "j8_retry_ledger": f"""WITH l AS ({_sql(_LEDGER)}), o AS ({_sql(_OUTCOMES)}), b AS (SELECT coalesce(l.message_id, o.message_id) AS message_id, l.attempts AS a, l.next_at AS na, l.terminal AS t, o.message_id IS NOT NULL AS seen, o.error, o.retry_after_ms AS ra, o.jitter AS j, coalesce(l.attempts, 0) + 1 AS n FROM l FULL JOIN o ON l.message_id = o.message_id)
      SELECT message_id, CAST(CASE WHEN seen THEN n ELSE a END AS BIGINT) AS attempts, CASE WHEN seen THEN CASE WHEN error IN ('rate-limit', 'network', 'server') AND n <= 4 THEN {NOW} + CAST(floor(greatest(30000 * pow(2, n - 1) * j, coalesce(ra, 0))) AS BIGINT) END ELSE na END AS next_at,
      CASE WHEN seen THEN NOT (error IN ('rate-limit', 'network', 'server') AND n <= 4) ELSE t END AS terminal FROM b WHERE NOT seen OR error IS NOT NULL""",
    "j8_stream_ledger": f"""WITH o AS ({_sql(_STREAM)}), s AS (SELECT message_id, max(seq) FILTER (WHERE error IS NULL) AS good, max(seq) AS last_ FROM o GROUP BY message_id),
      n AS (SELECT o.message_id, count(*) AS attempts, arg_max(error, seq) AS error, arg_max(coalesce(retry_after_ms, 0), seq) AS ra, arg_max(jitter, seq) AS j, arg_max("at", seq) AS "at" FROM o JOIN s ON o.message_id = s.message_id AND (good IS NULL OR seq > good) GROUP BY o.message_id),
      t AS (SELECT *, error NOT IN ('network', 'rate-limit', 'server') OR attempts > 4 AS terminal FROM n)
      SELECT message_id, attempts, CASE WHEN NOT terminal THEN "at" + CAST(floor(greatest(30000 * pow(2, attempts - 1) * j, ra)) AS BIGINT) END AS next_at, terminal FROM t""",
    "j9_route_failure": f"WITH f AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN {_KIND} ELSE 'none' END AS k, CASE WHEN event_id % 2 = 1 THEN status ELSE 0 END AS m FROM ({_sql(_FAILURES)})) SELECT event_id, CASE WHEN k IN ('auth', 'model') OR m IN (400, 401, 403, 422) THEN 'abort' WHEN k IN ('rate-limit', 'network', 'server') OR m IN (408, 429) OR m >= 500 THEN 'retry' ELSE 'terminal' END AS route FROM f",
    "j10_batch_delay": f"SELECT event_id, CASE WHEN status IN (408, 429) OR status >= 500 OR (status = 403 AND reason LIKE 'user%') THEN CAST(least(30000 * pow(2, attempt - 1), 900000) AS BIGINT) END AS delay_ms FROM ({_sql(_FAILURES)})",
    "j11_progress": f"SELECT (SELECT count(*) FROM ({_sql(_PROCESSED)})) AS processed, (SELECT count(*) FROM ({_sql(_PROCESSED)}) WHERE status = 'candidates') AS with_candidates, (SELECT count(*) FROM ({_sql(_PROCESSED)}) WHERE status = 'failed') AS failed, (SELECT count(*) FROM ({_sql(_LEDGER)}) WHERE NOT terminal) AS waiting, (SELECT min(next_at) FROM ({_sql(_LEDGER)}) WHERE NOT terminal) AS next_at, (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders WHERE {_DONE}) AS skipped, (SELECT count(*) FROM orders WHERE NOT {_DONE}) AS remaining",
}
