"""The driver's tables seen as messages and offers. The SQL runs on Spark and on DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..jobs.tables import written as written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """For work that takes long a row: over all cores where the files have fewer parts than there are; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Every document is a message; pages with its number are its HTML, with a link and a picture that carry codes.
MESSAGES = """
SELECT d.doc_id AS message_id, d.doc_id % 97 AS thread_id, d.source AS source,
  'Src ' || d.source || ' <mail@news.' || d.source || '.co.uk>' AS sender,
  'Your OFFER' || cast(d.doc_id % 30 AS string) || ' reward from ' || d.source AS subject,
  d.text || ' Use code SRC' || cast(d.doc_id % 50 AS string) || ' today' AS text,
  coalesce(p.html, '') || '<a href="https://t.example.com/c?x=1&amp;coupon=PG' || cast(d.doc_id % 40 AS string)
    || '&amp;u=https%3A%2F%2Fs.example%2Fa%3Fpromo%3DBIG' || cast(d.doc_id % 20 AS string) || '%26ref%3Dm">go</a>'
    || '<img alt="Use code ALT' || cast(d.doc_id % 25 AS string) || 'X" src="https://cdn.example/' || cast(d.doc_id % 7 AS string)
    || '.png" width="600" height="' || cast(d.doc_id % 300 AS string) || '">' AS html,
  1700000000000 + d.doc_id * 3600000 AS internal_date,
  CASE WHEN d.source = 'src3' THEN 'CATEGORY_UPDATES' ELSE 'CATEGORY_PROMOTIONS' END AS label
FROM {documents} d LEFT JOIN {pages} p ON p.page_id = d.doc_id
"""
MESSAGES_CTE = "messages AS (" + MESSAGES.replace("{documents}", "documents").replace("{pages}", "pages") + ")"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MESSAGES, documents=spread(table(spark, sf_dir, "documents")), pages=table(spark, sf_dir, "pages"))


#: Every event is a sighting of an offer: brand, code, arrival, date, and fields that are there now and then.
SIGHTINGS = """
SELECT cast(user_id AS string) AS brand_key, upper(event_type) AS normalized_code, event_id AS seq,
  cast(unix_micros(ts) / 60000000 AS bigint) AS source_date,
  CASE WHEN event_id % 11 = 0 THEN 4 ELSE 5 END AS extractor_version, event_id % 13 = 0 AS llm_processed,
  CASE WHEN event_id % 3 = 0 THEN cast(event_id % 90 AS string) || '%' END AS discount,
  CASE WHEN event_id % 4 = 0 THEN 'INR' END AS currency,
  CASE WHEN event_id % 5 = 0 THEN cast(event_id % 2000 AS double) END AS min_spend,
  CASE WHEN event_id % 3 = 1 THEN '2026-' || lpad(cast(event_id % 12 + 1 AS string), 2, '0') || '-15' END AS expiry,
  event_id % 7 = 0 AS new_users_only, event_id % 2 = 0 AS app_only,
  CASE WHEN event_id % 6 = 0 THEN 'not on sale items' ELSE '' END AS conditions,
  CASE WHEN event_id % 9 = 0 THEN 'link' WHEN event_id % 9 < 5 THEN 'text' ELSE 'ocr' END AS source,
  event_id % 5 <> 0 AS needs_review, 'c' || cast(event_id % 4 AS string) AS category, event_id AS message_id
FROM {events}
"""
SIGHTINGS_CTE = "sightings AS (" + SIGHTINGS.replace("{events}", "events").replace("unix_micros(ts) / 60000000", "epoch_us(ts) // 60000000") + ")"


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SIGHTINGS.replace("unix_micros(ts) / 60000000", "floor(unix_micros(cast(ts AS timestamp)) / 60000000)"), events=table(spark, sf_dir, "events"))
