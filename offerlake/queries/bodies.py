"""Queries on message parts and answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.conversations import answer_text
from ..sources.messages import charset_of, decode_base64url, text_kind
from .adapters import table

_TYPES = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'text/html; charset="UTF-8"' WHEN 1 THEN 'Text/Plain; CHARSET=iso-8859-1; x=y' WHEN 2 THEN 'text/html; charset = ''utf-16''' WHEN 3 THEN 'image/png' ELSE 'text/plain' END AS said FROM {documents}"""


def b3_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charset and kind of content types (B3 and B5)."""
    rows = spark.sql(_TYPES, documents=table(spark, sf_dir, "documents"))
    return rows.select("doc_id", charset_of(F.col("said")).alias("charset"), text_kind(F.col("said")).alias("kind"))


def b6_decode_base64url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text through unpadded base64url and back."""
    data = F.regexp_replace(F.translate(F.base64(F.encode("text", "utf-8")), "+/", "-_"), r"[=\s]", "")
    return table(spark, sf_dir, "documents").select("doc_id", decode_base64url(data, F.lit("utf-8")).alias("text"))


def l6_answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", answer_text(F.col("user_id") % 4, F.col("event_id") % 2 == 0).alias("said"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (b3_charset, b6_decode_base64url, l6_answer_text)}
ORACLE_SQL = {
    "b3_charset": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'iso-8859-1' WHEN 2 THEN 'utf-16' ELSE 'utf-8' END AS charset, CASE doc_id % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'text' WHEN 2 THEN 'html' WHEN 4 THEN 'text' END AS kind FROM documents",
    "b6_decode_base64url": "SELECT doc_id, text FROM documents",
    "l6_answer_text": "SELECT event_id, CASE user_id % 4 WHEN 1 THEN 'I found one matching coupon.' WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN 'I could not find a matching active coupon.' ELSE 'I have not found a matching coupon yet. More promotional emails are still being checked.' END ELSE 'I found ' || user_id % 4 || ' matching coupons.' END AS said FROM events",
}
