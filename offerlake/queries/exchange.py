"""Queries on pictures, conversations and diagnostics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN, match_offsets
from ..functions.values import FURNITURE
from ..operators import candidates as C
from ..operators import conversations as V
from ..operators import diagnostics as M
from ..operators import images as K
from . import extraction as X
from .adapters import MESSAGES_CTE, SIGHTINGS_CTE, messages, sightings, spread, table, written
from .sync import _PROCESSED, _sql, _view


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code-shaped tokens of all documents as words read in two pictures a document, with made-up confidence."""
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(match_offsets(F.col("text"), TOKEN)).alias("pos", "t"))
    return rows.select(F.col("doc_id").alias("message_id"), (F.col("pos") % 2).cast("bigint").alias("image"), "pos", F.col("t.match").alias("text"), ((F.col("doc_id") * 31 + F.col("pos") * 17) % 41 + 55).cast("double").alias("confidence"))


def k2_remote_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.remote_images(messages(spark, sf_dir)).select("message_id", "url", "width", "height", "pixel_area")


def k3_select_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id")).alias("message_id"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 3 == 0, "inline").otherwise("remote").alias("source"), F.when(F.col("event_id") % 4 > 0, (F.col("value") * 100).cast("bigint")).alias("byte_size"), F.when(F.col("event_id") % 5 > 0, (F.col("value") * 70).cast("bigint")).alias("pixel_area"))
    return K.select_images(rows).select("message_id", "ord", F.col("rank").cast("bigint").alias("rank"))


def k4_usable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.usable_text(_words(spark, sf_dir), ["message_id", "image"], floor=75).select("message_id", "image", F.round("mean", 6).alias("mean"), "n_words", "text")


def k5_ocr_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.ocr_runs(K.usable_text(_words(spark, sf_dir), ["message_id", "image"], floor=75)).withColumn("mean", F.round("mean", 6))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", F.least(F.lit(255), F.floor("value")).cast("int").alias("level"))


def k7_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.otsu_threshold(_pixels(spark, sf_dir), "event_type", "level").withColumn("threshold", F.col("threshold").cast("bigint"))


def k9_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pixels(spark, sf_dir)
    return K.polarity(rows, K.otsu_threshold(rows, "event_type", "level"), "event_type", "level").withColumn("threshold", F.col("threshold").cast("bigint"))


def k8_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", K.luma(*[(n * k % 256).cast("double") for k in (3, 5, 7, 11)]).alias("luma"))


def l1_offer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = sightings(spark, sf_dir).groupBy("brand_key", "normalized_code").agg(F.max("seq").alias("seq"), F.max("discount").alias("discount"))
    return V.offer_rows(offers, ["normalized_code", "discount"], mailbox="brand_key").select("brand_key", "normalized_code", "offer_id", "json")


def l2_recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.recent_turns(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role", "text")


def l3_retain_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    more = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn("role", F.lit("assistant"))
    return V.retain_turns(turns, more, 4)


def l5_validate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 7
    said = F.when(n == 0, '{"offer_ids":["offer_1","offer_2","offer_1"]}').when(n == 1, '{"offer_ids":["offer_9"]}').when(n == 2, '{"offer_ids":["offer_3"],"note":1}').when(n == 3, '{"offer_ids":[3]}').when(n == 4, "prose").when(n == 5, '{"offer_ids":[]}').otherwise('{"offer_ids":["offer_3","offer_2"]}')
    answers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("turn_id"), F.lit(0).alias("mailbox"), said.alias("json"))
    offers = spark.range(1, 4).select(F.lit(0).alias("mailbox"), F.concat(F.lit("offer_"), F.col("id").cast("string")).alias("offer_id"), F.concat(F.lit("key"), F.col("id").cast("string")).alias("offer_key"))
    return V.validate_answers(answers, offers).select("turn_id", "valid", F.array_join("offer_keys", ",").alias("offer_keys"))


def l7_turn_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"), "role", F.array((F.col("conv_id") % 50).cast("string"), (F.col("turn") + 1000).cast("string"), (F.col("turn") % 7).cast("string")).alias("offer_keys"))
    offers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("offer_key"))
    return V.turn_cards(turns, offers).select("turn_id", F.col("pos").cast("bigint").alias("pos"), "offer_key")


def m1_stage_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stage_funnel(_view(spark, sf_dir, _PROCESSED))


def m2_gate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = messages(spark, sf_dir)
    return M.gate_rate(C.scan_gate(all_))


def m3_blocklist_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written, as the confirmed ones are candidates too
    found = written(C.find_candidates(messages(spark, sf_dir)).withColumn("brand_key", F.col("message_id") % 20))
    confirmed = found.filter(F.col("source") == "link").select("normalized")
    return M.blocklist_mining(found, confirmed, 20)


def m3_daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the blocklist query, from stored sketches of days that are merged."""
    all_ = messages(spark, sf_dir)
    found = written(C.find_candidates(all_).withColumn("brand_key", F.col("message_id") % 20))
    rest = found.join(found.filter(F.col("source") == "link").select("normalized").distinct(), "normalized", "left_anti")
    day = F.date_format(F.timestamp_millis(F.lit(1700000000000) + F.col("message_id") * 3600000), "yyyy-MM-dd")
    daily = written(M.daily_sketches(rest.withColumn("day", day)))
    codes, all_days = M.merged_sketches(daily, 20)
    return codes.crossJoin(all_days.select("brands"))  # one row


def m4_token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("provider"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.col("l_partkey").cast("bigint").alias("input_tokens"), F.col("l_suppkey").cast("bigint").alias("output_tokens"))
    rates = spark.sql("SELECT * FROM VALUES ('A', 1.0D, 5.0D), ('N', 0.25D, 1.5D) AS t(provider, input_rate, output_rate)")
    return M.token_usage(calls, rates).withColumn("cost", F.round("cost", 9))


def m5_review_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.review_share(sightings(spark, sf_dir)).select("brand_key", "n", F.round("ocr_share", 9).alias("ocr_share"), F.round("review_share", 9).alias("review_share"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (k2_remote_images, k3_select_images, k4_usable_text, k5_ocr_runs, k7_otsu, k8_luma, k9_polarity, l1_offer_rows, l2_recent_turns, l3_retain_turns, l5_validate_answers, l7_turn_cards, m1_stage_funnel, m2_gate_rate, m3_blocklist_mining, m3_daily_sketches, m4_token_usage, m5_review_share)}

_TOK = r"'\b[A-Za-z0-9][A-Za-z0-9_-]{3,19}\b'"
_READ = f"""w AS (SELECT doc_id AS message_id, unnest(regexp_extract_all(text, {_TOK})) AS text, unnest(range(0, len(regexp_extract_all(text, {_TOK})))) AS pos FROM documents),
  c AS (SELECT *, pos % 2 AS image, CAST((message_id * 31 + pos * 17) % 41 + 55 AS DOUBLE) AS confidence FROM w),
  i AS (SELECT message_id, image, avg(confidence) AS mean, count(*) AS n_words, CASE WHEN avg(confidence) < 75 THEN '' ELSE coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE confidence >= CASE WHEN regexp_matches(upper(text), '[O0I1S5B8]') THEN 85 ELSE 70 END), '') END AS text FROM c GROUP BY message_id, image)"""
_OTSU = """p AS (SELECT event_type, CAST(least(255, floor(value)) AS INTEGER) AS level FROM events), h AS (SELECT event_type, level, count(*) AS n FROM p GROUP BY ALL),
  s AS (SELECT event_type, level, sum(n) OVER a AS w, sum(n * level) OVER a AS s, sum(n) OVER b AS wt, sum(n * level) OVER b AS st FROM h WINDOW a AS (PARTITION BY event_type ORDER BY level), b AS (PARTITION BY event_type)),
  v AS (SELECT event_type, level, CASE WHEN w < wt THEN CAST(w AS DOUBLE) * CAST(wt - w AS DOUBLE) * power(CAST(s AS DOUBLE) / w - CAST(st - s AS DOUBLE) / (wt - w), 2) ELSE 0 END AS x FROM s),
  t AS (SELECT event_type, CASE WHEN max(x) > 0 THEN CAST(arg_max(level, (x, -level)) AS BIGINT) ELSE 0 END AS threshold FROM v GROUP BY event_type)"""
_OVER = "round_even({c} * ({a} / 255) + 255.0 * (1 - {a} / 255), 0)"
_CHANNELS = [_OVER.format(c=f"CAST(event_id * {k} % 256 AS DOUBLE)", a="CAST(event_id * 11 % 256 AS DOUBLE)") for k in (3, 5, 7)]
_ALL = f"WITH {MESSAGES_CTE}, {X._STRIPPED}, {X._SURFACES}, {X._TOKENS}, {X._ENDS}, {X._JUDGED}, {X._LINKS}, {X._BEST}"
_FURNITURE = FURNITURE.replace("'", "''")
ORACLE_SQL = {
    "k2_remote_images": f"WITH {MESSAGES_CTE}, {X._STRIPPED}, t AS (SELECT message_id, " + ", ".join(f"unnest({X._values('s', 'img', k)}) AS {k}" for k in ("src", "alt", "width", "height")) + f" FROM stripped) SELECT message_id, src AS url, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, CAST(width AS BIGINT) * CAST(height AS BIGINT) AS pixel_area FROM t WHERE src LIKE 'http%' AND NOT regexp_matches(src || ' ' || alt, '{_FURNITURE}') AND CAST(width AS BIGINT) >= 200 AND CAST(height AS BIGINT) >= 100",
    "k3_select_images": "WITH i AS (SELECT user_id AS message_id, event_id AS ord, event_id % 3 = 0 AS inl, CASE WHEN event_id % 4 > 0 THEN CAST(trunc(value * 100) AS BIGINT) END AS b, CASE WHEN event_id % 5 > 0 THEN CAST(trunc(value * 70) AS BIGINT) END AS p FROM events), r AS (SELECT message_id, ord, row_number() OVER (PARTITION BY message_id ORDER BY inl DESC, coalesce(CASE WHEN inl THEN b ELSE p END, -1) DESC, ord) AS rank FROM i) SELECT * FROM r WHERE rank <= 25",
    "k4_usable_text": f"WITH {_READ} SELECT message_id, image, round(mean, 6) AS mean, n_words, text FROM i",
    "k5_ocr_runs": f"WITH {_READ} SELECT message_id, count(*) AS n_read, count(*) FILTER (WHERE text <> '') AS n_accepted, round(avg(mean), 6) AS mean, coalesce(string_agg(text, ' ' ORDER BY image) FILTER (WHERE text <> ''), '') AS text FROM i GROUP BY message_id",
    "k7_otsu": f"WITH {_OTSU} SELECT event_type, threshold FROM t",
    "k8_luma": f"SELECT event_id, CAST(round_even({_CHANNELS[0]} * 0.299::DOUBLE + {_CHANNELS[1]} * 0.587::DOUBLE + {_CHANNELS[2]} * 0.114::DOUBLE, 0) AS BIGINT) AS luma FROM events",
    "k9_polarity": f"WITH {_OTSU} SELECT event_type, threshold, count(*) FILTER (WHERE level <= threshold) * 2 > count(*) AS light_on_dark FROM p JOIN t USING (event_type) GROUP BY event_type, threshold",
    "l1_offer_rows": f"""WITH {SIGHTINGS_CTE}, o AS (SELECT brand_key, normalized_code, max(discount) AS discount FROM sightings GROUP BY ALL), n AS (SELECT *, 'offer_' || row_number() OVER (PARTITION BY brand_key ORDER BY normalized_code) AS offer_id FROM o) SELECT brand_key, normalized_code, offer_id, '{{"offer_id":"' || offer_id || '","normalized_code":"' || normalized_code || '"' || CASE WHEN discount IS NULL THEN '' ELSE ',"discount":"' || discount || '"' END || '}}' AS json FROM n""",
    "l2_recent_turns": "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "l3_retain_turns": "WITH a AS (SELECT conv_id, turn, role FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'assistant' FROM conversations GROUP BY conv_id) SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4",
    "l5_validate_answers": "SELECT o_orderkey AS turn_id, o_orderkey % 7 IN (0, 5, 6) AS valid, CASE o_orderkey % 7 WHEN 0 THEN 'key1,key2' WHEN 6 THEN 'key3,key2' ELSE '' END AS offer_keys FROM orders",
    "l7_turn_cards": "WITH t AS (SELECT conv_id * 100 + turn AS turn_id, unnest([conv_id % 50, turn + 1000, turn % 7]) AS k, unnest([0, 1, 2]) AS pos FROM conversations WHERE role = 'assistant') SELECT turn_id, CAST(pos AS BIGINT) AS pos, CAST(k AS VARCHAR) AS offer_key FROM t JOIN customer ON c_custkey = k",
    "m1_stage_funnel": f"SELECT coalesce(status, 'all') AS status, count(*) AS n, count(*) FILTER (WHERE n_candidates > 0) AS with_code, count(*) FILTER (WHERE llm_processed) AS enriched FROM ({_sql(_PROCESSED)}) GROUP BY ROLLUP (status)",
    "m2_gate_rate": f"{_ALL}, g AS (SELECT message_id, message_id IN (SELECT mid FROM best) OR message_id IN (SELECT mid FROM ends) AS x FROM messages) SELECT count(*) AS n, avg(CASE WHEN x THEN 1.0 ELSE 0.0 END) AS share, avg(CASE WHEN x THEN 1.0 ELSE 0.0 END) > 0.4 AS too_permissive FROM g",
    "m3_blocklist_mining": f"{_ALL} SELECT normalized, count(*) AS n, count(DISTINCT mid % 20) AS brands FROM best WHERE normalized NOT IN (SELECT normalized FROM best WHERE src = 'link') GROUP BY normalized ORDER BY n DESC, normalized LIMIT 20",
    "m3_daily_sketches": f"{_ALL}, r AS (SELECT normalized, mid FROM best WHERE normalized NOT IN (SELECT normalized FROM best WHERE src = 'link')) SELECT normalized, count(*) AS n, (SELECT count(DISTINCT mid % 20) FROM r) AS brands FROM r GROUP BY normalized ORDER BY n DESC, normalized LIMIT 20",
    "m4_token_usage": "WITH s AS (SELECT l_returnflag AS provider, strftime(l_shipdate, '%Y-%m-%d') AS day, CAST(sum(l_partkey) AS BIGINT) AS input_tokens, CAST(sum(l_suppkey) AS BIGINT) AS output_tokens FROM lineitem GROUP BY ALL) SELECT *, round((input_tokens * CAST(CASE provider WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.25 END AS DOUBLE) + output_tokens * CAST(CASE provider WHEN 'A' THEN 5.0 WHEN 'N' THEN 1.5 END AS DOUBLE)) / 1e6, 9) AS cost FROM s",
    "m5_review_share": f"WITH {SIGHTINGS_CTE} SELECT brand_key, count(*) AS n, round(avg(CASE WHEN source = 'ocr' THEN 1.0 ELSE 0.0 END), 9) AS ocr_share, round(avg(CASE WHEN needs_review THEN 1.0 ELSE 0.0 END), 9) AS review_share FROM sightings GROUP BY brand_key",
}
