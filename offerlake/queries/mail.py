"""Queries on whole messages as JSON: parts, bodies, pictures, responses of models, jobs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jobs.backfill import Model, catch_up, processed_messages, run_backfill
from ..jobs.tables import current, shared_dir
from ..operators import brand as B
from ..operators import candidates as C
from ..operators import conversations as V
from ..operators import enrichment as E
from ..operators import images as K
from ..operators import offers as O
from ..operators import sync as S
from ..sources import messages as R
from . import exchange as P
from . import offers as Q
from .adapters import MESSAGES_CTE, SIGHTINGS_CTE, messages, sightings, spread, table

NOW = 1_704_000_000_000


def _base64url(text: Column) -> Column:
    out = F.base64(F.encode(text, "utf-8"))
    # plain replacements, which take a tenth of what a translation by characters or a pattern does
    for said, instead in (("\r\n", ""), ("=", ""), ("+", "-"), ("/", "_")):
        out = F.replace(out, F.lit(said), F.lit(instead))
    return out


def _body(text: Column) -> Column:
    """A text as the data of a part; one that begins with U+FEFF has it twice there, as readers take the first for a mark of the encoding."""
    return _base64url(F.concat(F.when(F.startswith(text, F.lit("\ufeff")), F.lit("\ufeff")).otherwise(F.lit("")), text))


def _html(text: Column) -> Column:
    return F.concat(F.lit("<p>"), text, F.lit("</p>"))


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a message: text and HTML, every third one's HTML kept elsewhere, a picture, an attached message
    with a picture and a text of its own."""
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    head = lambda **h: F.array(*[F.struct(F.lit(k.replace("_", "-")).alias("name"), (v if isinstance(v, Column) else F.lit(v)).alias("value")) for k, v in h.items()])

    def part(mime: str, name: Column | str = "", headers: Column | None = None, data: Column | None = None, kept: Column | None = None, size: Column | None = None, parts: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        body = F.struct((none if kept is None else kept).alias("attachmentId"), (F.lit(None).cast("bigint") if size is None else size.cast("bigint")).alias("size"), (none if data is None else data).alias("data"))
        fields = [F.lit(mime).alias("mimeType"), (name if isinstance(name, Column) else F.lit(name)).alias("filename"), (head() if headers is None else headers).alias("headers"), body.alias("body")]
        return F.struct(*fields, *([] if parts is None else [parts.alias("parts")]))

    # arrays of parts that differ in depth are put together as JSON text
    listed = lambda *ps: F.concat(F.lit("["), F.concat_ws(",", *ps), F.lit("]"))
    js = lambda p: F.to_json(p)
    nest = lambda p, parts: F.concat(F.substring(js(p), F.lit(1), F.length(js(p)) - 1), F.lit(',"parts":'), parts, F.lit("}"))
    plain = part("text/plain", headers=head(content_type='text/plain; charset="UTF-8"'), data=_body(text))
    there = n % 3 != 0
    rich = part("text/html", headers=head(Content_Type="text/html; charset=utf-8"), data=F.when(there, _base64url(_html(text))), kept=F.when(~there, F.concat(F.lit("att-"), n.cast("string"))), size=F.length(text))
    picture = part("Image/PNG", name=F.concat(F.when(n % 4 == 0, "Logo").otherwise("banner"), F.lit(".png")), kept=F.lit("pic"), size=F.when(n % 5 > 0, F.col("n_chars") * 9))
    inner = listed(js(part("text/plain", data=_base64url(F.lit("enter code BOWL13 by noon")))), js(part("image/gif", name="shot.gif", data=_base64url(text), size=F.col("n_chars") * 5)))
    forwarded = nest(part("message/rfc822", name=F.when(n % 2 == 0, "mail.eml").otherwise(""), headers=F.when(n % 2 == 1, head(content_disposition="Attachment; x=1")).otherwise(head())), inner)
    top = part("multipart/mixed", headers=head(SUBJECT=F.concat(F.lit("News "), n.cast("string")), From=F.concat(F.lit("Shop <a@Mail.src"), (n % 9).cast("string"), F.lit(".co.uk>"))))
    payload = nest(top, listed(nest(part("multipart/alternative"), listed(js(plain), js(rich))), js(picture), forwarded))
    internal = F.when(n % 7 > 0, (n * 1000).cast("string"))
    return spread(table(spark, sf_dir, "documents")).select(n.cast("string").alias("id"), F.concat(F.lit("t"), (n % 97).cast("string")).alias("threadId"), internal.alias("internalDate"), F.array(F.lit("CATEGORY_PROMOTIONS")).alias("labelIds"), payload.alias("payload"))


def _attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies kept elsewhere; of every ninth message the body is missing."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").filter((n % 3 == 0) & (n % 9 != 0)).select(n.cast("string").alias("message_id"), F.concat(F.lit("att-"), n.cast("string")).alias("attachment_id"), _base64url(_html(F.coalesce("text", F.lit("")))).alias("data"))


def a1_read_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written as compressed JSON lines, payload and all, and read again.

    Such files are read whole, so they are kept small.
    """
    root = f"{shared_dir(spark)}/messages-{uuid.uuid4().hex}"
    raw_messages(spark, sf_dir).select(F.concat(F.substring(F.to_json(F.struct("id", "threadId", "internalDate", "labelIds")), 1, 1_000_000), F.lit("")).alias("head"), "payload").select(F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"payload":'), "payload", F.lit("}")).alias("value")).write.option("maxRecordsPerFile", 10_000).text(root, compression="lz4")
    return _parsed(R.parse_messages(R.read_messages(spark, root), _attachments(spark, sf_dir)))


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.select("message_id", "thread_id", "internal_date", F.array_join("labels", ",").alias("labels"), "subject", "sender", "sender_domain", "text", "html", "failed")


def b1_deep_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a message whose text lies under 1 to 40 levels of parts: how many parts it has, how deep they go, and the text."""
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    levels = (n % 40 + 1).cast("int")
    leaf = F.to_json(F.struct(F.lit("text/plain").alias("mimeType"), F.struct(_body(text).alias("data")).alias("body")))
    payload = F.concat(F.expr("repeat('{\"mimeType\":\"multipart/mixed\",\"parts\":[', cast(doc_id % 40 + 1 AS int))"), leaf, F.repeat(F.lit("]}"), levels))
    rows = table(spark, sf_dir, "documents").select(n.cast("string").alias("id"), payload.alias("payload"))
    parts = R.message_parts(rows)
    counts = parts.groupBy("message_id").agg(F.count(F.lit(1)).alias("n_parts"), F.max((F.length("path") - 1) / 5).cast("bigint").alias("depth"))
    # a message whose text is empty has no surfaces
    found = counts.join(R.message_surfaces(parts), "message_id", "left")
    return found.select("message_id", "n_parts", "depth", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("failed", F.lit(False)).alias("failed"))


def b1_message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.message_parts(raw_messages(spark, sf_dir)).select("message_id", "path", "mime_type", "filename", "in_attachment")


def b2_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = R.message_parts(raw_messages(spark, sf_dir))
    return parts.select("message_id", "path", R.header(F.col("headers"), "Content-Type").alias("content_type"), R.header(F.col("headers"), "subject").alias("subject"))


def b4_is_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = R.message_parts(raw_messages(spark, sf_dir))
    return parts.select("message_id", "path", R.is_attachment(F.col("filename"), F.col("headers")).alias("attached"))


def b7_message_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies at hand only: those kept elsewhere are left out and no failure."""
    return R.message_surfaces(R.message_parts(raw_messages(spark, sf_dir)))


def a4_hydrate_external_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.message_surfaces(R.message_parts(raw_messages(spark, sf_dir)), _attachments(spark, sf_dir))


def b9_parse_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(R.parse_messages(raw_messages(spark, sf_dir), _attachments(spark, sf_dir)))


def k1_inline_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.inline_images(R.message_parts(raw_messages(spark, sf_dir))).select("message_id", "path", "mime_type", "attachment_id", "byte_size", F.length("data").cast("bigint").alias("data_chars"))


def k6_image_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(n % 3 == 0, F.col("n_chars") * (n % 5000)).alias("byte_size"), F.when(n % 4 > 0, "text").alias("no"), F.when(n % 4 > 0, F.col("text")).alias("data"))
    return K.image_bytes_filter(rows).select("doc_id", "byte_size")


def k9_binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's value as a pixel of its type's picture; a type without pixels has the threshold 128."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.least(F.lit(255), F.floor("value")).cast("int").alias("level"))
    found = K.polarity(rows, K.otsu_threshold(rows, "event_type", "level"), "event_type", "level")
    return rows.join(found, "event_type").select("event_id", K.binarize(F.col("level"), F.col("threshold"), F.col("light_on_dark")).cast("bigint").alias("pixel"))


def k10_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("n_chars"), F.col("doc_id") % 4000
    factor = K.scale_factor(w, h)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(factor, 9).alias("factor"), K.scaled(w, factor).alias("width"), K.scaled(h, factor).alias("height"))


def k11_preprocess_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of each order as a gray picture of one row: its size, threshold, polarity and ink after preprocessing."""
    n = F.col("o_orderkey")
    level = F.transform(F.sequence(F.lit(0), (n % 9 + 2).cast("int")), lambda i: (i * i * 37 + n * 13) % 256)
    pixels = F.unhex(F.array_join(F.transform(level, lambda v: F.concat(F.repeat(F.lpad(F.hex(v), 2, "0"), 3), F.lit("FF"))), ""))
    rows = table(spark, sf_dir, "orders").select(n.alias("image"), F.lit(1).alias("height"), F.size(level).alias("width"), pixels.alias("pixels"))
    ink = F.length(F.regexp_replace(F.hex("pixels"), "FF", "")) / 2
    return K.preprocess_images(rows).select("image", F.col("height").cast("bigint").alias("height"), F.col("width").cast("bigint").alias("width"), F.col("threshold").cast("bigint").alias("threshold"), "light_on_dark", ink.cast("bigint").alias("ink"))


def k11_tiled_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a tile of four pixels of a picture of 64 tiles: threshold, polarity and ink of each tile."""
    n = F.col("event_id")
    k = (n % 64).cast("int")
    level = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.floor("value").cast("bigint") + i * n) % 256)
    pixels = F.unhex(F.array_join(F.transform(level, lambda v: F.concat(F.repeat(F.lpad(F.hex(v), 2, "0"), 3), F.lit("FF"))), ""))
    tiles = table(spark, sf_dir, "events").select(F.floor(n / 64).alias("image"), F.lit(8).alias("height"), F.lit(32).alias("width"), F.floor(k / 8).cast("int").alias("y"), (k % 8 * 4).alias("x"), F.lit(1).alias("tile_height"), F.lit(4).alias("tile_width"), pixels.alias("pixels"))
    ink = F.length(F.regexp_replace(F.hex("pixels"), "FF", "")) / 2
    return K.preprocess_tiles(tiles).select("image", *[F.col(c).cast("bigint").alias(c) for c in ("y", "x", "height", "width", "threshold")], "light_on_dark", ink.cast("bigint").alias("ink"))


_OFFER = """{"code":"save%d","discount":" 20%% ","currency":"inr","min_spend":%s,"max_discount":-1,"expiry":"2026-02-%s","single_use":null,"new_users_only":false,"app_only":true,"categories":["a"],"conditions":" none "}"""


def _extraction(n: Column) -> Column:
    """What a model says of an event, some of it wrong."""
    one = F.format_string(_OFFER, n % 50, F.when(n % 7 == 0, '"5"').otherwise(F.concat((n % 900).cast("string"), F.when(n % 2 == 0, ".5").otherwise(""))), F.when(n % 4 == 0, "31").otherwise("14"))
    two = F.format_string(_OFFER, n % 50 + 1, F.lit("null"), F.lit("14"))
    same = F.regexp_replace(one, "20%", "30%")
    said = F.concat(F.lit('{"offers":['), one, F.lit(","), same, F.lit(","), two, F.lit("]"), F.when(n % 11 == 0, ',"note":1').otherwise(""), F.lit("}"))
    return F.when(n % 13 == 0, "prose").when(n % 17 == 0, '{"offers":{}}').otherwise(said)


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    said = _extraction(n)
    quoted = F.to_json(F.struct(said.alias("v")))
    text = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    usage = lambda a, b: F.format_string(f'"{a}":%d,"{b}":%d', n % 3000, n % 200)
    tool = F.when(F.try_parse_json(said).isNull(), F.lit('{"type":"text","text":"no"}')).otherwise(F.concat(F.lit('{"type":"tool_use","name":"x","input":'), said, F.lit("}")))
    a = F.concat(F.lit('{"content":['), tool, F.lit('],"stop_reason":"tool_use","usage":{'), usage("input_tokens", "output_tokens"), F.lit("}}"))
    o = F.concat(F.lit('{"choices":[{"message":{"content":'), text, F.when(n % 5 == 0, ',"refusal":"no"').otherwise(""), F.lit('},"finish_reason":"'), F.when(n % 6 == 0, "length").otherwise("stop"), F.lit('"}],"usage":{'), usage("prompt_tokens", "completion_tokens"), F.lit("}}"))
    half = F.floor(F.length(said) / 2).cast("int")
    g = F.concat(F.lit('{"candidates":[{"content":{"parts":'), F.to_json(F.array(F.struct(F.substring(said, F.lit(1), half).alias("text")), F.struct(F.substring(said, half + 1, F.length(said)).alias("text")))), F.lit('}}],"promptFeedback":{'), F.when(n % 5 == 0, '"blockReason":"x"').otherwise(""), F.lit('},"usageMetadata":{'), usage("promptTokenCount", "candidatesTokenCount"), F.lit("}}"))
    kind = (n % 3).cast("int")
    provider = F.get(F.array(F.lit("anthropic"), F.lit("openai"), F.lit("gemini")), kind)
    return table(spark, sf_dir, "events").select(n.cast("string").alias("message_id"), provider.alias("provider"), F.when(n % 19 == 0, 429).otherwise(200).alias("status"), F.create_map(F.lit("retry-after"), (n % 60).cast("string")).alias("headers"), F.get(F.array(a, o, g), kind).alias("body"))


def a7_read_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses written as JSON lines and read again, with the wait and the kind of error of those that failed."""
    root = f"{shared_dir(spark)}/responses-{uuid.uuid4().hex}"
    _responses(spark, sf_dir).write.json(root)
    kind = F.when(F.col("status") != 200, S.classify_error(F.col("status"), F.col("body")))
    return R.read_responses(spark, root).select("message_id", "provider", F.col("status").cast("bigint").alias("status"), kind.alias("error"), S.retry_after_ms(F.col("headers"), NOW).alias("wait_ms"))


def i4_normalize_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.normalize_responses(_responses(spark, sf_dir).filter("status = 200"))
    return rows.select("message_id", F.col("json").isNotNull().alias("readable"), "input_tokens", "output_tokens", "error")


def i6_retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    at = F.date_format(F.timestamp_seconds(F.lit(NOW // 1000) + n % 400), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    none = F.lit(None).cast("string")
    headers = F.map_filter(F.map_from_arrays(F.array(F.lit("retry-after"), F.lit("anthropic-ratelimit-tokens-reset"), F.lit("x-ratelimit-reset-requests")), F.array(F.when(n % 2 == 0, (n % 90).cast("string")).otherwise(none), F.when(n % 3 == 0, at).otherwise(none), F.when(n % 5 == 0, F.format_string("%dm%ds", n % 4, n % 60)).otherwise(none))), lambda k, v: v.isNotNull())
    return table(spark, sf_dir, "events").select("event_id", S.retry_after_ms(headers, NOW).alias("wait_ms"))


def i7_validate_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the models' offers after shape, codes and fields are checked (I7 to I9)."""
    n = F.col("event_id")
    answers = table(spark, sf_dir, "events").select(n.alias("message_id"), _extraction(n).alias("json"))
    known = table(spark, sf_dir, "events").select(n.alias("message_id"), F.format_string("SAVE%d", n % 50).alias("normalized"), F.format_string("Save%d", n % 50).alias("code"))
    offers, _ = E.validate_responses(answers, known)
    return offers.select("message_id", "normalized_code", "code", "discount", "currency", "min_spend", "max_discount", "expiry", "single_use", "new_users_only", "app_only", F.array_join("categories", ",").alias("categories"), "conditions")


def i7_shape_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", E.is_sound(_extraction(n)).alias("sound"))


def i1_select_for_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    gated = table(spark, sf_dir, "events").select(n.alias("message_id"), (n % 3 > 0).alias("should_extract"), (n % 4).alias("n_candidates"))
    return E.select_for_enrichment(gated).select("message_id", "enrich", "llm_processed")


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(n.alias("message_id"), F.concat(F.lit("a"), n.cast("string"), F.lit("@x.io")).alias("sender"), F.concat(F.lit("S"), n.cast("string")).alias("subject"), (n * 86_400_000).alias("internal_date"), "text", F.when(n % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("V "), "text")).alias("visible"), F.when(n % 3 == 0, F.concat(F.lit(" R"), n.cast("string"), F.lit(" "))).alias("ocr_text"))
    ranked = rows.select("message_id", F.inline(F.array(*[F.struct(F.lit(k).alias("rank"), F.format_string(f"C%d{x}", F.col("message_id") % 9).alias("code")) for k, x in ((2, "B"), (1, "A"), (3, "A"))])))
    return E.build_prompts(rows, ranked)


def i2_build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir)


def i3_run_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that answers with the length of its prompt."""
    return E.run_inference(_prompts(spark, sf_dir), lambda prompts: prompts.str.len().astype(str), 4)


def i10_enrichment_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sightings(spark, sf_dir).withColumn("llm_processed", F.lit(False)).select("message_id", "brand_key", "normalized_code", "discount", "llm_processed")
    better = rows.withColumns({"discount": F.lit("best"), "llm_processed": F.lit(True)})
    n = F.col("message_id")
    outcomes = rows.filter(n % 5 > 0).select("message_id", F.get(F.array(*map(F.lit, (None, "refusal", "rate-limit", "schema"))), (n % 4).cast("int")).alias("error"))
    offers, states = E.enrichment_fallback(rows, better, outcomes)
    return offers.join(states.withColumnRenamed("llm_processed", "seen"), "message_id", "left")


def g2_build_offers_from_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.brand_keys(messages(spark, sf_dir).drop("source"))
    code = lambda k: F.format_string(f"SRC{k}%d", F.col("message_id") % 50)
    details = [F.lit("5%").alias("discount"), F.lit("INR").alias("currency"), *[F.lit(None).cast(t).alias(c) for c, t in (("min_spend", "double"), ("max_discount", "double"), ("expiry", "string"), ("single_use", "boolean"))], F.lit(False).alias("new_users_only"), F.lit(True).alias("app_only"), F.array(F.lit("x")).alias("categories"), F.lit("").alias("conditions")]
    said = rows.select("message_id", F.explode(F.array(code("A"), code("B"))).alias("normalized_code")).select("message_id", "normalized_code", F.lower("normalized_code").alias("code"), *details)
    found = rows.select("message_id", code("A").alias("normalized"), F.get(F.array(*map(F.lit, ("link", "alt", "ocr", "subject"))), (F.col("message_id") % 4).cast("int")).alias("source"))
    built = O.build_offers_from_extraction(rows, said, found)
    return built.select("brand_key", "normalized_code", "code", "brand", F.col("extractor_version").cast("bigint").alias("extractor_version"), "llm_processed", "discount", "app_only", "source", "needs_review", F.get("message_ids", F.lit(0)).alias("message_id"), O.thread_url(F.col("thread_id")).alias("url"))


def g8_thread_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("message_id", O.thread_url(F.col("thread_id")).alias("url"))


def h6_active_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.active_offers(sightings(spark, sf_dir), F.lit(Q.TODAY).cast("date")).select("seq", "expiry")


def e11_regate_with_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without link or picture texts as messages: those that have no candidate are read again with what their
    pictures say, if they have any."""
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(n.alias("message_id"), F.lit("").alias("subject"), F.when(n % 2 == 0, F.concat(F.lit("use code TEXT"), (n % 9).cast("string"))).otherwise("").alias("text"), F.lit("").alias("html"))
    ocr = rows.filter(n_(3) != 0).select("message_id", F.concat(F.lit("with code PIC"), (F.col("message_id") % 70).cast("string"), F.lit("Q")).alias("ocr_text"))
    images = rows.filter(n_(4) != 1).select("message_id")
    return C.regate_with_ocr(rows, C.find_candidates(rows), ocr, images).select("message_id", "normalized", "source")


def n_(k: int) -> Column:
    return F.col("message_id") % k


def l1_offers_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 13 fields of each brand's offers as one array."""
    rows = sightings(spark, sf_dir).groupBy("brand_key", "normalized_code").agg(F.max("seq").alias("seq"), F.max("discount").alias("discount"), F.max("currency").alias("currency"), F.bool_or("app_only").alias("app_only"))
    none = {c: F.lit(None).cast(t) for c, t in (("min_spend", "double"), ("max_discount", "double"), ("expiry", "string"))}
    full = rows.withColumns(none | {"brand": F.concat(F.lit('B "'), "brand_key", F.lit('"')), "code": F.lower("normalized_code"), "new_users_only": F.lit(False), "categories": F.array(F.lit("a")), "conditions": F.lit(""), "needs_review": F.lit(True)})
    return V.offers_json(full, mailbox="brand_key").select(F.col("mailbox").alias("brand_key"), "offers")


def l4_question_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
    rows = V.chat_json(turns, 3).join(asked, "conv_id")
    today = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("conv_id") % 300).cast("int"))
    return rows.select("conv_id", V.question_context(today, F.col("conv_id") % 2 == 0, F.col("conv_id") % 70, F.lit("[]"), F.col("chat"), F.col("question")).alias("context"))


def _mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).drop("source")


def _offers_of(spark: SparkSession, root: str) -> DataFrame:
    n = current(spark, root, "sources").groupBy(*O.KEY).agg(F.count(F.lit(1)).alias("n_messages"))
    return current(spark, root, "offers").join(n, O.KEY).select(*O.KEY, F.col("extractor_version").cast("bigint").alias("extractor_version"), "llm_processed", "n_messages")


def j6_run_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers after the window was read in two steps, the second of which ran twice."""
    root, rows = f"{shared_dir(spark)}/backfill-{uuid.uuid4().hex}", _mailbox(spark, sf_dir)
    run_backfill(rows.filter("message_id % 3 = 0"), root, 0, NOW, 365)
    run_backfill(rows, root, 1, NOW, 365)
    run_backfill(rows, root, 1, NOW, 365)
    return _offers_of(spark, root)


def _says(prompts: pd.Series) -> pd.DataFrame:
    """A model that finds 10 % for every candidate it is given."""

    def one(prompt: str) -> str:
        codes = next(line for line in prompt.split("\n") if line.startswith("CANDIDATE CODES: "))[len("CANDIDATE CODES: ") :].split(", ")
        fields = {"discount": "10%", "currency": None, "min_spend": None, "max_discount": None, "expiry": None, "single_use": None, "new_users_only": False, "app_only": False, "categories": [], "conditions": ""}
        return json.dumps({"choices": [{"message": {"content": json.dumps({"offers": [{"code": c} | fields for c in codes]})}, "finish_reason": "stop"}]})

    return pd.DataFrame({"status": 200, "body": [one(p) for p in prompts], "retry_after_ms": pd.array([None] * len(prompts), dtype="Int64")})


def j5_whole_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From all messages to the offers that a model has seen: candidates, prompts, the log of answers, their checks, the merge, the commit."""
    root = f"{shared_dir(spark)}/whole-{uuid.uuid4().hex}"
    run_backfill(_mailbox(spark, sf_dir), root, 0, NOW, 365, model=Model(_says, f"{root}/log"))
    n = current(spark, root, "sources").groupBy(*O.KEY).agg(F.count(F.lit(1)).alias("n_messages"))
    return current(spark, root, "offers").join(n, O.KEY).select(*O.KEY, "llm_processed", "discount", "n_messages")


def j7_relist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is processed after a backfill of some, changes since, and a cursor that has expired: as if all had been listed."""
    root, rows = f"{shared_dir(spark)}/relist-{uuid.uuid4().hex}", _mailbox(spark, sf_dir)
    history = rows.select(F.col("message_id").alias("seq"), "message_id")
    early = rows.filter("message_id % 10 < 4")
    cursor = catch_up(history.filter("seq % 10 < 4"), early, root, 0, None, NOW, 365)
    catch_up(history.filter(f"seq >= {cursor}"), rows, root, 1, cursor, NOW, 365)
    catch_up(history.filter("seq % 10 = 9"), rows, root, 2, 3, NOW, 365)
    return processed_messages(spark, root).withColumn("extractor_version", F.col("extractor_version").cast("bigint"))


def j12_version_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of version 4 stay while version 5 reads the mailbox again, and are gone when it is through."""
    root, rows = f"{shared_dir(spark)}/migration-{uuid.uuid4().hex}", _mailbox(spark, sf_dir)
    run_backfill(rows, root, 0, NOW, 365, version=4)
    run_backfill(rows.filter("message_id % 40 < 3"), root, 1, NOW, 365, complete=False)
    between = _offers_of(spark, root).withColumn("step", F.lit("between"))
    run_backfill(rows, root, 2, NOW, 365)
    return between.unionByName(_offers_of(spark, root).withColumn("step", F.lit("after")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        a1_read_messages, a4_hydrate_external_parts, a7_read_responses, b1_deep_parts, b1_message_parts, b2_header, b4_is_attachment, b7_message_surfaces, b9_parse_messages, e11_regate_with_ocr, g2_build_offers_from_extraction, g8_thread_url, h6_active_offers,
        i1_select_for_enrichment, i2_build_prompts, i3_run_inference, i4_normalize_responses, i6_retry_after, i7_shape_errors, i7_validate_responses, i10_enrichment_fallback, j5_whole_job, j6_run_backfill, j7_relist, j12_version_migration,
        k1_inline_images, k6_image_bytes, k9_binarize, k10_scale, k11_preprocess_images, k11_tiled_images, l1_offers_json, l4_question_context,
    )
}

_D = "d AS (SELECT *, CAST(doc_id AS VARCHAR) AS message_id, coalesce(text, '') AS said, doc_id % 3 <> 0 AS there FROM documents)"
_PARTS = f"""{_D}, parts AS (
  SELECT message_id, doc_id, n_chars, said, unnest(['~', '0000.~', '0000.0000.~', '0000.0001.~', '0001.~', '0002.~', '0002.0000.~', '0002.0001.~']) AS path,
    unnest(['multipart/mixed', 'multipart/alternative', 'text/plain', 'text/html', 'Image/PNG', 'message/rfc822', 'text/plain', 'image/gif']) AS mime_type,
    unnest(['', '', '', '', CASE WHEN doc_id % 4 = 0 THEN 'Logo.png' ELSE 'banner.png' END, CASE WHEN doc_id % 2 = 0 THEN 'mail.eml' ELSE '' END, '', 'shot.gif']) AS filename FROM d)"""
_PARSED = "SELECT message_id, 't' || doc_id % 97 AS thread_id, CASE WHEN doc_id % 7 > 0 THEN doc_id * 1000 ELSE 0 END AS internal_date, 'CATEGORY_PROMOTIONS' AS labels, 'News ' || doc_id AS subject, 'Shop <a@Mail.src' || doc_id % 9 || '.co.uk>' AS sender, 'mail.src' || doc_id % 9 || '.co.uk' AS sender_domain, said AS text, CASE WHEN doc_id % 9 = 0 THEN '' ELSE '<p>' || said || '</p>' END AS html, doc_id % 9 = 0 AS failed FROM d"
_NUMBER = "CASE WHEN event_id % 2 = 0 THEN event_id % 900 + 0.5 ELSE event_id % 900 END"
_BAD = "event_id % 13 = 0 OR event_id % 17 = 0 OR event_id % 11 = 0 OR event_id % 7 = 0"
_WINDOW = f"label = 'CATEGORY_PROMOTIONS' AND internal_date >= {NOW - 365 * 86_400_000}"
_GRAY = "g AS (SELECT o_orderkey AS image, unnest(range(0, o_orderkey % 9 + 3)) AS i, o_orderkey % 9 + 3 AS width FROM orders), p AS (SELECT image, width, (i * i * 37 + image * 13) % 256 AS level FROM g)"
ORACLE_SQL = {
    "a1_read_messages": f"WITH {_D} {_PARSED}",
    "b9_parse_messages": f"WITH {_D} {_PARSED}",
    "a4_hydrate_external_parts": f"WITH {_D} SELECT message_id, said AS text, CASE WHEN doc_id % 9 = 0 THEN '' ELSE '<p>' || said || '</p>' END AS html, doc_id % 9 = 0 AS failed FROM d",
    "b7_message_surfaces": f"WITH {_D} SELECT message_id, said AS text, CASE WHEN there THEN '<p>' || said || '</p>' ELSE '' END AS html, false AS failed FROM d",
    "b1_deep_parts": "SELECT CAST(doc_id AS VARCHAR) AS message_id, doc_id % 40 + 2 AS n_parts, doc_id % 40 + 1 AS depth, coalesce(text, '') AS text, false AS failed FROM documents",
    "b1_message_parts": f"WITH {_PARTS} SELECT message_id, path, mime_type, filename, filename <> '' OR path LIKE '0002.%' AS in_attachment FROM parts",
    "b2_header": f"""WITH {_PARTS} SELECT message_id, path, CASE path WHEN '0000.0000.~' THEN 'text/plain; charset="UTF-8"' WHEN '0000.0001.~' THEN 'text/html; charset=utf-8' ELSE '' END AS content_type, CASE path WHEN '~' THEN 'News ' || message_id ELSE '' END AS subject FROM parts""",
    "b4_is_attachment": f"WITH {_PARTS} SELECT message_id, path, filename <> '' OR path = '0002.~' AS attached FROM parts",
    "k1_inline_images": f"""WITH {_PARTS}, i AS (SELECT *, CASE WHEN path = '0001.~' THEN CASE WHEN doc_id % 5 > 0 THEN n_chars * 9 END ELSE n_chars * 5 END AS byte_size, path = '0001.~' AS pic, strlen(said) AS bytes FROM parts WHERE lower(mime_type) LIKE 'image/%')
      SELECT message_id, path, lower(mime_type) AS mime_type, CASE WHEN pic THEN 'pic' END AS attachment_id, byte_size, CASE WHEN NOT pic THEN CAST(bytes // 3 * 4 + CASE bytes % 3 WHEN 0 THEN 0 ELSE bytes % 3 + 1 END AS BIGINT) END AS data_chars FROM i WHERE filename <> 'Logo.png' AND (pic OR said <> '') AND coalesce(byte_size >= 6000, true)""",
    "k6_image_bytes": "WITH i AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN n_chars * (doc_id % 5000) END AS byte_size, CASE WHEN doc_id % 4 > 0 THEN length(text) * 3 // 4 END AS guess FROM documents) SELECT doc_id, byte_size FROM i WHERE coalesce(coalesce(byte_size, guess) BETWEEN 6000 AND 8000000, true)",
    "k10_scale": "WITH i AS (SELECT doc_id, n_chars AS w, doc_id % 4000 AS h, CASE WHEN n_chars * (doc_id % 4000) <= 0 THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, sqrt(4000000.0::DOUBLE / (n_chars * (doc_id % 4000)))) END AS f FROM documents) SELECT doc_id, round(f, 9) AS factor, CAST(greatest(1, floor(w * f + 0.5)) AS BIGINT) AS width, CAST(greatest(1, floor(h * f + 0.5)) AS BIGINT) AS height FROM i",
    "k11_preprocess_images": f"""WITH {_GRAY}, h AS (SELECT image, width, level, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT *, sum(n) OVER a AS w, sum(n * level) OVER a AS s, sum(n) OVER b AS wt, sum(n * level) OVER b AS st FROM h WINDOW a AS (PARTITION BY image ORDER BY level), b AS (PARTITION BY image)),
      v AS (SELECT *, CASE WHEN w < wt THEN CAST(3 * w AS DOUBLE) * CAST(3 * (wt - w) AS DOUBLE) * power(CAST(s AS DOUBLE) / w - CAST(st - s AS DOUBLE) / (wt - w), 2) ELSE 0 END AS x FROM s), t AS (SELECT image, width, CASE WHEN max(x) > 0 THEN arg_max(level, (x, -level)) ELSE 0 END AS threshold FROM v GROUP BY ALL),
      k AS (SELECT image, t.width, threshold, count(*) FILTER (WHERE level <= threshold) AS dark, count(*) AS n FROM p JOIN t USING (image) GROUP BY ALL)
      SELECT image, CAST(3 AS BIGINT) AS height, CAST(3 * width AS BIGINT) AS width, CAST(threshold AS BIGINT) AS threshold, dark * 2 > n AS light_on_dark, CAST(9 * CASE WHEN dark * 2 > n THEN n - dark ELSE dark END AS BIGINT) AS ink FROM k""",
    "a7_read_responses": "SELECT CAST(event_id AS VARCHAR) AS message_id, ['anthropic', 'openai', 'gemini'][CAST(event_id % 3 AS INTEGER) + 1] AS provider, CAST(CASE WHEN event_id % 19 = 0 THEN 429 ELSE 200 END AS BIGINT) AS status, CASE WHEN event_id % 19 = 0 THEN 'rate-limit' END AS error, event_id % 60 * 1000 AS wait_ms FROM events",
    "i4_normalize_responses": """WITH r AS (SELECT event_id, event_id % 3 AS p, event_id % 13 = 0 AS prose FROM events WHERE event_id % 19 <> 0),
      e AS (SELECT *, CASE WHEN p = 0 THEN CASE WHEN prose THEN 'refusal' END WHEN event_id % 5 = 0 THEN 'refusal' WHEN prose OR (p = 1 AND event_id % 6 = 0) THEN 'schema' END AS error FROM r)
      SELECT CAST(event_id AS VARCHAR) AS message_id, error IS NULL AS readable, event_id % 3000 AS input_tokens, event_id % 200 AS output_tokens, error FROM e""",
    "i6_retry_after": "SELECT event_id, greatest(CASE WHEN event_id % 2 = 0 THEN event_id % 90 * 1000 END, CASE WHEN event_id % 3 = 0 THEN event_id % 400 * 1000 END, CASE WHEN event_id % 5 = 0 THEN event_id % 4 * 60000 + event_id % 60 * 1000 END) AS wait_ms FROM events",
    "i7_shape_errors": f"SELECT event_id, NOT ({_BAD}) AS sound FROM events",
    "i7_validate_responses": f"SELECT event_id AS message_id, 'SAVE' || event_id % 50 AS normalized_code, 'Save' || event_id % 50 AS code, '20%' AS discount, 'INR' AS currency, CAST({_NUMBER} AS DOUBLE) AS min_spend, CAST(NULL AS DOUBLE) AS max_discount, CASE WHEN event_id % 4 <> 0 THEN '2026-02-14' END AS expiry, CAST(NULL AS BOOLEAN) AS single_use, false AS new_users_only, true AS app_only, 'a' AS categories, 'none' AS conditions FROM events WHERE NOT ({_BAD})",
    "i1_select_for_enrichment": "SELECT event_id AS message_id, event_id % 3 > 0 AND event_id % 4 > 0 AS enrich, NOT (event_id % 3 > 0 AND event_id % 4 > 0) AS llm_processed FROM events",
    "i10_enrichment_fallback": f"""WITH {SIGHTINGS_CTE}, k AS (SELECT *, CASE WHEN message_id % 5 = 0 OR message_id % 4 = 2 THEN 'later' WHEN message_id % 4 = 0 THEN 'done' ELSE 'lost' END AS o FROM sightings)
      SELECT message_id, brand_key, normalized_code, CASE WHEN o = 'done' THEN 'best' ELSE discount END AS discount, o <> 'later' AS llm_processed, CASE o WHEN 'lost' THEN 'failed' WHEN 'done' THEN 'candidates' END AS status, CASE WHEN o <> 'later' THEN true END AS seen FROM k""",
    "g2_build_offers_from_extraction": f"""WITH {MESSAGES_CTE}, {Q._brands('messages', 'message_id')}, b AS (SELECT *, unnest(['SRCA' || message_id % 50, 'SRCB' || message_id % 50]) AS normalized_code, unnest([true, false]) AS met FROM branded)
      SELECT brand_key, normalized_code, lower(normalized_code) AS code, brand, CAST(5 AS BIGINT) AS extractor_version, true AS llm_processed, '5%' AS discount, true AS app_only, CASE WHEN met AND message_id % 4 = 0 THEN 'link' WHEN met AND message_id % 4 = 2 THEN 'ocr' ELSE 'text' END AS source, met AND message_id % 4 = 2 AS needs_review, message_id, '{O.THREADS}' || thread_id AS url FROM b""",
    "g8_thread_url": f"WITH {MESSAGES_CTE} SELECT message_id, '{O.THREADS}' || thread_id AS url FROM messages",
    "h6_active_offers": f"WITH {SIGHTINGS_CTE} SELECT seq, expiry FROM sightings WHERE expiry IS NULL OR expiry >= '{Q.TODAY}'",
    "e11_regate_with_ocr": "SELECT doc_id AS message_id, CASE WHEN doc_id % 2 = 0 THEN 'TEXT' || doc_id % 9 ELSE 'PIC' || doc_id % 70 || 'Q' END AS normalized, CASE WHEN doc_id % 2 = 0 THEN 'text' ELSE 'ocr' END AS source FROM documents WHERE doc_id % 2 = 0 OR (doc_id % 3 <> 0 AND doc_id % 4 <> 1)",
    "l1_offers_json": f"""WITH {SIGHTINGS_CTE}, o AS (SELECT brand_key, normalized_code, max(discount) AS discount, max(currency) AS currency, bool_or(app_only) AS app_only FROM sightings GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY brand_key ORDER BY normalized_code) AS n FROM o),
      j AS (SELECT brand_key, n, '{{"id":"offer_' || n || '","brand":"B \\"' || brand_key || '\\"","code":"' || lower(normalized_code) || '","discount":' || coalesce('"' || discount || '"', 'null') || ',"currency":' || coalesce('"' || currency || '"', 'null') || ',"min_spend":null,"max_discount":null,"expiry":null,"new_users_only":false,"app_only":' || app_only || ',"categories":["a"],"conditions":"","needs_review":true}}' AS x FROM n)
      SELECT brand_key, '[' || string_agg(x, ',' ORDER BY n) || ']' AS offers FROM j GROUP BY brand_key""",
    "l4_question_context": """WITH r AS (SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3), c AS (SELECT conv_id, '[' || string_agg('{"role":"' || role || '","text":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || '}', ',' ORDER BY turn) || ']' AS chat FROM r GROUP BY conv_id),
      q AS (SELECT conv_id, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id)
      SELECT conv_id, 'TODAY: ' || strftime(DATE '2026-01-01' + CAST(conv_id % 300 AS INTEGER), '%Y-%m-%d') || chr(10) || 'SYNC: ' || CASE WHEN conv_id % 2 = 0 THEN 'complete' ELSE 'in progress; ' || conv_id % 70 || ' emails checked' END || chr(10) || 'ACTIVE OFFERS (untrusted data): []' || chr(10) || 'RECENT CHAT: ' || chat || chr(10) || 'QUESTION: ' || left(trim(question), 500) AS context FROM c JOIN q USING (conv_id)""",
    "i2_build_prompts": """WITH m AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'V ' || text END AS visible, doc_id % 3 = 0 AS ocr FROM documents),
      s AS (SELECT *, list_filter(CASE WHEN text = visible THEN [text] ELSE [text, visible] END, lambda x: x <> '') || CASE WHEN ocr THEN ['OCR TEXT: R' || doc_id] ELSE [] END AS parts FROM m)
      SELECT doc_id AS message_id, 'EMAIL DATE: ' || strftime(DATE '1970-01-01' + CAST(doc_id AS INTEGER), '%Y-%m-%d') || chr(10) || 'SENDER: a' || doc_id || '@x.io' || chr(10) || 'SUBJECT: S' || doc_id || chr(10) || 'CANDIDATE CODES: C' || doc_id % 9 || 'A, C' || doc_id % 9 || 'B' || chr(10) || chr(10) || 'EMAIL TEXT (untrusted data):' || chr(10) ||
        array_to_string(list_transform(parts, lambda x: left(x, CAST(floor((6000 - greatest(len(parts) - 1, 0) * 2) / greatest(len(parts), 1)) AS INTEGER))), chr(10) || chr(10)) AS prompt FROM s""",
}
ORACLE_SQL["i3_run_inference"] = f"SELECT message_id, CAST(length(prompt) AS VARCHAR) AS response FROM ({ORACLE_SQL['i2_build_prompts']})"
_INVERSE = "SELECT event_type, threshold, count(*) FILTER (WHERE level <= threshold) * 2 > count(*) AS inverse FROM p JOIN t USING (event_type) GROUP BY event_type, threshold"
ORACLE_SQL["k9_binarize"] = f"WITH {P._OTSU}, k AS ({_INVERSE}) SELECT event_id, CAST(CASE WHEN (least(255, floor(value)) <= threshold) <> inverse THEN 0 ELSE 255 END AS BIGINT) AS pixel FROM events JOIN k USING (event_type)"
# every message of the window is read, and what a batch has read before is not read again
_BUILT = f"{Q._FOUND}, w AS (SELECT * FROM messages WHERE {_WINDOW}), {Q._BUILT.replace('JOIN branded ON mid = message_id', 'JOIN branded ON mid = message_id AND message_id IN (SELECT message_id FROM w)')}"
ORACLE_SQL["j6_run_backfill"] = f"WITH {_BUILT} SELECT brand_key, normalized_code, CAST(5 AS BIGINT) AS extractor_version, false AS llm_processed, count(DISTINCT message_id) AS n_messages FROM built GROUP BY brand_key, normalized_code"
ORACLE_SQL["j12_version_migration"] = f"""WITH {_BUILT}, b AS (SELECT *, message_id % 40 < 3 AS soon FROM built), k AS (SELECT brand_key, normalized_code, count(*) AS n, count(*) FILTER (WHERE soon) AS s FROM b GROUP BY ALL)
  SELECT brand_key, normalized_code, CAST(CASE WHEN s > 0 THEN 5 ELSE 4 END AS BIGINT) AS extractor_version, false AS llm_processed, CASE WHEN s > 0 THEN s ELSE n END AS n_messages, 'between' AS step FROM k
  UNION ALL SELECT brand_key, normalized_code, CAST(5 AS BIGINT), false, n, 'after' FROM k"""
ORACLE_SQL["j7_relist"] = f"WITH {_BUILT}, any_ AS (SELECT DISTINCT mid FROM best), t AS (SELECT DISTINCT mid FROM ends) SELECT message_id, CAST(5 AS BIGINT) AS extractor_version, CASE WHEN message_id IN (FROM any_) OR message_id IN (FROM t) THEN 'candidates' ELSE 'no-code' END AS status, message_id NOT IN (FROM any_) AS llm_processed FROM w"
ORACLE_SQL["j5_whole_job"] = f"WITH {_BUILT} SELECT brand_key, normalized AS normalized_code, true AS llm_processed, '10%' AS discount, count(DISTINCT mid) AS n_messages FROM best JOIN branded ON mid = message_id WHERE mid IN (SELECT message_id FROM w) GROUP BY ALL"
ORACLE_SQL["k11_tiled_images"] = """WITH p AS (SELECT event_id // 64 AS image, event_id % 64 AS k, (CAST(floor(value) AS BIGINT) + i * event_id) % 256 AS level FROM events, (SELECT unnest(range(0, 4)) AS i)), h AS (SELECT image, level, count(*) AS n FROM p GROUP BY ALL),
  s AS (SELECT *, sum(n) OVER a AS w, sum(n * level) OVER a AS s, sum(n) OVER b AS wt, sum(n * level) OVER b AS st FROM h WINDOW a AS (PARTITION BY image ORDER BY level), b AS (PARTITION BY image)),
  v AS (SELECT *, CASE WHEN w < wt THEN CAST(9 * w AS DOUBLE) * CAST(9 * (wt - w) AS DOUBLE) * power(CAST(s AS DOUBLE) / w - CAST(st - s AS DOUBLE) / (wt - w), 2) ELSE 0 END AS x FROM s),
  t AS (SELECT image, CASE WHEN max(x) > 0 THEN arg_max(level, (x, -level)) ELSE 0 END AS threshold FROM v GROUP BY image), l AS (SELECT image, threshold, count(*) FILTER (WHERE level <= threshold) * 2 > count(*) AS light_on_dark FROM p JOIN t USING (image) GROUP BY ALL)
  SELECT image, k // 8 * 3 AS y, k % 8 * 12 AS x, CAST(3 AS BIGINT) AS height, CAST(12 AS BIGINT) AS width, CAST(threshold AS BIGINT) AS threshold, light_on_dark, 9 * count(*) FILTER (WHERE (level <= threshold) <> light_on_dark) AS ink FROM p JOIN l USING (image) GROUP BY image, k, threshold, light_on_dark"""
