"""Messages from JSON: parts as rows, text surfaces as columns."""

from __future__ import annotations

import codecs
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import trim
from ..jobs.tables import written
from ..operators.brand import sender_domain

HEADERS = "array<struct<name:string,value:string>>"
MESSAGE = "id string, threadId string, internalDate string, labelIds array<string>, payload string"
#: The type recurses, so children stay JSON text until their own level is read.
PART = f"mimeType string, filename string, headers {HEADERS}, body struct<attachmentId:string,size:bigint,data:string>, parts array<string>"
#: Bodies are strings of any length, of which the reader takes 20,000,000 characters if it is not told.
LONG = {"maxStringLen": str(2**31 - 1)}
#: A label that browsers read as another charset.
LABELS = {"iso-8859-1": "cp1252", "latin1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252"}


def read_messages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(MESSAGE).options(multiLine=multi_line, **LONG).json(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Saved responses of models: message_id, provider, status, headers, body (JSON text), one a line."""
    return spark.read.schema("message_id string, provider string, status int, headers map<string,string>, body string").json(path)


def header(headers: Column, name: str) -> Column:
    """The first header of a name, whatever its case; empty if there is none."""
    return F.coalesce(F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"], F.lit(""))


def charset_of(content_type: Column) -> Column:
    pattern = r"""(?i)charset\s*=\s*(?:"([^"]+)"|'([^']+)'|([^;\s]+))"""
    found = F.concat(*[F.regexp_extract(content_type, pattern, i) for i in (1, 2, 3)])
    return trim(F.coalesce(F.nullif(found, F.lit("")), F.lit("utf-8")))


def is_attachment(filename: Column, headers: Column) -> Column:
    """By its name or disposition; an attachment id alone can be a body kept elsewhere."""
    return (F.coalesce(filename, F.lit("")) != "") | header(headers, "Content-Disposition").rlike(r"(?i)\Aattachment(?![A-Za-z0-9_])")


def text_kind(mime_type: Column) -> Column:
    kind = F.lower(F.coalesce(mime_type, F.lit("")))
    return F.when(kind.startswith("text/plain"), "text").when(kind.startswith("text/html"), "html")


@F.pandas_udf(StringType())
def _decode(data: pd.Series, charset: pd.Series) -> pd.Series:
    def one(raw: bytes | None, name: str) -> str | None:
        if raw is None:
            return None
        try:
            codec = codecs.lookup(LABELS.get(name.lower(), name)).name
        except LookupError:
            codec = "utf-8"
        return raw.decode(codec, "replace")

    return pd.Series([one(r, n) for r, n in zip(data, charset, strict=True)])


def base64url_bytes(data: Column) -> Column:
    """The bytes of unpadded base64url data; null where it is no base64."""
    # two plain replacements, as a translation goes through all characters one by one
    return F.try_to_binary(F.replace(F.replace(data, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/")), F.lit("base64"))


def decode_bytes(raw: Column, charset: Column) -> Column:
    """Text of bytes. Bad ones become replacement characters.

    Only other charsets than UTF-8 and ASCII go through the helper.
    """
    plain = F.lower(charset).isin("utf-8", "utf8")
    text = F.when(plain, F.make_valid_utf8(raw.cast("string"))).otherwise(_decode(F.when(~plain, raw), charset))
    return F.regexp_replace(text, "\\A\\uFEFF", "")


def decode_base64url(data: Column, charset: Column) -> Column:
    """Text of unpadded base64url data; null where it is no base64."""
    return decode_bytes(base64url_bytes(data), charset)


PARTS = ["message_id", "path", "mime_type", "filename", "headers", "body", "in_attachment", "too_deep"]


def _levels(rows: DataFrame, step: int) -> DataFrame:
    """(message_id, found, left) of (message_id, level): the parts of ``step`` levels, and the children of the last one.

    Levels are arrays of the message's row, each read from the one above, without a shuffle or a second scan.
    """

    def inside(x: Column) -> Column:
        return x["above"] | F.coalesce(is_attachment(x["p"]["filename"], x["p"]["headers"]), F.lit(False))

    def child(x: Column) -> Callable[[Column, Column], Column]:
        return lambda c, n: F.struct(F.concat(x["prefix"], F.lpad(n.cast("string"), 4, "0"), F.lit(".")).alias("prefix"), inside(x).alias("above"), F.from_json(c, PART, LONG).alias("p"))

    def part(x: Column) -> Column:
        p = x["p"]
        return F.struct(F.concat(x["prefix"], F.lit("~")).alias("path"), p["mimeType"].alias("mime_type"), p["filename"].alias("filename"), p["headers"].alias("headers"), p["body"].alias("body"), inside(x).alias("in_attachment"))

    none = F.array().cast("array<string>")
    rows = rows.withColumnRenamed("level", "level_0")
    for depth in range(step):
        rows = rows.withColumn(f"level_{depth + 1}", F.flatten(F.transform(f"level_{depth}", lambda x: F.transform(F.coalesce(x["p"]["parts"], none), child(x)))))
    all_ = F.concat(*[F.col(f"level_{d}") for d in range(step)])
    return rows.select("message_id", F.transform(F.filter(all_, lambda x: x["p"].isNotNull()), part).alias("found"), F.col(f"level_{step}").alias("left"))


def message_parts(messages: DataFrame, max_depth: int = 256, step: int = 9) -> DataFrame:
    """One row a part: message_id, path, mime_type, filename, headers, body, in_attachment (its own or from above), too_deep.

    A path has a four-digit number a level and ends in ``~``, so that children sort before their parent. ``step`` levels are read
    in the message's row; only messages that name parts more often than that are read further, ``step`` levels a round, until none has
    more. One with parts below ``max_depth`` levels, or with JSON that nests deeper than can be read, has a row ``too_deep`` instead of them.
    """
    top = F.struct(F.lit("").alias("prefix"), F.lit(False).alias("above"), F.from_json("payload", PART, LONG).alias("p"))
    deep = F.coalesce(F.regexp_count("payload", F.lit('"parts"')) >= step, F.lit(False))

    def exploded(rows: DataFrame) -> DataFrame:
        # outer, as Spark would read the levels once more to leave out empty arrays before
        out = rows.select("message_id", F.explode_outer("found").alias("part")).filter("part is not null")
        return out.select("message_id", "part.*", F.lit(False).alias("too_deep"))

    # no level instead of a filter, which would have the payload computed once more where it is an expression
    out = exploded(_levels(messages.select(F.col("id").alias("message_id"), F.when(~deep, F.array(top)).alias("level")), step))
    # names parts, but has none: its JSON could not be read
    unread = F.coalesce(F.size(F.col("level")[0]["p"]["parts"]) < 1, F.lit(True)).alias("unread")
    left = written(messages.filter(deep).select(F.col("id").alias("message_id"), F.array(top).alias("level")).select("message_id", "level", unread))
    unread = left.filter("unread").select("message_id")
    left, depth = left.filter("not unread").select("message_id", "level"), 0
    while depth < max_depth and not left.isEmpty():
        read = written(_levels(left, min(step, max_depth - depth)))
        out = out.unionByName(exploded(read))
        left, depth = read.filter("size(left) > 0").select("message_id", F.col("left").alias("level")), depth + step
    beyond = unread.unionByName(left.filter(F.lit(depth >= max_depth)).select("message_id")).distinct()
    marks = [F.lit(True).alias(c) if c == "too_deep" else F.lit("~" if c == "path" else None).cast(out.schema[c].dataType).alias(c) for c in PARTS[1:]]
    return out.unionByName(beyond.select("message_id", *marks))


def _text_rows(parts: DataFrame) -> DataFrame:
    """``text_parts`` with too_deep, and a row without a kind for each message that is too deep."""
    rows = parts.withColumn("kind", F.when(~F.col("in_attachment") & ~F.col("too_deep"), text_kind(F.col("mime_type")))).filter("too_deep or kind is not null")
    data, kept = F.nullif(F.col("body.data"), F.lit("")), F.nullif(F.col("body.attachmentId"), F.lit(""))
    rows = rows.select("message_id", "path", "kind", "too_deep", charset_of(header(F.col("headers"), "Content-Type")).alias("charset"), data.alias("data"), F.when(data.isNull(), kept).alias("attachment_id"))
    return rows.filter("too_deep or data is not null or attachment_id is not null")


def text_parts(parts: DataFrame) -> DataFrame:
    """Text and HTML parts outside attachments: message_id, path, kind, charset, data, attachment_id."""
    return _text_rows(parts).filter("not too_deep").drop("too_deep")


def message_surfaces(parts: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """(message_id, text, html, failed): decoded parts in order, joined by line breaks.

    Bodies kept elsewhere come from ``attachments`` (message_id, attachment_id, data) and follow the inline ones.
    A body that is missing or no base64, or parts that nest too deep, make their message ``failed``. Bodies are shuffled as
    bytes for the join, and as text for the grouping.
    """
    rows = _text_rows(parts).withColumn("raw", base64url_bytes(F.col("data"))).drop("data")
    if attachments is not None:
        rows = rows.join(attachments.withColumnRenamed("data", "fetched"), ["message_id", "attachment_id"], "left")
        rows = rows.withColumn("raw", F.coalesce("raw", base64url_bytes(F.col("fetched"))))
    rows = rows.withColumn("said", decode_bytes(F.col("raw"), F.col("charset")))
    order = F.struct(F.col("attachment_id").isNotNull().alias("late"), "path", "said")
    bad = F.bool_or(F.col("too_deep") | F.col("said").isNull() & (F.lit(attachments is not None) | F.col("attachment_id").isNull()))

    def joined(kind: str) -> Column:
        listed = F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & F.col("said").isNotNull(), order)))
        return F.array_join(F.transform(listed, lambda x: x["said"]), "\n")

    return rows.groupBy("message_id").agg(joined("text").alias("text"), joined("html").alias("html"), bad.alias("failed"))


def parse_messages(messages: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """message_id, thread_id, internal_date, labels, subject, sender, sender_domain, text, html, failed."""
    top = messages.withColumn("h", F.from_json("payload", PART, LONG)["headers"])
    top = top.select(F.col("id").alias("message_id"), F.col("threadId").alias("thread_id"), F.coalesce(F.col("internalDate").cast("bigint"), F.lit(0)).alias("internal_date"), F.col("labelIds").alias("labels"), header(F.col("h"), "Subject").alias("subject"), header(F.col("h"), "From").alias("sender"))
    bodies = message_surfaces(message_parts(messages), attachments)
    rows = top.withColumn("sender_domain", sender_domain(F.col("sender"))).join(bodies, "message_id", "left")
    return rows.withColumns({"text": F.coalesce("text", F.lit("")), "html": F.coalesce("html", F.lit("")), "failed": F.coalesce("failed", F.lit(False))})
