"""Parts of any depth, trigger phrases by ranges, lookups that open few row groups."""

import json
import random

from pyspark.sql import functions as F

from offerlake.operators.candidates import find_candidates, range_candidates, text_candidates
from offerlake.operators.offers import lookup_offers, write_lookup
from offerlake.sources.messages import message_parts, parse_messages

MESSAGE = "id string, threadId string, internalDate string, labelIds array<string>, payload string"


def nested(levels, last):
    for _ in range(levels):
        last = '{"mimeType":"multipart/mixed","filename":"","parts":[' + last + "]}"
    return last


def test_parts_of_any_depth(spark):
    leaf = json.dumps({"mimeType": "text/plain", "filename": "", "body": {"data": "aGVsbG8"}})
    inner = json.dumps({"mimeType": "message/rfc822", "filename": "mail.eml", "parts": [json.loads(nested(20, leaf))]})
    rows = [("flat", leaf), ("eight", nested(8, leaf)), ("nine", nested(9, leaf)), ("forty", nested(40, leaf)), ("attached", nested(3, inner)), ("too", nested(120, leaf)), ("beyond", nested(3000, leaf)), ("bad", "{"), ("none", None)]
    messages = spark.createDataFrame([(i, "t", "5", ["L"], p) for i, p in rows], MESSAGE)
    parts = message_parts(messages, max_depth=100)
    counts = {r.message_id: r["count"] for r in parts.filter("not too_deep").groupBy("message_id").count().collect()}
    assert counts == {"flat": 1, "eight": 9, "nine": 10, "forty": 41, "attached": 25, "too": 100, "bad": 1}
    assert {r.message_id for r in parts.filter("too_deep").collect()} == {"too", "beyond"}
    assert parts.filter("message_id = 'attached' and mime_type = 'text/plain'").first().in_attachment
    deepest = parts.filter("message_id = 'forty'").orderBy(F.length("path").desc()).first()
    assert deepest.path == "0000." * 40 + "~" and deepest.mime_type == "text/plain"
    got = {r.message_id: (r.text, r.failed) for r in parse_messages(messages).collect()}
    assert got == {"flat": ("hello", False), "eight": ("hello", False), "nine": ("hello", False), "forty": ("hello", False), "attached": ("", False), "too": ("hello", False), "beyond": ("", True), "bad": ("", False), "none": ("", False)}


def test_ranges_give_what_the_scan_in_the_row_gives(spark):
    rng = random.Random(8)
    words = ["use code", "coupon code", "SAVE20", "X9", "a-b", "Teapot7", "with code", "promo code", "SPOON64", "kettle", "é", "\U0001f600", "12345", "OFF", "BIGSALE", "save15x"]
    rows = [(i, 3, 0, rng.choice(["text", "subject", "alt", "ocr"]), " ".join(rng.choices(words, k=rng.choice([0, 5, 60, 400])))) for i in range(60)]
    df = spark.createDataFrame(rows, "message_id long, surface_ord int, part_ord int, source string, text string")
    want = sorted(map(tuple, text_candidates(df).select("message_id", "surface_ord", "source", "position", "code", "normalized", "near", "score").collect()))
    got = range_candidates(df).select("message_id", "surface_ord", "source", "position", "code", "normalized", "near", "score")
    assert len(want) > 500 and sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    messages = spark.createDataFrame([(r[0], "subject SAVE20", r[4], "<p>use code HTML5X</p>") for r in rows], "message_id long, subject string, text string, html string")
    assert sorted(map(tuple, find_candidates(messages, longest=50).collect())) == sorted(map(tuple, find_candidates(messages).collect()))


def rows_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_lookup_reads_a_hundredth_of_the_table(spark, tmp_path):
    n = F.col("id")
    offers = spark.range(400_000).select(F.format_string("brand%05d", (n * 7919) % 5000).alias("brand_key"), F.sha2(n.cast("string"), 256).alias("normalized_code"), F.date_format(F.date_add(F.lit("2026-01-01"), (n % 300).cast("int")), "yyyy-MM-dd").alias("expiry"), F.array(F.lit("food")).alias("categories"))
    path = str(tmp_path / "offers")
    write_lookup(offers, path, files=16, block_bytes=1 << 17)
    table = spark.read.parquet(path)
    code = offers.filter("id = 777").first()
    for found, want in ((lookup_offers(table, brand="brand00042"), 80), (lookup_offers(table, code=code.normalized_code), 1), (lookup_offers(table, brand=code.brand_key, expires=(code.expiry, code.expiry)), None)):
        assert found.count() == want if want else found.count() >= 1
        assert rows_read(found) <= 4000
