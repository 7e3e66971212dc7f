"""The fold over stretches gives what the fold of whole keys gives, whatever the order of dates."""

import random

import pytest
from pyspark.sql import functions as F

from offerlake.operators.offers import KEY, merge_in_stretches, merge_offers

SCHEMA = """brand_key string, normalized_code string, seq long, source_date long, extractor_version int, llm_processed boolean, code string, discount string, currency string, min_spend double,
max_discount double, expiry string, single_use boolean, new_users_only boolean, app_only boolean, conditions string, source string, needs_review boolean, categories array<string>, message_ids array<long>"""


def sightings(n, keys, states, seed):
    rng = random.Random(seed)
    maybe = lambda x: x if rng.random() < 0.3 else None
    rows = []
    for seq in rng.sample(range(10 * n), n):
        key = 0 if rng.random() < 0.4 else rng.randrange(keys)
        version, seen = rng.choice(states)
        rows.append((f"b{key % 3}", f"C{key}", seq, rng.randrange(40), version, seen, f"c{seq % 9}", maybe(f"{seq}%"), maybe("INR"), maybe(float(seq)), maybe(2.0), maybe(f"2026-{seq % 12}"), maybe(True), rng.random() < 0.1, rng.random() < 0.1, rng.choice(["", "", "x", f"y{seq}"]), rng.choice(["text", "text", "ocr", "link" if key % 2 else "text"]), rng.random() < 0.9, [f"k{rng.randrange(5)}" for _ in range(rng.randrange(3))], [seq, seq % 7]))
    return rows


def flat(df, names):
    out = df.select(*[F.col(c).cast("string") for c in names])
    return sorted(map(str, out.collect()))


@pytest.mark.parametrize("n,keys,states,parts", [(900, 12, [(5, False)], 8), (900, 12, [(5, False)] * 200 + [(4, False), (5, True)], 13), (300, 5, [(4, False), (5, True), (5, False)], 5), (60, 60, [(5, True)], 1)])
def test_equals_the_fold_of_whole_keys(spark, n, keys, states, parts):
    rows = spark.createDataFrame(sightings(n, keys, states, n + parts), SCHEMA).repartition(3)
    want = merge_offers(rows)
    merged, sources = merge_in_stretches(rows, parts)
    names = [c for c in want.columns if c != "message_ids"]
    assert sorted(merged.columns) == sorted(names) and flat(merged, names) == flat(want, names)
    listed = want.select(*KEY, F.explode("message_ids").alias("message_id"))
    assert flat(sources, [*KEY, "message_id"]) == flat(listed, [*KEY, "message_id"])


def test_a_key_of_a_third_of_all_rows_lies_in_many_stretches(spark):
    rows = spark.createDataFrame(sightings(2000, 30, [(5, False)], 1), SCHEMA)
    stretches = rows.repartitionByRange(12, *KEY, "seq").withColumn("stretch", F.spark_partition_id()).filter("normalized_code = 'C0'")
    assert stretches.select("stretch").distinct().count() >= 4


def test_no_sightings(spark):
    merged, sources = merge_in_stretches(spark.createDataFrame([], SCHEMA), 4)
    assert merged.count() == sources.count() == 0
