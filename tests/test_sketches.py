"""Sketches of days against exact counts of all days."""

from pyspark.sql import functions as F

from offerlake.operators.diagnostics import blocklist_mining, daily_sketches, merged_sketches


def rows(spark):
    n = F.col("id")
    # a few codes that are frequent and thousands that are there once or twice
    code = F.when(n % 3 > 0, F.concat(F.lit("HOT"), F.floor(F.sqrt(n % 400)).cast("string"))).otherwise(F.concat(F.lit("RARE"), (n % 9001).cast("string")))
    return spark.range(60_000).select(code.alias("normalized"), (n * 7 % 1234).alias("brand_key"), (n % 31).alias("day"))


def test_merged_days_are_near_to_exact_counts(spark):
    found = rows(spark).repartition(5)
    exact = {r.normalized: r.n for r in blocklist_mining(found, found.limit(0), 20).collect()}
    for tracked in (20_000, 2_000):
        codes, total = merged_sketches(daily_sketches(found, tracked=tracked), 20, tracked)
        got = {r.normalized: r.n for r in codes.collect()}
        bound = 0 if tracked == 20_000 else 60_000 / (0.75 * tracked)
        assert got.keys() == exact.keys() and all(abs(got[c] - n) <= bound for c, n in exact.items())
        one = total.first()
        assert one.n == 60_000 and abs(one.brands - 1234) <= 0.05 * 1234


def test_a_span_of_days_needs_only_their_rows(spark):
    found = rows(spark)
    daily = daily_sketches(found)
    part = {r.normalized: r.n for r in merged_sketches(daily.filter("day < 7"), 10)[0].collect()}
    want = {r.normalized: r.n for r in blocklist_mining(found.filter("day < 7"), found.limit(0), 10).collect()}
    assert part == want


def test_no_days(spark):
    codes, total = merged_sketches(daily_sketches(rows(spark).limit(0)))
    assert codes.collect() == [] and total.first().asDict() == {"n": 0, "brands": 0}
