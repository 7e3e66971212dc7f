"""How the extraction does: grouped counts over messages, candidates, calls and offers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_funnel(processed: DataFrame) -> DataFrame:
    """Messages by status and all together: n, with a code, seen by a model."""
    rows = processed.rollup("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_candidates") > 0).alias("with_code"), F.count_if(F.col("llm_processed")).alias("enriched"))
    return rows.withColumn("status", F.coalesce("status", F.lit("all")))


def gate_rate(gated: DataFrame, most: float = 0.4) -> DataFrame:
    """One row: messages, the share that passes the gate, and whether that is too many."""
    return gated.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("should_extract").cast("double")).alias("share")).withColumn("too_permissive", F.col("share") > most)


def blocklist_mining(candidates: DataFrame, confirmed: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` most frequent candidate codes (normalized, brand_key) that no model confirmed: words to block."""
    rest = candidates.join(confirmed.select("normalized").distinct(), "normalized", "left_anti")
    return rest.groupBy("normalized").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("brand_key").alias("brands")).orderBy(F.desc("n"), "normalized").limit(k)


def token_usage(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Tokens by provider and day of ``calls`` (provider, day, input_tokens, output_tokens), with their cost."""
    sums = calls.groupBy("provider", "day").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return sums.join(rates, "provider", "left").select("provider", "day", "input_tokens", "output_tokens", ((F.col("input_tokens") * F.col("input_rate") + F.col("output_tokens") * F.col("output_rate")) / 1e6).alias("cost"))


def review_share(offers: DataFrame) -> DataFrame:
    """By brand: offers, the share read in pictures, the share to review."""
    return offers.groupBy("brand_key").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("source") == "ocr").cast("double")).alias("ocr_share"), F.avg(F.col("needs_review").cast("double")).alias("review_share"))


def daily_sketches(candidates: DataFrame, day: str = "day", tracked: int = 10_000) -> DataFrame:
    """One row a day of unconfirmed candidates (normalized, brand_key, day): n, ``codes`` and ``brands`` as sketches to be stored.

    ``codes`` counts the most frequent codes, each too low by at most n / (0.75 * tracked) or so, and exactly where there are no more
    than 0.75 * tracked codes; ``brands`` estimates how many brands there are. Both are of bounded size and can be merged.
    """
    return candidates.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(normalized, {tracked})").alias("codes"), F.hll_sketch_agg("brand_key").alias("brands"))


def merged_sketches(daily: DataFrame, k: int = 50, tracked: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Of some days' sketches the ``k`` most frequent codes (normalized, n), and one row with n and the estimated number of brands.

    No candidate is read again: a longer span merges the rows of its days.
    """
    total = daily.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("brands")), F.lit(0)).alias("brands"))
    # grouped, as no sketch is there to be combined where there are no days
    codes = daily.groupBy(F.lit(1)).agg(F.expr(f"approx_top_k_combine(codes, {tracked})").alias("codes"))
    # all that the sketch tracks, as the estimate does not say which of equal counts it leaves out
    found = codes.select(F.explode(F.expr(f"approx_top_k_estimate(codes, {tracked})")).alias("c"))
    return found.select(F.col("c.item").alias("normalized"), F.col("c.count").alias("n")).orderBy(F.desc("n"), "normalized").limit(k), total
