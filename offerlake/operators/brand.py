"""Brands: the registrable part of a sender's domain, by a longest-suffix join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim
from ..functions.values import SUFFIX_RULES


def sender_domain(sender: Column) -> Column:
    address = F.coalesce(F.nullif(F.regexp_extract(sender, "<([^>]+)>", 1), F.lit("")), sender)
    return F.regexp_replace(F.lower(F.element_at(F.split(address, "@", -1), -1)), r"[>\s]+\z", "")


def display_brand(sender: Column, brand_key: Column) -> Column:
    name = trim(F.coalesce(F.nullif(F.regexp_extract(sender, r'\A\s*"([^"]+)"\s*<', 1), F.lit("")), F.regexp_extract(sender, r"\A\s*([^<]+?)\s*<", 1)))
    titled = F.concat(F.upper(F.substring(brand_key, 1, 1)), F.substring(brand_key, F.lit(2), F.length(brand_key)))
    return F.when((name != "") & ~F.contains(name, F.lit("@")), name).when(brand_key != "", titled).otherwise(sender)


def suffix_labels(domains: DataFrame, rules: DataFrame) -> DataFrame:
    """(domain, n_suffix): how many labels the public suffix of each distinct domain has.

    Every suffix of a domain meets the rules (rule) by equality, with its first label also as a star. An exception
    takes one label less than it has and wins; else the longest rule does; with none the last label is it.
    """
    labels = F.split(F.regexp_replace(F.col("domain"), r"\.+\z", ""), r"\.", -1)
    ends = domains.select("domain").distinct().withColumn("labels", labels).select("domain", "labels", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("k"))
    tail = F.array_join(F.expr("slice(labels, -k, k)"), ".")
    star = F.concat_ws(".", F.lit("*"), F.array_join(F.expr("slice(slice(labels, -k, k), 2, k)"), "."))
    ends = ends.select("domain", "k", F.explode(F.array(tail, star, F.concat(F.lit("!"), tail))).alias("rule"))
    met = ends.join(rules, "rule")
    best = F.max_by(F.when(F.startswith(F.col("rule"), F.lit("!")), F.col("k") - 1).otherwise(F.col("k")), F.struct(F.startswith(F.col("rule"), F.lit("!")), "k"))
    return domains.select("domain").distinct().join(met.groupBy("domain").agg(best.alias("n")), "domain", "left").select("domain", F.coalesce("n", F.lit(1)).alias("n_suffix"))


def brand_keys(messages: DataFrame, rules: list[str] | DataFrame = SUFFIX_RULES) -> DataFrame:
    """``messages`` (with sender) and sender_domain, brand_key, brand.

    Domains are looked up once each. A domain that is itself a public suffix, an address number or no domain gives
    the lower-cased sender address instead.
    """
    if isinstance(rules, list):
        rules = messages.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    rows = messages.withColumn("sender_domain", sender_domain(F.col("sender")))
    known = rows.select(F.col("sender_domain").alias("domain")).filter(F.col("domain").rlike(r"\A[^\s@/:]+\z") & ~F.col("domain").rlike(r"\A[0-9.]+\z"))
    parts = F.split(F.regexp_replace(F.col("domain"), r"\.+\z", ""), r"\.", -1)
    keys = suffix_labels(known, rules).select(F.col("domain").alias("sender_domain"), F.get(parts, F.size(parts) - F.col("n_suffix") - 1).alias("registrable"))
    rows = rows.join(keys, "sender_domain", "left")
    address = F.lower(trim(F.coalesce(F.nullif(F.regexp_extract("sender", "<([^>]+)>", 1), F.lit("")), F.col("sender"))))
    rows = rows.withColumn("brand_key", F.coalesce(F.nullif(F.lower("registrable"), F.lit("")), address)).drop("registrable")
    return rows.withColumn("brand", display_brand(F.col("sender"), F.col("brand_key")))
