"""Offers: built from candidates, merged by brand and code, pruned, looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import days_left, retention_cutoff
from ..functions.values import EXTRACTOR_VERSION
from ..jobs.tables import written

KEY = ["brand_key", "normalized_code"]
#: Details whose null falls back to the older sighting.
FALLBACK = ["discount", "currency", "min_spend", "max_discount", "expiry", "single_use"]
EITHER = ["new_users_only", "app_only"]
#: Fixed value: where the mail client shows a thread.
THREADS = "https://mail.google.com/mail/u/0/#all/"


def stored_source(source: Column) -> Column:
    return F.when(source.isin("link", "ocr"), source).otherwise("text")


def build_offers(messages: DataFrame, candidates: DataFrame, version: int = EXTRACTOR_VERSION) -> DataFrame:
    """Offers that need no model: candidates of links and image texts, one a message and code.

    ``messages`` has message_id, thread_id, sender, sender_domain, subject, internal_date, brand_key, brand;
    ``candidates`` the best of each message and code.
    """
    found = candidates.filter(F.col("source").isin("link", "alt")).select("message_id", "code", F.col("normalized").alias("normalized_code"), "source")
    return found.join(messages, "message_id").select(
        "brand_key", "normalized_code", "code", "brand", "sender_domain", F.lit(version).alias("extractor_version"), F.lit(False).alias("llm_processed"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("discount", "string"), ("currency", "string"), ("min_spend", "double"), ("max_discount", "double"), ("expiry", "string"), ("single_use", "boolean"))],
        F.lit(False).alias("new_users_only"), F.lit(False).alias("app_only"), F.array().cast("array<string>").alias("categories"), F.lit("").alias("conditions"),
        stored_source(F.col("source")).alias("source"), (F.col("source") != "link").alias("needs_review"), F.array("message_id").alias("message_ids"),
        "thread_id", "sender", "subject", F.col("internal_date").alias("source_date"),
    )


def build_offers_from_extraction(messages: DataFrame, extracted: DataFrame, candidates: DataFrame, version: int = EXTRACTOR_VERSION) -> DataFrame:
    """Offers with a model's details (message_id, normalized_code, code and the details), joined to their candidates."""
    sources = candidates.select("message_id", F.col("normalized").alias("normalized_code"), F.col("source").alias("found_in"))
    rows = extracted.join(sources, ["message_id", "normalized_code"], "left").join(messages, "message_id")
    found = F.coalesce("found_in", F.lit("text"))
    return rows.select(
        *KEY, "code", "brand", "sender_domain", F.lit(version).alias("extractor_version"), F.lit(True).alias("llm_processed"), *FALLBACK, *EITHER, "categories", "conditions",
        stored_source(found).alias("source"), (found == "ocr").alias("needs_review"), F.array("message_id").alias("message_ids"), "thread_id", "sender", "subject", F.col("internal_date").alias("source_date"),
    )


def merge_offers(sightings: DataFrame) -> DataFrame:
    """One row a brand and code: its sightings folded in order of arrival (``seq``), exactly.

    Another version or model state replaces what is there. Otherwise the later date (the later arrival of equal
    ones) gives the fields, its nulls fall back to the other's, flags are or-ed, lists united in order,
    needs_review and-ed, and a link once seen stays the source. The fold needs a key's sightings together;
    ``merge_offers_by_date`` does not.
    """
    fields = [c for c in sightings.columns if c not in (*KEY, "seq")]
    kind = sightings.select(F.struct(*fields)).schema[0].dataType.simpleString()
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("v"))))
    return sightings.groupBy(*KEY).agg(F.aggregate(ordered, F.lit(None).cast(kind), lambda a, x: _fold(fields, a, x["v"])).alias("m")).select(*KEY, "m.*")


def _fold(fields: list[str], a: Column, x: Column) -> Column:
    newer = x["source_date"] >= a["source_date"]

    def pick(f: str) -> Column:
        new, old = F.when(newer, x[f]).otherwise(a[f]), F.when(newer, a[f]).otherwise(x[f])
        if f in FALLBACK:
            return F.coalesce(new, old)
        if f in EITHER:
            return a[f] | x[f]
        if f in ("categories", "message_ids"):
            return F.array_distinct(F.concat(a[f], x[f]))
        if f == "conditions":
            return F.when(new != "", new).otherwise(old)
        if f == "source":
            return F.when((a[f] == "link") | (x[f] == "link"), "link").otherwise(new)
        return a[f] & x[f] if f == "needs_review" else new

    other = a.isNull() | (a["extractor_version"] != x["extractor_version"]) | (a["llm_processed"] != x["llm_processed"])
    return F.when(other, x).otherwise(F.struct(*[pick(f).alias(f) for f in fields]))


def last_run(sightings: DataFrame) -> DataFrame:
    """The sightings of each key after the last change of version or model state, without a window over the key."""
    state = F.struct("extractor_version", "llm_processed")
    final = sightings.groupBy(*KEY).agg(F.max_by(state, "seq").alias("final"))
    others = sightings.join(final, KEY).filter(state != F.col("final")).groupBy(*KEY).agg(F.max("seq").alias("until"))
    return sightings.join(others, KEY, "left").filter(F.col("until").isNull() | (F.col("seq") > F.col("until"))).drop("until")


def merge_offers_by_date(sightings: DataFrame) -> DataFrame:
    """Like ``merge_offers`` where sightings arrive in order of date, with partial aggregation; without message_ids.

    Each field comes from the latest sighting of the last run that has it, so a key's sightings need not meet in
    one task: a code in millions of messages is summed before the shuffle. The messages of an offer, whose
    number has no bound, are rows of ``offer_sources``.
    """
    last = last_run(sightings)
    at = F.struct("source_date", "seq")
    fields = [c for c in sightings.columns if c not in (*KEY, "seq", "message_ids", "categories")]

    def pick(f: str) -> Column:
        if f in FALLBACK:
            return F.max_by(f, F.when(F.col(f).isNotNull(), at))
        if f in EITHER:
            return F.bool_or(f)
        if f == "conditions":
            return F.coalesce(F.max_by(f, F.when(F.col(f) != "", at)), F.lit(""))
        if f == "source":
            return F.when(F.bool_or(F.col(f) == "link"), "link").otherwise(F.max_by(f, at))
        return F.bool_and(f) if f == "needs_review" else F.max_by(f, at)

    merged = last.groupBy(*KEY).agg(*[pick(f).alias(f) for f in fields])
    if "categories" not in sightings.columns:
        return merged
    firsts = last.select(*KEY, "seq", F.posexplode("categories").alias("pos", "category")).groupBy(*KEY, "category").agg(F.min(F.struct("seq", "pos")).alias("at"))
    listed = firsts.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "category"))), lambda x: x["category"]).alias("categories"))
    return merged.join(listed, KEY, "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def merge_in_stretches(sightings: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``merge_offers``, exactly, and (brand_key, normalized_code, message_id, first_seq): the messages of each offer as rows.

    The order of arrival is cut into ``parts`` stretches (default: as many as shuffle partitions), a key of many sightings into many of
    them. Each stretch is summed up by its last state, its last sighting of another state and its latest date; a window over a
    key's stretches composes these, so that every sighting knows whether it is of the last run and whether its date was the latest
    when it came. With that the fold is an aggregation of one row each, combined before the shuffle: a field that may be null is that of
    the last such record that has it, or else of the first sighting that has it. No task has more of a key than a
    stretch. Arrivals of the same ``seq`` are ordered by their fields; flags, lists and conditions are not null.
    """
    fields = [c for c in sightings.columns if c not in (*KEY, "seq")]
    parts = parts or int(sightings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by, part = [*KEY, "stretch"], Window.partitionBy(*KEY).orderBy("stretch")
    whole, before = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), part.rowsBetween(Window.unboundedPreceding, -1)
    ordered = sightings.select(*KEY, "seq", F.struct(*fields).alias("v")).repartitionByRange(parts, *KEY, "seq").withColumn("stretch", F.spark_partition_id())
    inside = Window.partitionBy(*by).orderBy("seq", "v")
    # written, as ranges are found by sampling and must be the same in all that follows
    rows = written(written(ordered).withColumn("at", F.struct("stretch", F.row_number().over(inside).alias("pos"))))
    state, date = F.struct("v.extractor_version", "v.llm_processed"), F.col("v.source_date")
    heads = rows.groupBy(*by).agg(F.max_by(state, "at").alias("state")).select(*by, F.last("state").over(whole).alias("final"))
    ends = rows.join(heads, by).groupBy(*by).agg(F.max(F.when(state != F.col("final"), F.col("at"))).alias("end")).select(*by, F.max("end").over(whole).alias("end"))
    run = rows.join(ends, by).filter(F.col("end").isNull() | (F.col("at") > F.col("end"))).drop("end")
    tops = run.groupBy(*by).agg(F.max(date).alias("top")).select(*by, F.max("top").over(before).alias("top"))
    earlier = F.greatest("top", F.max(date).over(Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)))
    run = written(run.join(tops, by).select(*KEY, "seq", "at", "v.*", F.coalesce(F.col("source_date") >= earlier, F.lit(True)).alias("record")))
    latest = F.struct("source_date", "at")

    def pick(f: str) -> Column:
        has = F.col(f) != "" if f == "conditions" else F.col(f).isNotNull()
        if f in FALLBACK or f == "conditions":
            found = F.coalesce(F.max_by(f, F.when(F.col("record") & has, F.col("at"))), F.min_by(f, F.when(has, F.col("at"))))
            return F.coalesce(found, F.lit("")) if f == "conditions" else found
        if f in EITHER:
            return F.bool_or(f)
        if f == "source":
            return F.when(F.bool_or(F.col(f) == "link"), "link").otherwise(F.max_by(f, latest))
        return F.bool_and(f) if f == "needs_review" else F.max_by(f, latest)

    # a single sighting keeps its list as it is
    only = [F.when(F.count(F.lit(1)) == 1, F.first("categories")).alias("only")] if "categories" in fields else []
    merged = run.groupBy(*KEY).agg(*[pick(f).alias(f) for f in fields if f not in ("categories", "message_ids")], *only)
    if only:
        firsts = run.select(*KEY, "at", F.posexplode("categories").alias("n", "category")).groupBy(*KEY, "category").agg(F.min(F.struct("at", "n")).alias("first"))
        listed = firsts.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "category"))), lambda x: x["category"]).alias("categories"))
        merged = merged.join(listed, KEY, "left").withColumn("categories", F.coalesce("only", "categories", F.array().cast("array<string>"))).drop("only")
    sources = run.select(*KEY, "seq", F.explode("message_ids").alias("message_id")).groupBy(*KEY, "message_id").agg(F.min("seq").alias("first_seq"))
    return merged, sources


def offer_sources(sightings: DataFrame) -> DataFrame:
    """(brand_key, normalized_code, message_id, first_seq) of the last run: an offer's messages as rows."""
    rows = last_run(sightings).select(*KEY, "seq", F.explode("message_ids").alias("message_id"))
    return rows.groupBy(*KEY, "message_id").agg(F.min("seq").alias("first_seq"))


def drop_stale(offers: DataFrame, version: int = EXTRACTOR_VERSION, require_llm: bool = False) -> DataFrame:
    kept = offers.filter(F.col("extractor_version") == version)
    return kept.filter("llm_processed") if require_llm else kept


def purge_expired(offers: DataFrame, today: Column, grace_days: int = 30) -> DataFrame:
    """Without what expired more than ``grace_days`` ago; dates compare as text, as they are stored."""
    return offers.filter(F.col("expiry").isNull() | (F.col("expiry") >= retention_cutoff(today, grace_days)))


def active_offers(offers: DataFrame, today: Column) -> DataFrame:
    left = days_left(F.col("expiry"), today)
    return offers.filter(left.isNull() | (left >= 0))


def offer_key(brand_key: Column, code: Column) -> Column:
    return F.to_json(F.array(brand_key, code))


def thread_url(thread_id: Column, base: str = THREADS) -> Column:
    """The address that opens the newest message that supports an offer."""
    return F.concat(F.lit(base), thread_id.cast("string"))


def lookup_offers(offers: DataFrame, brand: str | None = None, code: str | None = None, expires: tuple[str, str] | None = None, category: str | None = None) -> DataFrame:
    if brand is not None:
        offers = offers.filter(F.col("brand_key") == brand)
    if code is not None:
        offers = offers.filter(F.col("normalized_code") == code)
    if expires is not None:
        offers = offers.filter(F.col("expiry").between(*expires))
    return offers if category is None else offers.filter(F.array_contains("categories", category))


def write_lookup(offers: DataFrame, path: str, files: int | None = None, block_bytes: int = 1 << 20) -> None:
    """Offers laid out for ``lookup_offers``: by ranges of brand, in order of brand and expiry, with Bloom filters of codes.

    A lookup by brand opens the row groups whose range has it, one by code those whose filter lets it through, and one by
    expiry those whose dates meet; a row group has about ``block_bytes``. The table is written anew by a merge, as Parquet is not changed in place.
    """
    files = files or max(1, int(offers.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = offers.repartitionByRange(files, "brand_key", "expiry", "normalized_code").sortWithinPartitions("brand_key", "expiry", "normalized_code")
    options = {"parquet.bloom.filter.enabled#normalized_code": "true", "parquet.bloom.filter.max.bytes": str(1 << 17), "parquet.bloom.filter.adaptive.enabled": "true", "parquet.block.size": str(block_bytes), "parquet.block.size.row.check.min": "1000"}
    rows.write.options(**options).parquet(path)
