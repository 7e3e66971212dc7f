"""The jobs on messages: list, leave out what is done, extract, ask the model, merge, commit; and what catches up after it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import visible_text
from ..functions.values import EXTRACTOR_VERSION
from ..operators.brand import brand_keys
from ..operators.candidates import find_candidates, gate, rank_candidates, regate_with_ocr
from ..operators.enrichment import build_prompts, enrichment_fallback, normalize_responses, run_logged_inference, select_for_enrichment, validate_responses
from ..operators.offers import KEY, build_offers, build_offers_from_extraction, drop_stale, merge_in_stretches, purge_expired
from ..operators.sync import classify_error, is_retryable, list_window, pending_messages, processed_status, route_failure, take_slice, update_ledger
from .tables import BUCKETS, bucket_of, commit_batch, compact, current, is_committed, written

LABEL = "CATEGORY_PROMOTIONS"
_LEDGER = "attempts int, next_at bigint, terminal boolean"


@dataclass(frozen=True)
class Model:
    """How to ask a model: see ``run_logged_inference``. ``provider`` names the shape of its responses."""

    call: Callable[[pd.Series], pd.DataFrame]
    log: str
    provider: str = "openai"
    name: str = ""
    slots: int = 8
    batch: int = 32


class Aborted(Exception):
    """A failure that ends a batch before anything of it is committed: the next one would meet it too."""


def _today(now_ms: int) -> Column:
    return F.to_date(F.timestamp_millis(F.lit(now_ms)))


def _candidates(read: DataFrame, ocr: Callable[[DataFrame], DataFrame] | None) -> tuple[DataFrame, DataFrame]:
    """The messages with ``ocr_text``, and the best candidates; pictures are read only of messages that have none without."""
    best = written(find_candidates(read))
    if ocr is None:
        return read.withColumn("ocr_text", F.lit("")), best
    bare = read.join(best.select("message_id").distinct(), "message_id", "left_anti")
    seen = written(ocr(bare).select("message_id", "ocr_text").filter("ocr_text <> ''"))
    return read.join(seen, "message_id", "left").withColumn("ocr_text", F.coalesce("ocr_text", F.lit(""))), written(regate_with_ocr(read, best, seen, seen))


def _answers(read: DataFrame, best: DataFrame, asked: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """What the model says of the messages ``asked``: sound details of candidates, and outcomes (message_id, error, retry_after_ms)."""
    texts = read.join(asked, "message_id", "left_semi").withColumn("visible", visible_text(F.col("html")))
    ranked = rank_candidates(best.join(asked, "message_id", "left_semi"))
    said = run_logged_inference(build_prompts(texts, ranked), model.call, model.log, model.name, model.slots, model.batch)
    said = written(said.withColumn("provider", F.lit(model.provider)))
    good = written(normalize_responses(said.filter("status = 200").select("message_id", "provider", "body")).select("message_id", "json", F.col("error").alias("unread")))
    details, unsound = validate_responses(good.filter("unread is null").select("message_id", "json"), best.select("message_id", "normalized", "code"))
    kind = F.when(F.col("status") != 200, classify_error(F.col("status"), F.coalesce("body", F.lit(""))))
    found = said.join(good.select("message_id", "unread"), "message_id", "left").join(unsound.select("message_id", F.col("error").alias("unsound")), "message_id", "left")
    return details, found.select("message_id", F.coalesce(kind, "unread", "unsound").alias("error"), "retry_after_ms")


def _enrich(spark: SparkSession, read: DataFrame, branded: DataFrame, best: DataFrame, asked: DataFrame, free: DataFrame, root: str, now_ms: int, version: int, model: Model) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, list[int]]:
    """Offers and states after the model, the messages to be asked again, and the ledger with the buckets of it that change."""
    details, outcomes = _answers(read, best, asked, model)
    jitter = 0.75 + F.pmod(F.xxhash64("message_id", F.lit(now_ms)), F.lit(1000)) / 2000
    outcomes = written(outcomes.withColumn("jitter", jitter))
    worst = outcomes.filter(route_failure(F.col("error"), F.lit(0)) == "abort").select("error").limit(1).collect()
    if worst:
        raise Aborted(f"the model's answer is an error of kind {worst[0][0]}")
    buckets = sorted(r[0] for r in outcomes.select(bucket_of("message_id")).distinct().collect())
    kept = current(spark, root, "ledger", buckets)
    if kept is None:
        kept = outcomes.select("message_id", *[F.lit(None).cast(part.split()[1]).alias(part.split()[0]) for part in _LEDGER.split(", ")]).limit(0)
    ledger = written(update_ledger(kept, outcomes, now_ms))
    given_up = ledger.select("message_id", F.col("terminal").alias("given_up"))
    error = F.when(is_retryable(F.col("error")) & F.coalesce("given_up", F.lit(False)), "exhausted").otherwise(F.col("error"))
    final = written(outcomes.join(given_up, "message_id", "left").select("message_id", error.alias("error")))
    mine = lambda offers: offers.withColumn("message_id", F.get("message_ids", F.lit(0)))
    offers, states = enrichment_fallback(mine(free), mine(build_offers_from_extraction(branded, details, best, version)), final)
    later = final.filter(is_retryable(F.col("error"))).select("message_id")
    return offers.join(later, "message_id", "left_anti").drop("message_id"), states, later, ledger, buckets


def _commit(pending: DataFrame, root: str, batch_id: int, version: int, complete: bool, now_ms: int, model: Model | None = None, ocr: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Extract, ask the model, fold into the offers of the same brands, commit.

    Messages whose bodies cannot be read are failed and those without the label ignored, without offers. Existing offers come before the new
    ones, which follow by date. Only buckets of the brands at hand are read and written, unless the scan is complete and nothing of
    it waits: then offers of other versions go, and with a model those that it has not seen, wherever they are. An offer's messages are rows of the
    table ``sources``.
    """
    spark = pending.sparkSession
    gone = F.coalesce(F.col("label") != LABEL, F.lit(True)) if "label" in pending.columns else F.lit(False)
    failed = F.coalesce("failed", F.lit(False)) if "failed" in pending.columns else F.lit(False)
    rows = written(pending.withColumns({"gone": gone, "failed": failed}))
    read, best = _candidates(rows.filter("not gone and not failed").drop("gone", "failed", "label"), ocr)
    branded = brand_keys(read)
    gated = written(select_for_enrichment(gate(read, best)))
    built, states, later = build_offers(branded, best, version), None, None
    replaced = {}
    if model is not None:
        built, states, later, ledger, held = _enrich(spark, read, branded, best, gated.filter("enrich").select("message_id"), built, root, now_ms, version, model)
        replaced["ledger"] = (ledger, "message_id", held)
    status = processed_status(F.col("gone"), F.coalesce(F.col("n_candidates") > 0, F.lit(False)), F.coalesce("should_extract", F.lit(False)), F.col("failed"))
    done = rows.select("message_id", "gone", "failed").join(gated, "message_id", "left")
    done = done.select("message_id", F.lit(version).alias("extractor_version"), status.alias("status"), F.coalesce("llm_processed", F.lit(True)).alias("llm_processed"))
    if model is not None:
        after = states.select("message_id", F.col("status").alias("then"), F.col("llm_processed").alias("seen"))
        done = done.join(later, "message_id", "left_anti").join(after, "message_id", "left").select("message_id", "extractor_version", F.coalesce("then", "status").alias("status"), F.coalesce("seen", "llm_processed").alias("llm_processed"))
    built = written(built)
    last = complete and (later is None or later.isEmpty()) and waiting(spark, root, now_ms) is None
    buckets = list(range(BUCKETS)) if last else sorted(r[0] for r in built.select(bucket_of("brand_key")).distinct().collect())
    # a null message stands for those of an offer that is there, which are rows already
    fields = [*KEY, *[c for c in built.columns if c not in KEY]]
    arrivals = built.select(*fields).withColumn("seq", F.struct(F.lit(1).alias("late"), "source_date", F.get("message_ids", F.lit(0)).cast("string").alias("id")))
    offers, sources = current(spark, root, "offers", buckets), current(spark, root, "sources", buckets)
    kind = built.schema["message_ids"].dataType
    if offers is not None:
        first = F.struct(F.lit(0).alias("late"), "source_date", F.lit("").alias("id"))
        arrivals = offers.withColumn("message_ids", F.array(F.lit(None)).cast(kind)).select(*fields).withColumn("seq", first).unionByName(arrivals)
    merged, found = merge_in_stretches(arrivals)
    merged = purge_expired(drop_stale(merged, version, model is not None) if last else merged, _today(now_ms))
    merged, found = written(merged), written(found.select(*KEY, "message_id", F.col("first_seq.source_date").alias("seen")))
    listed = found.filter("message_id is not null")
    if sources is not None:
        listed = sources.join(found.filter("message_id is null").select(*KEY), KEY, "left_semi").unionByName(listed).groupBy(*KEY, "message_id").agg(F.min("seen").alias("seen"))
    replaced |= {"offers": (merged, "brand_key", buckets), "sources": (listed.join(merged.select(*KEY), KEY, "left_semi"), "brand_key", buckets)}
    commit_batch({"processed": done.withColumn("batch", F.lit(batch_id))}, replaced, root, batch_id)


def waiting(spark: SparkSession, root: str, now_ms: int, due: bool = False) -> DataFrame | None:
    """(message_id, next_at) of the ledger that wait for their next attempt, or those whose time has come; None if nothing does."""
    ledger = current(spark, root, "ledger")
    if ledger is None:
        return None
    rows = ledger.filter(~F.col("terminal") & ((F.col("next_at") > now_ms) != F.lit(due))).select("message_id", "next_at")
    return None if rows.isEmpty() else rows


def processed_messages(spark, root: str) -> DataFrame | None:
    """The completion cache: the last row of each message."""
    rows = current(spark, root, "processed")
    if rows is None:
        return None
    last = F.max_by(F.struct("extractor_version", "status", "llm_processed"), "batch").alias("p")
    return rows.groupBy("message_id").agg(last).select("message_id", "p.*")


def compact_processed(spark: SparkSession, root: str, batch_id: int) -> None:
    """One folder instead of one for each batch, with the last row of each message."""
    rows = processed_messages(spark, root)
    if rows is not None:
        compact(spark, root, "processed", batch_id, rows.withColumn("batch", F.lit(batch_id)))


def _pending(listed: DataFrame, root: str, version: int, now_ms: int, model: Model | None) -> DataFrame:
    """What is not done yet and does not wait; with a model also what it has not seen."""
    spark = listed.sparkSession
    processed, later = processed_messages(spark, root), waiting(spark, root, now_ms)
    rows = listed if processed is None else pending_messages(listed, processed, version, model is not None)
    return rows if later is None else rows.join(later.select("message_id"), "message_id", "left_anti")


def run_backfill(messages: DataFrame, root: str, batch_id: int, now_ms: int, days: int = 45, version: int = EXTRACTOR_VERSION, complete: bool = True, model: Model | None = None, ocr: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process what the window has and the completion cache lacks; offers, cache and ledger are committed together.

    A new version finds nothing in the cache that is valid, so that all is read again; old offers stay in place until
    a complete scan drops them. A batch number that is committed is not run again.
    """
    spark = messages.sparkSession
    if is_committed(spark, root, batch_id):
        return
    _commit(_pending(list_window(messages, now_ms, days), root, version, now_ms, model), root, batch_id, version, complete, now_ms, model, ocr)


def run_slice(messages: DataFrame, ids: DataFrame, root: str, batch_id: int, now_ms: int, budget: int, days: int = 45, version: int = EXTRACTOR_VERSION, model: Model | None = None, ocr: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """At most ``budget`` messages: first the new ones (``ids``: message_id), then those of the window, the latest first."""
    if is_committed(messages.sparkSession, root, batch_id):
        return
    fresh = messages.join(ids.select("message_id").distinct(), "message_id", "left_semi")
    both = fresh.withColumn("fresh", F.lit(True)).unionByName(list_window(messages, now_ms, days).join(ids, "message_id", "left_anti").withColumn("fresh", F.lit(False)))
    order = F.struct("fresh", "internal_date")
    some = take_slice(_pending(both, root, version, now_ms, model).withColumn("order", order), budget, "order").drop("fresh", "order")
    _commit(some, root, batch_id, version, False, now_ms, model, ocr)


def purge(spark: SparkSession, root: str, batch_id: int, now_ms: int) -> None:
    """Offers that expired too long ago go, and their sources; only buckets that have any are written."""
    offers = current(spark, root, "offers")
    if offers is None or is_committed(spark, root, batch_id):
        return
    kept = purge_expired(offers, _today(now_ms))
    old = offers.join(kept.select(*KEY), KEY, "left_anti")
    buckets = sorted(r[0] for r in old.select(bucket_of("brand_key")).distinct().collect())
    if buckets:
        kept = written(purge_expired(current(spark, root, "offers", buckets), _today(now_ms)))
        sources = current(spark, root, "sources", buckets).join(kept.select(*KEY), KEY, "left_semi")
        commit_batch({}, {"offers": (kept, "brand_key", buckets), "sources": (sources, "brand_key", buckets)}, root, batch_id)


def process_ids(messages: DataFrame, ids: DataFrame, root: str, batch_id: int, now_ms: int, version: int = EXTRACTOR_VERSION, model: Model | None = None, ocr: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process the messages of ``ids`` (message_id) that are not done, whether or not they are in the window."""
    if is_committed(messages.sparkSession, root, batch_id):
        return
    wanted = ids.select(F.col("message_id").cast(messages.schema["message_id"].dataType).alias("message_id")).distinct()
    _commit(_pending(messages.join(wanted, "message_id", "left_semi"), root, version, now_ms, model), root, batch_id, version, False, now_ms, model, ocr)


def catch_up(history: DataFrame, messages: DataFrame, root: str, batch_id: int, cursor: int | None, now_ms: int, days: int = 45, version: int = EXTRACTOR_VERSION, model: Model | None = None, ocr: Callable[[DataFrame], DataFrame] | None = None) -> int | None:
    """Process the messages of the changes (seq, message_id) after ``cursor``; gives the next cursor.

    Where changes after the cursor are no longer kept, or there is no cursor yet, the window is listed again instead:
    the completion cache keeps that cheap, and the result is the same. The next cursor is read before anything is
    listed, so that what arrives meanwhile is still ahead of it.
    """
    spark = messages.sparkSession
    kept = history.agg(F.min("seq").alias("oldest"), F.max("seq").alias("newest")).first()
    if cursor is None or (kept["oldest"] is not None and kept["oldest"] > cursor + 1):
        run_backfill(messages, root, batch_id, now_ms, days, version, model=model, ocr=ocr)
    else:
        process_ids(messages, history.filter(F.col("seq") > cursor), root, batch_id, now_ms, version, model, ocr)
    return cursor if kept["newest"] is None else kept["newest"]
