"""Incremental work: the window, the completion cache, retries and progress. ``now`` and jitter are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import EXTRACTOR_VERSION

BASE_DELAY, MAX_DELAY, MAX_ATTEMPTS = 30_000, 900_000, 4
RETRYABLE = ("rate-limit", "network", "server")


def clamp_days(days: float | None) -> int:
    """Whole days from 1 to 365; 45 if not given."""
    return 45 if days is None else min(365, max(1, int(days)))


def list_window(messages: DataFrame, now_ms: int, days: float | None = None, label: str = "CATEGORY_PROMOTIONS") -> DataFrame:
    """Messages (with label and internal_date) of the label since ``days`` ago. Both conditions reach the scan."""
    return messages.filter((F.col("label") == label) & (F.col("internal_date") >= now_ms - clamp_days(days) * 86_400_000))


def feed_ids(history: DataFrame) -> DataFrame:
    """Message ids of change records (messages_added, labels_added: arrays), nulls dropped, each once."""
    both = F.concat(F.coalesce("messages_added", F.array().cast("array<string>")), F.coalesce("labels_added", F.array().cast("array<string>")))
    return history.select(F.explode(both).alias("message_id")).filter("message_id is not null").dropDuplicates(["message_id"])


def pending_messages(listed: DataFrame, processed: DataFrame, version: int = EXTRACTOR_VERSION, model: bool = False) -> DataFrame:
    """Listed messages without a valid row in ``processed`` (message_id, extractor_version, status, llm_processed).

    With a model, rows with candidates that it has not seen are not valid. The filter on the small side comes
    first; both sides shuffle on message_id, or not at all where they are bucketed by it.
    """
    valid = processed.filter(F.col("extractor_version") == version)
    if model:
        valid = valid.filter(~((F.col("status") == "candidates") & ~F.col("llm_processed")))
    return listed.join(valid.select("message_id"), "message_id", "left_anti")


def take_slice(pending: DataFrame, budget: int, order: str = "internal_date") -> DataFrame:
    """At most ``budget`` messages, the newest first: the bounded work of one trigger."""
    return pending.orderBy(F.desc(order), "message_id").limit(budget)


def processed_status(label_gone: Column, has_candidates: Column, should_extract: Column, failed: Column) -> Column:
    return F.when(failed, "failed").when(label_gone, "ignored").when(has_candidates | should_extract, "candidates").otherwise("no-code")


def classify_error(status: Column, body: Column) -> Column:
    """The kind of a failed call by its status, and for 400 by what its body names."""
    model = (status == 404) | ((status == 400) & body.rlike(r"(?i)(?<![A-Za-z0-9_])(model|unsupported parameter)(?![A-Za-z0-9_])"))
    return F.when(status.isin(401, 403), "auth").when(status == 429, "rate-limit").when(status == 408, "network").when(model, "model").when(status >= 500, "server").otherwise("schema")


def is_retryable(kind: Column) -> Column:
    return kind.isin(*RETRYABLE)


def route_failure(kind: Column, mail_status: Column) -> Column:
    """abort (the batch must not go on), retry, or terminal (recorded as failed)."""
    mail = mail_status.between(400, 499) & ~mail_status.isin(404, 408, 429)
    return F.when(kind.isin("auth", "model") | mail, "abort").when(is_retryable(kind) | mail_status.isin(408, 429) | (mail_status >= 500), "retry").otherwise("terminal")


def backoff(attempt: Column, most: int | None = None) -> Column:
    delay = F.lit(float(BASE_DELAY)) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)))
    return delay if most is None else F.least(delay, F.lit(float(most)))


def batch_retry_delay(attempt: Column, status: Column, reason: Column) -> Column:
    """Milliseconds until the whole batch runs again; null for failures that waiting does not mend."""
    limited = F.lower(F.regexp_replace(reason, "[_-]", "")).isin("ratelimitexceeded", "userratelimitexceeded")
    retry = status.isin(408, 429) | (status >= 500) | ((status == 403) & F.coalesce(limited, F.lit(False)))
    return F.when(retry, backoff(attempt, MAX_DELAY).cast("bigint"))


def update_ledger(ledger: DataFrame, outcomes: DataFrame, now_ms: int) -> DataFrame:
    """The retry ledger (message_id, attempts, next_at, terminal) after a batch.

    ``outcomes`` has message_id, error (null: success), retry_after_ms, jitter. A success clears the row; a
    retryable failure waits 30 s doubled each time, times the jitter, or as long as the provider says, at most four
    times; any other is terminal. Rows without an outcome stay.
    """
    both = ledger.alias("l").join(outcomes.withColumn("seen", F.lit(True)).alias("o"), "message_id", "full_outer")
    attempts = F.coalesce("l.attempts", F.lit(0)) + 1
    again = is_retryable(F.col("o.error")) & (attempts <= MAX_ATTEMPTS)
    wait = F.greatest(backoff(attempts) * F.col("o.jitter"), F.coalesce("o.retry_after_ms", F.lit(0)).cast("double")).cast("bigint")
    fresh = F.col("o.seen").isNotNull()
    rows = both.filter(~fresh | F.col("o.error").isNotNull()).select(
        "message_id",
        F.when(fresh, attempts).otherwise(F.col("l.attempts")).alias("attempts"),
        F.when(fresh, F.when(again, F.lit(now_ms) + wait)).otherwise(F.col("l.next_at")).alias("next_at"),
        F.when(fresh, ~again).otherwise(F.col("l.terminal")).alias("terminal"),
    )
    return rows


def progress(processed: DataFrame, ledger: DataFrame, listed: DataFrame | None = None, version: int = EXTRACTOR_VERSION, model: bool = False) -> DataFrame:
    """One row: processed, with_candidates, failed, waiting, next_at; with ``listed`` messages also total, skipped (of them, done before) and remaining."""
    done = processed.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("status") == "candidates").alias("with_candidates"), F.count_if(F.col("status") == "failed").alias("failed"))
    waiting = ledger.filter(~F.col("terminal")).agg(F.count(F.lit(1)).alias("waiting"), F.min("next_at").alias("next_at"))
    out = done.crossJoin(waiting)  # one row each
    if listed is None:
        return out
    total = listed.agg(F.count(F.lit(1)).alias("total"))
    left = pending_messages(listed, processed, version, model).agg(F.count(F.lit(1)).alias("remaining"))
    return out.crossJoin(total).crossJoin(left).withColumn("skipped", F.col("total") - F.col("remaining"))


def retry_after_ms(headers: Column, now_ms: int) -> Column:
    """The longest wait that a map of lower-case response headers asks for; null if none does."""
    seconds = F.try_element_at(headers, F.lit("retry-after"))
    plain = F.when(seconds.rlike(r"\A\s*[+-]?[0-9.]+\s*\z"), F.greatest(F.lit(0.0), seconds.cast("double") * 1000))
    later = lambda wait: F.when(wait.isNotNull(), F.greatest(F.lit(0.0), wait))
    until = lambda text, fmt=None: later(F.unix_millis(F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)) - F.lit(float(now_ms)))
    resets = [until(F.try_element_at(headers, F.lit(f"anthropic-ratelimit-{x}-reset"))) for x in ("requests", "tokens", "input-tokens", "output-tokens")]
    spans = [_duration(F.try_element_at(headers, F.lit(f"x-ratelimit-reset-{x}"))) for x in ("requests", "tokens")]
    return F.greatest(plain, F.when(plain.isNull(), until(seconds, "EEE, dd MMM yyyy HH:mm:ss z")), *resets, *spans).cast("bigint")


def _duration(text: Column) -> Column:
    pattern = r"([0-9]+(?:\.[0-9]+)?)(ms|s|m|h)"
    amounts, units = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    scale = lambda u: F.when(u == "ms", 1.0).when(u == "s", 1e3).when(u == "m", 6e4).otherwise(3.6e6)
    parts = F.zip_with(amounts, units, lambda a, u: a.cast("double") * scale(u))
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))
