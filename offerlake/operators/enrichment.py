"""Model enrichment as data: prompts, saved responses, checks of what models say."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import strict_date
from ..functions.text import normalize_code, trim
from ..jobs.tables import read_if_there, written
from .sync import is_retryable

BODY, CONDITIONS = 6000, 120
OFFER = "code string, discount string, currency string, min_spend double, max_discount double, expiry string, single_use boolean, new_users_only boolean, app_only boolean, categories array<string>, conditions string"
#: Types that a field of an offer may have.
TYPES = {
    "code": "STRING", "discount": "STRING|VOID", "currency": "STRING|VOID", "min_spend": "BIGINT|DOUBLE|DECIMAL.*|VOID", "max_discount": "BIGINT|DOUBLE|DECIMAL.*|VOID", "expiry": "STRING|VOID",
    "single_use": "BOOLEAN|VOID", "new_users_only": "BOOLEAN", "app_only": "BOOLEAN", "categories": "ARRAY<(?:STRING|VOID)>", "conditions": "STRING",
}


def select_for_enrichment(gated: DataFrame) -> DataFrame:
    """Adds ``enrich``: the gate let the message through and it has candidates; others count as done."""
    return gated.withColumn("enrich", F.col("should_extract") & (F.col("n_candidates") > 0)).withColumn("llm_processed", ~F.col("enrich"))


def enrichment_fallback(offers: DataFrame, enriched: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offers and processed state after the model ran, by its ``outcomes`` (message_id, error; null: success).

    A success gives the message's ``enriched`` offers. A failure that waiting does not mend keeps the ``offers`` that need no
    model, marked as seen by it, and the message counts as failed. A failure to be retried, or no outcome, leaves offers and
    message (message_id, status, llm_processed) as they were. Offers have message_id besides their own columns.
    """
    kind = outcomes.select("message_id", F.when(F.col("error").isNull(), "done").when(is_retryable(F.col("error")), "later").otherwise("lost").alias("outcome"))
    bare = offers.join(kind, "message_id", "left").filter(F.coalesce("outcome", F.lit("later")) != "done")
    bare = bare.withColumn("llm_processed", F.col("llm_processed") | F.coalesce(F.col("outcome") == "lost", F.lit(False))).drop("outcome")
    kept = bare.unionByName(enriched.join(kind.filter("outcome = 'done'").select("message_id"), "message_id", "left_semi"), allowMissingColumns=True)
    states = kind.filter("outcome <> 'later'").select("message_id", F.when(F.col("outcome") == "lost", "failed").otherwise("candidates").alias("status"), F.lit(True).alias("llm_processed"))
    return kept, states


def build_prompts(messages: DataFrame, ranked: DataFrame, budget: int = BODY) -> DataFrame:
    """(message_id, prompt) of messages (sender, subject, internal_date, text, visible, ocr_text) with ranked candidates.

    Distinct surfaces share the budget equally, less what parts them.
    """
    listed = F.array_sort(F.collect_list(F.struct("rank", "code")))
    codes = ranked.groupBy("message_id").agg(F.array_join(F.array_distinct(F.transform(listed, lambda x: x["code"])), ", ").alias("codes"))
    ocr = trim(F.coalesce("ocr_text", F.lit("")))
    surfaces = F.concat(F.array_distinct(F.filter(F.array("text", "visible"), lambda s: s != "")), F.when(ocr != "", F.array(F.concat(F.lit("OCR TEXT: "), ocr))).otherwise(F.array().cast("array<string>")))
    share = F.floor((budget - F.greatest(F.size("surfaces") - 1, F.lit(0)) * 2) / F.greatest(F.size("surfaces"), F.lit(1))).cast("int")
    rows = messages.withColumn("surfaces", surfaces).withColumn("share", share).join(codes, "message_id")
    body = F.array_join(F.transform("surfaces", lambda s: F.substring(s, F.lit(1), F.col("share"))), "\n\n")
    day = F.date_format(F.timestamp_millis("internal_date"), "yyyy-MM-dd")
    # The labels of the prompt's lines.
    lines = [F.concat(F.lit("EMAIL DATE: "), day), F.concat(F.lit("SENDER: "), "sender"), F.concat(F.lit("SUBJECT: "), "subject"), F.concat(F.lit("CANDIDATE CODES: "), "codes"), F.lit(""), F.lit("EMAIL TEXT (untrusted data):"), body]
    return rows.select("message_id", F.concat_ws("\n", *lines).alias("prompt"))


def run_inference(prompts: DataFrame, call: Callable[[pd.Series], pd.Series], slots: int) -> DataFrame:
    """(message_id, response) of prompts: ``call`` maps a batch of prompts to responses, in ``slots`` tasks at most.

    Write the result before using it, so that a later failure does not call again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"message_id": batch["message_id"], "response": call(batch["prompt"])})

    kind = prompts.schema["message_id"].dataType.simpleString()
    return prompts.select("message_id", "prompt").repartition(slots).mapInPandas(run, f"message_id {kind}, response string")


ANSWER = "key string, body string"
CALLED = "key string, status int, body string, retry_after_ms bigint"


def prompt_key(prompt: Column, model: str) -> Column:
    """What an answer is kept by: the model and the whole prompt."""
    return F.sha2(F.concat(F.lit(model), F.lit("\n"), prompt), 256)


def logged_answers(spark: SparkSession, log: str) -> DataFrame:
    """(key, body) of all answers in a log."""
    kept = read_if_there(lambda: spark.read.schema(ANSWER).option("recursiveFileLookup", "true").parquet(log))
    # an answer is there twice only if two jobs asked at the same time
    return spark.createDataFrame([], ANSWER) if kept is None else kept.groupBy("key").agg(F.min("body").alias("body"))


def _ask(call: Callable[[pd.Series], pd.DataFrame], log: str, batch: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Calls for what a bucket's folder lacks, and writes each batch of answers there before the next is asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(log)
        bucket, known = None, set()
        for rows in batches:
            for number, part in rows.groupby("bucket", sort=True):
                folder = f"{base}/{number}"
                if number != bucket:
                    bucket, known = number, set()
                    # what an attempt that was lost, or another job, has asked since the join
                    for file in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                        if file.path.endswith(".parquet"):
                            known |= set(pq.read_table(file.path, columns=["key"], filesystem=store)["key"].to_pylist())
                part = part[~part["key"].isin(known)]
                for at in range(0, len(part), batch):
                    some = part.iloc[at : at + batch]
                    said = call(some["prompt"]).assign(key=some["key"].to_numpy())
                    good = said[said["status"] == 200]
                    if len(good):
                        store.create_dir(folder, recursive=True)
                        name = uuid.uuid4().hex
                        pq.write_table(pa.Table.from_pydict({"key": good["key"].tolist(), "body": good["body"].tolist()}, pa.schema([("key", pa.string()), ("body", pa.string())])), f"{folder}/_{name}", filesystem=store)
                        store.move(f"{folder}/_{name}", f"{folder}/{name}.parquet")
                    yield said[said["status"] != 200][["key", "status", "body", "retry_after_ms"]]

    return run


def run_logged_inference(prompts: DataFrame, call: Callable[[pd.Series], pd.DataFrame], log: str, model: str = "", slots: int = 8, batch: int = 32, buckets: int = 256) -> DataFrame:
    """(message_id, status, body, retry_after_ms) of prompts, none of which is asked again once its answer is in ``log``.

    ``call`` takes a batch of prompts and gives status, body and retry_after_ms of each; ``slots`` tasks call at a time. A status
    of 200 is an answer. Answers are kept by the hash of model and prompt in a folder for each of ``buckets`` shares of the
    hashes; each batch is there before the next one is asked for, so a job that dies loses what it had under way at most, and a task that runs
    again asks only for the rest. Equal prompts are asked once. Failures are not kept: they are this run's result, and asked again by the next.
    """
    spark = prompts.sparkSession
    keyed = written(prompts.select("message_id", "prompt", prompt_key(F.col("prompt"), model).alias("key")))
    missing = keyed.join(logged_answers(spark, log).select("key"), "key", "left_anti").groupBy("key").agg(F.first("prompt").alias("prompt"))
    dealt = missing.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).repartition(slots, "bucket").sortWithinPartitions("bucket", "key")
    failed = written(dealt.mapInPandas(_ask(call, log, batch), CALLED))
    good = logged_answers(spark, log).select("key", F.lit(200).alias("status"), "body", F.lit(None).cast("bigint").alias("retry_after_ms"))
    return keyed.drop("prompt").join(good.unionByName(failed), "key").select("message_id", "status", "body", "retry_after_ms")


def normalize_responses(responses: DataFrame) -> DataFrame:
    """(message_id, json, input_tokens, output_tokens, error) of responses (message_id, provider, body) of three shapes."""
    a = F.from_json("body", "content array<struct<type:string,name:string,input:string,text:string>>, stop_reason string, usage struct<input_tokens:bigint,output_tokens:bigint>")
    o = F.from_json("body", "choices array<struct<message:struct<content:string,refusal:string>,finish_reason:string>>, usage struct<prompt_tokens:bigint,completion_tokens:bigint>")
    g = F.from_json("body", "candidates array<struct<content:struct<parts:array<struct<text:string>>>,finishReason:string>>, promptFeedback struct<blockReason:string>, usageMetadata struct<promptTokenCount:bigint,candidatesTokenCount:bigint>")
    rows = responses.withColumns({"a": F.when(F.col("provider") == "anthropic", a), "o": F.when(F.col("provider") == "openai", o), "g": F.when(F.col("provider") == "gemini", g)})
    tool = F.get(F.filter("a.content", lambda c: c["type"] == "tool_use"), F.lit(0))["input"]
    choice, candidate = F.get("o.choices", F.lit(0)), F.get("g.candidates", F.lit(0))
    said = F.array_join(F.transform(candidate["content"]["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), "")
    json = F.coalesce(tool, choice["message"]["content"], F.nullif(said, F.lit("")))
    refused = F.when(F.col("provider") == "anthropic", tool.isNull()).when(F.col("provider") == "openai", F.coalesce(choice["message"]["refusal"], F.lit("")) != "")
    refused = refused.otherwise(F.coalesce(F.col("g.promptFeedback.blockReason"), F.lit("")) != "") | F.coalesce(candidate["finishReason"].isin("SAFETY", "RECITATION"), F.lit(False))
    cut = F.coalesce(choice["finish_reason"] == "length", F.lit(False)) | F.coalesce(candidate["finishReason"] == "MAX_TOKENS", F.lit(False))
    readable = F.try_parse_json(F.col("body")).isNotNull()
    error = F.when(~readable, "schema").when(refused, "refusal").when(cut | json.isNull() | F.try_parse_json(json).isNull(), "schema")
    tokens = [F.coalesce(*[F.col(c) for c in cs], F.lit(0)) for cs in (("a.usage.input_tokens", "o.usage.prompt_tokens", "g.usageMetadata.promptTokenCount"), ("a.usage.output_tokens", "o.usage.completion_tokens", "g.usageMetadata.candidatesTokenCount"))]
    return rows.select("message_id", F.when(error.isNull(), json).alias("json"), tokens[0].alias("input_tokens"), tokens[1].alias("output_tokens"), error.alias("error"))


def is_sound(json: Column) -> Column:
    """Whether an extraction has the one key ``offers``, a list of objects with exactly the right fields and types."""
    whole = F.json_object_keys(json)
    entries = F.from_json(json, "offers array<string>")["offers"]

    def sound(entry: Column) -> Column:
        keys = F.json_object_keys(entry)
        kinds = [F.expr("true")]
        for name, kind in TYPES.items():
            kinds.append(F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(entry), f"$.{name}", "variant")).rlike(rf"\A(?:{kind})\z"), F.lit(False)))
        out = F.coalesce(F.size(keys) == len(TYPES), F.lit(False))
        for k in kinds:
            out = out & k
        return out

    listed = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), "$.offers", "variant")).startswith("ARRAY")
    return F.coalesce((F.size(whole) == 1) & F.array_contains(whole, "offers") & listed & F.forall(entries, sound), F.lit(False))


def validate_responses(answers: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offers of sound responses (message_id, json) whose code is among their message's candidates, and the errors.

    One wrong field makes a whole response a schema error. The source's spelling of a code counts, and the first
    of equal codes. Fields are trimmed and bounded; impossible ones are null.
    """
    rows = answers.withColumn("sound", is_sound(F.col("json")))
    each = rows.filter("sound").select("message_id", F.posexplode(F.from_json("json", f"offers array<struct<{OFFER.replace(' ', ':').replace(',:', ',')}>>")["offers"]).alias("pos", "o"))
    each = each.withColumn("normalized_code", normalize_code(F.col("o.code"))).filter("normalized_code <> ''")
    known = candidates.select("message_id", F.col("normalized").alias("normalized_code"), F.col("code").alias("source_code"))
    first = F.row_number().over(Window.partitionBy("message_id", "normalized_code").orderBy("pos"))
    met = each.join(known, ["message_id", "normalized_code"]).withColumn("n", first).filter("n = 1")
    text = lambda c: F.nullif(trim(F.col(f"o.{c}")), F.lit(""))
    money = lambda c: F.when(F.col(f"o.{c}") >= 0, F.col(f"o.{c}"))
    currency = F.upper(text("currency"))
    offers = met.select(
        "message_id", "normalized_code", F.col("source_code").alias("code"), text("discount").alias("discount"), F.when(currency.rlike(r"\A[A-Z]{3}\z"), currency).alias("currency"),
        money("min_spend").alias("min_spend"), money("max_discount").alias("max_discount"), F.when(strict_date(text("expiry")).isNotNull(), text("expiry")).alias("expiry"),
        "o.single_use", "o.new_users_only", "o.app_only", "o.categories", F.substring(trim(F.col("o.conditions")), 1, CONDITIONS).alias("conditions"),
    )
    return offers, rows.filter("not sound").select("message_id", F.lit("schema").alias("error"))
