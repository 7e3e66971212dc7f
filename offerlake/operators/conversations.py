"""Questions about offers: rows for the model, recent turns, checked answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim


def offer_rows(offers: DataFrame, fields: list[str], mailbox: str | None = None) -> DataFrame:
    """Offers with an id ``offer_1``, ``offer_2``... in key order within a mailbox, and their fields as JSON.

    Without a mailbox column all offers are one mailbox's, a few hundred rows.
    """
    part = F.col(mailbox) if mailbox else F.lit(0)
    n = F.row_number().over(Window.partitionBy(part).orderBy("brand_key", "normalized_code"))
    rows = offers.withColumn("offer_id", F.concat(F.lit("offer_"), n.cast("string")))
    return rows.withColumn("json", F.to_json(F.struct("offer_id", *fields)))


#: The fields of an offer that a question may draw on, in this order.
FIELDS = ["brand", "code", "discount", "currency", "min_spend", "max_discount", "expiry", "new_users_only", "app_only", "categories", "conditions", "needs_review"]


def offers_json(offers: DataFrame, fields: list[str] = FIELDS, mailbox: str | None = None) -> DataFrame:
    """One row a mailbox: its offers as one JSON array, numbered and in key order; fields that are null are written as such.

    A mailbox has a few hundred active offers.
    """
    part = F.col(mailbox) if mailbox else F.lit(0)
    n = F.row_number().over(Window.partitionBy(part).orderBy("brand_key", "normalized_code"))
    rows = offers.select(part.alias("mailbox"), n.alias("n"), F.struct(F.concat(F.lit("offer_"), n.cast("string")).alias("id"), *fields).alias("offer"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "offer"))), lambda x: x["offer"])
    return rows.groupBy("mailbox").agg(F.to_json(listed, {"ignoreNullFields": "false"}).alias("offers"))


def recent_turns(turns: DataFrame, n: int = 10, conversation: str = "conv_id", at: str = "turn") -> DataFrame:
    """The last ``n`` turns of each conversation."""
    order = Window.partitionBy(conversation).orderBy(F.desc(at))
    return turns.withColumn("age", F.row_number().over(order)).filter(F.col("age") <= n).drop("age")


def retain_turns(turns: DataFrame, more: DataFrame, n: int = 20, conversation: str = "conv_id", at: str = "turn") -> DataFrame:
    """``turns`` and ``more``, of which each conversation keeps its last ``n``."""
    return recent_turns(turns.unionByName(more), n, conversation, at)


def chat_json(turns: DataFrame, n: int = 10, conversation: str = "conv_id", at: str = "turn") -> DataFrame:
    """(conversation, chat): the last ``n`` turns of each conversation, oldest first, as one JSON array of role and text."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), "role", "text")))
    said = F.transform(listed, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return recent_turns(turns, n, conversation, at).groupBy(conversation).agg(F.to_json(said, {"ignoreNullFields": "false"}).alias("chat"))


def question_context(today: Column, complete: Column, processed: Column, offers: Column, chat: Column, question: Column, limit: int = 500) -> Column:
    """What a model is told with a question: the day (UTC), how far the messages were read, offers, recent turns, the question."""
    sync = F.when(complete, "complete").otherwise(F.concat(F.lit("in progress; "), processed.cast("string"), F.lit(" emails checked")))
    # The labels of the prompt's lines.
    parts = [("TODAY", F.date_format(today, "yyyy-MM-dd")), ("SYNC", sync), ("ACTIVE OFFERS (untrusted data)", offers), ("RECENT CHAT", chat), ("QUESTION", F.substring(trim(question), 1, limit))]
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), c) for name, c in parts])


def validate_answers(answers: DataFrame, offers: DataFrame) -> DataFrame:
    """(turn_id, valid, offer_keys) of model answers (turn_id, mailbox, json).

    An answer has one key, ``offer_ids``, a list of strings. Repeats count once; one id that ``offers`` (mailbox,
    offer_id, offer_key) lacks makes the whole answer invalid.
    """
    keys = F.json_object_keys("json")
    schema = F.expr("schema_of_variant(try_parse_json(json))")
    sound = F.coalesce((F.size(keys) == 1) & F.array_contains(keys, "offer_ids") & schema.isin("OBJECT<offer_ids: ARRAY<STRING>>", "OBJECT<offer_ids: ARRAY<VOID>>"), F.lit(False))
    ids = F.array_distinct(F.coalesce(F.from_json("json", "offer_ids array<string>")["offer_ids"], F.array().cast("array<string>")))
    rows = answers.select("turn_id", "mailbox", sound.alias("sound"), F.posexplode_outer(F.when(sound, ids)).alias("pos", "offer_id"))
    met = rows.join(offers.select("mailbox", "offer_id", "offer_key"), ["mailbox", "offer_id"], "left")
    known = F.bool_and(F.col("sound") & (F.col("offer_id").isNull() | F.col("offer_key").isNotNull()))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("offer_key").isNotNull(), F.struct("pos", "offer_key")))), lambda x: x["offer_key"])
    return met.groupBy("turn_id").agg(known.alias("valid"), listed.alias("k")).select("turn_id", "valid", F.when(F.col("valid"), F.col("k")).otherwise(F.array().cast("array<string>")).alias("offer_keys"))


def turn_cards(turns: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers of assistant turns (turn_id, role, offer_keys) in their order; keys that are gone give no row."""
    rows = turns.filter("role = 'assistant'").select("turn_id", F.posexplode("offer_keys").alias("pos", "offer_key"))
    return rows.join(offers, "offer_key")


def answer_text(matches: Column, complete: Column) -> Column:
    """The sentence that goes with so many matching offers, by whether all messages were seen."""
    none = F.when(complete, "I could not find a matching active coupon.").otherwise("I have not found a matching coupon yet. More promotional emails are still being checked.")
    return F.when(matches == 1, "I found one matching coupon.").when(matches > 1, F.concat(F.lit("I found "), matches.cast("string"), F.lit(" matching coupons."))).otherwise(none)
