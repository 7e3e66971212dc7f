"""Code candidates of messages: surfaces, tokens near trigger phrases, scores, the best of each code, the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import with_visible
from ..functions.text import CODE_TOKEN, bound, match_offsets, normalize_code, trigger_offsets, utf16
from ..functions.values import BLOCKLIST
from .links import attribute_rows, link_codes

AFTER, NEAR = 30, 40


def is_acceptable(raw: Column, normalized: Column, source: Column, after: Column, blocklist: list[str] = BLOCKLIST) -> Column:
    digit = normalized.rlike("[0-9]")
    upper = F.when(raw != F.upper(raw), digit & after).otherwise(digit | (after & (F.length(normalized) >= 5)))
    return ~normalized.isin(blocklist) & normalized.rlike("[A-Z]") & normalized.rlike(r"[A-Z0-9]\z") & ((source == "link") | upper)


def score(source: Column, normalized: Column, near: Column) -> Column:
    size = F.length(normalized)
    parts = [
        F.when(source == "link", 3).when(source.isin("alt", "subject"), 2).otherwise(0),
        F.when(near, 3).otherwise(0),
        F.when(normalized.rlike("[A-Z]") & normalized.rlike("[0-9]"), 1).otherwise(0),
        F.when(size.between(5, 12), 1).when(size > 15, -1).otherwise(0),
    ]
    return sum(parts[1:], parts[0])


def surfaces(messages: DataFrame) -> DataFrame:
    """(message_id, surface_ord, part_ord, source, text) of alts, subject, text, visible text and OCR text, in this order.

    ``messages`` has message_id, subject, text, html and, if there is any, ocr_text.
    """
    alts = attribute_rows(messages.select("message_id", "html"), "img", "alt").select("message_id", F.lit(1).alias("surface_ord"), F.col("ord").alias("part_ord"), F.lit("alt").alias("source"), F.col("value").alias("text"))
    ocr = F.col("ocr_text") if "ocr_text" in messages.columns else F.lit("")
    kinds = [("subject", F.col("subject"), 2), ("text", F.col("text"), 3), ("text", F.col("visible"), 4), ("ocr", ocr, 5)]
    each = F.array(*[F.struct(F.lit(o).alias("surface_ord"), F.lit(0).alias("part_ord"), F.lit(k).alias("source"), c.alias("text")) for k, c, o in kinds])
    whole = with_visible(messages).select("message_id", F.inline(each))
    return alts.unionByName(whole).filter("text <> ''")


def scan_surfaces(rows: DataFrame) -> DataFrame:
    """Surfaces without their text: message_id, surface_ord, part_ord, source, has_trigger, and the accepted tokens ``found``.

    Tokens meet the trigger phrases of their own text inside the row, and are judged there too. An offset is
    after a phrase within 30 characters, near one within 40 either way.
    """

    def judged(flat: Column, ends: Column) -> Column:
        def judge(t: Column) -> Column:
            at = t["start"]
            return F.struct(
                at.alias("position"),
                t["match"].alias("code"),
                F.upper(t["match"]).alias("normalized"),
                F.exists(ends, lambda e: (at >= e) & (at - e <= AFTER)).alias("after"),
                F.exists(ends, lambda e: F.abs(at - e) <= NEAR).alias("near"),
            )

        found = F.filter(F.transform(match_offsets(flat, CODE_TOKEN), judge), lambda t: is_acceptable(t["code"], t["normalized"], F.col("source"), t["after"]))
        return F.struct((F.size(ends) > 0).alias("has_trigger"), found.alias("found"))

    # bound, so that no rewriting of the plan computes them once a token
    scan = bound(utf16(F.col("text")), lambda flat: bound(trigger_offsets(flat), lambda ends: judged(flat, ends)))
    return rows.select("message_id", "surface_ord", "part_ord", "source", scan.alias("scan")).select("message_id", "surface_ord", "part_ord", "source", "scan.has_trigger", "scan.found")


def text_candidates(rows: DataFrame) -> DataFrame:
    """Accepted tokens of surfaces with position, code, normalized, near and score; only those that pass are exploded."""
    # outer, as Spark would scan the surfaces once more to leave out empty arrays before
    out = scan_surfaces(rows).select("message_id", "surface_ord", "part_ord", "source", F.explode_outer("found").alias("t")).filter("t is not null")
    return out.select("message_id", "surface_ord", "part_ord", "source", "t.position", "t.code", "t.normalized", "t.near", score(F.col("source"), F.col("t.normalized"), F.col("t.near")).alias("score"))


def range_candidates(rows: DataFrame) -> DataFrame:
    """As ``text_candidates``, by an interval join on surface and bin instead of a scan in the row.

    For surfaces with very many tokens and trigger phrases. Offsets fall into bins as wide as the longest distance that counts, so
    that a phrase can only be near to tokens of its own bin and its neighbours; a bin has at most so many ends of phrases in each. Surfaces are told apart by
    message_id, surface_ord, part_ord and source, which are not null. A surface's bins are spread over tasks.
    """
    keys = ["message_id", "surface_ord", "part_ord", "source"]
    flat = rows.select(*keys, utf16(F.col("text")).alias("flat"))
    tokens = flat.select(*keys, F.explode(match_offsets(F.col("flat"), CODE_TOKEN)).alias("t")).select(*keys, F.col("t.start").alias("position"), F.col("t.match").alias("code"), F.upper("t.match").alias("normalized"))
    tokens = tokens.filter(is_acceptable(F.col("code"), F.col("normalized"), F.col("source"), F.lit(True))).withColumn("bin", F.floor(F.col("position") / NEAR))
    ends = flat.select(*keys, F.explode(trigger_offsets(F.col("flat"))).alias("end")).withColumn("own", F.floor(F.col("end") / NEAR))
    bins = ends.select(*keys, "end", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("bin")).groupBy(*keys, "bin").agg(F.collect_set("end").alias("ends"))
    at = F.col("position")
    met = tokens.join(bins, [*keys, "bin"], "left").select(
        *keys, "position", "code", "normalized",
        F.coalesce(F.exists("ends", lambda e: (at >= e) & (at - e <= AFTER)), F.lit(False)).alias("after"), F.coalesce(F.exists("ends", lambda e: F.abs(at - e) <= NEAR), F.lit(False)).alias("near"),
    )
    good = met.filter(is_acceptable(F.col("code"), F.col("normalized"), F.col("source"), F.col("after")))
    return good.select(*keys, "position", "code", "normalized", "near", score(F.col("source"), F.col("normalized"), F.col("near")).alias("score"))


def link_candidates(messages: DataFrame) -> DataFrame:
    links = attribute_rows(messages.select("message_id", "html"), "a", "href")
    codes = link_codes(links).withColumn("normalized", normalize_code(F.col("code")))
    codes = codes.filter(is_acceptable(F.col("code"), F.col("normalized"), F.lit("link"), F.lit(True)))
    return codes.select("message_id", F.lit(0).alias("surface_ord"), F.col("ord").alias("part_ord"), F.lit("link").alias("source"), (F.col("param_ord") * 1000 + F.col("inner_ord")).alias("position"), "code", "normalized", F.lit(True).alias("near"), score(F.lit("link"), F.col("normalized"), F.lit(True)).alias("score"))


def best_candidates(found: DataFrame) -> DataFrame:
    """Of each message and normalized code the candidate of the highest score, the first one of equal ones.

    ``max_by`` keeps one row a key on the map side, so that a code repeated in a long message is shuffled once.
    """
    first = F.struct(F.col("score"), -F.col("surface_ord"), -F.col("part_ord"), -F.col("position"))
    best = F.max_by(F.struct("code", "source", "score"), first)
    return found.groupBy("message_id", "normalized").agg(best.alias("b")).select("message_id", "normalized", "b.code", "b.source", "b.score")


def rank_candidates(best: DataFrame) -> DataFrame:
    """Adds ``rank``: by score, then code in locale order (underscore, hyphen, digits, letters)."""
    order = Window.partitionBy("message_id").orderBy(F.desc("score"), F.collate(F.col("normalized"), "UNICODE"))
    return best.withColumn("rank", F.row_number().over(order))


def find_candidates(messages: DataFrame, longest: int | None = None) -> DataFrame:
    """The best candidates of messages; surfaces of more than ``longest`` characters, if given, are scanned by ``range_candidates``."""
    rows = surfaces(messages)
    if longest is None:
        return best_candidates(link_candidates(messages).unionByName(text_candidates(rows)))
    found = text_candidates(rows.filter(F.length("text") <= longest)).unionByName(range_candidates(rows.filter(F.length("text") > longest)))
    return best_candidates(link_candidates(messages).unionByName(found))


def gate(messages: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row a message: n_candidates, has_trigger (over all surfaces but links), should_extract."""
    triggers = surfaces(messages).groupBy("message_id").agg(F.max(F.size(trigger_offsets(utf16(F.col("text")))) > 0).alias("has_trigger"))
    counts = candidates.groupBy("message_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    rows = messages.select("message_id").join(counts, "message_id", "left").join(triggers, "message_id", "left")
    rows = rows.select("message_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("has_trigger", F.lit(False)).alias("has_trigger"))
    return rows.withColumn("should_extract", (F.col("n_candidates") > 0) | F.col("has_trigger"))


def scan_gate(messages: DataFrame) -> DataFrame:
    """As ``gate`` of a message's own candidates, by one scan of its surfaces."""
    text = scan_surfaces(surfaces(messages)).select("message_id", "has_trigger", F.explode_outer("found.normalized").alias("normalized"))
    both = text.unionByName(link_candidates(messages).select("message_id", F.lit(False).alias("has_trigger"), "normalized"))
    each = both.groupBy("message_id", "normalized").agg(F.bool_or("has_trigger").alias("has_trigger"))
    found = each.groupBy("message_id").agg(F.count("normalized").alias("n_candidates"), F.bool_or("has_trigger").alias("has_trigger"))
    rows = messages.select("message_id").join(found, "message_id", "left").select("message_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("has_trigger", F.lit(False)).alias("has_trigger"))
    return rows.withColumn("should_extract", (F.col("n_candidates") > 0) | F.col("has_trigger"))


def regate_with_ocr(messages: DataFrame, candidates: DataFrame, ocr: DataFrame, images: DataFrame) -> DataFrame:
    """Candidates again, with OCR text (message_id, ocr_text), for the messages that have none without and have one of
    the ``images`` (message_id) at least."""
    bare = messages.join(candidates.select("message_id").distinct(), "message_id", "left_anti").join(images.select("message_id").distinct(), "message_id", "left_semi").join(ocr, "message_id")
    return candidates.unionByName(find_candidates(bare))
