"""Personal data: pattern spans, and terms that disclose protected entities by co-occurrence. SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, in_blocks, match_offsets
from .common import cut, stash

SUPPORT = 1  # distinct texts that must hold an entity and a term together
GENERALISE = 0.9  # of an entity's information: from here on a term is generalised
REMOVE = 0.97  # from here on it is removed
WORD = r"\p{L}+"
# The patterns of the base kinds. They match what the plain patterns do. Possessive repeats keep
# long runs linear; a match may start at the last one's end, or else only where its run of characters starts.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: What a text must hold for a pattern to be worth trying.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
_FOUND = "array<struct<start:bigint,end:bigint,value:string>>"
_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def matches(text: Column, pattern: str) -> Column:
    """All leftmost matches with their code point offsets."""
    return F.transform(match_offsets(text, pattern), lambda x: F.struct(x["start"].cast("bigint").alias("start"), (x["start"] + F.length(x["match"])).cast("bigint").alias("end"), x["match"].alias("value")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Every second digit from the right doubled, digits of each summed: a multiple of ten."""
    turned = F.reverse(number)
    each = F.transform(F.sequence(F.lit(0), F.length(number) - 1), lambda i: F.substring(turned, i + 1, F.lit(1)).cast("int") * (i % 2 + 1))
    return F.aggregate(F.transform(each, lambda v: F.when(v > 9, v - 9).otherwise(v)), F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    """Whether a match passes its kind's check."""
    if kind == "ip":
        parts = F.transform(F.split(x["value"], r"\.", -1), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        n = digits(x["value"])
        return F.when(F.length(n).between(13, 19), passes_luhn(n)).otherwise(False)
    if kind == "phone":
        return F.length(digits(x["value"])).between(9, 15)
    return F.lit(True)


def base_spans(rows: DataFrame) -> DataFrame:
    """``rows`` with one column of spans for each base kind; failing matches are dropped."""
    for kind in KINDS:
        hint = F.contains(F.col("text"), F.lit("@")) if kind == "email" else F.col("text").rlike(HINTS[kind])
        found = F.when(hint, matches(F.col("text"), PATTERNS[kind])).otherwise(F.array().cast(_FOUND))
        rows = rows.withColumn(kind, F.filter(found, _check(kind)))
    return rows


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x)


def _as_spans(column: Column, kind: str) -> Column:
    return F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _entities(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.struct(F.concat(F.lit(f"{kind}:"), F.lower(x["value"])).alias("entity"), x["start"].alias("start"), x["end"].alias("end")))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower), lambda w: F.length(w) >= 3))


def disclosing_terms(rows: DataFrame, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """(of, term, share): by the hash of each text, its terms that give away at least ``threshold`` of the information
    of an entity (a base value) that it holds; the largest share where there are several.

    All counts are of distinct texts. With n_t that hold term t, n_et that hold it and entity e, n_e that hold e and n
    in all, t gives log(p(e|t) / p(e)) of log(1 / p(e)), with p(e|t) = n_et / n_t and p(e) = n_e / n. An entity
    in one text only counts like any other: words of that text alone give it away wholly. A larger ``support`` leaves
    out pairs that fewer texts hold.
    """
    of = F.xxhash64("text").alias("of")
    every = F.array_distinct(F.transform(F.concat(*map(_entities, KINDS)), lambda x: x["entity"]))
    evidence = stash(rows.filter(_has_base()).select(of, every.alias("entities"), _terms(F.col("text")).alias("terms")).dropDuplicates(["of"]))
    held = evidence.select("of", F.explode("entities").alias("entity"))
    held = held.join(held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).filter(F.col("n_e") >= support), "entity")
    # each of m equal texts counts as one mth of a text
    copies = cut(rows.groupBy(of).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    total = rows.count() - (copies.agg(F.sum(F.col("copies") - 1)).first()[0] or 0)
    weight = F.coalesce(1 / F.col("copies"), F.lit(1.0)).alias("weight")
    # outer, as Spark would read all words once more to leave out texts without any before
    weighed = rows.select(of, "text").join(copies, "of", "left").select(weight, F.explode_outer(_terms(F.col("text"))).alias("term")).filter("term is not null")
    frequency = weighed.groupBy("term").agg(F.round(F.sum("weight")).cast("bigint").alias("n_t"))
    words = evidence.select("of", F.explode("terms").alias("term")).join(frequency, "term").withColumn("n", F.lit(total))
    # n_et is n_e at most: most pairs fall short by that alone
    hopeful = stash(held.join(words, "of").withColumn("n_et", F.least("n_e", "n_t")).filter(_share() >= threshold).drop("n_et"))
    together = hopeful.groupBy("entity", "term", "n_e", "n_t", "n").agg(F.count(F.lit(1)).alias("n_et")).filter(F.col("n_et") >= support)
    found = together.select("entity", "term", _share().alias("share")).filter(F.col("share") >= threshold)
    # by the texts' own words, so that an entity in many texts does not bring all its terms to each
    return hopeful.select("of", "entity", "term").join(found, ["entity", "term"]).groupBy("of", "term").agg(F.max("share").alias("share"))


def occurrences(text: Column, terms: Column) -> Column:
    """Where words of the text are, in lower case, among ``terms``; null where those are.

    Terms lie in buckets by their hash, so that each word meets a few of them.
    """
    words = F.filter(matches(text, WORD), lambda w: F.length(w["value"]) >= 3)
    n = F.greatest(F.ceil(F.sqrt(F.size(terms))), F.lit(1)).cast("int")
    slot = lambda w: F.pmod(F.xxhash64(w), n)
    buckets = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.filter(terms, lambda t: slot(t) == b))
    said = lambda buckets_: F.filter(words, lambda w: F.array_contains(F.get(buckets_, slot(F.lower(w["value"])).cast("int")), F.lower(w["value"])))
    return F.when(F.size(terms) > 0, bound(buckets, said)).otherwise(F.array().cast(_FOUND))


def _has_base() -> Column:
    return F.greatest(*[F.size(k) for k in KINDS]) > 0


def _share() -> Column:
    """log(p(e|t) / p(e)) of log(1 / p(e)), from n_et, n_t, n_e and n. It falls as n_t grows."""
    given = F.least(F.col("n_et") / F.col("n_t"), F.lit(1.0))
    own = F.col("n_e") / F.col("n")
    return F.when(own < 1, F.log(given / own) / -F.log(own)).otherwise(F.lit(0.0))


def _clean(text: Column, spans: Column) -> Column:
    """The text with its spans replaced; where spans overlap the first one gives the replacement.

    Spans go in blocks, each with its own stretch of the text, so that no string of the whole text grows span by span.
    """
    label = lambda k: F.when(k == "removed", "").otherwise(F.concat(F.lit("["), F.upper(k), F.lit("]")))
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], (a["start"] - b["start"]).cast("int")).otherwise((b["end"] - a["end"]).cast("int")))
    zero = F.lit(0).cast("bigint")

    def begins(blocks: Column) -> Column:
        """How far the blocks before each reach."""
        start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
        reach = F.transform(blocks, lambda b: F.coalesce(F.array_max(F.transform(b, lambda x: x["end"])), zero))
        return F.aggregate(reach, start, lambda s, n: F.struct(F.greatest(s["at"], n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: F.concat(s["out"], F.array(s["at"])))

    def replaced(block: Column, begin: Column, end: Column) -> Column:
        def fold(part: Column) -> Column:
            def step(s: Column, x: Column) -> Column:
                said = F.concat(s["out"], F.substring(part, (s["at"] - begin + 1).cast("int"), (x["start"] - s["at"]).cast("int")), label(x["kind"]))
                return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], said).otherwise(s["out"]).alias("out"))

            return F.aggregate(block, F.struct(begin.alias("at"), F.lit("").alias("out")), step, lambda s: s["out"])

        return bound(F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int")), fold)

    def whole(blocks: Column) -> Column:
        def joined(at: Column) -> Column:
            parts = F.transform(blocks, lambda b, i: replaced(b, at[i], at[i + 1]))
            return F.concat(F.array_join(parts, ""), F.substring(text, (F.element_at(at, -1) + 1).cast("int"), F.length(text)))

        return bound(begins(blocks), joined)

    return F.when(F.size(spans) == 0, text).otherwise(bound(in_blocks(ordered), whole))


def personal_data(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Personal data in every whole text of ``docs`` (doc_id, text, and any other columns, which stay).

    Base spans are e-mail addresses, IP addresses, card and phone numbers by pattern and check. The corpus then
    tells how strongly the words of texts with those entities reveal them (``disclosing_terms``), counted over whole
    texts: in documents that hold an entity, words that give away ``generalise`` of its information become spans of kind ``term``,
    from ``remove`` on of kind ``removed``.

    Adds base (spans of the base kinds, by kind, then start), spans (base spans, then terms and removed, in the
    same order, none of them overlapping a base span) and clean, the text with each span replaced by its
    kind in brackets, or by nothing for ``removed``. A null text is empty. Repeated rows each get their row.
    Columns of these names, and ``entity_*``, are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in {"text", "base", "spans", "clean", *KINDS, "entity_key", "entity_terms"}]
    rows = base_spans(docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    terms = disclosing_terms(rows.select("text", *KINDS), support, generalise)
    rows = rows.withColumn("base", F.concat(*[_as_spans(F.col(k), k) for k in KINDS]))
    none = F.array().cast(_SPAN)
    # the words of one text: no more than it has
    mine = terms.groupBy("of").agg(*[F.collect_list(F.when(hit, F.col("term"))).alias(n) for n, hit in (("removed_terms", F.col("share") >= remove), ("general_terms", F.col("share") < remove))])
    mine = stash(mine.withColumnRenamed("of", "entity_key"))
    # only texts with entities are shuffled
    keyed = rows.filter(_has_base()).withColumn("entity_key", F.xxhash64("text")).join(mine, "entity_key", "left")
    for kind, column in (("term", "general_terms"), ("removed", "removed_terms")):
        free = F.filter(occurrences(F.col("text"), F.col(column)), lambda x: ~F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        keyed = keyed.withColumn(f"{kind}_spans", _as_spans(free, kind))
    keyed = keyed.withColumn("spans", F.concat("base", F.coalesce("term_spans", none), F.coalesce("removed_spans", none)))
    columns = [*[F.col(f"`{c}`") for c in kept], "text", *KINDS, "base", "spans"]
    rows = keyed.select(*columns).unionByName(rows.filter(~_has_base()).withColumn("spans", F.col("base")).select(*columns))
    rows = rows.withColumn("clean", _clean(F.col("text"), F.col("spans")))
    return rows.select(*[F.col(f"`{c}`") for c in kept], "text", "base", "spans", "clean", *KINDS)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans as text, from what ``personal_data`` returns."""
    said = lambda c: F.array_join(F.transform(F.col(c), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))
