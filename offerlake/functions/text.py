"""Text scans with the semantics of the message formats: ASCII word bounds, UTF-16 offsets, wide white space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import TRIGGER_PHRASES

SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
#: A code-shaped token between ASCII word bounds, which Java's own bound is not.
TOKEN = r"(?<![A-Za-z0-9_])[A-Za-z0-9][A-Za-z0-9_-]{3,19}(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<=-)(?=[A-Za-z0-9_]))"
#: All tokens that can be codes, and few others: where a run of token characters starts, it must have a digit, or a capital with
#: another or a dash behind it. Runs that have are scanned as with ``TOKEN``; in others no token is accepted.
CODE_TOKEN = TOKEN.replace(r"(?<![A-Za-z0-9_])", r"(?<![A-Za-z0-9_])(?:(?<=-)|(?=[A-Za-z_-]*(?:[0-9]|(?<=[A-Z])[A-Z_-])))", 1)
STRICT_CODE = r"\A[A-Za-z0-9][A-Za-z0-9_-]{3,19}\z"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"\\A[{SPACE}]+|[{SPACE}]+\\z", "")


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def normalize_code(c: Column) -> Column:
    return F.upper(trim(c))


def utf16(c: Column) -> Column:
    """The text with two fillers for each code point beyond the first plane, so that lengths are UTF-16 units."""
    return F.regexp_replace(c, "[\\x{10000}-\\x{10FFFF}]", "￼￼")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def in_blocks(values: Column) -> Column:
    """The array in blocks of about as many values as there are blocks; one empty block if it is empty."""
    size = F.greatest(F.ceil(F.sqrt(F.size(values))), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / size) - 1, F.lit(0)).cast("int")), lambda k: F.slice(values, k * size + 1, size))


def starts_of(lengths: Column) -> Column:
    """Where each of consecutive stretches of these lengths starts: the sums of the lengths before it, as bigint.

    Sums run over blocks of about as many values as there are blocks, so that no array of all values
    grows by one value at a time.
    """

    def fold(values: Column, start: Column) -> Column:
        zero = F.struct(start.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, zero, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    total = lambda block: F.aggregate(block, F.lit(0).cast("bigint"), lambda s, n: s + n)
    return bound(lengths, lambda v: bound(in_blocks(v), lambda b: F.flatten(F.zip_with(b, fold(F.transform(b, total), F.lit(0)), fold))))


def match_offsets(text: Column, pattern: str | Column) -> Column:
    """array<struct<match, start>> of all matches: what splitting leaves between them gives the offsets."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(0)), gaps, lambda m, g: F.struct(m.alias("match"), g.alias("gap")))

    def placed(found: Column) -> Column:
        starts = starts_of(F.transform(found, lambda x: x["gap"] + F.length(x["match"])))
        return F.zip_with(found, starts, lambda x, at: F.struct(x["match"].alias("match"), (at + x["gap"]).cast("int").alias("start")))

    return bound(F.filter(both, lambda x: x["match"].isNotNull()), placed)


def trigger_offsets(text: Column, phrases: list[str] = TRIGGER_PHRASES) -> Column:
    """End offsets of all trigger phrases in the lower-cased text, ascending.

    The text is split where a phrase ends, however phrases overlap; a look back at their last letters comes first.
    """
    lower = F.lower(text)
    tails: dict[str, list[str]] = {}
    for p in phrases:
        tails.setdefault(p[-4:], []).append(p)
    ends = "|".join(f"(?<=\\Q{tail}\\E)(?<=" + "|".join(f"\\Q{p}\\E" for p in ps) + ")" for tail, ps in tails.items())
    last = "".join(sorted({p[-1] for p in phrases}))
    pieces = F.transform(F.split(lower, f"(?<=[\\Q{last}\\E])(?:{ends})", -1), F.length)
    found = bound(pieces, lambda v: F.transform(F.slice(starts_of(v), 2, F.greatest(F.size(v) - 1, F.lit(0))), lambda at: at.cast("int")))
    some = F.contains(lower, F.lit("code")) if all("code" in p for p in phrases) else F.lit(True)
    return F.when(some, found).otherwise(F.array().cast("array<int>"))
