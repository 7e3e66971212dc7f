"""HTML scans as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import collapse, trim
from .values import ENTITIES

# The patterns of this module, what results depend on.
_REFERENCE = re.compile(r"&(#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]*);", re.I)


def strip_non_content(html: Column) -> Column:
    """Comments, scripts and styles, also unclosed ones, become blanks."""
    out = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", " ")
    out = F.regexp_replace(out, r"(?is)<(script|style)(?![A-Za-z0-9_])[^>]*>.*?</\1[\s]*>", " ")
    return F.regexp_replace(out, r"(?is)<(script|style)(?![A-Za-z0-9_])[^>]*>.*\z", " ")


def _decode(text: str) -> str:
    def one(m: re.Match) -> str:
        body = m[1]
        if body[0] != "#":
            return ENTITIES.get(body.lower(), m[0])
        digits = body[2:] if body[1] in "xX" else body[1:]
        # longer ones are out of range, and slow to read
        number = int(digits, 16 if body[1] in "xX" else 10) if len(digits.lstrip("0")) < 9 else 1 << 32
        return chr(number) if 0 < number <= 0x10FFFF and not 0xD800 <= number < 0xE000 else m[0]

    return _REFERENCE.sub(one, text)


@F.pandas_udf(StringType())
def _decode_all(texts: pd.Series) -> pd.Series:
    return texts.map(_decode, na_action="ignore")


def decode_entities(c: Column) -> Column:
    """Numeric and common named references, each decoded once; unknown ones stay.

    Named ones are plain replacements, ``&amp;`` last. Only texts with numeric ones, or with names in other case,
    go through the helper.
    """
    plain = c
    for name, said in sorted(ENTITIES.items(), key=lambda x: x[0] == "amp"):
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(said))
    rest = c.rlike("&#[0-9xX]") | c.rlike("&(?=[A-Za-z0-9]*[A-Z])[A-Za-z]")
    return F.when(~F.contains(c, F.lit("&")), c).when(rest, _decode_all(F.when(rest, c))).otherwise(plain)


def visible_text(html: Column) -> Column:
    return collapse(decode_entities(F.regexp_replace(strip_non_content(html), "<[^>]+>", " ")))


def with_visible(rows: DataFrame, html: str = "html", visible: str = "visible") -> DataFrame:
    """Adds ``visible_text``, with tags taken out once: inside one expression each condition of the decoding would have it done again."""
    bare = rows.withColumn("bare", F.regexp_replace(strip_non_content(F.col(html)), "<[^>]+>", " "))
    return bare.withColumn(visible, collapse(decode_entities(F.col("bare")))).drop("bare")


def tag_values(stripped: Column, tag: str, attribute: str) -> Column:
    """Raw values of one attribute in all matching tags of HTML without non-content, in order, with blanks."""
    pattern = rf"""(?i)<{tag}(?![A-Za-z0-9_])[^>]*?\s{attribute}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    # one pass over the text; a match says by itself what its groups are
    found = F.regexp_extract_all(stripped, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda m: F.concat(*[F.regexp_extract(m, pattern, i) for i in (1, 2, 3)]))


def tag_attributes(stripped: Column, tag: str) -> Column:
    """array<map<name, raw value>> of all matching tags; of repeated names the last one counts."""
    tags = F.regexp_extract_all(stripped, F.lit(rf"(?i)<{tag}(?![A-Za-z0-9_])([^>]*)>"), F.lit(1))
    pattern = r"""([a-zA-Z_:][-A-Za-z0-9_:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def attributes(source: Column) -> Column:
        names, *values = (F.regexp_extract_all(source, F.lit(pattern), F.lit(i)) for i in (1, 2, 3, 4))
        pairs = F.transform(names, lambda n, i: F.struct(F.lower(n).alias("k"), F.concat(*[F.get(v, i) for v in values]).alias("v"), i.alias("i")))
        last = F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["k"] == p["k"]) & (q["i"] > p["i"])))
        return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))

    return F.transform(tags, attributes)


def clean_value(c: Column) -> Column:
    return trim(decode_entities(c))
