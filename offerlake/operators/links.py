"""Links of pages and the parameters of their addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import clean_value, strip_non_content, tag_values
from ..functions.text import STRICT_CODE, trim
from ..functions.values import COUPON_PARAMS, REDIRECT_PARAMS


def attribute_rows(pages: DataFrame, tag: str, attribute: str, html: str = "html") -> DataFrame:
    """Adds ``ord`` and ``value`` to the columns of ``pages`` but its HTML: one row a value, empty ones dropped."""
    keep = [c for c in pages.columns if c != html]
    raw = pages.select(*keep, F.posexplode(tag_values(strip_non_content(F.col(html)), tag, attribute)).alias("ord", "raw"))
    return raw.select(*keep, "ord", clean_value(F.col("raw")).alias("value")).filter("value <> ''")


def form_decode(c: Column) -> Column:
    """Form decoding; a malformed percent sign stays."""
    plain = F.replace(c, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")), plain)


def query_pairs(url: Column) -> Column:
    """array<struct<key, value>> of an absolute address, repeats in order; empty for anything else."""
    absolute = url.rlike(r"(?i)\A\s*(?:https?|ftp|wss?)://[^/?#\s]") | (url.rlike(r"\A\s*[A-Za-z][A-Za-z0-9+.-]*:") & ~url.rlike(r"(?i)\A\s*(?:https?|ftp|wss?):"))
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    pieces = F.filter(F.split(query, "&", -1), lambda p: p != "")
    pairs = F.transform(pieces, lambda p: F.struct(form_decode(F.substring_index(p, "=", 1)).alias("key"), form_decode(F.regexp_extract(p, r"(?s)\A[^=]*=(.*)\z", 1)).alias("value")))
    return F.when(absolute, pairs).otherwise(F.array().cast("array<struct<key:string,value:string>>"))


def query_params(urls: DataFrame, url: str = "url") -> DataFrame:
    keep = [c for c in urls.columns if c != url]
    return urls.select(*keep, F.posexplode(query_pairs(F.col(url))).alias("param_ord", "pair")).select(*keep, "param_ord", F.col("pair.key").alias("key"), F.col("pair.value").alias("value"))


def link_codes(links: DataFrame, url: str = "value", coupons: list[str] = COUPON_PARAMS, redirects: list[str] = REDIRECT_PARAMS) -> DataFrame:
    """Codes in the parameters of links, and one level deep in those of addresses that redirect parameters hold.

    Adds param_ord, inner_ord and code.
    """
    keep = [c for c in links.columns if c != url]
    none = F.array().cast("array<struct<inner_ord:int,code:string>>")

    def codes(key: Column, value: Column) -> Column:
        """Both kinds of one parameter, so that links are read once for them."""
        inner = F.transform(query_pairs(value), lambda p, i: F.struct(F.lower(p["key"]).isin(coupons).alias("is"), i.alias("inner_ord"), trim(p["value"]).alias("code")))
        through = F.transform(F.filter(inner, lambda p: p["is"]), lambda p: F.struct(p["inner_ord"], p["code"]))
        direct = F.array(F.struct(F.lit(0).alias("inner_ord"), trim(value).alias("code")))
        return F.concat(F.when(F.lower(key).isin(coupons), direct).otherwise(none), F.when(F.lower(key).isin(redirects) & (value != ""), through).otherwise(none))

    found = query_params(links, url).select(*keep, "param_ord", F.explode_outer(codes(F.col("key"), F.col("value"))).alias("c"))
    return found.select(*keep, "param_ord", "c.inner_ord", "c.code").filter(F.col("code").rlike(STRICT_CODE))
