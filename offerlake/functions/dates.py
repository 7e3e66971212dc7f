"""Expiry dates, money and conditions: columns computed on read, never stored. ``today`` is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import SYMBOLS


def strict_date(c: Column) -> Column:
    """A real day written ``yyyy-MM-dd``, from the year 100 on; else null."""
    day = F.when(c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"))
    return F.when(F.year(day) >= 100, day)


def days_left(expiry: Column, today: Column) -> Column:
    return F.date_diff(strict_date(expiry), today)


def expiry_kind(left: Column) -> Column:
    return F.when(left.isNull(), "unknown").when(left < 0, "expired").otherwise("active")


def describe_expiry(left: Column) -> Column:
    days = F.abs(left).cast("string")
    said = F.when(left.isNull(), "No expiry given").when(left == -1, "Expired yesterday").when(left < 0, F.concat(F.lit("Expired "), days, F.lit(" days ago")))
    return said.when(left == 0, "Expires today").when(left == 1, "Expires tomorrow").otherwise(F.concat(days, F.lit(" days left")))


def format_money(amount: Column, currency: Column) -> Column:
    """Symbol or code, and the amount with Indian digit groups and at most three decimals; null without an amount."""
    rounded = F.round(F.abs(amount), 3).cast("decimal(28,3)")
    whole = F.regexp_replace(F.floor(rounded).cast("string"), r"(?<=\d)(?=(?:\d{2})*\d{3}$)", ",")
    decimals = F.regexp_replace(F.regexp_extract(rounded.cast("string"), r"(\.\d+)$", 1), r"\.?0+$", "")
    symbol = F.coalesce(F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv])[currency], F.concat(currency, F.lit(" ")), F.lit(""))
    return F.concat(symbol, F.when((amount < 0) & (rounded > 0), "-").otherwise(""), whole, decimals)


def describe_conditions(min_spend: Column, currency: Column, new_users: Column, app_only: Column, single_use: Column, conditions: Column) -> Column:
    parts = [
        F.concat(F.lit("Min "), format_money(min_spend, currency)),
        F.when(new_users, "New users only"),
        F.when(app_only, "App only"),
        F.when(single_use, "One-time use"),
        F.when(conditions != "", conditions),
    ]
    return F.nullif(F.concat_ws(" · ", *parts), F.lit(""))


def retention_cutoff(today: Column, grace_days: int = 30) -> Column:
    return F.date_format(F.date_sub(today, grace_days), "yyyy-MM-dd")
