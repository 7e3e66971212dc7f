"""Queries on brands, offers, dates and money."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.values import SUFFIX_RULES, SYMBOLS
from ..jobs.tables import shared_dir
from ..operators import brand as B
from ..operators import candidates as C
from ..operators import offers as O
from . import extraction as X
from .adapters import MESSAGES_CTE, SIGHTINGS_CTE, messages, sightings, table, written

TODAY = "2026-09-14"
CODE = "CLICK"


def _branded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.brand_keys(messages(spark, sf_dir))


def _arrays(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c not in ("category", "message_id")], F.array("category").alias("categories"), F.array("message_id").alias("message_ids"))


def _flat(rows: DataFrame) -> DataFrame:
    joined = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("categories", "message_ids") if c in rows.columns]
    return rows.select(*[F.col(c).cast("bigint").alias(c) if c == "extractor_version" else c for c in rows.columns if c not in ("categories", "message_ids")], *joined)


def f1_brand_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("Shop <mail@"), host, F.lit(">")).alias("sender"))
    return B.brand_keys(rows).select("page_id", "sender_domain", "brand_key", "brand")


def f2_display_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _branded(spark, sf_dir).select("message_id", "sender_domain", "brand_key", "brand")


def g1_build_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    built = O.build_offers(B.brand_keys(rows.drop("source")), C.find_candidates(rows))
    return built.select("brand_key", "normalized_code", "code", "brand", "source", "needs_review", F.get("message_ids", F.lit(0)).alias("message_id"), O.offer_key(F.col("brand_key"), F.col("normalized_code")).alias("offer_key"), "source_date")


def g3_merge_by_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(O.merge_offers(_arrays(sightings(spark, sf_dir))))


def g3_merge_in_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact fold as a scan over stretches of arrivals, with the number of messages of each offer."""
    merged, sources = O.merge_in_stretches(_arrays(sightings(spark, sf_dir)))
    return _flat(merged).join(sources.groupBy(*O.KEY).agg(F.count(F.lit(1)).alias("n_messages")), O.KEY)


def g4_merge_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(O.merge_offers_by_date(_arrays(sightings(spark, sf_dir))))


def g4_offer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.offer_sources(_arrays(sightings(spark, sf_dir)))


def g5_drop_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.drop_stale(sightings(spark, sf_dir), require_llm=True).select("seq", "brand_key", "normalized_code")


def g6_purge_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.purge_expired(sightings(spark, sf_dir), F.lit(TODAY).cast("date")).select("seq", "expiry")


def g9_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arrays(sightings(spark, sf_dir))
    return O.lookup_offers(rows, code=CODE, expires=("2026-02-01", "2026-10-31"), category="c1").select("seq", "brand_key", "expiry")


def g9_indexed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lookup over a table laid out for it."""
    path = f"{shared_dir(spark)}/lookup-{uuid.uuid4().hex}"
    O.write_lookup(_arrays(sightings(spark, sf_dir)), path)
    return O.lookup_offers(spark.read.parquet(path), code=CODE, expires=("2026-02-01", "2026-10-31"), category="c1").select("seq", "brand_key", "expiry")


def h2_expiry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's date as an expiry date, some of them no dates (H1 to H3, H6, H7)."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    said = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.substring(day, 1, 8), F.lit("31"))).when(F.col("o_orderkey") % 11 == 0, F.lit("soon")).otherwise(day)
    left = D.days_left(F.col("expiry"), F.lit("1995-06-17").cast("date"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("expiry"))
    return rows.select("o_orderkey", left.cast("bigint").alias("days_left"), D.expiry_kind(left).alias("kind"), D.describe_expiry(left).alias("said"), F.coalesce(left <= 1, F.lit(False)).alias("urgent"))


def h4_format_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    currency = F.get(F.array(*map(F.lit, ("INR", "USD", "XYZ", None))), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.format_money(F.col("o_totalprice"), currency).alias("money"))


def h5_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sightings(spark, sf_dir)
    return rows.select("seq", D.describe_conditions(F.col("min_spend"), F.col("currency"), F.col("new_users_only"), F.col("app_only"), F.col("seq") % 10 == 0, F.col("conditions")).alias("said"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active offers of each brand with their supporting messages: extraction, brands, merge and expiry."""
    rows = messages(spark, sf_dir)
    built = O.build_offers(B.brand_keys(rows.drop("source")), C.find_candidates(rows)).withColumn("seq", F.get("message_ids", F.lit(0)))
    built = written(built)  # read by the merge and by the support, several times each
    merged = O.active_offers(O.merge_offers_by_date(built.drop("categories")), F.lit(TODAY).cast("date"))
    support = O.offer_sources(built).groupBy(*O.KEY).agg(F.count(F.lit(1)).alias("n_messages"))
    return merged.join(support, O.KEY).select("brand_key", "normalized_code", "code", "brand", "source", "needs_review", "source_date", "n_messages")


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SYMBOLS.items())


def _money(amount: str, currency: str) -> str:
    whole = f"CAST(floor(round(abs({amount}), 3)) AS BIGINT)"
    text = f"CAST({whole} AS VARCHAR)"
    grouped = f"CASE WHEN length({text}) <= 3 THEN {text} ELSE reverse(trim(regexp_replace(reverse(left({text}, length({text}) - 3)), '(..)', '\\1,', 'g'), ',')) || ',' || right({text}, 3) END"
    decimals = f"regexp_replace(regexp_extract(CAST(CAST(round(abs({amount}), 3) AS DECIMAL(28, 3)) AS VARCHAR), '(\\.[0-9]+)$', 1), '\\.?0+$', '')"
    return f"CASE WHEN {amount} IS NULL THEN NULL ELSE coalesce(CASE {currency} {_CASES} ELSE {currency} || ' ' END, '') || {grouped} || {decimals} END"


_RULES = ", ".join(f"'{r}'" for r in SUFFIX_RULES if r[0] not in "*!")


def _brands(source: str, key: str) -> str:
    return f"""
  dom AS (SELECT *, lower(split_part(regexp_extract(sender, '<([^>]+)>', 1), '@', 2)) AS sender_domain FROM {source}),
  lab AS (SELECT *, string_split(sender_domain, '.') AS l FROM dom),
  suf AS (SELECT {key}, max(k) AS n FROM (SELECT {key}, l, unnest(range(1, len(l) + 1)) AS k FROM lab) WHERE array_to_string(l[len(l) - k + 1:len(l)], '.') IN ({_RULES}) GROUP BY {key}),
  branded AS (
    SELECT lab.*, coalesce(l[len(l) - coalesce(n, 1)], lower(regexp_extract(sender, '<([^>]+)>', 1))) AS brand_key, trim(regexp_extract(sender, '^([^<]*)<', 1)) AS brand
    FROM lab LEFT JOIN suf USING ({key}))"""


_FOUND = f"{MESSAGES_CTE}, {X._STRIPPED}, {X._SURFACES}, {X._TOKENS}, {X._ENDS}, {X._JUDGED}, {X._LINKS}, {X._BEST}, {_brands('messages', 'message_id')}"
_BUILT = "built AS (SELECT brand_key, normalized AS normalized_code, code, brand, CASE src WHEN 'link' THEN 'link' ELSE 'text' END AS source, src <> 'link' AS needs_review, message_id, internal_date AS source_date FROM best JOIN branded ON mid = message_id WHERE src IN ('link', 'alt'))"
_RUNS = f"""
  {SIGHTINGS_CTE}, marked AS (
    SELECT *, CASE WHEN lag(extractor_version) OVER w <> extractor_version OR lag(llm_processed) OVER w <> llm_processed THEN 1 ELSE 0 END AS turn FROM sightings WINDOW w AS (PARTITION BY brand_key, normalized_code ORDER BY seq)
  ), runs AS (SELECT *, sum(turn) OVER (PARTITION BY brand_key, normalized_code ORDER BY seq) AS run FROM marked),
  run_ AS (SELECT * FROM runs QUALIFY run = max(run) OVER (PARTITION BY brand_key, normalized_code))"""
_LATEST = ", ".join(f"arg_max({f}, (source_date, seq)) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in ("discount", "currency", "min_spend", "expiry"))
_BY_DATE = f"""max(extractor_version) AS extractor_version, bool_or(llm_processed) AS llm_processed, {_LATEST}, max(source_date) AS source_date, bool_or(new_users_only) AS new_users_only, bool_or(app_only) AS app_only,
  coalesce(arg_max(conditions, (source_date, seq)) FILTER (WHERE conditions <> ''), '') AS conditions, CASE WHEN bool_or(source = 'link') THEN 'link' ELSE arg_max(source, (source_date, seq)) END AS source, bool_and(needs_review) AS needs_review"""
_CATEGORIES = "cats AS (SELECT brand_key, normalized_code, string_agg(category, ',' ORDER BY first_) AS categories FROM (SELECT brand_key, normalized_code, category, min(seq) AS first_ FROM run_ GROUP BY ALL) GROUP BY ALL)"
# the fold, as a recursive walk along each key's sightings
_FOLD = f"""
WITH RECURSIVE {SIGHTINGS_CTE}, numbered AS (SELECT *, row_number() OVER (PARTITION BY brand_key, normalized_code ORDER BY seq) AS n FROM sightings),
walk AS (
  SELECT n, brand_key, normalized_code, source_date, extractor_version, llm_processed, discount, currency, min_spend, expiry, new_users_only, app_only, conditions, source, needs_review, [category] AS cats, [message_id] AS ids FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.n, x.brand_key, x.normalized_code,
    CASE WHEN o OR x.source_date >= a.source_date THEN x.source_date ELSE a.source_date END, x.extractor_version, x.llm_processed,
    {", ".join(f"CASE WHEN o THEN x.{f} WHEN x.source_date >= a.source_date THEN coalesce(x.{f}, a.{f}) ELSE coalesce(a.{f}, x.{f}) END" for f in ("discount", "currency", "min_spend", "expiry"))},
    CASE WHEN o THEN x.new_users_only ELSE x.new_users_only OR a.new_users_only END, CASE WHEN o THEN x.app_only ELSE x.app_only OR a.app_only END,
    CASE WHEN o THEN x.conditions WHEN x.source_date >= a.source_date THEN CASE WHEN x.conditions <> '' THEN x.conditions ELSE a.conditions END ELSE CASE WHEN a.conditions <> '' THEN a.conditions ELSE x.conditions END END,
    CASE WHEN o THEN x.source WHEN x.source = 'link' OR a.source = 'link' THEN 'link' WHEN x.source_date >= a.source_date THEN x.source ELSE a.source END,
    CASE WHEN o THEN x.needs_review ELSE x.needs_review AND a.needs_review END,
    CASE WHEN o THEN [x.category] WHEN list_contains(a.cats, x.category) THEN a.cats ELSE list_append(a.cats, x.category) END,
    CASE WHEN o THEN [x.message_id] ELSE list_append(a.ids, x.message_id) END
  FROM walk a JOIN numbered x ON x.brand_key = a.brand_key AND x.normalized_code = a.normalized_code AND x.n = a.n + 1,
    LATERAL (SELECT a.extractor_version <> x.extractor_version OR a.llm_processed <> x.llm_processed AS o)
)
SELECT brand_key, normalized_code, source_date, CAST(extractor_version AS BIGINT) AS extractor_version, llm_processed, discount, currency, min_spend, expiry, new_users_only, app_only, conditions, source, needs_review,
  array_to_string(cats, ',') AS categories, array_to_string(list_transform(ids, lambda i: CAST(i AS VARCHAR)), ',') AS message_ids
FROM walk QUALIFY n = max(n) OVER (PARTITION BY brand_key, normalized_code)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (flagship, f1_brand_keys, f2_display_brand, g1_build_offers, g3_merge_by_arrival, g3_merge_in_stretches, g4_merge_by_date, g4_offer_sources, g5_drop_stale, g6_purge_expired, g9_lookup, g9_indexed_lookup, h2_expiry_state, h4_format_money, h5_conditions)
}
_LEFT = "date_diff('day', DATE '1995-06-17', d)"
ORACLE_SQL = {
    "flagship": f"WITH {_FOUND}, {_BUILT} SELECT brand_key, normalized_code, arg_max(code, (source_date, message_id)) AS code, arg_max(brand, (source_date, message_id)) AS brand, CASE WHEN bool_or(source = 'link') THEN 'link' ELSE 'text' END AS source, bool_and(needs_review) AS needs_review, max(source_date) AS source_date, count(*) AS n_messages FROM built GROUP BY ALL",
    "f1_brand_keys": f"WITH hosts AS (SELECT page_id, 'Shop <mail@' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '>' AS sender FROM pages), {_brands('hosts', 'page_id')} SELECT page_id, sender_domain, brand_key, brand FROM branded",
    "f2_display_brand": f"WITH {MESSAGES_CTE}, {_brands('messages', 'message_id')} SELECT message_id, sender_domain, brand_key, brand FROM branded",
    "g1_build_offers": f"""WITH {_FOUND}, {_BUILT} SELECT brand_key, normalized_code, code, brand, source, needs_review, message_id, '["' || brand_key || '","' || normalized_code || '"]' AS offer_key, source_date FROM built""",
    "g3_merge_by_arrival": _FOLD,
    "g3_merge_in_stretches": _FOLD.replace("array_to_string(list_transform(ids, lambda i: CAST(i AS VARCHAR)), ',') AS message_ids", "CAST(len(list_distinct(ids)) AS BIGINT) AS n_messages"),
    "g4_merge_by_date": f"WITH {_RUNS}, {_CATEGORIES}, m AS (SELECT brand_key, normalized_code, {_BY_DATE} FROM run_ GROUP BY ALL) SELECT m.* REPLACE (CAST(extractor_version AS BIGINT) AS extractor_version), categories FROM m JOIN cats USING (brand_key, normalized_code)",
    "g4_offer_sources": f"WITH {_RUNS} SELECT brand_key, normalized_code, message_id, min(seq) AS first_seq FROM run_ GROUP BY ALL",
    "g5_drop_stale": f"WITH {SIGHTINGS_CTE} SELECT seq, brand_key, normalized_code FROM sightings WHERE extractor_version = 5 AND llm_processed",
    "g6_purge_expired": f"WITH {SIGHTINGS_CTE} SELECT seq, expiry FROM sightings WHERE expiry IS NULL OR CAST(expiry AS DATE) >= DATE '{TODAY}' - 30",
    "g9_indexed_lookup": f"WITH {SIGHTINGS_CTE} SELECT seq, brand_key, expiry FROM sightings WHERE normalized_code = '{CODE}' AND expiry BETWEEN '2026-02-01' AND '2026-10-31' AND category = 'c1'",
    "g9_lookup": f"WITH {SIGHTINGS_CTE} SELECT seq, brand_key, expiry FROM sightings WHERE normalized_code = '{CODE}' AND expiry BETWEEN '2026-02-01' AND '2026-10-31' AND category = 'c1'",
    "h2_expiry_state": f"""WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y-%m-') || '31' WHEN o_orderkey % 11 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS x FROM orders), t AS (SELECT o_orderkey, TRY_CAST(x AS DATE) AS d FROM e)
      SELECT o_orderkey, {_LEFT} AS days_left, CASE WHEN d IS NULL THEN 'unknown' WHEN {_LEFT} < 0 THEN 'expired' ELSE 'active' END AS kind,
      CASE WHEN d IS NULL THEN 'No expiry given' WHEN {_LEFT} = -1 THEN 'Expired yesterday' WHEN {_LEFT} < 0 THEN 'Expired ' || -{_LEFT} || ' days ago' WHEN {_LEFT} = 0 THEN 'Expires today' WHEN {_LEFT} = 1 THEN 'Expires tomorrow' ELSE {_LEFT} || ' days left' END AS said, coalesce({_LEFT} <= 1, false) AS urgent FROM t""",
    "h4_format_money": f"SELECT o_orderkey, {_money('o_totalprice', 'c')} AS money FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' WHEN 2 THEN 'XYZ' END AS c FROM orders)",
    "h5_conditions": f"WITH {SIGHTINGS_CTE} SELECT seq, nullif(concat_ws(' · ', 'Min ' || {_money('min_spend', 'currency')}, CASE WHEN new_users_only THEN 'New users only' END, CASE WHEN app_only THEN 'App only' END, CASE WHEN seq % 10 = 0 THEN 'One-time use' END, nullif(conditions, '')), '') AS said FROM sightings",
}
