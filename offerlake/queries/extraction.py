"""Queries on HTML, links and code candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.text import TOKEN, match_offsets, trigger_offsets, utf16
from ..functions.values import BLOCKLIST, COUPON_PARAMS, ENTITIES, REDIRECT_PARAMS, TRIGGER_PHRASES
from ..operators import candidates as C
from ..operators import links as L
from .adapters import MESSAGES_CTE, messages, spread, table


def _names(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _decoded(sql: str) -> str:
    for name, said in sorted(ENTITIES.items(), key=lambda x: x[0] == "amp"):
        sql = f"replace({sql}, '&{name};', '{said.replace(chr(39), chr(39) * 2)}')"
    return sql


def _stripped(sql: str) -> str:
    for pattern in (r"(?s)<!--.*?(?:-->|\z)", r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?is)<(script|style)\b[^>]*>.*\z"):
        sql = f"regexp_replace({sql}, '{pattern}', ' ', 'g')"
    return sql


def _visible(sql: str) -> str:
    return f"trim(regexp_replace({_decoded(f'regexp_replace({_stripped(sql)}, {chr(39)}<[^>]+>{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}, '\\s+', ' ', 'g'))"


def _values(sql: str, tag: str, attribute: str) -> str:
    p = rf"(?i)<{tag}\b[^>]*?\s{attribute}\s*=\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\s\"''>]+))".replace('\\"', '"')
    one, two, three = (f"regexp_extract_all({sql}, '{p}', {i})" for i in (1, 2, 3))
    return f"list_transform(range(1, len({one}) + 1), lambda i: concat({one}[i], {two}[i], {three}[i]))"


def c1_strip_non_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.strip_non_content(F.col("html")).alias("stripped"))


def c2_decode_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.decode_entities(F.col("html")).alias("decoded"))


def c3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.attribute_rows(table(spark, sf_dir, "pages").select("page_id", "html"), "a", "href").select("page_id", F.col("ord").cast("bigint").alias("ord"), "value")


def c4_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages")).select("page_id", H.visible_text(F.col("html")).alias("visible"))


def c5_tag_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).select("message_id", F.posexplode(H.tag_attributes(H.strip_non_content(F.col("html")), "img")).alias("ord", "a"))
    return rows.select("message_id", *[H.clean_value(F.coalesce(F.col("a")[k], F.lit(""))).alias(k) for k in ("alt", "src", "width", "height")])


def d1_query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.query_params(table(spark, sf_dir, "pages").select("page_id", "url")).withColumn("param_ord", F.col("param_ord").cast("bigint"))


def d2_link_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and redirected codes of all links of all messages (D2 and D3)."""
    links = L.attribute_rows(messages(spark, sf_dir).select("message_id", "html"), "a", "href")
    return L.link_codes(links).select("message_id", "code")


def e1_trigger_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("message_id", F.explode(trigger_offsets(utf16(F.col("text")))).alias("end")).select("message_id", F.col("end").cast("bigint").alias("end_at"))


def e2_scan_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(match_offsets(utf16(F.col("text")), TOKEN)).alias("t"))
    return rows.select("doc_id", F.col("t.match").alias("token"), F.col("t.start").cast("bigint").alias("start_at"))


def e5_text_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and scored tokens of the text surface of all messages (E3 to E5, E10)."""
    rows = messages(spark, sf_dir).select("message_id", F.lit(3).alias("surface_ord"), F.lit(0).alias("part_ord"), F.lit("text").alias("source"), "text")
    return C.text_candidates(rows).select("message_id", F.col("position").cast("bigint").alias("position"), "code", "normalized", "near", F.col("score").cast("bigint").alias("score"))


def e3_trigger_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tokens by the interval join."""
    rows = messages(spark, sf_dir).select("message_id", F.lit(3).alias("surface_ord"), F.lit(0).alias("part_ord"), F.lit("text").alias("source"), "text")
    return C.range_candidates(rows).select("message_id", F.col("position").cast("bigint").alias("position"), "code", "normalized", "near", F.col("score").cast("bigint").alias("score"))


def e8_ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All surfaces, the best of each code, ranked (E6 to E8)."""
    return C.rank_candidates(C.find_candidates(messages(spark, sf_dir))).select("message_id", "code", "normalized", "source", F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def e9_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = messages(spark, sf_dir)
    return C.scan_gate(all_).select("message_id", F.col("n_candidates").cast("bigint").alias("n_candidates"), "has_trigger", "should_extract")


_TOKENS = r"""
  toks AS (
    SELECT *, regexp_extract_all(t, '\b[A-Za-z0-9][A-Za-z0-9_-]{3,19}\b') AS m, regexp_split_to_array(t, '\b[A-Za-z0-9][A-Za-z0-9_-]{3,19}\b') AS g FROM surf
  ), each_tok AS (
    SELECT mid, so, po, src, unnest(m) AS code, unnest(g[1:len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS k FROM toks
  ), placed AS (
    SELECT *, CAST(sum(length(gap) + length(code)) OVER (PARTITION BY mid, so, po ORDER BY k) - length(code) AS BIGINT) AS position FROM each_tok
  )"""
_ENDS = f"""
  phrases AS (SELECT unnest([{_names(TRIGGER_PHRASES)}]) AS phrase),
  parts AS (SELECT mid, so, po, phrase, string_split(lower(t), phrase) AS p FROM surf, phrases WHERE contains(lower(t), phrase)),
  heads AS (SELECT mid, so, po, phrase, unnest(p[1:len(p) - 1]) AS h, unnest(range(1, len(p))) AS k FROM parts),
  ends AS (SELECT mid, so, po, CAST(sum(length(h) + length(phrase)) OVER (PARTITION BY mid, so, po, phrase ORDER BY k) AS BIGINT) AS end_at FROM heads)"""
_JUDGED = f"""
  judged AS (
    SELECT p.mid, p.so, p.po, p.src, p.position, p.code, upper(p.code) AS normalized,
      coalesce(bool_or(p.position >= e.end_at AND p.position - e.end_at <= 30), false) AS after_,
      coalesce(bool_or(abs(p.position - e.end_at) <= 40), false) AS near
    FROM placed p LEFT JOIN ends e ON p.mid = e.mid AND p.so = e.so AND p.po = e.po GROUP BY ALL
  ), accepted AS (
    SELECT *, regexp_matches(normalized, '[0-9]') AS digit FROM judged
    WHERE normalized NOT IN ({_names(BLOCKLIST)}) AND regexp_matches(normalized, '[A-Z]') AND regexp_matches(normalized, '[A-Z0-9]$')
  ), scored AS (
    SELECT mid, so, po, src, position, code, normalized, near,
      CAST(CASE WHEN src IN ('alt', 'subject') THEN 2 ELSE 0 END + CASE WHEN near THEN 3 ELSE 0 END + CASE WHEN digit THEN 1 ELSE 0 END
        + CASE WHEN length(normalized) BETWEEN 5 AND 12 THEN 1 WHEN length(normalized) > 15 THEN -1 ELSE 0 END AS BIGINT) AS score
    FROM accepted WHERE CASE WHEN code <> upper(code) THEN digit AND after_ ELSE digit OR (after_ AND length(normalized) >= 5) END
  )"""
_SURFACES = f"""
  surf AS (
    SELECT message_id AS mid, 1 AS so, po, 'alt' AS src, {_decoded('v')} AS t FROM (
      SELECT message_id, unnest({_values('s', 'img', 'alt')}) AS v, unnest(range(0, len({_values('s', 'img', 'alt')}))) AS po FROM stripped)
    UNION ALL SELECT message_id, 2, 0, 'subject', subject FROM messages
    UNION ALL SELECT message_id, 3, 0, 'text', text FROM messages
    UNION ALL SELECT message_id, 4, 0, 'text', {_visible('html')} FROM messages
  )"""
_LINKS = f"""
  hrefs AS (
    SELECT message_id, po, {_decoded('v')} AS u FROM (
      SELECT message_id, unnest({_values('s', 'a', 'href')}) AS v, unnest(range(0, len({_values('s', 'a', 'href')}))) AS po FROM stripped)
  ), absolute AS (SELECT message_id, po, u FROM hrefs WHERE regexp_matches(u, '(?i)^(https?|ftp)://[^/?#]')),
  pieces AS (
    SELECT message_id, po, unnest(string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&')) AS piece,
      unnest(range(0, len(string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&')))) AS n FROM absolute
  ), params AS (
    SELECT message_id, po, n, lower(split_part(piece, '=', 1)) AS k, url_decode(replace(regexp_extract(piece, '^[^=]*=(.*)$', 1), '+', ' ')) AS v FROM pieces WHERE piece <> ''
  ), inner_pieces AS (
    SELECT message_id, po, n, unnest(string_split(regexp_extract(v, '^[^?#]*\\?([^#]*)', 1), '&')) AS piece,
      unnest(range(0, len(string_split(regexp_extract(v, '^[^?#]*\\?([^#]*)', 1), '&')))) AS i
    FROM params WHERE k IN ({_names(REDIRECT_PARAMS)}) AND regexp_matches(v, '(?i)^(https?|ftp)://[^/?#]')
  ), codes AS (
    SELECT message_id, po, n, 0 AS i, trim(v) AS code FROM params WHERE k IN ({_names(COUPON_PARAMS)})
    UNION ALL
    SELECT message_id, po, n, i, trim(url_decode(replace(regexp_extract(piece, '^[^=]*=(.*)$', 1), '+', ' '))) FROM inner_pieces WHERE lower(split_part(piece, '=', 1)) IN ({_names(COUPON_PARAMS)})
  ), link_codes AS (SELECT * FROM codes WHERE regexp_matches(code, '^[A-Za-z0-9][A-Za-z0-9_-]{{3,19}}$'))"""
_STRIPPED = f"stripped AS (SELECT message_id, {_stripped('html')} AS s FROM messages)"
_BEST = f"""
  found AS (
    SELECT mid, so, po, src, position, code, normalized, score FROM scored
    UNION ALL
    SELECT message_id, 0, po, 'link', n * 1000 + i, code, upper(code),
      CAST(6 + CASE WHEN regexp_matches(code, '[0-9]') THEN 1 ELSE 0 END + CASE WHEN length(code) BETWEEN 5 AND 12 THEN 1 WHEN length(code) > 15 THEN -1 ELSE 0 END AS BIGINT)
    FROM link_codes WHERE upper(code) NOT IN ({_names(BLOCKLIST)}) AND regexp_matches(upper(code), '[A-Z]') AND regexp_matches(upper(code), '[A-Z0-9]$')
  ), best AS (
    SELECT mid, code, normalized, src, score FROM found QUALIFY row_number() OVER (PARTITION BY mid, normalized ORDER BY score DESC, so, po, position) = 1
  )"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (c1_strip_non_content, c2_decode_entities, c3_links, c4_visible_text, c5_tag_attributes, d1_query_params, d2_link_codes, e1_trigger_offsets, e2_scan_tokens, e3_trigger_ranges, e5_text_candidates, e8_ranked_candidates, e9_gate)}
ORACLE_SQL = {
    "c1_strip_non_content": f"SELECT page_id, {_stripped('html')} AS stripped FROM pages",
    "c2_decode_entities": f"SELECT page_id, {_decoded('html')} AS decoded FROM pages",
    "c3_links": f"WITH x AS (SELECT page_id, {_stripped('html')} AS s FROM pages), v AS (SELECT page_id, unnest({_values('s', 'a', 'href')}) AS raw, unnest(range(0, len({_values('s', 'a', 'href')}))) AS ord FROM x) SELECT page_id, CAST(ord AS BIGINT) AS ord, trim({_decoded('raw')}) AS value FROM v WHERE trim({_decoded('raw')}) <> ''",
    "c4_visible_text": f"SELECT page_id, {_visible('html')} AS visible FROM pages",
    "c5_tag_attributes": f"WITH {MESSAGES_CTE}, {_STRIPPED} SELECT message_id, " + ", ".join(f"unnest({_values('s', 'img', k)}) AS {k}" for k in ("alt", "src", "width", "height")) + " FROM stripped",
    "d1_query_params": f"WITH q AS (SELECT page_id, string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&') AS p FROM pages WHERE regexp_matches(url, '(?i)^(https?|ftp)://[^/?#]')), e AS (SELECT page_id, unnest(p) AS piece, unnest(range(0, len(p))) AS param_ord FROM q) SELECT page_id, CAST(param_ord AS BIGINT) AS param_ord, url_decode(replace(split_part(piece, '=', 1), '+', ' ')) AS key, url_decode(replace(regexp_extract(piece, '^[^=]*=(.*)$', 1), '+', ' ')) AS value FROM e WHERE piece <> ''",
    "d2_link_codes": f"WITH {MESSAGES_CTE}, {_STRIPPED}, {_LINKS} SELECT message_id, code FROM link_codes",
    "e1_trigger_offsets": f"WITH {MESSAGES_CTE}, surf AS (SELECT message_id AS mid, 3 AS so, 0 AS po, text AS t FROM messages), {_ENDS} SELECT mid AS message_id, end_at FROM ends",
    "e2_scan_tokens": f"WITH surf AS (SELECT doc_id AS mid, 3 AS so, 0 AS po, 'text' AS src, text AS t FROM documents), {_TOKENS} SELECT mid AS doc_id, code AS token, position AS start_at FROM placed",
    "e3_trigger_ranges": f"WITH {MESSAGES_CTE}, surf AS (SELECT message_id AS mid, 3 AS so, 0 AS po, 'text' AS src, text AS t FROM messages), {_TOKENS}, {_ENDS}, {_JUDGED} SELECT mid AS message_id, position, code, normalized, near, score FROM scored",
    "e5_text_candidates": f"WITH {MESSAGES_CTE}, surf AS (SELECT message_id AS mid, 3 AS so, 0 AS po, 'text' AS src, text AS t FROM messages), {_TOKENS}, {_ENDS}, {_JUDGED} SELECT mid AS message_id, position, code, normalized, near, score FROM scored",
    "e8_ranked_candidates": f"WITH {MESSAGES_CTE}, {_STRIPPED}, {_SURFACES}, {_TOKENS}, {_ENDS}, {_JUDGED}, {_LINKS}, {_BEST} SELECT mid AS message_id, code, normalized, src AS source, score, row_number() OVER (PARTITION BY mid ORDER BY score DESC, translate(normalized, '_-0123456789', chr(1) || chr(2) || '0123456789')) AS rank FROM best",
    "e9_gate": f"WITH {MESSAGES_CTE}, {_STRIPPED}, {_SURFACES}, {_TOKENS}, {_ENDS}, {_JUDGED}, {_LINKS}, {_BEST}, n AS (SELECT mid, count(*) AS n_candidates FROM best GROUP BY mid), t AS (SELECT DISTINCT mid FROM ends) SELECT message_id, CAST(coalesce(n_candidates, 0) AS BIGINT) AS n_candidates, t.mid IS NOT NULL AS has_trigger, coalesce(n_candidates, 0) > 0 OR t.mid IS NOT NULL AS should_extract FROM messages m LEFT JOIN n ON n.mid = m.message_id LEFT JOIN t ON t.mid = m.message_id",
}
