"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokenizers
from .common import spread, table
from .decontamination import find_contamination
from .fingerprints import fingerprint_versions
from .hard_negatives import mine_hard_negatives
from .jaccard_join import jaccard_components
from .languages import identify_languages
from .mixing import mix_sources
from .near_duplicates import near_duplicates
from .pages import main_text
from .personal_data import digest, personal_data
from .substrings import substring_dedup
from .tokens import count_tokens
from .toxicity import score_toxicity


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spread(table(spark, sf_dir, "documents")))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spread(table(spark, sf_dir, "pages")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence is the voting examples, the nearest first: id, similarity and label of each."""
    found = score_toxicity(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    said = F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["doc_id"], F.round(x["similarity"], 4), x["toxic"])), ",")
    return found.select("doc_id", "held_out", "score", "predicted", said.alias("evidence"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_versions(spread(table(spark, sf_dir, "documents"))).drop("differ_edited", "differ_next")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans are languages with their first and last word."""
    said = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["lang"], x["first"], x["last"])), ",")
    return identify_languages(spread(table(spark, sf_dir, "documents"))).select("doc_id", "held_out", "lang_pred", "score", said.alias("spans"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spread(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(personal_data(spread(table(spark, sf_dir, "documents")).select("doc_id", "text")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spread(table(spark, sf_dir, "documents"))).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(spread(table(spark, sf_dir, "documents")))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spread(table(spark, sf_dir, "documents")))


OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM words WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS win FROM starts
), firsts AS (
  SELECT win, min(doc_id) AS least FROM windows GROUP BY win
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS i FROM windows JOIN firsts USING (win) WHERE doc_id > least
), listed AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), kept AS (
  SELECT l.doc_id, count(g.i) AS n_removed, string_agg(l.word, ' ' ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS kept
  FROM listed l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""

OP11_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id) AS positive_rank FROM scored WHERE same QUALIFY positive_rank <= 5
), negatives AS (
  SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other_id) AS rank, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score, p.positive_rank
  FROM positives p JOIN scored s ON p.anchor = s.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score, CAST(positive_rank AS INTEGER) AS positive_rank FROM negatives
"""

OP13_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words
), tokens AS (
  SELECT r, len(s) AS n, unnest(s) AS t FROM sets
), links AS (
  SELECT a.r AS a, b.r AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
  SELECT r AS a, r AS b FROM sets UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
), least AS (
  SELECT a, min(doc_id) AS component_id FROM reached JOIN sets ON sets.r = reached.b GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN least ON a = r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_main_text, op3_near_duplicates, op4_toxicity, op5_fingerprints, op6_decontamination, op7_language_id, op8_mixing, op9_personal_data, op10_substring_dedup, op11_hard_negatives, op12_tokenizer_alignment, op13_jaccard_join)}
ORACLE_SQL: dict[str, str] = {"op10_substring_dedup": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_jaccard_join": OP13_SQL}
