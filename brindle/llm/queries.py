"""The numbered operators' queries over the whole tables, and their SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import (
    brown,
    fingerprints,
    language,
    mixing,
    neardup,
    packing,
    pages,
    quality,
    repair,
    spelling,
    substrings,
    toxicity,
    vectors,
)
from brindle.llm.text import crc_mod
from brindle.staging import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def tokenizer_path() -> str:
    """Where the public tokenizer's vocabulary lies on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return brown.learn_and_score(docs, held_out)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removals(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), docs.filter(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audit(repair.damage(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_html_extraction": op3_html_extraction,
    "op4_near_dedup": op4_near_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_mixing": op8_mixing,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_repair": op13_conversation_repair,
}

#: DuckDB's regular expression of a word.
_WORD = "'[^\\x20\\x09-\\x0D]+'"

_OP1 = f"""
WITH w AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws
  FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w)
), again AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT g.doc_id, unnest(generate_series(g.i, g.i + 4)) AS p FROM g JOIN again USING (doc_id, g))
  GROUP BY doc_id
), m AS (
  SELECT doc_id, host, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD})))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD})))))::BIGINT
      AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_symbols * 10 > n_words AS fail_symbols, n_dup_lines * 10 > greatest(n_words, 1) AS fail_lines,
    word_chars / greatest(n_words, 1) < 2 OR word_chars / greatest(n_words, 1) > 15 AS fail_length
  FROM m
), r AS (
  SELECT host, rule, count(*) AS n, sum(fail::INT) AS k, any_value(most) AS most
  FROM (
    SELECT host, 'base' AS rule, base_failed AS fail, 0.5 AS most FROM f
    UNION ALL SELECT host, 'symbols', fail_symbols, 0.6 FROM f
    UNION ALL SELECT host, 'lines', fail_lines, 0.6 FROM f
    UNION ALL SELECT host, 'length', fail_length, 0.6 FROM f)
  GROUP BY host, rule
), prior AS (
  SELECT rule, avg(k / n) AS a,
    CASE WHEN var_pop(k / n) > 0
      THEN greatest(1.0, least(1e6, avg(k / n) * (1 - avg(k / n)) / var_pop(k / n) - 1)) ELSE 1e6 END AS weight
  FROM r GROUP BY rule
), bad AS (
  SELECT DISTINCT host, TRUE AS refused FROM r JOIN prior USING (rule) WHERE (k + a * weight) / (n + weight) > most
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND refused IS NULL AS kept
FROM f LEFT JOIN bad ON f.host IS NOT DISTINCT FROM bad.host
"""

_OP8 = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD}))::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, sum(3 * source_size) OVER w AS caps, sum(weight) OVER w AS used, row_number() OVER w AS k
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source ROWS UNBOUNDED PRECEDING)
), t AS (SELECT sum(source_size) AS total, sum(weight) AS weights FROM s),
levels AS (
  SELECT k, (total - (caps - 3 * source_size))::DOUBLE / (weights - (used - weight))::DOUBLE AS level,
    3 * source_size AS cap, weight
  FROM o, t
), level AS (SELECT level FROM levels WHERE weight * level <= cap ORDER BY k LIMIT 1),
x AS (
  SELECT source, source_size, least(weight * level, (3 * source_size)::DOUBLE) AS target FROM s, level
), y AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM x
), z AS (SELECT *, round(target - whole * source_size)::BIGINT AS extra FROM y)
SELECT doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, extra - coalesce(sum(size) OVER (
    PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT
    AS taken
FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source
"""

_OP11 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a),
c AS (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": _OP1, "op8_mixing": _OP8, "op11_embedding_dedup": _OP11}
