"""The registered queries of this folder, and their SQL where SQL expresses them."""

from __future__ import annotations

from riskloom.llm import collocations, debruijn, decontam, html_extract, jaccard_join, license_scan, packing, quality_model, quality_rules, ranking, secrets, simhash, suffix_dedup
from riskloom.llm.common import table

QUERIES = {
    "op1_secret_scan": lambda spark, d: secrets.op1(table(spark, d, "documents")),
    "op2_quality_classifier": lambda spark, d: quality_model.op2(table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_license_scan": lambda spark, d: license_scan.op3(table(spark, d, "documents")),
    "op4_decontamination": lambda spark, d: decontam.op4(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op5_suffix_dedup": lambda spark, d: suffix_dedup.op5(table(spark, d, "documents")),
    "op6_html_extraction": lambda spark, d: html_extract.op6(table(spark, d, "pages")),
    "op7_passage_dedup": lambda spark, d: debruijn.op7(table(spark, d, "documents")),
    "op8_jaccard_join": lambda spark, d: jaccard_join.op8(table(spark, d, "documents")),
    "op9_quality_rules": lambda spark, d: quality_rules.op9(table(spark, d, "documents")),
    "op10_best_fit_packing": lambda spark, d: packing.op10(table(spark, d, "documents")),
    "op11_simhash_dedup": lambda spark, d: simhash.op11(table(spark, d, "documents")),
    "op12_ranked_search": lambda spark, d: ranking.op12(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op13_collocations": lambda spark, d: collocations.op13(table(spark, d, "documents")),
}


def _sql9() -> str:
    stop = ", ".join("'" + w + "'" for w in sorted({w for words in quality_rules.STOP_WORDS.values() for w in words}))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS s FROM documents),
a AS (
  SELECT doc_id, s,
    list_filter(string_split_regex(s, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(s, chr(10)), lambda l: regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g') <> '') AS lines
  FROM t),
g AS (
  SELECT doc_id, i, words[i:i+4] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM a)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM g) WHERE n > 1),
c AS (
  SELECT doc_id, CAST(sum(least(5, i - coalesce(p, -9))) AS BIGINT) AS n
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM d) GROUP BY doc_id),
m AS (
  SELECT a.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(s, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(s) - length(regexp_replace(s, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(s) - length(replace(s, '!', '')) AS BIGINT) AS n_shouts,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    len(lines) AS n_lines,
    coalesce(c.n, 0) AS n_repeat_words,
    len(list_filter(words, lambda w: w IN ({stop}))) AS n_stop
  FROM a LEFT JOIN c ON a.doc_id = c.doc_id),
v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_words < 10 OR CAST(n_repeat_words AS DOUBLE) / n_words > 0.2
    OR CAST(word_chars AS DOUBLE) / n_words < 2 OR CAST(word_chars AS DOUBLE) / n_words > 15
    OR CAST(n_symbols AS DOUBLE) / n_words > 0.25 OR CAST(n_shouts AS DOUBLE) / n_words > 0.3
    OR (n_words >= 60 AND CAST(n_stop AS DOUBLE) / n_words < 0.02)
    OR CAST(n_dup_lines AS DOUBLE) / n_lines > 0.5 AS bad
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(bad, true) AS kept
FROM v"""


ORACLES = {"op9_quality_rules": _sql9(), "op12_ranked_search": ranking.SQL, "op13_collocations": collocations.SQL}
