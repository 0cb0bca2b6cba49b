"""Registered queries of the training-data operators and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textspan.llm import bpe, hamming, langid, lines, mixing, quality, repeats, sharding, simhash, tokenfile


def _over(name: str, work: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: work(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": _over("documents", simhash.op1),
    "op2_hilbert_shards": _over("documents", sharding.op2),
    "op3_multi_index_hashing": _over("embeddings", hamming.op3),
    "op4_source_mix": _over("documents", mixing.op4),
    "op5_prefix_doubling": _over("documents", repeats.op5),
    "op6_line_chunks": _over("documents", lines.op6),
    "op7_byte_bpe": _over("documents", bpe.op7),
    "op8_token_files": _over("documents", tokenfile.op8),
    "op9_language": _over("documents", langid.op9),
    "op10_quality_ledger": _over("documents", quality.op10),
}

ORACLES: dict[str, str] = {
    "op5_prefix_doubling": """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS k, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT rid, k, u.i AS i, substr(h, 2 * u.i + 1, 100) AS s FROM d, unnest(range(0, length(h) // 2 - 49)) AS u(i)
), f AS (SELECT s, min(k) AS m FROM w GROUP BY s
), g AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM w JOIN f USING (s) WHERE k > m
), n AS (SELECT rid, i, sum(CASE WHEN p IS NULL OR i - p > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM g
), r AS (SELECT rid, run, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY rid, run
), t AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed FROM r GROUP BY rid
), e AS (
  SELECT rid, a AS stop, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS start FROM r
  UNION ALL SELECT d.rid, length(h) // 2, coalesce(max(b), 0) FROM d LEFT JOIN r USING (rid) GROUP BY d.rid, h
), x AS (SELECT e.rid, string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start) AS kept FROM e JOIN d USING (rid) GROUP BY e.rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN t USING (rid) LEFT JOIN x USING (rid)
""",
    "op10_quality_ledger": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), s AS (
  SELECT rid, u.i AS i, array_to_string(list_slice(w, u.i, u.i + 4), ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS u(i)
), r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM s
), c AS (SELECT rid, count(DISTINCT i + u.k) AS n_repeat_words FROM r, unnest(range(0, 5)) AS u(k) WHERE n > 1 GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN c USING (rid)
), b AS (
  SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END) AS BIGINT) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       failed = 0 AS kept, failed FROM b
""",
}
