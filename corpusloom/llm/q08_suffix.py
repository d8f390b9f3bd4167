"""op8: every byte of a 400-byte string that starts at two places is removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import prepare
from corpusloom.llm.suffix_dedup import remove_repeats


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_N = 400
#: Over the texts as hexadecimal digits, two for each byte.
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () r, hex(encode(coalesce(text, ''))) x FROM documents),
w AS (SELECT r, p, md5(substr(x, 2 * p + 1, {2 * _N})) h FROM (SELECT r, x, unnest(range(0, length(x) // 2 - {_N} + 1)) p FROM d)),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) gap FROM w SEMI JOIN twice USING (h)),
run AS (SELECT r, p, sum(CASE WHEN gap <= {_N} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) g FROM hit),
span AS (SELECT r, g, min(p) a, max(p) + {_N} b FROM run GROUP BY r, g),
part AS (SELECT r, x, a, b, a + length(regexp_extract(substr(x, 2 * a + 1, 6), '^((?:[89AB].)*)', 1)) // 2 ca,
                b - CASE WHEN 2 * b >= length(x) THEN 0 ELSE length(regexp_extract(substr(x, 2 * b - 5, 8), '((?:[89AB].)*)$', 1)) // 2 END cb,
                coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) before FROM span JOIN d USING (r)),
cut AS (SELECT *, coalesce(lag(cb) OVER (PARTITION BY r ORDER BY a), 0) cbefore FROM part),
kept AS (SELECT r, sum(b - a) n_removed, count(*) n_spans,
                string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) left_x,
                string_agg(substr(x, 2 * cbefore + 1, 2 * (ca - cbefore)), '' ORDER BY a) || substr(any_value(x), 2 * max(cb) + 1) text_x FROM cut GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(left_x, x))) AS kept_sha256, decode(unhex(coalesce(text_x, x))) AS kept_text
FROM d LEFT JOIN kept USING (r)
"""
