"""op12: five filters over all documents, in each of their 120 orders, by part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.filter_audit import audit


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Every document meets every order; the step that removes it is the first whose filter it fails.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') part, coalesce(text, '') x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
first AS (SELECT x, min(doc_id) lowest FROM d GROUP BY x),
lab AS (SELECT doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) good, coalesce(bad, false) bad,
             map {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x),
                  'D': regexp_matches(x, '[#$%&*|]'), 'E': coalesce(d.doc_id > lowest, false)} m
      FROM d JOIN first USING (x) LEFT JOIN lab ON d.doc_id = lab.doc_id),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) c),
o AS (SELECT a.c || b.c || c.c || e.c || g.c ord FROM s a, s b, s c, s e, s g
      WHERE len(list_distinct([a.c, b.c, c.c, e.c, g.c])) = 5),
gone AS (SELECT part, good, bad, m, ord, coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda i: m[substr(ord, i, 1)])), 6) gone_at FROM f, o),
st AS (SELECT part, ord AS filter_order, CAST(step AS INT) AS step, substr(ord, step, 1) AS "filter",
              count(*) FILTER (gone_at > step) AS kept, count(*) FILTER (gone_at = step) AS removed, count(*) FILTER (gone_at < step AND m[substr(ord, step, 1)]) AS redundant,
              count(*) FILTER (m[substr(ord, step, 1)] AND list_sum(list_transform(map_values(m), lambda v: CAST(v AS INT))) = 1) AS unique_fails,
              count(*) FILTER (gone_at = step AND good) AS good_lost, count(*) FILTER (gone_at = step AND bad) AS toxic_lost
       FROM gone, (SELECT unnest([1, 2, 3, 4, 5]) step) GROUP BY part, ord, step)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, "filter") AS BIGINT) AS shapley FROM st
"""
