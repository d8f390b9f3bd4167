"""op2: every document that contains a benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import prepare
from corpusloom.llm.decontamination import find


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("key").distinct()


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: x <> '')"
SQL = f"""
WITH i AS (SELECT item_id, {_WORDS.format()} w FROM benchmark),
iw AS (SELECT item_id, w, least(len(w), 5) k FROM i WHERE len(w) > 0),
sh AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, p, p + k - 1), ' ') t
       FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) p FROM iw)),
sz AS (SELECT item_id, count(*) n FROM sh GROUP BY 1),
d AS (SELECT doc_id, xh, {_WORDS.format()} w FROM (SELECT DISTINCT doc_id, text, md5(coalesce(text, '')) xh FROM documents)),
ks AS (SELECT DISTINCT k FROM iw),
dt AS (SELECT DISTINCT doc_id, xh, array_to_string(list_slice(w, p, p + k - 1), ' ') t
       FROM (SELECT doc_id, xh, w, k, unnest(range(1, len(w) - k + 2)) p FROM d, ks WHERE len(w) >= k)),
c AS (SELECT doc_id, xh, item_id, count(*) n_found FROM dt JOIN sh USING (t) GROUP BY 1, 2, 3)
SELECT DISTINCT doc_id, item_id, CAST(n AS INT) n_shingles, CAST(n_found AS INT) n_found, n_found / n AS containment
FROM c JOIN sz USING (item_id) WHERE n_found >= ceil(0.8 * n - 1e-9)
"""
