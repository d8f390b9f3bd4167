"""op3: for every twentieth vector its 20 nearest by inner product."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.ann import search
from corpusloom.llm.common import prepare


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), lambda v: v % 20 == 0)


#: Where all lists are read (up to some 4,000 vectors) the search is exact. The sum goes from the first term to the last.
SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
