"""The driver's tables as matched designs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector

#: Labels masked in the test texts.
LABELS = ("the", "of", "une", "der", "que la")
STRATA_SQL = "{c} % 10 AS cluster, CASE WHEN {c} % 10 < 4 THEN 'd0' ELSE 'd1' END AS dimension, ({c} // 10) % 5 AS family, {c} // 50 AS article"
COMPANY_SQL = "CASE WHEN {s} < 2 THEN 'A' WHEN {s} < 4 THEN 'B' ELSE 'C' END AS company"
OBS_SQL = f"obs AS (SELECT *, {STRATA_SQL.format(c='cell')}, {COMPANY_SQL.format(s='stream')} FROM (SELECT vec_id, vec_id % 5 AS stream, vec_id // 5 AS cell, embedding::DOUBLE[] AS v FROM embeddings))"
FACT_SQL = OBS_SQL + ", fact AS (SELECT x.cell, x.cluster, x.dimension, x.family, x.article, x.stream AS a, y.stream AS b, x.company AS company_a, y.company AS company_b, least(greatest(1 - list_dot_product(x.v, y.v), 0), 2) AS distance FROM obs x JOIN obs y ON x.cell = y.cell AND x.stream < y.stream)"
BLOCKS_SQL = OBS_SQL + ", blocks AS (SELECT x.stream, x.company, x.dimension, x.article, x.family, x.cluster AS cluster_a, y.cluster AS cluster_b, least(greatest(1 - list_dot_product(x.v, y.v), 0), 2) AS distance FROM obs x JOIN obs y ON x.stream = y.stream AND x.dimension = y.dimension AND x.article = y.article AND x.family = y.family AND x.cell < y.cell)"
TEXT_SQL = f"obs AS (SELECT *, {STRATA_SQL.format(c='cell')} FROM (SELECT doc_id, doc_id % 4 AS stream, doc_id // 4 AS cell, text, lang, source FROM documents))"


def _strata(rows: DataFrame) -> DataFrame:
    c = F.col("cell")
    return rows.select("*", (c % 10).alias("cluster"), F.when(c % 10 < 4, "d0").otherwise("d1").alias("dimension"), (F.floor(c / 10) % 5).alias("family"), F.floor(c / 50).alias("article"))


def obs_vec(spark: SparkSession, sf_dir: str, size: int | None = None) -> DataFrame:
    """Vectors of five streams; ``size``: only the first elements, of unit length again."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = F.col("embedding") if size is None else vector.unit(F.slice("embedding", 1, size))
    rows = rows.select("vec_id", (F.col("vec_id") % 5).alias("stream"), F.expr("vec_id div 5").alias("cell"), v.alias("v"))
    s = F.col("stream")
    return _strata(rows).withColumn("company", F.when(s < 2, "A").when(s < 4, "B").otherwise("C"))


def obs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _strata(rows.select("doc_id", (F.col("doc_id") % 4).alias("stream"), F.expr("doc_id div 4").alias("cell"), "text", "lang", "source"))
