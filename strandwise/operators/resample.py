"""Cluster bootstraps with shared draws, and rank correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import order

SEED, DRAWS = 20260927, 2000


def draws(sizes: DataFrame, n: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(k, draw, pick): for each number of clusters in column ``k`` the clusters of each draw, by md5, so equal in any engine.

    All statistics of one k share its draws.
    """
    text = lambda d, s: F.concat(F.lit(f"{seed}|"), d.cast("string"), F.lit("|"), s.cast("string"))
    pick = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda s: F.conv(F.substring(F.md5(text(F.col("draw"), s).cast("binary")), 1, 8), 16, 10).cast("long") % F.col("k"))
    return sizes.select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("draw")).select("k", "draw", pick.alias("pick"))


def generator_draws(spark: SparkSession, sizes: list[int], n: int = DRAWS, seed: int = SEED) -> DataFrame:
    """As ``draws``, those of a PCG64 generator seeded anew for each k."""
    import numpy as np

    rows = [(k, d, row.tolist()) for k in sizes for d, row in enumerate(np.random.default_rng(seed).integers(0, k, (n, k)))]
    return spark.createDataFrame(rows, "k int, draw long, pick array<long>")


def bootstrap(clusters: DataFrame, keys: list[str], cluster: str, top: Column, bottom: Column | None = None, n: int = DRAWS, seed: int = SEED, mode: str = "md5") -> DataFrame:
    """Percentile intervals (keys, ci_low, ci_high) of the mean of ``top`` over clusters, or of sum(top) / sum(bottom).

    ``clusters`` has one row for each key and cluster; a statistic's clusters are one short array, in cluster order,
    and each draw folds over it. The draws are made for the numbers of clusters that occur, so every key is kept; Spark
    broadcasts them where they are small. ``mode`` "numpy" takes ``generator_draws``.
    """
    row = F.struct(F.col(cluster).alias("c"), top.alias("x"), (F.lit(1.0) if bottom is None else bottom.cast("double")).alias("n"))
    stats = clusters.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("all")).withColumn("k", F.size("all"))
    sizes = stats.select("k").distinct()
    table = generator_draws(clusters.sparkSession, [r[0] for r in sizes.collect()], n, seed) if mode == "numpy" else draws(sizes, n, seed)
    rows = stats.join(table, "k")
    total = lambda f: F.aggregate("pick", F.lit(0.0), lambda s, i: s + F.get("all", i.cast("int"))[f])
    drawn = rows.select(*keys, (total("x") / total("n")).alias("stat"))
    return drawn.groupBy(*keys).agg(F.percentile("stat", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(*keys, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def average_rank(x: str, *by: str) -> Column:
    """Rank with ties at their mean."""
    ranks = F.rank().over(W.partitionBy(*by).orderBy(x))
    return ranks + (F.count("*").over(W.partitionBy(*by, x)) - 1) / 2.0


def _rho(ranked: DataFrame, *by: str) -> DataFrame:
    return ranked.groupBy(*by).agg(F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")).alias("rho"), F.count("*").alias("n"))


def spearman(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """(by, rho, n): rank correlation; null where either side is constant. Rows with a null side are left out.

    Without ``by`` all rows are ranked in one task: it is for tables of one row a pair of streams, and
    ``spearman_of_all`` for others.
    """
    ranked = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, average_rank(x, *by).alias("rx"), average_rank(y, *by).alias("ry"))
    return _rho(ranked, *by)


def spearman_of_all(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(rho, n) over all rows, however many: values are ranked in buckets."""
    full = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    rank = lambda c: order.value_ranks(full, c).select(c, (F.col("before") + (F.col("n") + 1) / 2.0).alias(f"r{c}"))
    return _rho(full.join(rank("x"), "x").join(rank("y"), "y"))
