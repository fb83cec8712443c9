"""Positions in a total order without one task for all rows: buckets between quantiles, and a sum of the buckets before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _buckets(rows: DataFrame, column: str, parts: int) -> Column:
    """The bucket of a number between approximate quantiles; any bounds give the same positions."""
    bounds = sorted(set(rows.select(F.col(column).cast("double").alias("x")).approxQuantile("x", [k / parts for k in range(1, parts)], 0.25 / parts)))
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(column).cast("double")))


def value_ranks(rows: DataFrame, column: str, parts: int = 32) -> DataFrame:
    """(column, before, n): each distinct number with how many rows have a smaller one and how many have it.

    Equal values are counted before they are ordered, so ties gather nothing; a bucket is ordered in one task, and
    ``parts`` sums of buckets are joined to it. Nulls are left out; an empty table gives no rows.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    counts = counts.withColumn("_b", _buckets(counts, column, parts))
    sums = counts.groupBy(F.col("_b").alias("_c")).agg(F.sum("n").alias("_s"))
    pairs = counts.select(F.col("_b")).distinct().join(sums, F.col("_c") < F.col("_b"), "left").groupBy("_b").agg(F.coalesce(F.sum("_s"), F.lit(0)).alias("_o"))
    inside = F.sum("n").over(W.partitionBy("_b").orderBy(column)) - F.col("n")
    return counts.withColumn("_i", inside).join(pairs, "_b").select(column, (F.col("_i") + F.col("_o")).alias("before"), "n")


def numbered(rows: DataFrame, column: str, name: str, parts: int = 32) -> DataFrame:
    """``rows`` with ``name``, the zero-based position of their distinct numbers in ``column``; ties share one."""
    ranks = value_ranks(rows.select(column).distinct(), column, parts).select(F.col(column).alias("_k"), F.col("before").alias(name))
    return rows.join(ranks, rows[column] == ranks["_k"]).drop("_k")
