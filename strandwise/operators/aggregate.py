"""Means of the distance fact by pair, stratum, company and block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_means(fact: DataFrame, *strata: str) -> DataFrame:
    return fact.groupBy("a", "b", *strata).agg(F.avg("distance").alias("mean_distance"), F.count("*").alias("n"))


def stratified_means(fact: DataFrame, strata: tuple[str, ...]) -> DataFrame:
    """All of the pair's means and those by each stratum in one pass, as grouping sets; ``level`` names the stratum."""
    sets = [[F.col("a"), F.col("b")], *([F.col("a"), F.col("b"), F.col(s)] for s in strata)]
    out = fact.groupingSets(sets, F.col("a"), F.col("b"), *[F.col(s) for s in strata]).agg(F.avg("distance").alias("mean_distance"), F.count("*").alias("n"), *[F.grouping(s).alias(f"_{s}") for s in strata])
    level, value = F.lit("all"), F.lit(None).cast("string")
    for s in strata:
        level = F.when(F.col(f"_{s}") == 0, s).otherwise(level)
        value = F.when(F.col(f"_{s}") == 0, F.col(s).cast("string")).otherwise(value)
    return out.select("a", "b", level.alias("level"), value.alias("value"), "mean_distance", "n")


def company_pair_cells(fact: DataFrame, cell: str = "cell", *keep: str) -> DataFrame:
    """(company_a, company_b, cell, keep, d, m): the mean over a company pair's stream pairs; names in alphabetical order."""
    keyed = fact.select(F.least("company_a", "company_b").alias("company_a"), F.greatest("company_a", "company_b").alias("company_b"), cell, *keep, "distance")
    return keyed.groupBy("company_a", "company_b", cell, *keep).agg(F.avg("distance").alias("d"), F.count("*").alias("m"))


def company_pairs(fact: DataFrame, cell: str = "cell") -> DataFrame:
    """Mean over cells of the mean over a company pair's stream pairs."""
    return company_pair_cells(fact, cell).groupBy("company_a", "company_b").agg(F.avg("d").alias("mean_distance"), F.max("m").alias("model_pairs"), F.count("*").alias("n_prompts"))


def contrast_by_cell(fact: DataFrame, cell: str = "cell", *keep: str) -> DataFrame:
    same = F.col("company_a") == F.col("company_b")
    return fact.groupBy(cell, *keep).agg(F.avg(F.when(same, F.col("distance"))).alias("within"), F.avg(F.when(~same, F.col("distance"))).alias("between"))


def company_contrast(fact: DataFrame, cell: str = "cell") -> DataFrame:
    return contrast_by_cell(fact, cell).agg(F.avg("within").alias("within_mean"), F.avg("between").alias("between_mean"), F.avg(F.col("between") - F.col("within")).alias("delta"), F.count("*").alias("n_prompts"))


BLOCK = ("stream", "company", "dimension", "article", "family")


def block_means(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(*BLOCK).agg(F.avg("distance").alias("d"), F.count("*").alias("m"))


def identity_sensitivity(blocks: DataFrame) -> DataFrame:
    """By stream and dimension: the unweighted mean of block means."""
    return block_means(blocks).groupBy("stream", "company", "dimension").agg(F.avg("d").alias("mean_distance"), F.sum("m").alias("n_pairs"), F.count("*").alias("n_blocks"))


def label_influence(blocks: DataFrame) -> DataFrame:
    """Mean over blocks of a label's mean distance to the others of its block."""
    ends = blocks.select(*BLOCK, F.explode(F.array("cluster_a", "cluster_b")).alias("cluster"), "distance")
    each = ends.groupBy(*BLOCK, "cluster").agg(F.avg("distance").alias("d"))
    return each.groupBy("stream", "company", "dimension", "cluster").agg(F.avg("d").alias("mean_distance"), F.count("*").alias("n_blocks"))


def symmetric_matrix(means: DataFrame, streams: list) -> DataFrame:
    """One row a stream, one column for each other stream, as m0, m1, ..."""
    both = means.select("a", "b", "mean_distance").unionAll(means.select(F.col("b").alias("a"), F.col("a").alias("b"), "mean_distance"))
    return both.groupBy("a").pivot("b", streams).agg(F.first("mean_distance")).select("a", *[F.col(str(s)).alias(f"m{s}") for s in streams])


def pooled_chunks(chunks: DataFrame, owner: str, weight: str, v: str) -> DataFrame:
    """Weighted sums of an owner's chunk vectors, then unit length: (owner, v)."""
    from ..functions import vector

    parts = chunks.select(owner, weight, F.posexplode(v).alias("i", "x")).groupBy(owner, "i").agg(F.sum(F.col(weight) * F.col("x").cast("double")).alias("x"))
    whole = parts.groupBy(owner).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return whole.select(owner, vector.unit(F.col("v")).alias("v"))
