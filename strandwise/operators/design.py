"""Roles of the columns of a matched design, and the pair operators on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector


@dataclass(frozen=True)
class Design:
    """Column names: ``stream`` (ordinal), ``cell`` and the strata that are functions of the cell; ``company`` of the stream."""

    stream: str = "stream"
    cell: str = "cell"
    cluster: str = "cluster"
    dimension: str = "dimension"
    family: str = "family"
    article: str = "article"
    company: str = "company"

    @property
    def strata(self) -> tuple[str, ...]:
        return (self.cluster, self.dimension, self.family, self.article)


def matched_pairs(obs: DataFrame, design: Design = Design(), keep: tuple[str, ...] = ("v",)) -> DataFrame:
    """Observations a and b of one cell, a before b: cell, strata, a, b, company_a, company_b, and ``keep`` of both.

    An equi-join on the cell, whose groups are as many rows as there are streams.
    """
    d = design
    a = obs.select(d.cell, *d.strata, F.col(d.stream).alias("a"), F.col(d.company).alias("company_a"), *[F.col(k).alias(f"{k}_a") for k in keep])
    b = obs.select(F.col(d.cell).alias("_cell"), F.col(d.stream).alias("b"), F.col(d.company).alias("company_b"), *[F.col(k).alias(f"{k}_b") for k in keep])
    return a.join(b, (a[d.cell] == b["_cell"]) & (a["a"] < b["b"])).drop("_cell")


def distances(obs: DataFrame, design: Design = Design()) -> DataFrame:
    """The distance fact: cell, strata, a, b, companies, distance."""
    return matched_pairs(obs, design).withColumn("distance", vector.cosine_distance(F.col("v_a"), F.col("v_b"))).drop("v_a", "v_b")


def block_distances(obs: DataFrame, design: Design = Design()) -> DataFrame:
    """Pairs of labels within a block (stream, dimension, article, family): both clusters and the distance."""
    d = design
    keys = [d.stream, d.dimension, d.article, d.family]
    a = obs.select(*keys, F.col(d.company).alias(d.company), F.col(d.cluster).alias("cluster_a"), F.col(d.cell).alias("cell_a"), F.col("v").alias("v_a"))
    b = obs.select(*keys, F.col(d.cluster).alias("cluster_b"), F.col(d.cell).alias("cell_b"), F.col("v").alias("v_b"))
    pairs = a.join(b, keys).where("cell_a < cell_b")
    return pairs.withColumn("distance", vector.cosine_distance(F.col("v_a"), F.col("v_b"))).drop("v_a", "v_b")


def with_dimension(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of their row of ``dimension``, null where it has none; an error where a key stands twice.

    Spark broadcasts a dimension that is small.
    """
    twice = dimension.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError("a key of the dimension stands twice")
    return rows.join(dimension, key, "left")
