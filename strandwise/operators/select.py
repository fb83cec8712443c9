"""Case selection with a full order for ties, screening, and the check ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_cases(fact: DataFrame, n: int = 6, largest: bool = True) -> DataFrame:
    """The n largest (or smallest) distances; ties by cell, a, b."""
    return fact.orderBy(F.desc("distance") if largest else F.asc("distance"), "cell", "a", "b").limit(n)


def furthest_by_pair(fact: DataFrame) -> DataFrame:
    """Each pair's cell of the largest distance, the first one on ties: a grouped maximum."""
    best = fact.groupBy("a", "b").agg(F.max(F.struct("distance", (-F.col("cell")).alias("c"))).alias("m"))
    return best.select("a", "b", (-F.col("m.c")).alias("cell"), F.col("m.distance").alias("distance"))


def upper_median_by_pair(fact: DataFrame) -> DataFrame:
    """Each pair's element at n // 2 of its distances in ascending order; ties by cell.

    Two approximate quantiles about the middle, whose rank is off by a ten-thousandth of n at most, enclose it; only
    what lies between them is ordered.
    """
    bounds = F.percentile_approx("distance", [0.499, 0.501], 10_000)
    sizes = fact.groupBy("a", "b").agg(F.count("*").alias("n"), bounds.alias("q")).select("a", "b", "n", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    rows = fact.select("a", "b", "cell", "distance").join(sizes, ["a", "b"])
    below = rows.where("distance < lo").groupBy("a", "b").agg(F.count("*").alias("below"))
    near = rows.where("distance between lo and hi").join(below, ["a", "b"], "left").withColumn("r", F.row_number().over(W.partitionBy("a", "b").orderBy("distance", "cell")))
    return near.where("r + coalesce(below, 0) = n div 2 + 1").select("a", "b", "cell", "distance")


def without(rows: DataFrame, excluded: DataFrame, cell: str = "cell") -> DataFrame:
    return rows.join(excluded.select(cell).distinct(), cell, "left_anti")


def only(rows: DataFrame, included: DataFrame, cell: str = "cell") -> DataFrame:
    return rows.join(included.select(cell).distinct(), cell, "left_semi")


def checks(*named: tuple[str, DataFrame, str]) -> DataFrame:
    """Ledger (check, pass, details): each check is a frame and a condition over one aggregate row of it."""
    out = None
    for name, rows, condition in named:
        one = rows.selectExpr(f"'{name}' as check", f"coalesce({condition}, false) as pass", f"to_json(struct({', '.join(rows.columns)})) as details")
        out = one if out is None else out.unionAll(one)
    return out


def aligned(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """One row: pairs of two tables, those only in one, and those further apart than ``tolerance``."""
    both = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys, "full_outer")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unmatched"), F.count_if(F.abs(F.col("x") - F.col("y")) > tolerance).alias("apart"))


def first_rows(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Of each key's rows the one of the smallest ``index``, by a grouped minimum; ``index`` must tell rows apart."""
    first = rows.groupBy(*keys).agg(F.min(index).alias("_first"))
    return rows.join(first.select(F.col("_first").alias(index)), index, "left_semi")


def condition(rows: DataFrame, values: dict[str, object], cell: str = "cell") -> DataFrame:
    """Rows that have all of ``values``; an error unless they are of exactly one cell."""
    found = rows
    for column, value in values.items():
        found = found.where(F.col(column).eqNullSafe(F.lit(value)))
    cells = found.select(cell).distinct().limit(2).count()
    if cells != 1:
        raise ValueError("the condition has no cell" if not cells else "the condition has more than one cell")
    return found


def with_texts(cases: DataFrame, texts: DataFrame, column: str, cell: str = "cell", stream: str = "stream") -> DataFrame:
    """``cases`` (cell, a, b) with both streams' texts, text_a and text_b: two lookups by (cell, stream)."""
    a = texts.select(cell, F.col(stream).alias("a"), F.col(column).alias("text_a"))
    b = texts.select(cell, F.col(stream).alias("b"), F.col(column).alias("text_b"))
    return cases.join(a, [cell, "a"], "left").join(b, [cell, "b"], "left")


def selections(fact: DataFrame) -> DataFrame:
    """Cases to read, with ``selection``: the largest and smallest distance of all, and for each pair of one company its
    upper median and its largest."""
    names = ["cell", "a", "b", "distance"]
    same = fact.where("company_a = company_b")
    parts = [("high", top_cases(fact, 1)), ("low", top_cases(fact, 1, largest=False)), ("company_median", upper_median_by_pair(same)), ("company_high", furthest_by_pair(same))]
    out = None
    for name, part in parts:
        one = part.select(F.lit(name).alias("selection"), *names)
        out = one if out is None else out.unionByName(one)
    return out


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows only ``a`` and only ``b`` has (with repetition), and whether both are equal or a is a part of b."""
    only_a, only_b = a.exceptAll(b).select(F.lit(1).alias("x"), F.lit(0).alias("y")), b.exceptAll(a).select(F.lit(0).alias("x"), F.lit(1).alias("y"))
    both = only_a.unionAll(only_b).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("only_a"), F.coalesce(F.sum("y"), F.lit(0)).alias("only_b"))
    return both.select("only_a", "only_b", F.expr("only_a = 0 and only_b = 0").alias("equal"), F.expr("only_a = 0").alias("subset"))
