"""Checks of results against their inputs: each gives frames for ``select.checks``, so a ledger has them by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import aggregate, select


def summary_checks(fact: DataFrame, summary: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Ledger: summary means (a, b, mean_distance, ci_low, ci_high) equal the fact's, and intervals are ordered within 0..2."""
    same = select.aligned(aggregate.pair_means(fact), summary, ["a", "b"], "mean_distance", tolerance)
    bounds = summary.agg(F.every(F.expr("ci_low <= ci_high and ci_low between 0 and 2 and ci_high between 0 and 2")).alias("ordered"))
    return select.checks(("means", same, "unmatched = 0 and apart = 0"), ("intervals", bounds, "ordered"))


def screened_checks(fact: DataFrame, excluded: DataFrame, summary: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Ledger: the screened summary (a, b, mean_distance, n) rests on all cells but the excluded, and its means are theirs."""
    kept = select.without(fact, excluded)
    cells = kept.agg(F.countDistinct("cell").alias("cells")).withColumn("one", F.lit(1))
    sizes = summary.agg(F.min("n").alias("least"), F.max("n").alias("most")).withColumn("one", F.lit(1))
    same = select.aligned(aggregate.pair_means(kept), summary, ["a", "b"], "mean_distance", tolerance)
    return select.checks(("balanced", cells.join(sizes, "one").drop("one"), "least = cells and most = cells"), ("screened means", same, "unmatched = 0 and apart = 0"))


def case_checks(cases: DataFrame, fact: DataFrame, texts: DataFrame, column: str, excluded: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """(selection, cell, a, b, quoted, distant, kept) of each case: whether its texts are those of its rows, its distance
    is the fact's, and its cell is not excluded. ``cases``: selection, cell, a, b, distance, text_a, text_b."""
    true = select.with_texts(cases.select("selection", "cell", "a", "b", "distance", F.col("text_a").alias("quote_a"), F.col("text_b").alias("quote_b")), texts, column)
    true = true.join(fact.select("cell", "a", "b", F.col("distance").alias("d")), ["cell", "a", "b"], "left").join(excluded.select("cell").distinct().withColumn("out", F.lit(True)), "cell", "left")
    return true.select(
        "selection", "cell", "a", "b",
        F.expr("coalesce(quote_a = text_a and quote_b = text_b, false)").alias("quoted"),
        F.coalesce(F.abs(F.col("distance") - F.col("d")) < tolerance, F.lit(False)).alias("distant"),
        F.col("out").isNull().alias("kept"),
    )


def board_checks(rows: DataFrame, facts: list[str], distances: DataFrame, excluded: DataFrame, screened_cells: int) -> DataFrame:
    """Ledger: no (cell, stream) stands twice, a cell's ``facts`` are the same in all rows, distances and exclusions name
    known cells only, and as many cells stay as were said."""
    twice = rows.groupBy("cell", "stream").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    clashes = rows.groupBy("cell").agg(*[F.countDistinct(F.coalesce(F.col(f).cast("string"), F.lit("\0"))).alias(f) for f in facts])
    clashes = clashes.agg(F.count_if(F.greatest(*facts, F.lit(1)) > 1 if len(facts) > 1 else F.col(facts[0]) > 1).alias("clashing"))
    cells = rows.select("cell").distinct()
    strangers = lambda x: x.select("cell").distinct().join(cells, "cell", "left_anti").agg(F.count("*").alias("unknown"))
    stay = cells.join(excluded.select("cell").distinct(), "cell", "left_anti").agg(F.count("*").alias("cells"))
    return select.checks(("unique", twice, "repeated = 0"), ("facts", clashes, "clashing = 0"), ("distance cells", strangers(distances), "unknown = 0"), ("excluded cells", strangers(excluded), "unknown = 0"), ("screened cells", stay, f"cells = {screened_cells}"))


def hashes_agree(*frames: DataFrame) -> DataFrame:
    """One row: whether one-row frames with ``corpus_sha256`` all have the same."""
    every = frames[0].select("corpus_sha256")
    for frame in frames[1:]:
        every = every.unionAll(frame.select("corpus_sha256"))
    return every.agg(F.count("*").alias("n"), (F.countDistinct("corpus_sha256") == 1).alias("agree"))
