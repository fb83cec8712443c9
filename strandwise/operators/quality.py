"""Audit operators: counts, duplicates, completeness, dependencies, blanks, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import order


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def group_size_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """How many groups have each size."""
    return value_counts(rows, *columns).groupBy(F.col("n").alias("group_size")).agg(F.count("*").alias("groups"))


def duplicate_groups(rows: DataFrame, key: Column, index: str) -> DataFrame:
    """Groups of more than one row of a key, named by the key's hash: first row, size, and the rows' digest."""
    return rows.groupBy(F.md5(key.cast("binary")).alias("key")).agg(F.min(index).alias("first_row"), F.count("*").alias("n"), F.sum(index).alias("row_sum")).where("n > 1")


def duplicate_members(rows: DataFrame, key: Column, index: str) -> DataFrame:
    """The rows of the groups of ``duplicate_groups``: key, first_row, n, row. A list in long form, so no group is gathered."""
    keyed = rows.select(F.md5(key.cast("binary")).alias("key"), F.col(index).alias("row"))
    groups = keyed.groupBy("key").agg(F.min("row").alias("first_row"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(groups, "key").select("key", "first_row", "n", "row")


def missing_pairs(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Combinations of the values of two columns that no row has.

    Only the values of ``right`` that lack a partner are completed, by the numbers of all values of ``left``, and what
    they have is taken away; the work is of the size of the result and of these values' rows.
    """
    have = rows.select(F.col(left).alias("l"), F.col(right).alias("r")).where("l is not null and r is not null").distinct()
    codes = encoded(have.withColumn("f", F.xxhash64("l")), "l", "f")
    total = codes.agg(F.count("*")).first()[0]
    open_ = have.groupBy("r").agg(F.count("*").alias("n")).where(F.col("n") < total).select("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(total - 1, 0)).cast("long"))).alias("id"))
    lacking = open_.join(codes, "id").select("l", "r").join(have, ["l", "r"], "left_anti")
    return lacking.select(F.col("l").alias(left), F.col("r").alias(right))


def dependency_violations(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, n): fields that have other than one value within a key."""
    counts = rows.groupBy(key).agg(*[F.countDistinct(f).alias(f) for f in fields])
    long = counts.unpivot([key], fields, "field", "n")
    return long.where("n <> 1")


def blank_counts(rows: DataFrame) -> DataFrame:
    """(field, blanks, distinct values) of every column."""
    kept = [c for c, t in rows.dtypes if not t.startswith(("array", "map", "struct"))]
    one = rows.agg(*[F.count_if(text.blank(F.col(c))).alias(f"b_{c}") for c in kept], *[F.countDistinct(c).alias(f"d_{c}") for c in kept])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"b_{c}").alias("blanks"), F.col(f"d_{c}").alias("distinct_values")) for c in kept]))
    return one.select(pairs.alias("x")).select("x.*")


def coverage(rows: DataFrame, by: str, cell: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct(cell).alias("cells"))


def stream_summary(rows: DataFrame, stream: str, words: str, ok: str) -> DataFrame:
    """Rows, mean and median words, share within the length range."""
    return rows.groupBy(stream).agg(F.count("*").alias("n"), F.avg(words).alias("mean_words"), F.median(words).alias("median_words"), F.min(words).alias("min_words"), F.max(words).alias("max_words"), F.avg(F.col(ok).cast("double")).alias("compliance"))


def flagged(rows: DataFrame, flags: dict[str, Column], *keep: str) -> DataFrame:
    """Rows with one flag or more: ``keep``, flags joined by semicolons."""
    return rows.select(*keep, text.joined_flags(flags).alias("flags")).where("flags <> ''")


def flag_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.split("flags", ";")).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def attached_flags(rows: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the sorted list of their flags, empty where there are none."""
    lists = flags.groupBy(*keys).agg(F.sort_array(F.collect_set("flag")).alias("flag_list"))
    return rows.join(lists, keys, "left").withColumn("flag_list", F.coalesce("flag_list", F.array().cast("array<string>")))


def encoded(rows: DataFrame, column: str, index: str) -> DataFrame:
    """Dense ids of a dimension's values, in the order of their first row: (column, id)."""
    first = rows.groupBy(column).agg(F.min(index).alias("_first"))
    return order.numbered(first, "_first", "id").select(column, F.col("id").cast("long").alias("id"))


def anchored(rows: DataFrame, anchors: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``rows`` with their reviewed anchor's ``reason`` (null without one); an error where its ``evidence`` is gone.

    ``anchors``: keys, evidence, reason, one row a key.
    """
    both = rows.join(anchors.select(*keys, "evidence", "reason"), keys, "left")
    gone = F.col("evidence").isNotNull() & ~F.coalesce(F.contains(column, "evidence"), F.lit(False))
    return both.withColumn("reason", F.when(gone, F.raise_error(F.lit("reviewed evidence has changed"))).otherwise(F.col("reason"))).drop("evidence")


def audit_summary(rows: DataFrame, stream: str, cell: str, labels: list[str], time: str, raw: str, clean: str, header: Column) -> DataFrame:
    """One row a stream: counts, distinct cells, label histograms (``label=n`` by label, joined by semicolons), the
    range of ``time``, and raw and clean word counts with those out of range."""
    base = rows.groupBy(stream).agg(
        F.count("*").alias("rows"), F.countDistinct(cell).alias("unique_cells"), F.min(time).alias("time_min"), F.max(time).alias("time_max"),
        F.avg(raw).alias("raw_mean"), F.avg(clean).alias("clean_mean"), F.min(clean).alias("clean_min"), F.max(clean).alias("clean_max"),
        F.count_if(~text.in_range(F.col(raw))).alias("raw_outside"), F.count_if(~text.in_range(F.col(clean))).alias("clean_outside"), F.count_if(header).alias("headers"),
    )
    for label in labels:  # a histogram has a row a label, so few
        each = rows.groupBy(stream, label).agg(F.count("*").alias("n"))
        shown = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", F.coalesce(F.col(label).cast("string"), F.lit("")), F.col("n").cast("string")))), ";")
        base = base.join(each.groupBy(stream).agg(shown.alias(f"{label}_labels")), stream)
    return base


def attached_to_either(rows: DataFrame, by_cell: DataFrame, cell_keys: list[str], by_run: DataFrame, run: str) -> DataFrame:
    """Rows with ``flag_list``: the sorted flags of their run, then those of their cell; empty where there are none."""
    lists = lambda flags, keys, name: flags.groupBy(*keys).agg(F.sort_array(F.collect_set("flag")).alias(name))
    none = F.array().cast("array<string>")
    both = rows.join(lists(by_run, [run], "_r"), run, "left").join(lists(by_cell, cell_keys, "_c"), cell_keys, "left")
    return both.withColumn("flag_list", F.concat(F.coalesce("_r", none), F.coalesce("_c", none))).drop("_r", "_c")


def tree_hash(rows: DataFrame, text_column: str, index: str, width: int = 1024) -> DataFrame:
    """One row: a sha256 over the texts in row order, of any size: hashes of rows, then of ``width`` hashes at a time.

    ``index`` must tell rows apart. An empty table hashes the empty string.
    """
    level = order.numbered(rows.select(F.col(index).alias("at"), F.sha2(F.coalesce(text_column, F.lit("")).cast("binary"), 256).alias("h")), "at", "i").select("i", "h")
    n = rows.count()
    size = n
    while True:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))), lambda s: s["h"]), "")
        level = level.groupBy(F.floor(F.col("i") / width).alias("i")).agg(F.sha2(joined.cast("binary"), 256).alias("h"))
        size = -(-size // width)
        if size <= 1:
            break
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    return level.agg(F.coalesce(F.max("h"), F.lit(empty)).alias("corpus_sha256")).withColumn("n", F.lit(n).cast("long"))


def corpus_hash(rows: DataFrame, text_column: str, index: str) -> DataFrame:
    """One row: sha256 of the newline-joined texts in row order, for corpora that fit one value; others are an error.

    ``tree_hash`` takes any size.
    """
    size = rows.agg(F.sum(F.octet_length(text_column) + 1)).first()[0] or 0
    if size > 1 << 30:
        raise ValueError(f"{size} bytes don't fit one value: use tree_hash")
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(index, text_column))), lambda s: s[text_column]), "\n")
    return rows.agg(F.sha2(ordered.cast("binary"), 256).alias("corpus_sha256"), F.count("*").alias("n"))
