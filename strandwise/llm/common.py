"""Helpers shared by the training-data operators: shared storage, row identities, components, order statistics."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents are processed in groups of about so many bytes of text inside a task.
BLOCK_BYTES = 1 << 18
#: Caches of this process that serve all tasks of one operator.
_caches: list[dict] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a folder under the warehouse where it is unset on one machine.

    On a cluster an unset folder is an error, as a folder of one machine would lose tables with it.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage is cut, and the files survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandwise-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandwise_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that no later table or result reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._strandwise_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def released() -> None:
    """Give freed memory of this Python worker back to the system: it stays alive between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def cached(cache: dict) -> dict:
    """``cache``, emptied once a task of an operator that does not keep caches runs in this process."""
    _caches.append(cache)
    return cache


def emptied() -> None:
    """Empty the caches that an earlier operator left in this Python worker: Spark uses a worker for one after the other."""
    for cache in _caches:
        cache.clear()


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` whose tasks give their memory back when they end; unless it ``keeps`` them, caches of others as well."""

    def task(batches):
        if not keeps:
            emptied()
        yield from run(batches)
        released()

    return df.mapInArrow(task, schema)


def grouped(values: Iterable[tuple[int, str | None]], limit: int = BLOCK_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """Lists of (position, text) of about ``limit`` characters; a longer text is a list of its own."""
    keys: list[int] = []
    texts: list[str] = []
    size = 0
    for key, text in values:
        text = text or ""
        if texts and size + len(text) > limit:
            yield keys, texts
            keys, texts, size = [], [], 0
        keys.append(key)
        texts.append(text)
        size += len(text)
    if texts:
        yield keys, texts


def values(column: pa.Array, rows: int = 256) -> Iterator:
    """The column's values, as Python objects for ``rows`` rows at a time."""
    for k in range(0, len(column), rows):
        yield from column.slice(k, rows).to_pylist()


def table(batch: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(batch[f.name], type=f.type) for f in schema], schema=schema)


def bit_filter(keys: DataFrame, most: int = 1 << 28) -> np.ndarray:
    """Bits, set at the longs of column ``k`` modulo their number; false hits are possible, misses are not.

    There are 16 bits or more for each row of ``keys``, up to ``most`` (32 MB), which bounds what the driver gets and
    the tasks are sent; beyond, a filter only lets more through.
    """
    size = 1 << 16
    n = keys.count()
    while size < min(most, 16 * n):
        size *= 4
    each = keys.select(F.expr(f"cast(pmod(k, {size}L) div 64 as int)").alias("w"), F.expr("shiftleft(1L, cast(pmod(k, 64L) as int))").alias("b"))
    found = each.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return bits


def passes(bits: np.ndarray, k: np.ndarray) -> np.ndarray:
    spot = k.view(np.int64) & (64 * len(bits) - 1)
    return (bits[spot >> 6] >> (spot & 63) & 1).astype(bool)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (a long, b long): rows (node, component), component the smallest node reached.

    Alternates the large-star and small-star steps, each a grouped minimum and a join; a hot centre is only ever a
    grouped minimum (combined before the shuffle) and a skew-splittable join, never a collected list. Each round is
    written to the shared folder. Self links and nulls are ignored; an empty input gives no rows.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = stored(small, "links")
        n, same = after.count(), after.join(edges, ["u", "v"], "left_semi").count()
        done = n == same == edges.count()
        dropped(edges)
        edges = after
        if done:
            break
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 4096) -> float | None:
    """The exact k-th largest of a double column (nulls left out), by histograms of at most ``bins`` rows a round.

    None if there are fewer than ``k`` values. Each round narrows to one bin; it ends when the bin holds one value.
    """
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if k < 1 or n < k:
        return None
    rest = df.select(F.col(col).alias("x")).where("x is not null")
    while lo < hi:
        width = (hi - lo) / bins
        if lo + width <= lo or hi - width >= hi:  # the next doubles: a grouped count of the few values left
            for x, c in sorted(((r[0], r[1]) for r in rest.groupBy("x").count().collect()), reverse=True):
                k -= c
                if k <= 0:
                    return x
        index = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.lit(lo)) / F.lit(width))).cast("int")
        rows = sorted(rest.groupBy(index.alias("i")).agg(F.count("*").alias("c"), F.min("x"), F.max("x")).collect(), reverse=True)
        for i, c, least, most in rows:
            if k <= c:
                rest, lo, hi = rest.where(F.col("x").between(least, most)), least, most
                break
            k -= c
    return lo
