"""Importance resampling: hashed n-gram models of target and raw text, their log ratio, and a Gumbel top-k sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textblocks

BUCKETS = 1 << 14


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Document positions and buckets of all words and word pairs of lower-cased texts."""
    w = textblocks.words([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    pairs, at = textblocks.shingles(w, 2)
    doc = np.concatenate([w.doc, w.doc[at]])
    return doc, (np.concatenate([w.hash, pairs]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def target_ids(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` documents labelled good and not toxic, those of the lowest hash: a bounded sample."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def model(documents: DataFrame, targets: DataFrame) -> np.ndarray:
    """Log ratio of target to raw probability by bucket, both with one added to each count. All documents are raw."""
    rows = documents.select("doc_id", "text").join(F.broadcast(targets.withColumn("target", F.lit(True))), "doc_id", "left").select("text", "target")
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            hit = np.array([bool(x) for x in batch.column("target").to_pylist()], dtype=bool)
            for at, texts in common.grouped(enumerate(common.values(batch.column("text")))):
                doc, bucket = features(texts)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[hit[np.array(at)][doc]], minlength=BUCKETS)
        found = np.flatnonzero(raw)
        yield common.table({"bucket": found, "raw": raw[found], "target": target[found]}, schema)

    # at most BUCKETS rows reach the driver
    sums = rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for bucket, r, t in sums:
        raw[bucket] += r
        target[bucket] += t
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weighed(documents: DataFrame, ratio: np.ndarray, seed: int = 7) -> DataFrame:
    """(doc_id, n_features, log_weight, key): key is log_weight plus Gumbel noise drawn from a hash of doc_id and ``seed``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("log_weight", pa.float64())])

    def run(batches):
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for at, texts in common.grouped(enumerate(common.values(batch.column("text")))):
                doc, bucket = features(texts)
                n = np.bincount(doc, minlength=len(texts))
                w = np.bincount(doc, weights=ratio[bucket], minlength=len(texts))
                yield common.table({"doc_id": [keys[k] for k in at], "n_features": n, "log_weight": [float(x) if c else None for x, c in zip(w, n, strict=True)]}, schema)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_features long, log_weight double")
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return rows.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))


def sampled(documents: DataFrame, labels: DataFrame, share: float | None = None, most_targets: int = 20_000, seed: int = 7) -> DataFrame:
    """Every document (doc_id, text; other columns are ignored) with its weight, key and whether the sample has it.

    The sample is the top k keys, k being ``share`` of the documents; None takes the share of good labels among all
    labels, the estimate of how much of the corpus is like the target. ``most_targets`` bounds the labelled documents
    that fit the target model; the raw model counts all documents. A text without words (null, empty) has no weight
    and is not kept; ties at the k-th key (repeated rows) are all kept; without labels nothing is known and all texts
    with words are kept. An empty table gives no rows.
    """
    targets = target_ids(labels, most_targets)
    good, n = labels.agg(F.count_if(F.col("quality") == 1), F.count("quality")).first() if share is None else (1, 1)
    scores = common.stored(weighed(documents, model(documents, targets), seed), "weights")
    part = share if share is not None else good / n if n else 1.0
    cut = common.kth_largest(scores, "key", round(scores.count() * part))
    kept = F.col("key").isNotNull() if cut is None else F.coalesce(F.col("key") >= cut, F.lit(False))
    return scores.withColumn("kept", kept)


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
