"""Language identification: averaged embeddings of hashed subwords and a linear softmax, fitted by SGD in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS, WIDTH, SIZES = 1 << 14, 16, (2, 3, 4)
LETTER = re.compile(r"[^\W\d_]")
#: Bytes that stand for no letter become a space: subwords are runs of letters with their borders.
_PLAIN = np.where(np.isin(np.arange(256), [*range(ord("a"), ord("z") + 1), *range(128, 256)]), np.arange(256), 32).astype(np.uint32)


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Document positions and buckets of all byte n-grams of the lower-cased texts that hold a letter."""
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    doc = np.repeat(np.arange(len(raw), dtype=np.int32), [len(x) for x in raw])
    data = _PLAIN[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    docs, buckets = [], []
    for n in SIZES:
        m = len(data) - n + 1
        if m <= 0:
            continue
        code = data[:m].copy()
        for k in range(1, n):
            code = (code << np.uint32(8)) | data[k : m + k]
        fine = (doc[:m] == doc[n - 1 :]) & (code != np.uint32(0x20202020 >> (8 * (4 - n))))
        code = (code[fine] + np.uint32(n)) * np.uint32(0x9E3779B1)
        docs.append(doc[:m][fine])
        buckets.append((code >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32))
    return np.concatenate(docs), np.concatenate(buckets)


@dataclass
class Model:
    """``table``: embedding times softmax weights by bucket, so a text's logits are the mean of its rows plus ``bias``."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        doc, bucket = subwords(texts)
        n = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
        logits = np.stack([np.bincount(doc, weights=self.table[bucket, c], minlength=len(texts)) for c in range(len(self.langs))], axis=1) / n[:, None] + self.bias
        return softmax(logits / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 8.0, seed: int = 3) -> Model:
    """Fit on (lang, buckets, shares) rows; every fourth is held back to set the temperature and the rejection score.

    ``reject`` is the score that all but one in 200 of the rightly judged held-back texts reach, at most 0.5.
    """
    langs = sorted({r[0] for r in rows})
    code = {x: k for k, x in enumerate(langs)}
    if not langs:
        return Model(["und"], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    out, bias = rng.uniform(-1, 1, (WIDTH, len(langs))), np.zeros(len(langs))
    held = [r for k, r in enumerate(rows) if k % 4 == 3] or rows
    fit = [r for k, r in enumerate(rows) if k % 4 != 3] or rows
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for k in rng.permutation(len(fit)):
            lang, index, share = fit[k]
            lr = rate * (1 - done / steps)
            hidden = share @ emb[index]
            error = softmax(hidden @ out + bias)
            error[code[lang]] -= 1
            back = out @ error
            out -= 0.05 * lr * np.outer(hidden, error)
            bias -= 0.002 * lr * error
            emb[index] -= lr * np.outer(share / max(share @ share, 1e-4) * 0.05, back)
            done += 1
    table = emb @ out
    logits = np.array([share @ table[index] + bias for _, index, share in held])
    truth = np.array([code[r[0]] for r in held])
    loss = {t: -np.log(softmax(logits / t)[np.arange(len(held)), truth] + 1e-12).mean() for t in np.geomspace(0.05, 5, 40)}
    heat = min(loss, key=loss.get)
    p = softmax(logits / heat)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    return Model(langs, table, bias, float(heat), float(min(0.5, np.quantile(right, 0.005))) if len(right) else 0.0)


def held_out(doc_id: Column) -> Column:
    """Documents that no model may learn from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fitted(documents: DataFrame, most: int = 4000) -> Model:
    """A model from a bounded sample: ``most`` labelled documents that aren't held out, those of the lowest doc_id hash.

    Executors turn whole texts into bucket shares; only these, at most BUCKETS a document, reach the driver.
    """
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("index", pa.binary()), ("share", pa.binary())])

    def run(batches):
        for batch in batches:
            for d, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True):
                index, n = np.unique(subwords([text])[1], return_counts=True)
                if len(index):
                    yield common.table({"doc_id": [d], "lang": [lang], "index": [index.astype(np.uint16).tobytes()], "share": [(n / n.sum()).astype(np.float32).tobytes()]}, schema)

    picked = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").join(F.broadcast(ids), "doc_id")
    found = common.arrow(picked, run, "doc_id long, lang string, index binary, share binary").limit(most).collect()
    found.sort(key=lambda r: (r[0] * 0x9E3779B1 % (1 << 32), r[1]))
    return train([(r[1], np.frombuffer(r[2], np.uint16).astype(np.int64), np.frombuffer(r[3], np.float32).astype(float)) for r in found])


def identified(documents: DataFrame, model: Model, reject: bool = False) -> DataFrame:
    """``documents`` with lang_pred and score, every row and column kept (own columns of these names are replaced).

    ``und`` and 0 if the text is null or has no letter; with ``reject`` also ``und`` if the score is below the model's
    rejection score. Whole texts are judged; lang, source and doc_id are never read. An empty table gives no rows.
    """
    rows = documents.drop("lang_pred", "score")
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            lang, score = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            for at, texts in common.grouped((k, t) for k, t in enumerate(common.values(batch.column("text"))) if t and LETTER.search(t)):
                p = model.probabilities(texts)
                for k, c, s in zip(at, p.argmax(axis=1), p.max(axis=1), strict=True):
                    if not reject or s >= model.reject:
                        lang[k] = model.langs[c]
                    score[k] = float(min(s, 1.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return common.arrow(rows, run, schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identified(documents.select("doc_id", "text"), fitted(documents))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
