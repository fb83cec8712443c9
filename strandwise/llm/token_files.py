"""Token ids in directly addressable codes: chunk levels with continuation bitmaps and rank directories.

A segment is one binary value (so any store that Spark writes can hold it)::

    magic "DAC1" | uint32 documents, levels | uint64 tokens
    per document: int64 doc_id (null: the flag below) | uint64 its first token in the segment, one entry more
    bitmap of documents whose doc_id is null
    per level: uint64 entries | bytes, one chunk of 8 bits an entry
             | bitmap, bit set: the value goes on in the next level (absent from the last level)
             | uint32 rank directory: set bits before each block of 512 bits

``access`` finds any token by one rank a level, without decoding its neighbours.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, tokenizer_path

MAGIC, BLOCK = b"DAC1", 512
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.uint8)


def pack(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """(chunks, bitmap, ranks) of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        low = (rest & 255).astype(np.uint8)
        if not more.any():
            return [*levels, (low, None, None)]
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        counts = _ONES[bits].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint32)
        levels.append((low, bits, ranks))
        rest = rest[more] >> np.uint32(8)


def segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.uint64)
    levels = pack(np.concatenate(ids) if ids else np.zeros(0, np.uint32))
    nulls = np.packbits([d is None for d in doc_ids], bitorder="little")
    out = [MAGIC, struct.pack("<IIQ", len(doc_ids), len(levels), int(first[-1])), np.array([d or 0 for d in doc_ids], np.int64).tobytes(), first.tobytes(), nulls.tobytes()]
    for low, bits, ranks in levels:
        out += [struct.pack("<Q", len(low)), low.tobytes()] + ([bits.tobytes(), ranks.tobytes()] if bits is not None else [])
    return b"".join(out)


class Segment:
    """Reader of one segment; all parts are views of its bytes."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token segment")
        docs, n_levels, self.tokens = struct.unpack_from("<IIQ", blob, 4)
        at = 20

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(blob, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        raw, self.first = take(np.int64, docs), take(np.uint64, docs + 1).astype(np.int64)
        null = np.unpackbits(take(np.uint8, -(-docs // 8)), count=docs, bitorder="little")
        self.doc_ids = [None if z else int(d) for d, z in zip(raw, null, strict=True)]
        self.levels = []
        for k in range(n_levels):
            (n,) = struct.unpack_from("<Q", blob, at)
            at += 8
            low = take(np.uint8, n)
            blocks = 0 if k == n_levels - 1 else -(-n // BLOCK)
            self.levels.append((low, take(np.uint8, blocks * BLOCK // 8), take(np.uint32, blocks)))

    def access(self, i: int) -> int:
        """The token at ``i``."""
        value = 0
        for k, (low, bits, ranks) in enumerate(self.levels):
            value |= int(low[i]) << (8 * k)
            if k == len(self.levels) - 1 or not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK * (BLOCK // 8)
            before = int(_ONES[bits[block : i >> 3]].sum()) + int(_ONES[bits[i >> 3] & ((1 << (i & 7)) - 1)])
            i = int(ranks[i // BLOCK]) + before
        raise AssertionError

    def slice(self, start: int, end: int) -> np.ndarray:
        """Tokens start..end-1: by level, the entries of a range that go on are again one range."""
        low = self.levels[0][0]
        out = low[start:end].astype(np.uint32)
        where = np.arange(end - start)
        for k in range(len(self.levels) - 1):
            _, bits, ranks = self.levels[k]
            if end == start:
                break
            lead = start // BLOCK * BLOCK
            flags = np.unpackbits(bits[lead >> 3 : (end + 7) >> 3], bitorder="little")[: end - lead]
            begin = int(ranks[start // BLOCK]) + int(flags[: start - lead].sum(dtype=np.int64))
            more = flags[start - lead :].astype(bool)
            where = where[more]
            start, end = begin, begin + len(where)
            out[where] |= self.levels[k + 1][0][start:end].astype(np.uint32) << np.uint32(8 * (k + 1))
        return out

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        ids = self.slice(0, self.tokens)
        for k, doc_id in enumerate(self.doc_ids):
            a, b = int(self.first[k]), int(self.first[k + 1])
            yield doc_id, a, ids[a:b]


SEGMENTS = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])
_SEGMENTS = "shard int, segment int, before long, n_docs long, n_tokens long, data binary"


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = 1, drops_space: bool = False, shard_bytes: int = 32 << 20, segment_tokens: int = 1 << 19) -> None:
    """Encode ``documents`` (doc_id, text; other columns are ignored) and write segments in ascending doc_id order.

    Shards are ranges of (doc_id, hash of the text, row) of about ``shard_bytes`` of text, so that rows of one doc_id,
    and equal rows, are divided as well; each is one task. Null texts are empty, null doc_ids come first, rows of one
    doc_id go by their text's hash, repeated rows stay, an empty table writes no segment. Within a shard ``segment``
    counts up and ``before`` is the number of its earlier tokens; the order of all tokens is (shard, segment).
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    keyed = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(max(1, -(-size // shard_bytes)), F.col("doc_id").asc_nulls_first(), "hash", "row")
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "hash", "row").select("doc_id", "text")
    file, end = tokenizer, np.array([end_id], np.uint32)

    def encode(batches):
        from pyspark import TaskContext

        code = encoder(tokenizer_path(file), drops_space)
        shard = TaskContext.get().partitionId()
        names, ids, size, number, before = [], [], 0, 0, 0

        def made():
            return common.table({"shard": [shard], "segment": [number], "before": [before], "n_docs": [len(names)], "n_tokens": [size], "data": [segment(names, ids)]}, SEGMENTS)

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for at, texts in common.grouped(enumerate(common.values(batch.column("text")))):
                for k, x in zip(at, code.ids(texts), strict=True):
                    names.append(keys[k])
                    ids.append(np.concatenate([x, end]))
                    size += len(ids[-1])
                    if size >= segment_tokens:
                        yield made()
                        before += size
                        names, ids, size, number = [], [], 0, number + 1
        if names:
            yield made()

    common.arrow(dealt, encode, _SEGMENTS, keeps=True).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The driver and each task get one number a shard; the segments themselves stay where they are read.
    """
    found = spark.read.schema(_SEGMENTS).parquet(path)
    sums = sorted((r[0], r[1]) for r in found.groupBy("shard").agg(F.sum("n_tokens")).collect())
    offsets = np.zeros((sums[-1][0] if sums else 0) + 2, np.int64)
    for shard, tokens in sums:
        offsets[shard + 1] = tokens
    shared = spark.sparkContext.broadcast(np.cumsum(offsets))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches):
        for batch in batches:
            for shard, before, blob in zip(batch.column("shard").to_pylist(), batch.column("before").to_pylist(), batch.column("data"), strict=True):
                base = int(shared.value[shard]) + before
                rows = [(d, base + a, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, a, x in Segment(blob.as_py()).documents()]
                yield common.table(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema)

    return common.arrow(found.select("shard", "before", "data"), decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{common.shared_dir(spark)}/strandwise-tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, "word_bpe_49k.json", end_id=1, drops_space=True)
    return read_tokens(spark, path)
