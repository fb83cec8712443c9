"""Packing of token ids into sequences of one length by minimum bin slack, with free cuts."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, tokenizer_path


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (each at most ``counts`` times) with the sum closest to ``capacity`` from below.

    The longest length is always taken, so that windows end. A bit set of reachable sums grows by one group of equal
    items at a time, longest first, their count split in powers of two; it stops once ``capacity`` is reachable. Going
    back through the kept sets gives the counts.
    """
    lengths = sorted(counts, reverse=True)
    mask = (1 << (capacity + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    reach, goal = 1 << lengths[0], 1 << capacity
    for length in lengths:
        left = min(counts[length] - (length == lengths[0]), (capacity - lengths[0]) // length)
        size = 1
        while left > 0 and not reach & goal:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left -= take
            size *= 2
        if reach & goal:
            break
    total = reach.bit_length() - 1
    chosen = {lengths[0]: 1}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def pack(lengths: list[int], capacity: int = 2048) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length); ``lengths`` are the documents' token counts.

    Whole windows are cut from long documents first; the rests are packed by ``fill``, a found multiset being used as
    often as its counts allow. A longest rest whose best multiset is short of ``capacity`` is set aside while the others
    are packed. Those set aside then take their closest multiset each, its slack filled by one cut from the longest rest
    left, which goes on as a shorter rest. What is short of a window at the end is cut at the powers of two of its
    length, which need no padding. A length of 0 gives no piece.
    """
    out: list[list[tuple[int, int, int]]] = []
    rests: dict[int, list[tuple[int, int]]] = {}
    for doc, n in enumerate(lengths):
        whole = n // capacity
        out += [[(doc, k * capacity, capacity)] for k in range(whole)]
        if n % capacity:
            rests.setdefault(n % capacity, []).append((doc, whole * capacity))
    counts = {k: len(v) for k, v in rests.items()}
    aside: dict[int, int] = {}
    for cutting in (False, True):
        while counts:
            chosen = fill(counts, capacity)
            slack = capacity - sum(k * c for k, c in chosen.items())
            if slack and not cutting:
                longest = max(counts)
                aside[longest] = counts.pop(longest)
                continue
            if slack and chosen == counts:
                break
            times = 1 if slack else min(counts[k] // c for k, c in chosen.items())
            for _ in range(times):
                out.append([(*rests[k].pop(), k) for k, c in chosen.items() for _ in range(c)])
            for k, c in chosen.items():
                counts[k] -= c * times
                if not counts[k]:
                    del counts[k]
            if slack:  # any rest left is longer than the slack, else it would have been chosen
                longest = max(counts)
                doc, start = rests[longest].pop()
                out[-1].append((doc, start, slack))
                counts[longest] -= 1
                if not counts[longest]:
                    del counts[longest]
                rests.setdefault(longest - slack, []).append((doc, start + slack))
                counts[longest - slack] = counts.get(longest - slack, 0) + 1
        if not cutting:
            counts = aside
    left = [(doc, start, k) for k in sorted(rests, reverse=True) for doc, start in rests[k]]
    room = sum(k for *_, k in left)
    sizes = [capacity] * (room // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if room % capacity >> b & 1]
    now: list[tuple[int, int, int]] = []
    for size in sizes:
        free = size
        while free:
            doc, start, k = left.pop(0)
            cut = min(k, free)
            now.append((doc, start, cut))
            free -= cut
            if cut < k:
                left.insert(0, (doc, start + cut, k - cut))
        out.append(now)
        now = []
    return out


PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def packed(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, buffer_tokens: int = 1 << 22) -> DataFrame:
    """One row a piece (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all ``documents``.

    Each task packs what it reads, ``buffer_tokens`` at a time (a longer document is packed alone), so nothing is
    shuffled and memory is bounded by the buffer and the longest text. Null texts are empty: their one piece is the end
    id. Repeated rows are packed each on its own; null doc_ids stay null; other columns are ignored; an empty table
    gives no rows. ``sequence_id`` is the task's number times 2**33 plus a count, as in monotonically_increasing_id.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    end = np.array([end_id], np.uint32)

    def run(batches):
        from pyspark import TaskContext

        code = encoder(tokenizer_path(tokenizer), False)
        number = TaskContext.get().partitionId() << 33
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal number
            out = {n: [] for n in PIECES.names}
            for pieces in pack([len(x) for x in ids], capacity):
                offset = 0
                for doc, start, length in pieces:
                    for n, v in zip(PIECES.names, (names[doc], start, length, zlib.crc32(ids[doc][start : start + length].astype("<u4").tobytes()), len(ids[doc]), number, offset), strict=True):
                        out[n].append(v)
                    offset += length
                number += 1
            names.clear()
            ids.clear()
            return common.table(out, PIECES)

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for at, texts in common.grouped(enumerate(common.values(batch.column("text")))):
                for k, x in zip(at, code.ids(texts), strict=True):
                    names.append(keys[k])
                    ids.append(np.concatenate([x, end]))
                    size += len(x) + 1
                if size >= buffer_tokens:
                    yield flush()
                    size = 0
        if names:
            yield flush()

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in PIECES.names))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), "byte_bpe_50k.json")
