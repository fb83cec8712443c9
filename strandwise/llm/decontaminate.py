"""Benchmark decontamination: rare word pairs of test items seed a join with training passages, which Smith-Waterman
alignment then scores, so edited copies are found as well.

The seeds miss no passage from the threshold up. An alignment of m of an item's n words with e edits scores 2m - e, so
from a share t of 2n up m >= t n and e <= 2m - 2tn. Its matches stand in at most e + 1 runs, so it keeps at least
m - e - 1 >= (2t - 1) n - 1 word pairs, within a span of n + 2(1 - t) n words. Where that is no pair (short items, low
thresholds), single words are the seeds, of which it keeps t n. Of the pairs that it keeps at least, half may be the
item's most frequent ones, by counts over all documents: these are no seeds, and the other half must still be there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textblocks

BLOCK_CHARS = 16 << 20
#: Seeds are paired with items for about so many pairs at a time (a text with more is done alone).
PAIRS = 1 << 20
#: Word characters: letters and digits after lower-casing, and all of UTF-8 beyond ASCII.
BREAKS = ~np.isin(np.arange(256), [*range(48, 58), *range(97, 123), *range(128, 256)])


def word_block(texts: list[str]) -> textblocks.Words:
    return textblocks.words([t.lower().encode("utf-8", "surrogatepass") for t in texts], BREAKS)


def grams(w: textblocks.Words, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    parts = [textblocks.shingles(w, n) for n in sizes]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def align(item: np.ndarray, passage: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences, and where in ``passage`` the best alignment ends."""
    return align_to(item, passage, match, mismatch, gap)[::2]


def align_to(item: np.ndarray, passage: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """Best score, and where in ``item`` and in ``passage`` its alignment ends."""
    n = len(passage)
    ramp = np.arange(n + 1) * -gap
    row, best, last, end = np.zeros(n + 1, np.int64), 0, 0, 0
    for k, word in enumerate(item):
        now = np.zeros(n + 1, np.int64)
        now[1:] = np.maximum(row[:-1] + np.where(passage == word, match, mismatch), row[1:] + gap)
        now = np.maximum(np.maximum.accumulate(np.maximum(now, 0) + ramp) - ramp, 0)
        top = int(now.argmax())
        if now[top] > best:
            best, last, end = int(now[top]), k + 1, top
        row = now
    return best, last, end


def begins(item: np.ndarray, passage: np.ndarray, score: int, match: int = 2, mismatch: int = -1, gap: int = -1) -> int:
    """Where in ``passage`` an alignment of ``score`` begins that ends at the end of both: the same sums from the end,
    without a new start on the way."""
    item, passage = item[::-1], passage[::-1]
    ramp = np.arange(len(passage) + 1) * -gap
    row = -ramp
    for k, word in enumerate(item):
        now = np.full(len(passage) + 1, gap * (k + 1))
        now[1:] = np.maximum(row[:-1] + np.where(passage == word, match, mismatch), row[1:] + gap)
        row = np.maximum.accumulate(now + ramp) - ramp
        at = np.flatnonzero(row >= score)
        if len(at):
            return len(passage) - int(at[0])
    return 0


def ceiling(x: float) -> int:
    return math.ceil(x - 1e-9)


class Items:
    """A block of test items: word hashes, and their distinct grams, sorted, with the items and places that have them."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float):
        self.ids = [r[0] for r in rows]
        self.threshold = threshold
        w = word_block([r[1] or "" for r in rows])
        self.words = [w.hash[w.first[k] : w.first[k + 1]] for k in range(len(rows))]
        n = np.diff(w.first)
        pairs = [ceiling((2 * threshold - 1) * x - 1) for x in n.tolist()]
        single = np.array([p < 1 for p in pairs], bool)
        #: how many seeds an alignment keeps at least, in a span of how many words
        self.need = np.array([max(1, ceiling(threshold * x)) if p < 1 else p for p, x in zip(pairs, n.tolist(), strict=True)], np.int64)
        self.slack = np.array([max(0, int(2 * (1 - threshold) * x + 1e-9)) for x in n.tolist()], np.int64)
        self.span = n + self.slack
        self.sizes = tuple(size for size, some in ((1, single), (2, ~single)) if (some & (n > 0)).any()) or (2,)
        found = []
        for size in self.sizes:
            h, at = textblocks.shingles(w, size)
            keep = single[w.doc[at]] == (size == 1)
            found.append((h[keep], w.doc[at[keep]], at[keep] - w.first[w.doc[at[keep]]]))
        h, item, inside = (np.concatenate(x) for x in zip(*found, strict=True))
        self._index(h, item, inside)

    def _index(self, h: np.ndarray, item: np.ndarray, inside: np.ndarray) -> None:
        order = np.argsort(h, kind="stable")
        self.grams, first = np.unique(h[order], return_index=True)
        self.first, self.item, self.inside = np.append(first, len(h)), item[order], inside[order]

    def keep_rare(self, counts: np.ndarray) -> None:
        """Leave an item's most frequent grams out, by ``counts`` of documents: half of what an alignment keeps at least."""
        h, n = np.repeat(self.grams, np.diff(self.first)), np.repeat(counts, np.diff(self.first))
        order = np.lexsort((self.inside, h, n, self.item))
        drop = self.need // 2
        size = np.bincount(self.item, minlength=len(self.need))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
        stay = order[rank < (size - drop)[self.item[order]]]
        self.need = self.need - drop
        self._index(h[stay], self.item[stay], self.inside[stay])

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the entries of ``h`` that are grams, and which."""
        if not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
        hit = np.flatnonzero(self.grams[at] == h)
        return hit, at[hit]

    def seeded(self, place: np.ndarray, gram: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, item, start) of the grams at ``place`` that stand where an item has enough of them in its span."""
        many = np.diff(self.first)[gram]
        item, inside = (x[np.repeat(self.first[gram] - np.cumsum(many) + many, many) + np.arange(many.sum())] for x in (self.item, self.inside))
        place, doc = np.repeat(place, many), np.repeat(doc, many)
        order = np.lexsort((place, item, doc))
        place, doc, item, inside = place[order], doc[order], item[order], inside[order]
        # an item's gram may stand at several of its places: one place of the text counts once
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (item[1:] != item[:-1])
        at = np.flatnonzero(new)
        p, d, k = place[at], doc[at], item[at]
        need = self.need[k] - 1
        last = np.minimum(np.arange(len(at)) + need, len(at) - 1)
        dense = (np.arange(len(at)) + need < len(at)) & (d[last] == d) & (k[last] == k) & (p[last] - p < self.span[k])
        # places from a dense one to its last
        cover = np.zeros(len(at) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(dense), 1)
        np.add.at(cover, last[dense] + 1, -1)
        stay = (np.cumsum(cover[:-1]) > 0)[np.cumsum(new) - 1]
        return doc[stay], item[stay], (place - inside)[stay]


HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("n_seeds", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64())])


def hits(texts: list[str], items: Items):
    """(text position, item position, share of the full score, seeds, first and last word) of texts that align with items."""
    w = word_block(texts)
    h, first = grams(w, items.sizes)
    hit, g = items.look(h)
    place = first[hit]
    order = np.argsort(place, kind="stable")
    place, g = place[order], g[order]
    doc = w.doc[place]
    near: dict[tuple[int, int], list[int]] = {}
    # whole texts, about PAIRS pairs at a time
    sums = np.cumsum(np.diff(items.first)[g])
    begin = 0
    while begin < len(g):
        end = int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + PAIRS, side="right"))
        if end < len(g):
            end = int(np.searchsorted(doc, doc[end], side="left"))
        if end <= begin:
            end = int(np.searchsorted(doc, doc[begin], side="right"))
        for d, k, start in zip(*(x.tolist() for x in items.seeded(place[begin:end], g[begin:end], doc[begin:end])), strict=True):
            near.setdefault((d, k), []).append(start)
        begin = end
    for (doc, item), starts in near.items():
        words = items.words[item]
        lo, hi, slack, best = int(w.first[doc]), int(w.first[doc + 1]), int(items.slack[item]) + 1, (0, 0, 0, 0)
        # passages: windows about the seeds, joined where they overlap
        passages: list[list[int]] = []
        for s in sorted(set(starts)):
            a, b = max(lo, s - slack), min(hi, s + len(words) + slack)
            if a >= b:
                continue
            if passages and a <= passages[-1][1]:
                passages[-1][1] = b
            else:
                passages.append([a, b])
        for a, b in passages:
            score, last, end = align_to(words, w.hash[a:b])
            if score > best[0]:
                best = (score, last, a, a + end)
        score, last, a, end = best
        if score >= items.threshold * 2 * len(words):
            yield doc, item, score / (2 * len(words)), len(starts), a + begins(words[:last], w.hash[a:end], score) - lo, end - lo


def scan(rows: DataFrame, items: Broadcast) -> DataFrame:
    """One row for each row of ``rows`` (doc_id, text) and item that align."""

    def run(batches):
        for batch in batches:
            keys, out = batch.column("doc_id").to_pylist(), {n: [] for n in HITS.names}
            for at, part in common.grouped(enumerate(common.values(batch.column("text")))):
                for doc, item, *rest in hits(part, items.value):
                    for n, v in zip(HITS.names, (keys[at[doc]], items.value.ids[item], *rest), strict=True):
                        out[n].append(v)
            yield common.table(out, HITS)

    return common.arrow(rows, run, "doc_id long, item_id long, score double, n_seeds long, start_word long, end_word long")


def gram_counts(rows: DataFrame, items: Items) -> np.ndarray:
    """In how many of all ``rows`` (text) each gram of the items stands. A task sums its own, so few rows are shuffled."""
    schema = pa.schema([("gram", pa.int32()), ("n", pa.int64())])
    shared = rows.sparkSession.sparkContext.broadcast((items.grams, items.sizes))

    def run(batches):
        known, sizes = shared.value
        sums = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, part in common.grouped(enumerate(common.values(batch.column("text")))):
                w = word_block(part)
                h, first = grams(w, sizes)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = np.flatnonzero(known[at] == h) if len(known) else at[:0]
                pairs = np.unique(np.stack([w.doc[first[hit]], at[hit]]), axis=1)
                np.add.at(sums, pairs[1], 1)
        found = np.flatnonzero(sums)
        yield common.table({"gram": found, "n": sums[found]}, schema)

    counts = np.zeros(len(items.grams), np.int64)
    found = common.arrow(rows.select("text"), run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return counts


def item_blocks(documents: DataFrame, benchmark: DataFrame, threshold: float) -> Iterator[Broadcast]:
    """The items, in blocks of about BLOCK_CHARS characters by hash, with the seeds that are rare in ``documents``."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS) or 1
    for k in range(blocks):
        block = Items([(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()], threshold)
        block.keep_rare(gram_counts(documents, block))
        yield documents.sparkSession.sparkContext.broadcast(block)


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, start_word, end_word) for each document and test item that align.

    ``score`` is the best local alignment (match 2, mismatch and gap -1) of the item's words with a passage, as a share
    of the item's full score; from ``threshold`` up it is contamination. All documents (doc_id, text) are read against
    the items in blocks of at most about BLOCK_CHARS characters, so what tasks get is bounded whatever the benchmark's
    size; a block takes two passes, one for its seeds' counts. An item of one word is found wherever that word stands.
    Null and empty texts or items, and items without words, match nothing. Repeated rows give repeated rows, as
    do repeated items; empty tables give none; other columns are ignored.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in item_blocks(rows, benchmark, threshold):
        found = scan(rows, items)
        out = found if out is None else out.unionAll(found)
    return out


def decontaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``documents`` without those that ``contaminated`` finds, all columns kept; rows are judged in the scan, unshuffled."""
    out = documents
    for items in item_blocks(documents, benchmark, threshold):

        def run(batches, items=items):
            for batch in batches:
                stay = np.ones(batch.num_rows, bool)
                for at, part in common.grouped(enumerate(common.values(batch.column("text")))):
                    for doc, *_ in hits(part, items.value):
                        stay[at[doc]] = False
                yield batch.filter(pa.array(stay))

        out = common.arrow(out, run, documents.schema)
    return out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
