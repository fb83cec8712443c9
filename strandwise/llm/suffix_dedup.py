"""Exact substring deduplication by a sparse suffix sort with hash-compared suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere. Sorting every suffix of the corpus is
not needed: each window of LENGTH bytes has one anchor, the least hashed ``GRAM``-byte string in it, so equal windows
have equal anchors at equal places. Windows next to each other with one anchor are a span.

1. Anchors that stand once are unique and drop out. Anchors whose spans are all equal, by a 128-bit BLAKE2 digest of
   their bytes, repeat as a whole.
2. The spans of the other anchors (about edits and passage ends) are suffix-sorted, anchor by anchor: a stable sort of
   the first bytes, then a mergesort whose comparisons find the common extension of two suffixes by binary search on
   prefix polynomial hashes. Neighbours that agree on LENGTH bytes by hash are compared byte by byte.
3. A hot anchor (a passage in very many different surroundings) would put all its spans in one task. Its spans are
   divided further, by anchors as long as a window: each window is then its own span, and windows are told apart by
   128-bit digests as in step 1, in a grouped sum that no key makes large. Both ways are exact, so the number of spans
   from which on an anchor is divided changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textblocks

LENGTH, GRAM = 400, 160
#: The number of different spans from which on an anchor is divided, bytes of the spans that are sorted at a time, and
#: bytes of a text that are read at a time.
MANY, SORTED, PIECE = 2000, 1 << 20, 1 << 18
#: The low bits of a key in ``spans`` hold a place in the block, the others the gram's hash.
_PLACE = np.uint64((1 << 28) - 1)


def spans(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(doc, start, windows, anchor hash, anchor's place in the span, bytes of the block, start in it) of all spans."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offset = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, width = len(data), length - gram + 1
    if n > int(_PLACE):
        raise ValueError("a block of texts must be shorter than 2**28 bytes")
    if n < length:
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64), np.zeros(0, np.int64), data, np.zeros(0, np.int64))
    prefix = textblocks.prefix_hashes(data)
    at = np.arange(n - gram + 1)
    grams = textblocks.span_hashes(prefix, at, at + gram)
    key = (grams & ~_PLACE) | at.astype(np.uint64)
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    place = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & _PLACE).astype(np.int64)
    room = np.maximum(sizes - length + 1, 0)
    valid = np.zeros(n + 1, np.int8)
    full = np.flatnonzero(room)
    np.add.at(valid, offset[:-1][full], 1)
    np.add.at(valid, offset[:-1][full] + room[full], -1)
    valid = np.cumsum(valid)[:windows].astype(bool)
    change = np.ones(windows, bool)
    change[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    change |= ~valid
    first_of_doc = offset[:-1][full]
    change[first_of_doc] = True
    begin = np.flatnonzero(change)
    count = np.diff(np.append(begin, windows))
    keep = valid[begin]
    begin, count = begin[keep], count[keep]
    anchor = place[begin]
    doc = np.searchsorted(offset, begin, side="right") - 1
    return doc, begin - offset[doc], count, grams[anchor], anchor - begin, data, begin


def digests(raws: Iterable[bytes], salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, as two longs, of each byte string and its number in ``salt``."""
    found = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in raws]), np.uint64).reshape(-1, 2)
    more = salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return textblocks.mixed(found[:, 0] + more).view(np.int64), textblocks.mixed(found[:, 1] ^ more).view(np.int64)


def blocks(batches) -> Iterator[tuple[list[bytes], list[int], list[tuple[int, int]]]]:
    """Bounded lists of texts: their bytes, and of each piece its text in the list and its first byte there.

    A text longer than PIECE is read in pieces that share LENGTH - 1 bytes, so each window lies in one piece. A span
    that is cut so is two spans of one anchor, which changes no window's verdict.
    """
    for batch in batches:
        for _, texts in common.grouped(enumerate(common.values(batch.column("text")))):
            raws = [t.encode("utf-8", "surrogatepass") for t in texts]
            yield raws, [(k, a) for k, raw in enumerate(raws) for a in range(0, max(1, len(raw) - LENGTH + 1), PIECE)]


def pieces(raws: list[bytes], places: list[tuple[int, int]]) -> Iterator[tuple[list[tuple[int, int]], tuple]]:
    """``spans`` of the pieces, a bounded number of bytes at a time, with the pieces' places."""
    now, size = [], 0
    for k, a in places:
        n = min(len(raws[k]) - a, PIECE + LENGTH - 1)
        if now and size + n > 2 * PIECE:
            yield now, spans([raws[k][a : a + PIECE + LENGTH - 1] for k, a in now])
            now, size = [], 0
        now.append((k, a))
        size += n
    yield now, spans([raws[k][a : a + PIECE + LENGTH - 1] for k, a in now])


def cut(data: np.ndarray, begin: np.ndarray, count: np.ndarray) -> list[bytes]:
    return [data[a : a + n + LENGTH - 1].tobytes() for a, n in zip(begin.tolist(), count.tolist(), strict=True)]


def anchors(texts: DataFrame) -> DataFrame:
    """(k, s1, s2) of all spans: hash of the anchor and digest of the span."""
    schema = pa.schema([("k", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])

    def run(batches):
        for raws, places in blocks(batches):
            for _, (_, _, count, k, inside, data, begin) in pieces(raws, places):
                s1, s2 = digests(cut(data, begin, count), inside)
                yield common.table({"k": k.view(np.int64), "s1": s1, "s2": s2}, schema)

    return common.arrow(texts, run, "k long, s1 long, s2 long")


class Suffixes:
    """Suffixes of a byte array, compared by their longest common extension of at most ``depth`` bytes."""

    def __init__(self, data: np.ndarray, depth: int):
        self.data, self.depth = np.concatenate([data, np.zeros(depth, np.uint8)]), depth
        self.prefix = textblocks.prefix_hashes(self.data)
        self.inverse = textblocks.powers(textblocks.INVERSE, len(self.prefix))

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.prefix[i + n] - self.prefix[i]) * self.inverse[i] == (self.prefix[j + n] - self.prefix[j]) * self.inverse[j]

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common bytes of the suffixes at i and j, up to ``depth``, by binary search on hashes."""
        lo = np.where(self.same(i, j, np.full(len(i), self.depth)), self.depth, 0)
        hi = np.where(lo == self.depth, self.depth, self.depth - 1)
        while (open_ := lo < hi).any():
            at = np.flatnonzero(open_)
            mid = (lo[at] + hi[at] + 1) // 2
            fine = self.same(i[at], j[at], mid)
            lo[at] = np.where(fine, mid, lo[at])
            hi[at] = np.where(fine, hi[at], mid - 1)
        return lo

    def before(self, i: np.ndarray, j: np.ndarray, ties: bool) -> np.ndarray:
        """Whether the suffix at i sorts before that at j; equal ones (to ``depth``) give ``ties``."""
        n = self.extension(i, j)
        return np.where(n >= self.depth, ties, self.data[i + np.minimum(n, self.depth - 1)] < self.data[j + np.minimum(n, self.depth - 1)])

    def order(self, group: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Indices that sort the suffixes at ``start`` within equal ``group`` numbers.

        A stable sort by group and first eight bytes comes first; runs that still tie are merged bottom-up, all runs at
        once: an element's place is its place in its half plus the elements of the other half before it, found by
        binary search with ``before``.
        """
        head = np.zeros(len(start), np.uint64)
        for k in range(8):
            head = head << np.uint64(8) | self.data[start + k].astype(np.uint64)
        out = np.lexsort((head, group))
        new = np.ones(len(out), bool)
        new[1:] = (group[out[1:]] != group[out[:-1]]) | (head[out[1:]] != head[out[:-1]])
        begin = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        size = np.diff(np.append(begin, len(out)))
        at = np.flatnonzero(size[run] > 1)
        width = 1
        while len(at) and width < size.max():
            b, n = begin[run[at]], size[run[at]]
            inside = at - b
            half = inside // width
            other = np.where(half % 2 == 0, half + 1, half - 1) * width
            lo, hi = np.minimum(other, n), np.minimum(other + width, n)
            left = half % 2 == 0
            lo0 = lo.copy()
            mine = start[out[at]]
            while (open_ := lo < hi).any():
                p = np.flatnonzero(open_)
                mid = (lo[p] + hi[p]) // 2
                theirs = start[out[b[p] + mid]]
                # a left element goes before equal right ones, a right one after equal left ones
                ahead = np.where(left[p], self.before(theirs, mine[p], False), self.before(theirs, mine[p], True))
                lo[p] = np.where(ahead, mid + 1, lo[p])
                hi[p] = np.where(ahead, hi[p], mid)
            place = b + np.where(left, half, half - 1) * width + (inside - half * width) + (lo - lo0)
            moved = out.copy()
            moved[place] = out[at]
            out = moved
            width *= 2
        return out

    def equal_bytes(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Byte-by-byte check of ``depth`` bytes."""
        out = np.zeros(len(i), bool)
        view = np.lib.stride_tricks.sliding_window_view(self.data, self.depth)
        for a in range(0, len(i), 4096):
            out[a : a + 4096] = (view[i[a : a + 4096]] == view[j[a : a + 4096]]).all(axis=1)
        return out


def repeated(groups: list[int], texts: list[bytes], windows: list[int], length: int) -> list[np.ndarray]:
    """For spans given by anchor group, bytes and number of windows: which windows stand twice or more in the group."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1]
    owner = np.repeat(np.arange(len(texts)), windows)
    first = np.concatenate([[0], np.cumsum(windows)])
    start = base[owner] + np.arange(len(owner)) - first[owner]
    suffixes = Suffixes(data, length)
    order = suffixes.order(np.unique(np.array(groups), return_inverse=True)[1][owner], start)
    i, j = order[:-1], order[1:]
    near = np.flatnonzero(np.array(groups)[owner[i]] == np.array(groups)[owner[j]])
    near = near[suffixes.same(start[i[near]], start[j[near]], np.full(len(near), length))]
    near = near[suffixes.equal_bytes(start[i[near]], start[j[near]])]
    flag = np.zeros(len(start), bool)
    flag[i[near]] = flag[j[near]] = True
    return [flag[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def _runs(flag: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(flag.astype(np.int8), prepend=0, append=0))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


JUDGED = pa.schema([("k", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("runs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])
_RUNS = "array<struct<a:int,b:int>>"
_JUDGED = f"k long, s1 long, s2 long, runs {_RUNS}"


def judged(texts: DataFrame, many: int | None = None) -> DataFrame:
    """Stored (k, s1, s2, runs) of all spans with repeated windows: runs of windows, counted from the span's start.

    The digest is null for anchors whose spans are all equal: their windows all repeat, and ``runs`` is null.
    """
    many = MANY if many is None else many
    spark = texts.sparkSession
    bounds = [f(c).alias(f"{n}{c}") for c in ("s1", "s2") for n, f in (("lo", F.min), ("hi", F.max))]
    groups = anchors(texts).groupBy("k").agg(F.count("*").alias("n"), *bounds).where("n > 1")
    groups = common.stored(groups.select("k", F.expr("los1 <> his1 or los2 <> his2").alias("mixed")), "suffix-groups")
    null = F.lit(None)
    same = groups.where("not mixed").select("k", null.cast("long").alias("s1"), null.cast("long").alias("s2"), null.cast(_RUNS).alias("runs"))
    bits = spark.sparkContext.broadcast(common.bit_filter(groups.where("mixed").select("k")))
    schema = pa.schema([("k", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("windows", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])

    def ship(batches):
        for raws, places in blocks(batches):
            for _, (_, _, count, k, inside, data, begin) in pieces(raws, places):
                hit = np.flatnonzero(common.passes(bits.value, k))
                each = cut(data, begin[hit], count[hit])
                s1, s2 = digests(each, inside[hit])
                order = np.lexsort((s2, s1, k[hit]))  # equal spans of a block go as one row
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(k[hit][order].view(np.int64)) != 0) | (np.diff(s1[order]) != 0) | (np.diff(s2[order]) != 0)
                at = np.flatnonzero(new)
                one = order[at]
                yield common.table({"k": k[hit][one].view(np.int64), "s1": s1[one], "s2": s2[one], "windows": count[hit][one], "n": np.diff(np.append(at, len(order))), "data": [each[x] for x in one.tolist()]}, schema)

    shipped = common.arrow(texts, ship, "k long, s1 long, s2 long, windows int, n long, data binary")
    each = shipped.groupBy("k", "s1", "s2").agg(F.sum("n").alias("n"), F.first("windows").alias("windows"), F.first("data").alias("data"))
    each = common.stored(each.join(groups.where("mixed").select("k"), "k"), "suffix-spans")
    each = each.join(each.groupBy("k").agg(F.count("*").alias("m")), "k")

    def sort(batches):
        rows: list[tuple] = []
        size = 0

        def flush():
            flags = repeated([r[0] for r in rows], [r[4] for r in rows], [r[3] for r in rows], LENGTH)
            runs = [[{"a": 0, "b": r[3]}] if r[5] > 1 else _runs(f) for r, f in zip(rows, flags, strict=True)]
            kept = [x for x, y in enumerate(runs) if y]
            return common.table({"k": [rows[x][0] for x in kept], "s1": [rows[x][1] for x in kept], "s2": [rows[x][2] for x in kept], "runs": [runs[x] for x in kept]}, JUDGED)

        for batch in batches:
            for row in zip(*(common.values(batch.column(c)) for c in ("k", "s1", "s2", "windows", "data", "n")), strict=True):
                if rows and size > SORTED and row[0] != rows[-1][0]:
                    yield flush()
                    rows.clear()
                    size = 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield flush()

    few = each.where(F.col("m") <= many).select("k", "s1", "s2", "windows", "data", "n")
    few = common.arrow(few.repartition(F.col("k")).sortWithinPartitions("k", "s1", "s2"), sort, _JUDGED)
    divided = pa.schema([("k", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("o", pa.int32()), ("x", pa.int64()), ("y", pa.int64())])

    def windows(batches):
        for batch in batches:
            for k, s1, s2, w, data in zip(*(common.values(batch.column(c)) for c in ("k", "s1", "s2", "windows", "data")), strict=True):
                x, y = digests((data[a : a + LENGTH] for a in range(w)), np.zeros(w))
                yield common.table({"k": [k] * w, "s1": [s1] * w, "s2": [s2] * w, "o": np.arange(w), "x": x, "y": y}, divided)

    hot = each.where(F.col("m") > many)
    opened = common.arrow(hot.select("k", "s1", "s2", "windows", "data"), windows, "k long, s1 long, s2 long, o int, x long, y long")
    opened = common.stored(opened, "suffix-windows")
    twice = opened.groupBy("x", "y").agg(F.count("*").alias("c")).where("c > 1").select("x", "y")
    places = F.transform(F.sort_array(F.collect_list("o")), lambda o: F.struct(o.alias("a"), (o + 1).alias("b")))
    found = opened.join(twice, ["x", "y"]).groupBy("k", "s1", "s2").agg(places.alias("runs"))
    whole = hot.where("n > 1").select("k", "s1", "s2", F.array(F.struct(F.lit(0).alias("a"), F.col("windows").alias("b"))).alias("runs"))
    return common.stored(same.unionAll(few).unionAll(found).unionAll(whole), "suffix-judged")


def removed(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(id, cut): for texts with repeated windows, by md5 of the text, the byte ranges to remove (they may overlap)."""
    bits = texts.sparkSession.sparkContext.broadcast(common.bit_filter(found.select("k")))
    schema = pa.schema([("id", pa.string()), ("at", pa.int64()), ("windows", pa.int32()), ("k", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])

    def run(batches):
        for raws, places in blocks(batches):
            ids: dict[int, str] = {}
            for own, (piece, start, count, k, inside, data, begin) in pieces(raws, places):
                hit = np.flatnonzero(common.passes(bits.value, k))
                s1, s2 = digests(cut(data, begin[hit], count[hit]), inside[hit])
                name, at = [], []
                for p, a in zip(piece[hit].tolist(), start[hit].tolist(), strict=True):
                    doc, first = own[p]
                    if doc not in ids:
                        ids[doc] = hashlib.md5(raws[doc]).hexdigest()
                    name.append(ids[doc])
                    at.append(first + a)
                yield common.table({"id": name, "at": at, "windows": count[hit], "k": k[hit].view(np.int64), "s1": s1, "s2": s2}, schema)

    rows = common.arrow(texts, run, "id string, at long, windows int, k long, s1 long, s2 long").distinct()
    whole = rows.join(found.where("s1 is null").select("k"), "k").select("id", "at", F.lit(0).alias("a"), F.col("windows").alias("b"))
    part = rows.join(found.where("s1 is not null"), ["k", "s1", "s2"]).select("id", "at", F.explode("runs").alias("r")).select("id", "at", "r.a", "r.b")
    cuts = whole.unionAll(part).select("id", F.struct((F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b") + (LENGTH - 1)).alias("b")).alias("r"))
    return cuts.groupBy("id").agg(F.collect_list("r").alias("cut"))  # a text's own ranges


def union(cut: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in cut):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def deduplicated(documents: DataFrame) -> DataFrame:
    """Every document (doc_id, text; other columns are ignored) without its repeated bytes.

    Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining UTF-8 bytes) and
    kept_sha256. What is removed depends on a text's bytes and the corpus only, so equal texts share one result. Texts
    shorter than LENGTH bytes, null and empty ones lose nothing. Repeated rows are copies: all their bytes go. An empty
    table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    texts = documents.select(text.alias("text")).where(F.octet_length("text") >= LENGTH)
    cuts = removed(texts, judged(texts))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            out = {n: [] for n in schema.names}
            for d, t, cut in zip(*(common.values(batch.column(c)) for c in ("doc_id", "text", "cut")), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                spans_, at, kept = union(cut or []), 0, []
                for a, b in spans_:
                    kept.append(raw[at:a])
                    at = b
                rest = b"".join([*kept, raw[at:]])
                for n, v in zip(schema.names, (d, len(raw), len(raw) - len(rest), len(spans_), rest, hashlib.sha256(rest).hexdigest()), strict=True):
                    out[n].append(v)
            yield common.table(out, schema)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("id", F.md5(F.col("text").cast("binary")))
    return common.arrow(rows.join(cuts, "id", "left").select("doc_id", "text", "cut"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
