"""N-gram Jaccard join, size-aware: subsets of a fixed size for small (light) sets, inverted lists for large (heavy) ones.

Exact steps, each on the distinct shingle sets only:

1. Equal sets are one class; only classes go on.
2. Light classes emit every subset of the sizes that an intersection can have. Classes with a common subset of size c
   link if their sizes allow it, and all that link within such a group link with its smallest member, so stars suffice.
3. Heavy classes meet first by minhash bands, as stars around two members of each bucket, verified: this only contracts
   groups of near copies. One centre has the fewest rare tokens, as the text that the others were made from has, and one is
   drawn by hash, anew for each key: members near the threshold miss some of them.
4. Inverted lists of prefix tokens (rare tokens first) give all pairs that can link. Lists within one component are
   dropped, pairs are made across components only, and verified on the sets. No link between components is lost: two
   sets that link share tokens of their prefixes under any common order. Of a pair's needed intersection follows how
   many of a prefix's tokens may stand in no other component's lists; sets with more such *dead* tokens are not paired,
   nor are sets at a token that the others leave too few common tokens before and after it.
5. Connected components of all links.

Where light ends is chosen by cost: subsets of a size against prefix tokens times the measured length of a list.

A shingle is its 64-bit hash: two different ones of a pair of sets share one with a chance of 2**-64 each.
"""

from __future__ import annotations

import zlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, textblocks

WORDS, PERCENT = 4, 85
#: Cells of the sketch that orders tokens by frequency (a fixed size, whatever the input), and the slices it is summed in.
CELLS, SLICES = 1 << 22, 128
BANDS, ROWS = 6, 3
LIGHT_MOST = 20


def least(n: int, percent: int = PERCENT) -> int:
    """The smallest intersection a set of ``n`` can have with a set it links with."""
    return -(-percent * n // 100)


def sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, by text and hash: (first, hashes, text positions); first has one entry more.

    ASCII capitals are lowered; a text of fewer words has its whole sequence as one shingle.
    """
    w = textblocks.words([t.encode("utf-8", "surrogatepass").lower() for t in texts])
    h, at = textblocks.shingles(w, words)
    doc, n = [w.doc[at]], np.diff(w.first)
    parts = [h]
    for k in range(1, words):
        short, at = textblocks.shingles(w, k)
        own = n[w.doc[at]] == k
        parts.append(short[own] + np.uint64(k))
        doc.append(w.doc[at[own]])
    d, h = np.concatenate(doc), np.concatenate(parts)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    d, h = d[new], h[new]
    return np.searchsorted(d, np.arange(len(texts) + 1)), h, d


def digests(first: np.ndarray, h: np.ndarray, d: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's whole set."""
    out = []
    for salt in (0x1B873593CC9E2D51, 0x2545F4914F6CDD1D):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(textblocks.mixed(h ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _blocks(batches, column="text"):
    for batch in batches:
        for at, texts in common.grouped(enumerate(common.values(batch.column(column)))):
            yield batch, at, texts


def sketch(texts: DataFrame, words: int) -> tuple[np.ndarray, dict[int, int], float]:
    """Document counts of tokens by hashed cell, document counts of small set sizes, and the length of a list.

    Each task counts all its tokens in a table of CELLS cells and writes it in slices, byte by byte of the counts; the
    slices are summed as they arrive, so the result does not depend on how documents are dealt to tasks, and a table
    of CELLS cells reaches the driver. The counts only order tokens: any order gives the same links.
    """
    schema, width = pa.schema([("slice", pa.int32()), ("shift", pa.int32()), ("data", pa.binary())]), CELLS // SLICES

    def count(batches):
        cells, sizes = np.zeros(CELLS, np.uint32), np.zeros(LIGHT_MOST + 1, np.int64)
        for _, _, part in _blocks(batches):
            first, h, _ = sets(part, words)
            np.add.at(cells, (h & np.uint64(CELLS - 1)).astype(np.int64), 1)
            n = np.diff(first)
            sizes += np.bincount(n[n <= LIGHT_MOST], minlength=LIGHT_MOST + 1)
        out = {"slice": [-1], "shift": [0], "data": [sizes.tobytes()]}
        for k, part in enumerate(cells.reshape(SLICES, width)):
            for shift in range(0, 32, 8):
                if (part >> np.uint32(shift)).any():
                    out["slice"].append(k)
                    out["shift"].append(shift)
                    out["data"].append(zlib.compress((part >> np.uint32(shift)).astype(np.uint8).tobytes(), 1))
        yield common.table(out, schema)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, shift, data in zip(*(batch.column(c).to_pylist() for c in schema.names), strict=True):
                part = np.frombuffer(data, np.int64) if k < 0 else np.frombuffer(zlib.decompress(data), np.uint8).astype(np.int64) << shift
                sums[k] = sums[k] + part if k in sums else part
        yield common.table({"slice": list(sums), "shift": [0] * len(sums), "data": [x.astype(np.int64 if k < 0 else np.uint32).tobytes() for k, x in sums.items()]}, schema)

    kind = "slice int, shift int, data binary"
    parts = common.arrow(texts, count, kind).repartition(F.col("slice"))
    cells, sizes = np.zeros((SLICES, width), np.uint32), np.zeros(LIGHT_MOST + 1, np.int64)
    for k, data in common.arrow(parts, add, kind).select("slice", "data").collect():  # a row a slice
        if k < 0:
            sizes = np.frombuffer(data, np.int64)
        else:
            cells[k] = np.frombuffer(data, np.uint32)
    cells = cells.ravel()
    counted = cells[cells > 0]
    return cells, {k: n for k, n in enumerate(sizes.tolist()) if n}, float(np.median(counted)) if len(counted) else 1.0


def boundary(sizes: dict[int, int], list_length: float, percent: int = PERCENT) -> int:
    """The largest light size, at the least total cost over documents of small sizes."""

    def light(n: int) -> int:
        return sum(comb(n, c) for c in range(least(n, percent), n + 1))

    def heavy(n: int) -> float:
        return (n - least(n, percent) + 1) * (1 + list_length)

    costs = {x: sum(k * (light(n) if n <= x else heavy(n)) for n, k in sizes.items() if n) for x in range(1, LIGHT_MOST + 1)}
    return min(costs, key=lambda x: (costs[x], x))


def subset_keys(first: np.ndarray, h: np.ndarray, light: int, percent: int) -> pa.ListArray:
    """For each set, the (c, key) of all its subsets of c tokens for each c an intersection can have; none over ``light``."""
    n = np.diff(first)
    counts = np.zeros(len(n), np.int64)
    made = {}
    for size in np.unique(n[(n > 1) & (n <= light)]).tolist():
        own = np.flatnonzero(n == size)
        tokens = h[first[own][:, None] + np.arange(size)]
        parts = []
        for c in range(least(size, percent), size + 1):
            picked = np.array(list(combinations(range(size), c)))
            key = np.full((len(own), len(picked)), c, np.uint64)
            for k in range(c):
                key = key * np.uint64(0xC2B2AE3D27D4EB4F) + tokens[:, picked[:, k]]
            parts.append((c, textblocks.mixed(key)))
        made[size] = (own, np.concatenate([np.full(key.shape[1], c, np.int32) for c, key in parts]), np.hstack([key for _, key in parts]))
        counts[own] = made[size][2].shape[1]
    offsets = np.concatenate([[0], np.cumsum(counts)])
    sizes, keys = np.zeros(offsets[-1], np.int32), np.zeros(offsets[-1], np.uint64)
    for own, c, key in made.values():
        at = offsets[own][:, None] + np.arange(len(c))
        sizes[at], keys[at] = c, key
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(sizes), pa.array(keys.view(np.int64))], ["c", "key"]))


SIGNED = "doc_id long, n int, rare int, h1 long, h2 long, bands array<long>, prefix array<long>, subsets array<struct<c:int,key:long>>"


def signed(documents: DataFrame, words: int, percent: int) -> tuple[DataFrame, int]:
    """Stored row of each document: set size, digests, and the keys by which its set can meet others."""
    texts = documents.select("text")
    cells, sizes, length = sketch(texts, words)
    light = boundary(sizes, length, percent)
    usual = 3 + 2 * float(cells.mean())  # a token of a cell below is rare
    shared = documents.sparkSession.sparkContext.broadcast(cells)  # CELLS * 4 bytes
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("rare", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), ("subsets", pa.list_(pa.struct([("c", pa.int32()), ("key", pa.int64())])))])

    def run(batches):
        count = shared.value
        for batch, at, part in _blocks(batches):
            keys = batch.column("doc_id")
            first, h, d = sets(part, words)
            h1, h2 = digests(first, h, d, len(part))
            n = np.diff(first)
            # prefix: by estimated count, then hash
            counted = count[(h & np.uint64(CELLS - 1)).astype(np.int64)]
            order = np.lexsort((h, counted, d))
            ranked = h[order].view(np.int64)
            full = np.flatnonzero(n)
            minhash = []
            for k in range(BANDS * ROWS):
                low = np.zeros(len(part), np.uint64)
                if len(full):
                    low[full] = np.minimum.reduceat(textblocks.mixed(h * np.uint64(2 * k + 3) + np.uint64(k)), first[:-1][full])
                minhash.append(low)
            bands = [textblocks.mixed(sum((minhash[b * ROWS + r] * np.uint64(0x9E3779B97F4A7C15 + 2 * r) for r in range(ROWS)), np.full(len(part), b + 1, np.uint64))).view(np.int64) for b in range(BANDS)]
            # light sets stand in lists only if a heavy set can link with them
            listed = (n > 0) & (n >= least(light + 1, percent))
            early = np.where(listed, n + 1 + (-percent * n) // 100, 0)
            offsets = np.concatenate([[0], np.cumsum(early)])
            prefix = ranked[np.repeat(first[:-1] - offsets[:-1], early) + np.arange(offsets[-1])]
            many = np.where(n > light, BANDS, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(at)),
                    pa.array(n, pa.int32()),
                    pa.array(np.bincount(d, counted < usual, minlength=len(part)), pa.int32()),
                    pa.array(h1),
                    pa.array(h2),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(np.stack(bands, 1)[n > light].ravel())),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(prefix)),
                    subset_keys(first, h, light, percent),
                ],
                names=schema.names,
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.stored(common.arrow(rows, run, SIGNED), "jaccard-signed"), light


def _linked(both, n1, n2, percent: int = PERCENT):
    return both * 100 >= (n1 + n2 - both) * percent


def wanted_sets(documents: DataFrame, classes: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """Stored (node, tokens) of the classes in ``nodes``: one more pass over the texts, which ships only what a bit
    filter lets through (false hits only ship more)."""
    asked = classes.join(nodes.distinct(), "node")
    shared = documents.sparkSession.sparkContext.broadcast(common.bit_filter(asked.select(F.col("h1").bitwiseXOR(F.coalesce("min_doc", F.lit(0))).alias("k"))))
    schema = pa.schema([("doc", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary())])

    def run(batches):
        for batch, at, part in _blocks(batches):
            keys = [batch.column("doc_id")[k].as_py() for k in at]
            first, h, d = sets(part, words)
            h1, h2 = digests(first, h, d, len(part))
            n = np.diff(first)
            hit = np.flatnonzero(common.passes(shared.value, h1 ^ np.array([k or 0 for k in keys], np.int64)) & (n > 0))
            yield common.table({"doc": [keys[k] for k in hit], "h1": h1[hit], "h2": h2[hit], "n": n[hit], "tokens": [h[first[k] : first[k + 1]].astype("<u8").tobytes() for k in hit]}, schema)

    rows = common.arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null"), run, "doc long, h1 long, h2 long, n int, tokens binary")
    keyed = asked.select("node", F.col("min_doc").alias("doc"), "h1", "h2", "n")
    # repeated rows of a document give its set again: any of them
    return common.stored(rows.join(keyed, [rows[c].eqNullSafe(keyed[c]) for c in ("doc", "h1", "h2", "n")]).select("node", "tokens").dropDuplicates(["node"]), "jaccard-sets")


def verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets link."""
    rows = pairs.join(tokens.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b").join(tokens.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            out = {"a": [], "b": []}
            for a, b, x, y in zip(*(common.values(batch.column(c)) for c in ("a", "b", "ta", "tb")), strict=True):
                n1, n2 = len(x) // 8, len(y) // 8
                if min(n1, n2) * 100 < max(n1, n2) * percent:
                    continue
                both = n1 + n2 - len(np.unique(np.frombuffer(x + y, "<u8")))
                if _linked(both, n1, n2, percent):
                    out["a"].append(a)
                    out["b"].append(b)
            yield common.table(out, schema)

    return common.arrow(rows.select("a", "b", "ta", "tb"), run, "a long, b long")


def linked(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows of ``joined`` with ``component``, which tells components apart where ids are null or repeated; it is
    null for texts without words."""
    rows, light = signed(documents, words, percent)
    full = rows.where("n > 0")
    one = full.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("min_doc"), F.first("rare").alias("rare"), F.first("bands").alias("bands"), F.first("prefix").alias("prefix"), F.first("subsets").alias("subsets"))
    classes = common.stored(one.withColumn("node", F.monotonically_increasing_id()), "jaccard-classes")
    # light sets: stars of equal subsets
    small = classes.where(F.size("subsets") > 0).select("node", "n", F.explode("subsets").alias("x")).select("node", "n", "x.c", "x.key")
    centre = small.groupBy("c", "key").agg(F.min(F.struct("n", "node")).alias("m"), F.count("*").alias("k")).where("k > 1").select("c", "key", F.col("m.n").alias("m"), F.col("m.node").alias("a"))
    light_links = small.join(centre, ["c", "key"]).where((F.col("node") != F.col("a")) & _linked(F.col("c"), F.col("n"), F.col("m"), percent)).select("a", F.col("node").alias("b")).distinct()
    # heavy sets: stars of equal bands, verified
    banded = classes.where(F.size("bands") > 0).select("node", "n", "rare", F.explode("bands").alias("key"))
    own, drawn = F.struct(F.col("node").alias("a"), F.col("n").alias("na")), F.xxhash64("key", "node")
    centre = banded.groupBy("key").agg(F.count("*").alias("k"), F.min_by(own, F.struct("rare", drawn)).alias("plain"), F.min_by(own, drawn).alias("drawn")).where("k > 1")
    met = banded.join(centre, "key").select("node", "n", F.explode(F.array("plain", "drawn")).alias("m"))
    met = met.where((F.col("node") != F.col("m.a")) & (F.least("n", "m.na") * 100 >= F.greatest("n", "m.na") * percent))
    stars = common.stored(met.select(F.least("node", "m.a").alias("a"), F.greatest("node", "m.a").alias("b")).distinct(), "jaccard-stars")
    tokens = wanted_sets(documents, classes, stars.select(F.col("a").alias("node")).unionAll(stars.select("b")), words)
    links = common.stored(verified(stars, tokens, percent).unionAll(light_links), "jaccard-links")
    groups = common.stored(common.components(links), "jaccard-groups")
    common.dropped(stars, tokens)
    # all other pairs: lists of prefix tokens, across components; a token of one component's lists only is dead
    placed = classes.select("node", "n", "prefix").join(groups, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"), "prefix")
    lists = placed.where(F.size("prefix") > 0).select("node", "n", F.size("prefix").alias("size"), "component", F.posexplode("prefix").alias("at", "token"))
    mixed = lists.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    own = W.partitionBy("node")
    lists = lists.join(mixed, "token").withColumn("live", F.row_number().over(own.orderBy("at")) - 1).withColumn("dead", F.col("size") - F.count("*").over(own).cast("int"))
    lists = common.stored(lists.drop("size"), "jaccard-lists")
    left = lists.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("live").alias("la"), F.col("dead").alias("da"), F.col("component").alias("ca"))
    right = lists.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("live").alias("lb"), F.col("dead").alias("db"), F.col("component").alias("cb"))
    near = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    fits = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") > light) & (F.col("ca") != F.col("cb"))
    # sets that link have ``both`` tokens in common at least, so of the first n - both + l tokens of each they share l:
    # b's prefix has nb - low + 1 tokens, low = least(nb), so l = both - low + 1 of them are common, and nb - both dead
    # at most; of a's first na - low + 1 tokens as many, and its prefix has only low - least(na) more
    both, low_a, low_b = f"(({percent} * (na + nb) + {99 + percent}) div {100 + percent})", f"(({percent} * na + 99) div 100)", f"(({percent} * nb + 99) div 100)"
    alive = F.expr(f"db <= nb - {both} and da <= na - {both} + {low_b} - {low_a}")
    # common tokens before this one stand among both sets' live ones before it, and the others after it
    alive = alive & F.expr(f"least(la, lb) + 1 + least(na - pa, nb - pb) - 1 >= {both}")
    share = f"greatest(1, ({both} - {low_b} + 1) div 3)"
    early = F.expr(f"pa < na - {both} + {share} and pb < nb - {both} + {share}")
    pairs = left.join(right, "token").where(near & fits & alive & early).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
    pairs = common.stored(pairs.where(F.expr(f"k >= {share}")).select("a", "b"), "jaccard-pairs")
    common.dropped(lists)
    tokens = wanted_sets(documents, classes, pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")), words)
    more = common.stored(verified(pairs, tokens, percent), "jaccard-more")
    groups = common.stored(common.components(links.unionAll(more)), "jaccard-components") if not more.isEmpty() else groups
    common.dropped(pairs, tokens, links, more)
    named = classes.select("node", "n", "h1", "h2", "min_doc").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("min_doc").alias("component_id"))
    label = named.join(names, "component").select("n", "h1", "h2", "component", "component_id")
    out = rows.select("doc_id", "n", "h1", "h2").join(label, ["n", "h1", "h2"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "h1", "h2", "component")


def joined(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, h1, h2 (digests of its set).

    ``component_id`` is the smallest doc_id reachable by links. Null, empty and wordless texts have no shingles and
    link with nothing: their component is their own doc_id. Repeated rows are equal sets, so one class; rows of one
    doc_id with different texts are judged each by its text. Null doc_ids are nodes as well; a component of such only
    has a null id. Other columns are ignored; an empty table gives no rows.
    """
    return linked(documents, words, percent).drop("component")


def deduplicated(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component of ``joined`` stays, that of the smallest doc_id; all columns are kept.

    Null ids and ids that stand on unlinked texts name no component, so each of those keeps a document of its own; a
    null id comes last in its component. Texts without words stay. Of repeated rows of one doc_id with the same set,
    one stays; without words and id, all do.
    """
    found = linked(documents, words, percent)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h1", "h2")
    first = found.where("n_shingles > 0").groupBy("component").agg(F.min(order).alias("m")).select("m.doc_id", "m.h1", "m.h2")
    # texts without words have digests of 0: each is its own component
    own = found.where("n_shingles = 0").select("doc_id", "h1", "h2")
    stay = first.unionAll(own).distinct().select(F.col("doc_id").alias("_d"), F.col("h1").alias("_a"), F.col("h2").alias("_b"))
    row = F.struct(*(documents[c] for c in documents.columns))  # in a struct, no column's name can clash with ours
    rows = documents.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc"))
    schema = T.StructType([rows.schema["row"], rows.schema["doc"], T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])

    def run(batches):
        for batch in batches:
            a, b = [], []
            texts = pa.RecordBatch.from_arrays([batch.column("row").field("text")], names=["text"])
            for _, _, part in _blocks([texts]):
                first, h, d = sets(part, words)
                x, y = digests(first, h, d, len(part))
                a.append(x)
                b.append(y)
            more = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc"), *more], names=["row", "doc", "h1", "h2"])

    unnamed = F.col("doc").isNull() & (F.col("h1") == 0) & (F.col("h2") == 0)
    rows = common.arrow(rows, run, schema).withColumn("own", F.when(unnamed, F.monotonically_increasing_id()))
    kept = rows.join(stay, rows["doc"].eqNullSafe(stay["_d"]) & (rows["h1"] == stay["_a"]) & (rows["h2"] == stay["_b"]))
    return kept.dropDuplicates(["_d", "_a", "_b", "own"]).select("row.*")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
