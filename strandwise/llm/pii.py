"""Personal data: base patterns, and bootstrapped contextual extraction.

Base matches are the seeds, and long hexadecimal strings are seeds of a fifth kind, ``secret``, which has no base
pattern. The words around seeds and around other identifier-like strings are lexical patterns; a graph of patterns and
instances is scored in rounds of joins, and patterns of high confidence give their kind to instances that the base
patterns miss.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Seeds of the fifth kind: hexadecimal strings of 32 digits or more.
SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])")
#: Strings that may be identifiers: digit groups, mail-like strings, what is quoted after a label, and tokens with a digit.
CANDIDATE = re.compile(
    r"(?<=[:=]\s[\"'])[^\s\"']{6,}|(?<![0-9A-Za-z])\+?\(?[0-9][0-9().\x20/-]{3,}[0-9](?![0-9A-Za-z])"
    r"|[^\s@]+(?:@|\s?[(\[]at[)\]]\s?)[^\s@]+|(?<![A-Za-z0-9_-])[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*"
)
MARK = re.compile(r"[0-9@]|[(\[]at[)\]]|[:=]\s[\"']")
PART = re.compile(r"\w+|[^\w\s]+")
#: A pattern needs seeds worth this much and this share of all its instances; rounds of the graph's scoring; the
#: characters on either side that patterns look at.
SUPPORT, CONFIDENCE, ROUNDS, REACH = 3.0, 0.8, 3, 80


def digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(s: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(s)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base matches, sorted."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out)


def shape(s: str) -> str:
    """A string with its digit runs as 9 and its letter runs as a."""
    return re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", s))


def around(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns at a span of one line: the two words before it, the two after it, a label that leads up to it
    (``token = "``), and the word on either side with the span's shape. Words that the reach cuts are left out."""
    line = max(text.rfind("\n", 0, start) + 1, start - REACH)
    before = PART.findall(text[line:start].lower())
    if line and not text[line - 1].isspace() and not text[line].isspace():
        before = before[1:]
    stop = text.find("\n", end, end + REACH)
    cut = stop < 0 and end + REACH < len(text)
    after = PART.findall(text[end : stop if stop >= 0 else end + REACH].lower())
    if cut and not text[end + REACH].isspace():
        after = after[:-1]
    words, next_ = [x for x in before if x[0].isalnum()], [x for x in after if x[0].isalnum()]
    out, form = [], shape(text[start:end])
    if len(words) > 1:
        out.append(f"L {words[-2]} {words[-1]}")
    if len(next_) > 1:
        out.append(f"R {next_[0]} {next_[1]}")
    marks = "".join(before[k] for k in range(len(before)) if k > max((j for j, x in enumerate(before) if x[0].isalnum()), default=-1))
    if words and any(c in marks for c in ":=#"):
        out.append(f"l {words[-1]}{marks}")
    if len(form) <= 24:
        out += [f"s {words[-1]} {form}"] if words else []
        out += [f"t {form} {next_[0]}"] if next_ else []
    return out


def read_text(text: str) -> tuple[list, list, list]:
    """Base spans; seeds (kind number, instance, patterns); candidates (start, end, instance, patterns) beside the base spans."""
    if not MARK.search(text):
        return [], [], []
    base = base_spans(text)
    seeds = [(k, text[a:b].lower(), around(text, a, b)) for a, k, b in base]
    others = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        s = m.group()
        quoted = text[a - 1 : a] in "\"'" and a > 1
        if "@" not in s and "at" not in s.lower() and len(digits(s)) < 5 and not quoted:
            continue
        while b > a and text[b - 1] in ".,;:!?)":
            b -= 1
        if any(x < b and a < y for x, _, y in base) or not (patterns := around(text, a, b)):
            continue
        instance = text[a:b].lower()
        if SECRET.fullmatch(text, a, b) and not instance.isdigit():
            seeds.append((4, instance, patterns))
        others.append((a, b, instance, patterns))
    return base, seeds, others


ROW = "id string, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<s:int,k:int,e:int>>, seeds array<struct<k:int,i:string,p:array<string>>>, others array<struct<s:int,e:int,i:string,p:array<string>>>"
_SPAN = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
_SEED = pa.list_(pa.struct([("k", pa.int32()), ("i", pa.string()), ("p", pa.list_(pa.string()))]))
_OTHER = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("i", pa.string()), ("p", pa.list_(pa.string()))]))
_SCHEMA = pa.schema([("id", pa.string()), ("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("base", _SPAN), ("seeds", _SEED), ("others", _OTHER)])


def extracted(documents: DataFrame) -> DataFrame:
    """Stored rows: ``uid``, the text's md5 ``id``, base counts and digest, base spans, seeds and candidates; no text."""

    def run(batches):
        for batch in batches:
            out = {n: [] for n in _SCHEMA.names}
            out["doc_id"] = batch.column("doc_id").to_pylist()
            for text in common.values(batch.column("text")):
                text = text or ""
                base, seeds, others = read_text(text)
                counts = [0] * len(BASE)
                for _, k, _ in base:
                    counts[k] += 1
                for kind, n in zip(BASE, counts, strict=True):
                    out[f"n_{kind}"].append(n)
                out["id"].append(hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest() if others else None)
                out["base_sha256"].append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest())
                out["base"].append([{"s": a, "k": k, "e": b} for a, k, b in base])
                out["seeds"].append([{"k": k, "i": i, "p": p} for k, i, p in seeds])
                out["others"].append([{"s": a, "e": b, "i": i, "p": p} for a, b, i, p in others])
            yield common.table(out, _SCHEMA)

    rows = common.arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, ROW)
    return common.stored(rows.withColumn("uid", F.monotonically_increasing_id()), "pii-rows")


def learned(rows: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """Accepted patterns (pattern, k, confidence), from ROUNDS of scoring the pattern-instance graph.

    Pattern and kind: the sum of its instances' scores (seeds 1, others as far as found) must reach ``support`` and, as
    a share of all its distinct instances, ``confidence``. Instance: one minus the product of what its accepted patterns
    leave in doubt. Hot patterns and instances are grouped sums, combined before the shuffle.
    """
    seed = rows.select(F.explode("seeds").alias("x")).select(F.col("x.i").alias("i"), F.explode("x.p").alias("pattern"), F.col("x.k").alias("k"))
    other = rows.select(F.explode("others").alias("x")).select(F.col("x.i").alias("i"), F.explode("x.p").alias("pattern"), F.lit(None).cast("int").alias("k"))
    edges = common.stored(seed.unionAll(other).groupBy("i", "pattern").agg(F.min("k").alias("k")), "pii-edges")
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    sure = edges.where("k is not null").select("i", "pattern", "k", F.lit(1.0).alias("score"))
    known, accepted = sure, None
    for step in range(rounds):
        sums = known.groupBy("pattern", "k").agg(F.sum("score").alias("s")).where(F.col("s") >= support)
        accepted = sums.join(size, "pattern").where(F.col("s") >= F.col("n") * confidence).select("pattern", "k", (F.col("s") / F.col("n")).alias("confidence"))
        accepted = common.stored(accepted, "pii-patterns")
        if step == rounds - 1 or accepted.isEmpty():
            break
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        found = edges.where("k is null").join(accepted.select("pattern", F.col("k").alias("kind"), "confidence"), "pattern").groupBy("i", "kind").agg((1 - doubt).alias("score"))
        known = sure.unionAll(edges.where("k is null").select("i", "pattern").join(found, "i").select("i", "pattern", F.col("kind").alias("k"), "score"))
    return accepted


def contextual(rows: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """(key, more): for rows whose candidates have accepted patterns, the spans found, of the surest pattern's kind; of
    equally sure kinds the first. ``key`` is uid, or id for each distinct text once."""
    each = rows.where(F.size("others") > 0).select(key, F.explode("others").alias("x")).select(key, "x.s", "x.e", F.explode("x.p").alias("pattern"))
    best = each.join(accepted, "pattern").groupBy(key, "s", "e").agg(F.max(F.struct("confidence", (-F.col("k")).alias("k"))).alias("m"))
    span = F.struct(F.col("s"), (-F.col("m.k")).cast("int").alias("k"), F.col("e"))
    return best.groupBy(key).agg(F.sort_array(F.collect_list(span)).alias("more"))  # a document's own spans


def found(documents: DataFrame) -> DataFrame:
    """All spans of all ``documents`` (doc_id, text; other columns are ignored), one row each.

    Columns: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base matches, and ``spans`` (base and
    contextual ones as kind:start:end in code points, comma-joined, by start, then kind), n_context (the method's
    spans) and n_spans (all). Null and empty texts have none. Repeated rows stay; an empty table gives no rows.
    """
    rows = extracted(documents)
    more = contextual(rows, learned(rows), "uid")
    every = F.sort_array(F.concat("base", F.coalesce("more", F.array().cast("array<struct<s:int,k:int,e:int>>"))))
    names = F.array(*map(F.lit, KINDS))
    text = F.transform(every, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string")))
    n = F.coalesce(F.size("more"), F.lit(0)).cast("long")
    both = rows.join(more, "uid", "left")
    return both.select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", F.array_join(text, ",").alias("spans"), n.alias("n_context"), (n + F.size("base")).alias("n_spans"))


def masked(text: str, more: list[dict]) -> str:
    """``text`` with base spans and the spans ``more`` replaced by the kind's mark, like ``<EMAIL>``."""
    spans = [(a, b, k) for a, k, b in base_spans(text)] + [(x["s"], x["e"], x["k"]) for x in more]
    out, at = [], 0
    for a, b, k in sorted(spans):
        if a < at:  # spans of two kinds may overlap: one mark for both
            at = max(at, b)
            continue
        out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = b
    return "".join(out) + text[at:] if out else text


def redacted(documents: DataFrame) -> DataFrame:
    """``documents`` with all personal data in ``text`` masked; all rows and columns stay, ``n_chars`` is counted anew.

    Null and empty texts stay. Contextual spans are joined by the text's md5, so equal texts are masked alike. Columns
    of any name may stand beside doc_id and text; repeated rows stay; an empty table gives no rows.
    """
    rows = extracted(documents)
    more = contextual(rows, learned(rows), "id")
    # in a struct, no column's name can clash with ours
    keyed = documents.select(F.struct(*(documents[c] for c in documents.columns)).alias("row"), F.md5(F.coalesce(documents["text"], F.lit("")).cast("binary")).alias("id"))
    schema = T.StructType([keyed.schema["row"]])
    at = next(k for k, c in enumerate(documents.columns) if c.lower() == "text")

    def run(batches):
        for batch in batches:
            row = batch.column("row")
            columns = [row.field(k) for k in range(row.type.num_fields)]
            pairs = zip(common.values(columns[at]), common.values(batch.column("more")), strict=True)
            columns[at] = pa.array([masked(t, found or ()) if t else t for t, found in pairs], pa.string())
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=list(row.type))], names=["row"])

    out = common.arrow(keyed.join(more, "id", "left").select("row", "more"), run, schema).select("row.*")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else out


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark.read.parquet(f"{sf_dir}/documents.parquet"))
