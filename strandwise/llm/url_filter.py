"""URL verdicts: host and path rules first, then the ratio of two character models of accepted and rejected URLs.

Only DataFrame functions run here. The models are variable-order Markov models: for each character and each order k
the counts of its k-gram and of that gram's context are looked up, and the probability of order k is smoothed with
that of order k - 1, (n(gram) + a p) / (n(context) + a), down to a uniform one. The counts are a table of the grams
themselves, which grows with the URLs; a gram is scored once and joined to its places.

The rules label the URLs that train the models. So that the models do not just learn the rules again, they don't see
what rules speak of: the last two labels of the host (its domain) and the path's first segment.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER, STRENGTH, ALPHABET = 4, 2.0, 128
#: (verdict, host, path); a rule fits its host and all subdomains, for paths that start with its path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty if the URL is null or has no ``://``."""
    begin = F.instr(url, "://")
    tail = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise("")
    tail = F.coalesce(tail, F.lit(""))
    host = F.translate(F.regexp_extract(tail, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, like ``net/``, and its verdict; null where none fits."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


def seen(url: Column, host: Column) -> Column:
    """What the models see of a URL: its host without the last two labels, its path without the first segment, the rest."""
    begin = F.instr(url, "://")
    rest = F.translate(F.substring(url, begin + 3 + F.length(host), F.length(url)), UPPER, LOWER)
    # a host of one or two labels is all domain; a path's first segment ends with a slash
    name = F.regexp_replace(host, r"(^|\.)[^.]*(\.[^.]*)?$", "")
    return F.when(begin > 0, F.concat(name, F.lit("/"), F.regexp_replace(rest, r"^/[^/?#]*/", ""))).otherwise(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER))


def _places(texts: DataFrame) -> DataFrame:
    """One row a character of column ``t`` (after a start mark): the other columns and ``g``, its ORDER-gram."""
    t = texts.withColumn("t", F.concat(F.lit("^"), "t"))
    t = t.withColumn("i", F.explode(F.sequence(F.lit(2), F.greatest(F.length("t"), F.lit(2)))))
    begin = F.greatest(F.col("i") - F.lit(ORDER - 1), F.lit(1))
    return t.select(*[c for c in texts.columns if c != "t"], F.substring(F.col("t"), begin, F.col("i") - begin + 1).alias("g"))


def _tail(gram: Column, k: int) -> Column:
    """The last k characters; a gram at the text's start may have fewer."""
    return F.substring(gram, F.greatest(F.length(gram) - F.lit(k - 1), F.lit(1)), F.lit(k))


def fitted(labelled: DataFrame) -> DataFrame:
    """Counts (k, gram, accepted, rejected) of the grams of each order in the URLs in column ``t`` by boolean ``good``."""
    longest = _places(labelled.select("t", "good")).groupBy("g").agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("r"))
    each = F.array(*[F.struct(F.lit(k).alias("k"), _tail(F.col("g"), k).alias("gram")) for k in range(1, ORDER + 1)])
    return longest.select("a", "r", F.inline(each)).groupBy("k", "gram").agg(F.sum("a").cast("double").alias("accepted"), F.sum("r").cast("double").alias("rejected"))


def scored(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(t, score): mean log-likelihood difference a character of each distinct ``t``, accepted minus rejected."""
    texts = texts.select("t").distinct().select("t", F.xxhash64("t").alias("u"), F.xxhash64(F.lit(1), F.col("t")).alias("v"))
    places = _places(texts)
    rows = places.select("g").distinct()
    contexts = model.groupBy("k", F.expr("substring(gram, 1, length(gram) - 1)").alias("gram")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    chance = {side: F.lit(1.0 / ALPHABET) for side in "ar"}
    for k in range(1, ORDER + 1):
        for x, table, key in (("g", model, _tail(F.col("g"), k)), ("c", contexts, F.expr(f"substring(g, greatest(length(g) - {k - 1}, 1), least({k}, length(g)) - 1)"))):
            m = table.where(F.col("k") == k).select(F.col("gram").alias("_m"), F.col("accepted").alias(f"a{x}{k}"), F.col("rejected").alias(f"r{x}{k}"))
            rows = rows.withColumn("_k", key).join(m, F.col("_k") == F.col("_m"), "left").drop("_k", "_m")
    for k in range(1, ORDER + 1):
        for side in "ar":
            context, own = F.coalesce(f"{side}c{k}", F.lit(0.0)), F.coalesce(f"{side}g{k}", F.lit(0.0))
            chance[side] = (own + F.lit(STRENGTH) * chance[side]) / (context + F.lit(STRENGTH))
    grams = rows.select("g", (F.log(chance["a"]) - F.log(chance["r"])).alias("d"))
    means = places.join(grams, "g").groupBy("u", "v").agg(F.avg("d").alias("score"))
    return texts.join(means, ["u", "v"]).select("t", "score")


def threshold(scores: DataFrame, width: float = 0.05) -> float | None:
    """The cut with the best sum of the shares kept of good and dropped of bad URLs; ties: the middle of the best run.

    ``scores``: (score, good). At most 400 grouped bins reach the driver. None if a class is missing, or if the sum is
    no more than twice its standard error above that of a guess, 1: then nothing is known of URLs without a rule.
    """
    place = F.floor(F.least(F.greatest("score", F.lit(-10.0)), F.lit(10.0)) / F.lit(width)).cast("int")
    bins = sorted((r[0], r[1], r[2]) for r in scores.groupBy(place.alias("b")).agg(F.count_if("good"), F.count_if(~F.col("good"))).collect())
    good, bad = sum(r[1] for r in bins), sum(r[2] for r in bins)
    if not good or not bad:
        return None
    marks, kept, dropped = [], good, 0
    for b, g, r in bins:
        marks.append((kept / good + dropped / bad, b))
        kept, dropped = kept - g, dropped + r
    best = max(m for m, _ in marks)
    if best - 1 <= math.sqrt(1 / good + 1 / bad):
        return None
    at = [b for m, b in marks if m == best]
    low = max([b for b, *_ in bins if b < at[0]], default=at[0] - 2)
    return width * (low + 1 + at[0]) / 2


def filtered(pages: DataFrame, rules=RULES) -> DataFrame:
    """Verdicts of all ``pages`` (page_id, url; other columns are ignored): page_id, host, path, rule, verdict, score.

    URLs that a rule decides are the labels: those of three quarters of the hosts, by crc32, train the models, the
    others calibrate the cut, so no host is on both sides; the URLs without a rule get the models' verdict (allow from
    the cut up; allow for all where ``threshold`` gives none), and ``score`` is null for ruled ones. A text that stands
    under an allowed and a blocked URL counts on both sides. Null and empty URLs have an empty host and path and are
    scored as an empty text. Repeated rows stay. An empty table gives no rows.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", seen(F.col("url"), F.col("host")).alias("t"), "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    training = F.pmod(F.crc32(F.col("host").cast("binary")), F.lit(4)) != 0
    labels = rows.where("rule is not null").select("t", (F.col("ruled") == "allow").alias("good"), training.alias("training")).distinct()
    model = common.stored(fitted(labels.where("training")), "url-model")
    held = labels.where("not training")
    scores = common.stored(scored(rows.where("rule is null").select("t").unionAll(held.select("t")), model), "url-scores")
    cut = threshold(scores.join(held, "t"))
    found = rows.where("rule is null").join(scores, "t", "left")
    judged = F.when(F.col("score") >= F.lit(float("-inf") if cut is None else cut), "allow").otherwise("block")
    return found.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), judged.alias("verdict"), "score").unionAll(
        rows.where("rule is not null").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("score"))
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"))
