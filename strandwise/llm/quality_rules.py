"""Line-first cleaning with DataFrame functions only: lines are judged one by one, failing lines go, and a document that
loses too much of its text is rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of `[^\x20\x09-\x0D]+`, and the symbols that are counted.
WHITE, SYMBOLS, SPLIT = "\t\n\x0b\x0c\r", "#*$%&|<>", r"[\x20\x09-\x0D]+"
#: Phrases of page furniture, looked for in lower case.
BOILERPLATE = (
    "cookie", "javascript", "all rights reserved", "copyright", "terms of use", "terms of service", "privacy policy",
    "subscribe", "newsletter", "click here", "read more", "share this", "share on", "lorem ipsum", "released under the",
)
#: Phrases that end with a word's end.
BORDERED = r"sign (in|up)\b|log ?in\b"
ENDS = r"[.!?…:;。！？][\"'”’»)\]]*$"


def word_list(text: Column) -> Column:
    """Words of the whole text; no word: an empty array."""
    flat = F.btrim(text, F.lit(WHITE + " "))
    return F.when(F.length(flat) == 0, F.array().cast("array<string>")).otherwise(F.split(flat, SPLIT))


def _given(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words in runs of three words that stand twice or more in the text, the first included; without a join or shuffle.

    Runs are 64-bit hashes (two of a text's runs share one with a chance below 1e-10, whatever its length up to 60,000
    words); they are sorted with their places, equal neighbours give places, and the places' runs are joined to a length.
    """

    def runs(w: Column) -> Column:
        n = F.size(w) - 2
        two = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(two, F.slice(w, 3, n), lambda h, c: F.xxhash64(h, c))

    def places(sorted_runs: Column) -> Column:
        m = F.size(sorted_runs) - 1
        pairs = F.zip_with(F.slice(sorted_runs, 1, m), F.slice(sorted_runs, 2, m), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(at, start, lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])

    def counted(r: Column) -> Column:
        tagged = F.zip_with(r, F.sequence(F.lit(0), F.size(r) - 1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        return F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0)).otherwise(_given(F.sort_array(tagged), lambda s: covered(places(s))))

    return _given(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(_given(runs(w), counted)))


def line_passes(line: Column, min_words: int = 3) -> Column:
    """A line stays if it ends as a sentence does, has some words, and is no navigation, boilerplate, shouting or litany."""


    def judged(flat: Column, low: Column) -> Column:
        symbols = F.length(flat) - F.length(F.translate(flat, SYMBOLS, ""))
        furniture = F.lit(False)
        for phrase in BOILERPLATE:
            furniture = furniture | low.contains(phrase)
        furniture = furniture | ((low.contains("sign ") | low.contains("log")) & low.rlike(BORDERED))
        capitals = F.length(F.regexp_replace(flat, r"\P{Lu}+", ""))
        small = F.length(F.regexp_replace(flat, r"\P{Ll}+", ""))
        varied = _given(F.split(flat, SPLIT), lambda w: (F.size(w) >= min_words) & (F.size(F.array_distinct(w)) * 4 >= F.size(w)))
        return flat.rlike(ENDS) & (symbols * 20 <= F.length(flat)) & ~furniture & varied & (capitals <= small)

    # each value is bound once, as nothing inside a lambda is shared otherwise
    return _given(F.btrim(line, F.lit(WHITE + " ")), lambda flat: _given(F.lower(flat), lambda low: judged(flat, low)))


def cleaned(documents: DataFrame, min_words: int = 50, min_kept: float = 0.5) -> DataFrame:
    """``documents`` (doc_id, text; other columns are ignored) with counts, verdict and cleaned text, one row each.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines,
    n_lines_kept, clean_text. ``kept`` is false if the base fails, else whether the lines that stay hold at least
    ``min_kept`` of the characters of all lines. Null and empty texts have no words and fail. Repeated rows stay; an
    empty table gives no rows. All work is in the row, so nothing is shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    # the arrays are columns of their own, so each is made once however often it is used
    rows = documents.select("doc_id", text.alias("text")).select("doc_id", "text", word_list(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), has_word).alias("lines"))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.array_join("lines", "")).cast("long").alias("line_chars"),
        # a function of two parameters would be given the line's index as its second
        F.filter("lines", lambda x: line_passes(x)).alias("good"),
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    enough = F.length(F.array_join("good", "")) >= F.col("line_chars") * min_kept
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & enough).alias("kept"), "n_lines",
        F.size("good").cast("long").alias("n_lines_kept"), F.array_join("good", "\n").alias("clean_text"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("clean_text")
