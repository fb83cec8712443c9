"""Column expressions for responses: cleaning, counts, masks, flags. White space and word characters are Unicode's."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed character classes: white space beyond ASCII, and what counts inside a word.
SPACE, WORD = r"[\s\x1c-\x1f\x85\p{Z}]", r"[\p{L}\p{N}_]"


def cleaned(text: Column) -> Column:
    """Without a leading interface header line and response number line; white space collapsed and trimmed."""
    text = F.regexp_replace(text, rf"^{SPACE}*Gemini said{SPACE}*\n+", "")
    text = F.regexp_replace(text, rf"^{SPACE}*Response \d+:{SPACE}*\n+", "")
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def header_removed(text: Column) -> Column:
    """The audit's cleaning: the header goes with or without a line break, inner white space stays."""
    return F.regexp_replace(F.regexp_replace(text, rf"^{SPACE}*Gemini said{SPACE}*", ""), rf"^{SPACE}+|{SPACE}+$", "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[^{SPACE[1:-1]}]+"))


def in_range(count: Column, low: int = 100, high: int = 150) -> Column:
    return count.between(low, high)


def company(stream: Column, prefixes: dict[str, str], default: str) -> Column:
    """Company by the stream's prefix, in the order given."""
    out = None
    for prefix, name in prefixes.items():
        out = F.when(stream.startswith(prefix), name) if out is None else out.when(stream.startswith(prefix), name)
    return F.lit(default) if out is None else out.otherwise(default)


def masked(text: Column, labels: list[str], mark: str = "[IDENTITY]") -> Column:
    """Whole labels replaced, longest first, in any case."""
    either = "|".join(re.escape(x) for x in sorted(labels, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?iu)(?<!{WORD})(?:{either})(?!{WORD})", mark.replace("[", r"\[")) if either else text


def body_after(text: Column, mark: str = "\n\nARTICLE\n") -> Column:
    """What follows the first ``mark``; an error where it is missing."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text))).otherwise(F.raise_error(F.lit("no article mark")).cast("string"))


def excerpt(text: Column, n: int = 450) -> Column:
    return F.substring(text, 1, n)


def blank(column: Column) -> Column:
    return F.coalesce(F.trim(column.cast("string")), F.lit("")) == ""


def domains(text: Column) -> Column:
    """URLs and hosts that open with www., with their paths."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:https?://|www\.)[a-zA-Z0-9./_-]+"), F.lit(0))


def leads_with(text: Column, start: str) -> Column:
    """Whether the text begins with ``start`` after any white space."""
    return F.coalesce(text, F.lit("")).rlike(rf"^{SPACE}*{re.escape(start)}")


def identity_mismatch(label: Column, question: Column, prompt: Column) -> Column:
    """The question does not say ``I am <label>.``, or the prompt does not hold the question."""
    said = F.contains(question, F.concat(F.lit("I am "), label, F.lit(".")))
    return ~(F.coalesce(said, F.lit(False)) & F.coalesce(F.contains(prompt, question), F.lit(False)))


def row_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def joined_evidence(evidence: dict[str, Column]) -> Column:
    """What holds, in the order given, between spaced pipes."""
    return joined_flags(evidence, " | ")


def joined_flags(flags: dict[str, Column], separator: str = ";") -> Column:
    """Names of the flags that hold, in the order given."""
    return F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]), lambda x: x.isNotNull()), separator)


def tokens(text: Column) -> Column:
    """Lower-cased tokens of two word characters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"{WORD}{{2,}}"), F.lit(0))


def grams(words: Column) -> Column:
    """Tokens and pairs of neighbours."""
    n = F.size(words) - 1
    return F.when(n < 1, words).otherwise(F.concat(words, F.zip_with(F.slice(words, 1, F.greatest(n, F.lit(1))), F.slice(words, 2, F.greatest(n, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))))


def number(column: Column, kind: str = "double") -> Column:
    """Tolerant cast: what is no number is null."""
    return F.expr("null").cast(kind) if column is None else column.try_cast(kind)
