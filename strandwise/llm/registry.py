"""The queries of the training-data operators, and their SQL where SQL can express them.

The ten queries hold results of tokenizers, hashes or fitted models, which SQL does not express. What is fixed by
their contracts alone, the rules and counts before a method adds to them, stands in queries of its own with SQL.
"""

from pyspark.sql import DataFrame, SparkSession

from . import pii, quality_rules, url_filter
from .decontaminate import op5_decontaminate
from .importance import op8_importance
from .jaccard_join import op10_jaccard_join
from .language import op9_language
from .packing import op2_packing
from .pii import op4_pii
from .quality_rules import op7_quality_rules
from .suffix_dedup import op6_suffix_dedup
from .token_files import op1_token_files
from .url_filter import op3_url_filter


def base_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every URL, and the rule's verdict; null where no rule fits."""
    rows = url_filter.filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.selectExpr("page_id", "host", "path", "rule", "case when rule is not null then verdict end as verdict")


def base_pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base matches of every document."""
    return pii.found(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    rows = quality_rules.cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


_rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
_fits = [(kind, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for kind, h, p in _rules]
_word = r"[^\x20\x09-\x0D]"

SQL: dict[str, str] = {
    "base_url_rules": f"""WITH t AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t FROM pages),
h AS (SELECT page_id, translate(regexp_extract(t, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM t)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {f} THEN '{name}'" for _, name, f in _fits)} END AS rule, CASE {' '.join(f"WHEN {f} THEN '{kind}'" for kind, _, f in _fits)} END AS verdict FROM h""",
    "base_pii_counts": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS i,
  list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS c, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS p FROM t)
SELECT doc_id, len(e) AS n_email,
  len(list_filter(i, lambda x: len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR coalesce(try_cast(ltrim(y, '0') AS INT), 0) > 255)) = 0)) AS n_ip,
  len(list_filter(c, lambda d: length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda k: CASE WHEN (length(d) - k) % 2 = 0 THEN substr(d, k, 1)::INT WHEN substr(d, k, 1)::INT > 4 THEN 2 * substr(d, k, 1)::INT - 9 ELSE 2 * substr(d, k, 1)::INT END)) % 10 = 0)) AS n_card,
  len(list_filter(p, lambda d: length(d) BETWEEN 10 AND 15)) AS n_phone FROM m""",
    "base_quality_counts": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_word}+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d), g AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM i),
r AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM r GROUP BY doc_id),
x AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_word}')) AS lines, coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x""",
}

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files, op2_packing, op3_url_filter, op4_pii, op5_decontaminate, op6_suffix_dedup, op7_quality_rules, op8_importance, op9_language, op10_jaccard_join,
        base_url_rules, base_pii_counts, base_quality_counts,
    )
}
