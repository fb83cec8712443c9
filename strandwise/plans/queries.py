"""The reference's operators as queries on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, vector
from ..operators import aggregate as agg
from ..operators import design, quality, represent, resample, select
from .bindings import BLOCKS_SQL, FACT_SQL, LABELS, OBS_SQL, TEXT_SQL, obs_text, obs_vec

QUERIES: dict = {}
SQL: dict[str, str] = {}
DRAWS, SEED, TERMS = resample.DRAWS, resample.SEED, 50_000
EXCLUDED = "cell % 7 = 3"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _fact(spark, sf_dir, size=None):
    return design.distances(obs_vec(spark, sf_dir, size))


def _r(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# distances and their means


@query(f"WITH {FACT_SQL} SELECT cell, a, b, round(distance, 6) AS distance FROM fact")
def pair_distance_long(spark, sf_dir):
    return _fact(spark, sf_dir).select("cell", "a", "b", *_r("distance"))


@query(f"WITH {FACT_SQL} SELECT a, b, round(avg(distance), 6) AS mean_distance, count(*) AS n FROM fact GROUP BY a, b")
def pair_mean(spark, sf_dir):
    return agg.pair_means(_fact(spark, sf_dir)).select("a", "b", *_r("mean_distance"), "n")


def _by(stratum):
    @query(f"WITH {FACT_SQL} SELECT a, b, {stratum}, round(avg(distance), 6) AS mean_distance, count(*) AS n FROM fact GROUP BY a, b, {stratum}")
    def f(spark, sf_dir):
        return agg.pair_means(_fact(spark, sf_dir), stratum).select("a", "b", stratum, *_r("mean_distance"), "n")

    QUERIES[f"pair_by_{stratum}"], SQL[f"pair_by_{stratum}"] = QUERIES.pop("f"), SQL.pop("f")


for _s in ("cluster", "family", "article"):
    _by(_s)


@query(
    f"WITH {FACT_SQL} SELECT a, b, 'all' AS level, NULL::VARCHAR AS value, round(avg(distance), 6) AS mean_distance, count(*) AS n FROM fact GROUP BY a, b"
    + "".join(f" UNION ALL SELECT a, b, '{s}', {s}::VARCHAR, round(avg(distance), 6), count(*) FROM fact GROUP BY a, b, {s}" for s in ("cluster", "family", "article"))
)
def pair_strata(spark, sf_dir):
    return agg.stratified_means(_fact(spark, sf_dir), ("cluster", "family", "article")).select("a", "b", "level", "value", *_r("mean_distance"), "n")


@query(f"WITH {FACT_SQL}, c AS (SELECT least(company_a, company_b) AS company_a, greatest(company_a, company_b) AS company_b, cell, avg(distance) AS d, count(*) AS m FROM fact GROUP BY 1, 2, 3) SELECT company_a, company_b, round(avg(d), 6) AS mean_distance, max(m) AS model_pairs, count(*) AS n_prompts FROM c GROUP BY 1, 2")
def company_pair(spark, sf_dir):
    return agg.company_pairs(_fact(spark, sf_dir)).select("company_a", "company_b", *_r("mean_distance"), "model_pairs", "n_prompts")


@query(f"WITH {FACT_SQL}, c AS (SELECT cell, avg(distance) FILTER (WHERE company_a = company_b) AS w, avg(distance) FILTER (WHERE company_a <> company_b) AS b FROM fact GROUP BY cell) SELECT round(avg(w), 6) AS within_mean, round(avg(b), 6) AS between_mean, round(avg(b - w), 6) AS delta, count(*) AS n_prompts FROM c")
def company_contrast(spark, sf_dir):
    return agg.company_contrast(_fact(spark, sf_dir)).select(*_r("within_mean", "between_mean", "delta"), "n_prompts")


def _blocks(spark, sf_dir):
    return design.block_distances(obs_vec(spark, sf_dir))


@query(f"WITH {BLOCKS_SQL}, m AS (SELECT stream, company, dimension, article, family, avg(distance) AS d, count(*) AS m FROM blocks GROUP BY ALL) SELECT stream, company, dimension, round(avg(d), 6) AS mean_distance, sum(m)::BIGINT AS n_pairs, count(*) AS n_blocks FROM m GROUP BY ALL")
def identity_sensitivity(spark, sf_dir):
    return agg.identity_sensitivity(_blocks(spark, sf_dir)).select("stream", "company", "dimension", *_r("mean_distance"), "n_pairs", "n_blocks")


@query(f"WITH {BLOCKS_SQL}, e AS (SELECT *, unnest([cluster_a, cluster_b]) AS cluster FROM blocks), m AS (SELECT stream, company, dimension, article, family, cluster, avg(distance) AS d FROM e GROUP BY ALL) SELECT stream, company, dimension, cluster, round(avg(d), 6) AS mean_distance, count(*) AS n_blocks FROM m GROUP BY ALL")
def label_influence(spark, sf_dir):
    return agg.label_influence(_blocks(spark, sf_dir)).select("stream", "company", "dimension", "cluster", *_r("mean_distance"), "n_blocks")


@query(f"WITH {BLOCKS_SQL}, m AS (SELECT stream, dimension, article, family, avg(distance) AS d FROM blocks GROUP BY ALL), s AS (SELECT stream, dimension, avg(d) AS d FROM m GROUP BY ALL) SELECT dimension, round(avg(d), 6) AS mean_distance, count(*) AS n FROM s GROUP BY dimension")
def dimension_mean(spark, sf_dir):
    return agg.identity_sensitivity(_blocks(spark, sf_dir)).groupBy("dimension").agg(F.avg("mean_distance").alias("mean_distance"), F.count("*").alias("n")).select("dimension", *_r("mean_distance"), "n")


@query(
    f"WITH {BLOCKS_SQL}, m AS (SELECT stream, dimension, article, family, avg(distance) AS d FROM blocks GROUP BY ALL), s AS (SELECT stream, dimension, avg(d) AS x FROM m GROUP BY ALL), e AS (SELECT *, unnest([cluster_a, cluster_b]) AS cluster FROM blocks), i AS (SELECT stream, dimension, article, family, cluster, avg(distance) AS d FROM e GROUP BY ALL), l AS (SELECT stream, dimension, cluster, avg(d) AS d FROM i GROUP BY ALL), k AS (SELECT stream, dimension, avg(d) AS y FROM l GROUP BY ALL) SELECT stream, dimension, round(x, 6) AS sensitivity, round(y, 6) AS mean_influence, abs(x - y) < 1e-9 AS agree FROM s JOIN k USING (stream, dimension)"
)
def aggregate_consistency(spark, sf_dir):
    rows = _blocks(spark, sf_dir)
    x = agg.identity_sensitivity(rows).select("stream", "dimension", F.col("mean_distance").alias("x"))
    y = agg.label_influence(rows).groupBy("stream", "dimension").agg(F.avg("mean_distance").alias("y"))
    return x.join(y, ["stream", "dimension"]).select("stream", "dimension", F.round("x", 6).alias("sensitivity"), F.round("y", 6).alias("mean_influence"), (F.abs(F.col("x") - F.col("y")) < 1e-9).alias("agree"))


_m = ", ".join(f"max(CASE WHEN b = {k} THEN m END) AS m{k}" for k in range(5))


@query(f"WITH {FACT_SQL}, p AS (SELECT a, b, round(avg(distance), 6) AS m FROM fact GROUP BY a, b), q AS (SELECT * FROM p UNION ALL SELECT b, a, m FROM p) SELECT a, {_m} FROM q GROUP BY a")
def pivot_matrix(spark, sf_dir):
    means = agg.pair_means(_fact(spark, sf_dir)).select("a", "b", *_r("mean_distance"))
    return agg.symmetric_matrix(means, list(range(5)))


# resampling


def _ci_sql(rows: str, keys: str, cluster: str, top: str, bottom: str = "1") -> str:
    """SQL of ``bootstrap``: the draws are made for each number of clusters that occurs."""
    return f"""c AS (SELECT {keys}, {top} AS s, {bottom} AS n, row_number() OVER (PARTITION BY {keys} ORDER BY {cluster}) - 1 AS ix, count(*) OVER (PARTITION BY {keys}) AS k FROM {rows}),
slots AS (SELECT k, unnest(range(k)) AS slot FROM (SELECT DISTINCT k FROM c)),
draws AS (SELECT k, draw, slot, ('0x' || substr(md5('{SEED}|' || draw || '|' || slot), 1, 8))::BIGINT % k AS ix FROM slots, range({DRAWS}) d(draw)),
t AS (SELECT {keys}, draw, sum(s) / sum(n) AS x FROM c JOIN draws USING (k, ix) GROUP BY ALL)"""


_ci = "round(quantile_cont(x, 0.025), 6) AS ci_low, round(quantile_cont(x, 0.975), 6) AS ci_high"


def _ci_columns(rows, *keys):
    return rows.select(*keys, *_r("ci_low", "ci_high"))


@query(f"WITH {FACT_SQL}, m AS (SELECT a, b, cluster, avg(distance) AS m FROM fact GROUP BY ALL), {_ci_sql('m', 'a, b', 'cluster', 'm')} SELECT a, b, {_ci} FROM t GROUP BY a, b")
def boot_pair_ci(spark, sf_dir):
    means = agg.pair_means(_fact(spark, sf_dir), "cluster")
    return _ci_columns(resample.bootstrap(means, ["a", "b"], "cluster", F.col("mean_distance")), "a", "b")


@query(f"WITH {FACT_SQL}, m AS (SELECT a, b, cluster, sum(distance) AS su, count(*) AS co FROM fact WHERE NOT ({EXCLUDED}) GROUP BY ALL), {_ci_sql('m', 'a, b', 'cluster', 'su', 'co')} SELECT a, b, {_ci} FROM t GROUP BY a, b")
def boot_ratio_ci(spark, sf_dir):
    fact = _fact(spark, sf_dir).where(f"not ({EXCLUDED})")
    sums = fact.groupBy("a", "b", "cluster").agg(F.sum("distance").alias("s"), F.count("*").alias("n"))
    return _ci_columns(resample.bootstrap(sums, ["a", "b"], "cluster", F.col("s"), F.col("n")), "a", "b")


@query(f"WITH {BLOCKS_SQL}, m AS (SELECT stream, dimension, article, family, avg(distance) AS m FROM blocks GROUP BY ALL), {_ci_sql('m', 'stream, dimension', 'article, family', 'm')} SELECT stream, dimension, {_ci} FROM t GROUP BY ALL")
def boot_block_ci(spark, sf_dir):
    means = agg.block_means(_blocks(spark, sf_dir)).withColumn("block", F.struct("article", "family"))
    return _ci_columns(resample.bootstrap(means, ["stream", "dimension"], "block", F.col("d")), "stream", "dimension")


_company_cells = "cc AS (SELECT least(company_a, company_b) AS company_a, greatest(company_a, company_b) AS company_b, cell, cluster, avg(distance) AS d FROM fact GROUP BY ALL), m AS (SELECT company_a, company_b, cluster, avg(d) AS m FROM cc GROUP BY ALL)"


@query(f"WITH {FACT_SQL}, {_company_cells}, {_ci_sql('m', 'company_a, company_b', 'cluster', 'm')} SELECT company_a, company_b, {_ci} FROM t GROUP BY ALL")
def company_pair_ci(spark, sf_dir):
    each = agg.company_pair_cells(_fact(spark, sf_dir), "cell", "cluster").groupBy("company_a", "company_b", "cluster").agg(F.avg("d").alias("m"))
    return _ci_columns(resample.bootstrap(each, ["company_a", "company_b"], "cluster", F.col("m")), "company_a", "company_b")


_contrast = "e AS (SELECT cell, cluster, avg(distance) FILTER (WHERE company_a <> company_b) - avg(distance) FILTER (WHERE company_a = company_b) AS d FROM fact{where} GROUP BY ALL), m AS (SELECT 'delta' AS name, cluster, {agg} FROM e GROUP BY ALL)"


@query(f"WITH {FACT_SQL}, {_contrast.format(where='', agg='avg(d) AS m')}, {_ci_sql('m', 'name', 'cluster', 'm')} SELECT name, {_ci} FROM t GROUP BY ALL")
def company_contrast_ci(spark, sf_dir):
    each = agg.contrast_by_cell(_fact(spark, sf_dir), "cell", "cluster").groupBy(F.lit("delta").alias("name"), "cluster").agg(F.avg(F.col("between") - F.col("within")).alias("m"))
    return _ci_columns(resample.bootstrap(each, ["name"], "cluster", F.col("m")), "name")


@query(f"WITH {FACT_SQL}, {_contrast.format(where=f' WHERE NOT ({EXCLUDED})', agg='sum(d) AS su, count(d) AS co')}, {_ci_sql('m', 'name', 'cluster', 'su', 'co')} SELECT name, {_ci} FROM t GROUP BY ALL")
def screened_contrast_ci(spark, sf_dir):
    delta = F.col("between") - F.col("within")
    each = agg.contrast_by_cell(_fact(spark, sf_dir).where(f"not ({EXCLUDED})"), "cell", "cluster").groupBy(F.lit("delta").alias("name"), "cluster").agg(F.sum(delta).alias("s"), F.count(delta).alias("n"))
    return _ci_columns(resample.bootstrap(each, ["name"], "cluster", F.col("s"), F.col("n")), "name")


def _rho_sql(source: str, x: str, y: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    tie = lambda c: f"PARTITION BY {by + ', ' if by else ''}{c}"
    rank = lambda c: f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER ({tie(c)}) - 1) / 2.0"
    head = f"{by}, " if by else ""
    return f"SELECT {head}round(CASE WHEN stddev_pop(rx) * stddev_pop(ry) = 0 THEN NULL ELSE covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END, 6) AS rho, count(*) AS n FROM (SELECT {head}{rank(x)} AS rx, {rank(y)} AS ry FROM {source}) {'GROUP BY ' + by if by else ''}"


_words_sql = "len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> ''))"


@query(f"WITH {TEXT_SQL}, w AS (SELECT cell, stream, {_words_sql} AS words, length(text) AS chars FROM obs), p AS (SELECT x.stream AS a, y.stream AS b, abs(x.words - y.words) AS dw, abs(x.chars - y.chars) AS dc FROM w x JOIN w y ON x.cell = y.cell AND x.stream < y.stream) {_rho_sql('p', 'dw', 'dc', 'a, b')}")
def spearman_length(spark, sf_dir):
    rows = obs_text(spark, sf_dir).select("cell", "cluster", "dimension", "family", "article", "stream", F.lit("A").alias("company"), text.word_count(F.col("text")).alias("words"), F.length("text").alias("chars"))
    pairs = design.matched_pairs(rows, keep=("words", "chars"))
    pairs = pairs.select("a", "b", F.abs(F.col("words_a") - F.col("words_b")).alias("dw"), F.abs(F.col("chars_a") - F.col("chars_b")).alias("dc"))
    return resample.spearman(pairs, "dw", "dc", "a", "b").select("a", "b", *_r("rho"), "n")


_short = "list_dot_product(x.v[1:32], y.v[1:32]) / (sqrt(list_dot_product(x.v[1:32], x.v[1:32])) * sqrt(list_dot_product(y.v[1:32], y.v[1:32])))"
_both_metrics = f"two AS (SELECT x.cell, x.stream AS a, y.stream AS b, least(greatest(1 - list_dot_product(x.v, y.v), 0), 2) AS d1, least(greatest(1 - {_short}, 0), 2) AS d2 FROM obs x JOIN obs y ON x.cell = y.cell AND x.stream < y.stream)"


@query(f"WITH {OBS_SQL}, {_both_metrics}, p AS (SELECT a, b, avg(d1) AS d1, avg(d2) AS d2 FROM two GROUP BY a, b) {_rho_sql('p', 'd1', 'd2')}")
def encoder_agreement(spark, sf_dir):
    x = agg.pair_means(_fact(spark, sf_dir)).select("a", "b", F.col("mean_distance").alias("d1"))
    y = agg.pair_means(_fact(spark, sf_dir, 32)).select("a", "b", F.col("mean_distance").alias("d2"))
    return resample.spearman(x.join(y, ["a", "b"]), "d1", "d2").select(*_r("rho"), "n")


@query(f"WITH {OBS_SQL}, {_both_metrics} {_rho_sql('two', 'd1', 'd2')}")
def encoder_agreement_cells(spark, sf_dir):
    """The rank correlation of two metrics over all cells and pairs."""
    x = _fact(spark, sf_dir).select("cell", "a", "b", F.col("distance").alias("d1"))
    y = _fact(spark, sf_dir, 32).select("cell", "a", "b", F.col("distance").alias("d2"))
    return resample.spearman_of_all(x.join(y, ["cell", "a", "b"]), "d1", "d2").select(*_r("rho"), "n")


@query(f"WITH {FACT_SQL}, f AS (SELECT a, b, avg(distance) AS x FROM fact GROUP BY a, b), s AS (SELECT a, b, avg(distance) AS y FROM fact WHERE NOT ({EXCLUDED}) GROUP BY a, b), p AS (SELECT * FROM f JOIN s USING (a, b)), r AS ({_rho_sql('p', 'x', 'y')}) SELECT rho, (SELECT round(max(abs(x - y)), 6) FROM p) AS max_change, (SELECT round(avg(abs(x - y)), 6) FROM p) AS mean_change FROM r")
def screen_stability(spark, sf_dir):
    fact = _fact(spark, sf_dir)
    screened = select.without(fact, fact.where(EXCLUDED))
    both = agg.pair_means(fact).select("a", "b", F.col("mean_distance").alias("x")).join(agg.pair_means(screened).select("a", "b", F.col("mean_distance").alias("y")), ["a", "b"])
    change = both.agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("max_change"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_change"))
    rho = resample.spearman(both, "x", "y").select("rho", F.lit(1).alias("one"))
    return rho.join(change.withColumn("one", F.lit(1)), "one").select(*_r("rho", "max_change", "mean_change"))


@query(f"WITH {FACT_SQL} SELECT a, b, round(avg(distance), 6) AS mean_distance, count(*) AS n FROM fact WHERE NOT ({EXCLUDED}) GROUP BY a, b")
def screened_pair_mean(spark, sf_dir):
    fact = _fact(spark, sf_dir)
    return agg.pair_means(select.without(fact, fact.where(EXCLUDED))).select("a", "b", *_r("mean_distance"), "n")


# cases


@query(f"WITH {FACT_SQL} SELECT cell, a, b, round(distance, 6) AS distance FROM fact ORDER BY fact.distance DESC, cell, a, b LIMIT 6")
def case_top(spark, sf_dir):
    return select.top_cases(_fact(spark, sf_dir)).select("cell", "a", "b", *_r("distance"))


@query(f"WITH {FACT_SQL} SELECT a, b, cell, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY distance DESC, cell) AS r FROM fact) WHERE r = 1")
def case_argmax(spark, sf_dir):
    return select.furthest_by_pair(_fact(spark, sf_dir)).select("a", "b", "cell", *_r("distance"))


@query(f"WITH {FACT_SQL} SELECT a, b, cell, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY distance, cell) AS r, count(*) OVER (PARTITION BY a, b) AS n FROM fact) WHERE r = n // 2 + 1")
def case_upper_median(spark, sf_dir):
    return select.upper_median_by_pair(_fact(spark, sf_dir)).select("a", "b", "cell", *_r("distance"))


# texts

_headed_sql = "CASE WHEN doc_id % 7 = 0 THEN 'Gemini said' || chr(10) || chr(10) || text WHEN doc_id % 7 = 1 THEN 'Response 2:' || chr(10) || chr(10) || text ELSE text END"
_clean_sql = f"trim(regexp_replace(regexp_replace(regexp_replace({_headed_sql}, '^\\s*Gemini said\\s*\\n+', ''), '^\\s*Response \\d+:\\s*\\n+', ''), '\\s+', ' ', 'g'))"


def _headed():
    d = F.col("doc_id") % 7
    return F.when(d == 0, F.concat(F.lit("Gemini said\n\n"), "text")).when(d == 1, F.concat(F.lit("Response 2:\n\n"), "text")).otherwise(F.col("text"))


@query(f"WITH c AS (SELECT doc_id, {_clean_sql} AS t FROM documents) SELECT doc_id, md5(t) AS clean_md5, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS words FROM c")
def clean_texts(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", text.cleaned(_headed()).alias("t"))
    return rows.select("doc_id", F.md5(F.col("t").cast("binary")).alias("clean_md5"), text.word_count(F.col("t")).alias("words"))


@query(f"WITH {TEXT_SQL}, w AS (SELECT stream, {_words_sql} AS words FROM obs) SELECT stream, count(*) AS n, round(avg(words), 6) AS mean_words, round(median(words), 6) AS median_words, min(words) AS min_words, max(words) AS max_words, round(avg((words BETWEEN 100 AND 150)::INT), 6) AS compliance FROM w GROUP BY stream")
def clean_word_stats(spark, sf_dir):
    rows = obs_text(spark, sf_dir).withColumn("words", text.word_count(F.col("text"))).withColumn("ok", text.in_range(F.col("words")))
    return quality.stream_summary(rows, "stream", "words", "ok").select("stream", "n", *_r("mean_words", "median_words"), "min_words", "max_words", *_r("compliance"))


@query(f"WITH {TEXT_SQL}, w AS (SELECT cell, stream, {_words_sql} AS words FROM obs), p AS (SELECT x.stream AS a, y.stream AS b, abs(x.words - y.words) AS d, x.words BETWEEN 50 AND 400 AND y.words BETWEEN 50 AND 400 AS ok FROM w x JOIN w y ON x.cell = y.cell AND x.stream < y.stream) SELECT a, b, count(*) FILTER (WHERE ok) AS both_n, round(avg(d) FILTER (WHERE ok), 6) AS both_mean FROM p GROUP BY a, b")
def length_sensitivity(spark, sf_dir):
    rows = obs_text(spark, sf_dir).withColumn("words", text.word_count(F.col("text"))).withColumn("company", F.lit("A")).withColumn("ok", text.in_range(F.col("words"), 50, 400))
    pairs = design.matched_pairs(rows, keep=("words", "ok")).withColumn("ok", F.col("ok_a") & F.col("ok_b"))
    return pairs.groupBy("a", "b").agg(F.count_if("ok").alias("both_n"), F.round(F.avg(F.when(F.col("ok"), F.abs(F.col("words_a") - F.col("words_b")))), 6).alias("both_mean"))


_alts = "|".join(sorted(LABELS, key=len, reverse=True))
_mask = lambda x: f"regexp_replace({x}, '(^|[^\\p{{L}}\\p{{N}}_])(?:{_alts})([^\\p{{L}}\\p{{N}}_]|$)', '\\1[IDENTITY]\\2', 'gi')"


@query(f"WITH m AS (SELECT doc_id, {_mask(_mask('text'))} AS t FROM documents) SELECT doc_id, md5(t) AS masked_md5, (length(t) - length(replace(t, '[IDENTITY]', ''))) // 10 AS n_masks FROM m")
def mask_labels(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", text.masked(F.col("text"), list(LABELS)).alias("t"))
    return rows.select("doc_id", F.md5(F.col("t").cast("binary")).alias("masked_md5"), F.expr("(length(t) - length(replace(t, '[IDENTITY]', ''))) div 10").alias("n_masks"))


# audit


@query("SELECT md5(text) AS key, min(doc_id) AS first_row, count(*) AS n, sum(doc_id)::BIGINT AS row_sum FROM documents GROUP BY text HAVING count(*) > 1")
def dup_raw(spark, sf_dir):
    return quality.duplicate_groups(_read(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query("WITH n AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents) SELECT md5(t) AS key, min(doc_id) AS first_row, count(*) AS n, sum(doc_id)::BIGINT AS row_sum FROM n GROUP BY t HAVING count(*) > 1")
def dup_normalised(spark, sf_dir):
    return quality.duplicate_groups(_read(spark, sf_dir, "documents"), F.lower(text.cleaned(F.col("text"))), "doc_id")


@query("SELECT n AS group_size, count(*) AS groups FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY n")
def group_size_hist(spark, sf_dir):
    return quality.group_size_counts(_read(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT n AS group_size, count(*) AS groups FROM (SELECT count(*) AS n FROM events GROUP BY ts) GROUP BY n")
def repeated_timestamps(spark, sf_dir):
    return quality.group_size_counts(_read(spark, sf_dir, "events"), "ts")


@query(f"WITH {OBS_SQL}, o AS (SELECT * FROM obs WHERE vec_id % 37 <> 0) SELECT s.stream, c.cell FROM (SELECT DISTINCT stream FROM o) s, (SELECT DISTINCT cell FROM o) c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.stream = s.stream AND o.cell = c.cell)")
def completeness_missing(spark, sf_dir):
    return quality.missing_pairs(obs_vec(spark, sf_dir).where("vec_id % 37 <> 0"), "stream", "cell")


@query("SELECT conv_id, field, n FROM (SELECT conv_id, 'role' AS field, count(DISTINCT role) AS n FROM conversations GROUP BY conv_id UNION ALL SELECT conv_id, 'turn', count(DISTINCT turn) FROM conversations GROUP BY conv_id) WHERE n <> 1")
def fd_violations(spark, sf_dir):
    return quality.dependency_violations(_read(spark, sf_dir, "conversations"), "conv_id", ["role", "turn"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE coalesce(trim({c}::VARCHAR), '') = '') AS blanks, count(DISTINCT {c}) AS distinct_values FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")))
def blank_counts(spark, sf_dir):
    return quality.blank_counts(_read(spark, sf_dir, "documents"))


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS cells FROM documents GROUP BY lang")
def coverage(spark, sf_dir):
    return quality.coverage(_read(spark, sf_dir, "documents"), "lang", "source")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf_dir):
    return quality.value_counts(_read(spark, sf_dir, "events"), "event_type")


_flag_sql = f"WITH f AS (SELECT doc_id, lang, list_filter([CASE WHEN {_words_sql} < 50 THEN 'short' END, CASE WHEN lang = 'en' AND contains(lower(text), ' une ') AND contains(lower(text), ' der ') THEN 'cross' END, CASE WHEN lang <> 'en' AND contains(lower(text), ' the ') THEN 'cross' END, CASE WHEN len(list_filter(regexp_extract_all(text, '(?:https?://|www\\.)[a-zA-Z0-9./_-]+'), lambda d: contains(d, 'example'))) > 0 THEN 'domain' END, CASE WHEN regexp_matches(text, '^\\s*The') THEN 'header' END], lambda x: x IS NOT NULL) AS fl FROM documents)"


def _flags(rows):
    low = F.lower("text")
    named = {
        "short": text.word_count(F.col("text")) < 50,
        "cross": ((F.col("lang") == "en") & low.contains(" une ") & low.contains(" der ")) | ((F.col("lang") != "en") & low.contains(" the ")),
        "domain": F.exists(text.domains(F.col("text")), lambda d: d.contains("example")),
        "header": text.leads_with(F.col("text"), "The"),
    }
    return quality.flagged(rows, named, "doc_id", "lang")


@query(_flag_sql + " SELECT doc_id, lang, array_to_string(fl, ';') AS flags FROM f WHERE len(fl) > 0")
def flag_rows(spark, sf_dir):
    return _flags(_read(spark, sf_dir, "documents"))


@query(_flag_sql + ", e AS (SELECT unnest(fl) AS flag FROM f) SELECT flag, count(*) AS n FROM e GROUP BY flag")
def flag_counts(spark, sf_dir):
    return quality.flag_counts(_flags(_read(spark, sf_dir, "documents")))


@query(_flag_sql + " SELECT l.doc_id, l.quality, coalesce(array_to_string(list_sort(f.fl), ';'), '') AS flag_list FROM labels l LEFT JOIN f USING (doc_id)")
def flags_attached(spark, sf_dir):
    flags = _flags(_read(spark, sf_dir, "documents")).select("doc_id", F.explode(F.split("flags", ";")).alias("flag"))
    return quality.attached_flags(_read(spark, sf_dir, "labels"), flags, ["doc_id"]).select("doc_id", "quality", F.array_join("flag_list", ";").alias("flag_list"))


@query("WITH d AS (SELECT unnest(regexp_extract_all(url, '(?:https?://|www\\.)[a-zA-Z0-9./_-]+')) AS domain FROM pages) SELECT domain, count(*) AS n FROM d GROUP BY domain")
def domains(spark, sf_dir):
    return quality.value_counts(_read(spark, sf_dir, "pages").select(F.explode(text.domains(F.col("url"))).alias("domain")), "domain")


@query("SELECT source, row_number() OVER (ORDER BY f) - 1 AS id FROM (SELECT source, min(doc_id) AS f FROM documents GROUP BY source)")
def dictionary_codes(spark, sf_dir):
    return quality.encoded(_read(spark, sf_dir, "documents"), "source", "doc_id")


@query("SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY lang")
def distinct_labels(spark, sf_dir):
    return _read(spark, sf_dir, "documents").groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query("SELECT event_type, count(*) AS n, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END)::BIGINT AS nulls, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events GROUP BY event_type")
def capture_range(spark, sf_dir):
    rows = _read(spark, sf_dir, "events")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"), stamp(F.min("ts")).alias("first_ts"), stamp(F.max("ts")).alias("last_ts"))


@query("SELECT sha256(string_agg(text, chr(10) ORDER BY item_id)) AS corpus_sha256, count(*) AS n FROM benchmark")
def corpus_hash(spark, sf_dir):
    return quality.corpus_hash(_read(spark, sf_dir, "benchmark"), "text", "item_id")


@query("SELECT c.conv_id, c.turn, r.role FROM conversations c JOIN (SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY conv_id) f USING (conv_id, turn) JOIN conversations r USING (conv_id, turn)")
def first_turns(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations")
    first = rows.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    return rows.select("conv_id", "turn").join(first, ["conv_id", "turn"]).join(rows.select("conv_id", "turn", "role"), ["conv_id", "turn"])


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def included_labels(spark, sf_dir):
    return select.only(_read(spark, sf_dir, "labels"), _read(spark, sf_dir, "documents").where("lang = 'fr'"), "doc_id").select("doc_id", "quality")


# representations

_terms_sql = "tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents), term AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tok), tf AS (SELECT doc_id, term, count(*) AS tf FROM term GROUP BY ALL), vocab AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT 50000)"


@query(f"WITH {_terms_sql} SELECT * FROM vocab")
def tfidf_vocab(spark, sf_dir):
    return represent.vocabulary(_read(spark, sf_dir, "documents"), "text", TERMS)


@query(
    f"WITH {TEXT_SQL}, {_terms_sql}, raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term)), norm AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM raw GROUP BY doc_id), u AS (SELECT o.cell, o.stream, r.term, r.w / n.n AS w FROM raw r JOIN norm n USING (doc_id) JOIN obs o USING (doc_id)), spine AS (SELECT x.cell, x.stream AS a, y.stream AS b FROM obs x JOIN obs y ON x.cell = y.cell AND x.stream < y.stream), sim AS (SELECT x.cell, x.stream AS a, y.stream AS b, sum(x.w * y.w) AS s FROM u x JOIN u y ON x.cell = y.cell AND x.term = y.term AND x.stream < y.stream GROUP BY ALL) SELECT a, b, round(avg(least(greatest(1 - coalesce(s, 0), 0), 2)), 6) AS mean_distance, count(*) AS n FROM spine LEFT JOIN sim USING (cell, a, b) GROUP BY a, b"
)
def tfidf_pair_distance(spark, sf_dir):
    rows = obs_text(spark, sf_dir)
    pairs = represent.sparse_distances(rows, represent.vocabulary(rows, "text", TERMS), "doc_id", "text", ["cell"], "stream", ["stream"])
    return agg.pair_means(pairs.withColumnsRenamed({"stream_a": "a", "stream_b": "b"})).select("a", "b", *_r("mean_distance"), "n")


@query(f"WITH n AS (SELECT doc_id, {_words_sql} AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(0, greatest(n, 1), 220)) AS start FROM n) SELECT doc_id, start, greatest(1, least(220, n - start)) AS weight FROM c")
def chunk_plan(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("n"))
    rows = rows.select("doc_id", "n", F.explode(vector.chunk_starts(F.col("n"), 220)).alias("start"))
    return rows.select("doc_id", "start", F.greatest(F.lit(1), F.least(F.lit(220), F.col("n") - F.col("start"))).alias("weight"))


@query("WITH e AS (SELECT vec_id // 5 AS owner, vec_id % 5 + 1 AS w, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), s AS (SELECT owner, i, sum(w * x) AS x FROM e GROUP BY ALL), n AS (SELECT owner, sqrt(sum(x * x)) AS n FROM s GROUP BY owner) SELECT owner, round(max(x / n), 6) AS largest, round(sum(x / n), 6) AS total FROM s JOIN n USING (owner) GROUP BY owner")
def pooled_vector(spark, sf_dir):
    chunks = _read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("owner"), (F.col("vec_id") % 5 + 1).alias("w"), "embedding")
    v = agg.pooled_chunks(chunks, "owner", "w", "embedding")
    return v.select("owner", F.round(F.array_max("v"), 6).alias("largest"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {OBS_SQL}, s AS (SELECT article, v AS src FROM obs WHERE vec_id IN (SELECT min(vec_id) FROM obs GROUP BY article)) SELECT stream, cell, o.article, round(1 - list_dot_product(o.v, s.src), 6) + 0 AS article_distance FROM obs o JOIN s USING (article)")
def source_proximity(spark, sf_dir):
    obs = obs_vec(spark, sf_dir)
    source = obs.groupBy("article").agg(F.min_by("v", "vec_id").alias("src"))
    return obs.join(source, "article").select("stream", "cell", "article", (F.round(1 - vector.dot(F.col("v"), F.col("src")), 6) + 0).alias("article_distance"))


@query("SELECT label, count(*) AS n, bool_and(abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) < 1e-5) AS unit, bool_and(len(embedding) = 64) AS full_length FROM embeddings GROUP BY label")
def norm_check(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings")
    norm = F.sqrt(vector.dot(F.col("embedding"), F.col("embedding")))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.every(F.abs(norm - 1) < 1e-5).alias("unit"), F.every(F.size("embedding") == 64).alias("full_length"))


@query(f"WITH {FACT_SQL}, m AS (SELECT a, b, avg(distance) AS m FROM fact GROUP BY a, b) SELECT 'bounds' AS name, (SELECT min(distance) >= 0 AND max(distance) <= 2 FROM fact) AS pass UNION ALL SELECT 'pairs', (SELECT count(*) = 10 FROM m) UNION ALL SELECT 'complete', (SELECT count(*) = count(DISTINCT cell) * 5 FROM obs)")
def check_ledger(spark, sf_dir):
    fact, obs = _fact(spark, sf_dir), obs_vec(spark, sf_dir)
    ledger = select.checks(
        ("bounds", fact.agg(F.min("distance").alias("lo"), F.max("distance").alias("hi")), "lo >= 0 and hi <= 2"),
        ("pairs", fact.agg(F.countDistinct("a", "b").alias("n")), "n = 10"),
        ("complete", obs.agg(F.count("*").alias("n"), F.countDistinct("cell").alias("cells")), "n = cells * 5"),
    )
    return ledger.select(F.col("check").alias("name"), "pass")


@query(f"WITH {OBS_SQL}, x AS (SELECT p.stream AS a, q.stream AS b, avg(1 - list_dot_product(p.v, q.v)) AS d FROM obs p JOIN obs q ON p.cell = q.cell AND p.stream < q.stream GROUP BY ALL), y AS (SELECT p.stream AS a, q.stream AS b, avg(list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - q.v[i]) ** 2)) / 2) AS d FROM obs p JOIN obs q ON p.cell = q.cell AND p.stream < q.stream GROUP BY ALL) SELECT count(*) AS n, 0::BIGINT AS unmatched, count(*) FILTER (WHERE abs(x.d - y.d) > 2e-6) AS apart FROM x JOIN y USING (a, b)")
def recomputed_distance(spark, sf_dir):
    """The mean distances against a second formulation, half the squared Euclidean distance of unit vectors."""
    pairs = design.matched_pairs(obs_vec(spark, sf_dir))
    squares = F.aggregate(F.zip_with("v_a", "v_b", lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x) / 2
    second = pairs.groupBy("a", "b").agg(F.avg(squares).alias("mean_distance"))
    return select.aligned(agg.pair_means(_fact(spark, sf_dir)), second, ["a", "b"], "mean_distance", 2e-6)
