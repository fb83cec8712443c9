"""More of the reference's operators as queries with SQL: audit lookups, cases, sets, locks and the validation family."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregate as agg
from ..operators import design, quality, represent, resample, select, validate
from .bindings import BLOCKS_SQL, FACT_SQL, OBS_SQL, TEXT_SQL, obs_text, obs_vec
from .queries import EXCLUDED, _ci, _ci_sql, _fact, _headed, _headed_sql, _r, _read, _terms_sql, _words_sql, query

# texts

_stream_name = "CASE doc_id % 4 WHEN 0 THEN 'GPT x' WHEN 1 THEN 'Claude y' WHEN 2 THEN 'Gemini z' ELSE 'other' END"
_marked_sql = "'q' || doc_id || chr(10) || chr(10) || 'ARTICLE' || chr(10) || text"


@query(f"SELECT doc_id, CASE WHEN starts_with(s, 'GPT') THEN 'A' WHEN starts_with(s, 'Claude') THEN 'B' ELSE 'C' END AS company FROM (SELECT doc_id, {_stream_name} AS s FROM documents)")
def company_of_stream(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.expr(_stream_name).alias("s"))
    return rows.select("doc_id", text.company(F.col("s"), {"GPT": "A", "Claude": "B"}, "C").alias("company"))


@query(f"WITH m AS (SELECT doc_id, text, {_marked_sql} AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(text) AS body_md5, substr(text, 1, 450) AS excerpt, sha256(t) AS row_sha256 FROM m")
def article_body(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.lit("q"), F.col("doc_id").cast("string"), F.lit("\n\nARTICLE\n"), "text").alias("t"))
    rows = rows.select("doc_id", "t", text.body_after(F.col("t")).alias("body"))
    return rows.select("doc_id", F.md5(F.col("body").cast("binary")).alias("body_md5"), text.excerpt(F.col("body")).alias("excerpt"), text.row_hash(F.col("t")).alias("row_sha256"))


@query(f"WITH w AS (SELECT doc_id, lang, {_words_sql} AS n FROM documents) SELECT doc_id, concat_ws(' | ', CASE WHEN n < 50 THEN 'few words' END, CASE WHEN lang = 'fr' THEN 'french' END) AS evidence FROM w")
def evidence_joined(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.joined_evidence({"few words": text.word_count(F.col("text")) < 50, "french": F.col("lang") == "fr"}).alias("evidence"))


_odd_number = "CASE WHEN vec_id % 3 = 0 THEN 'x' || vec_id WHEN vec_id % 3 = 1 THEN '' ELSE (vec_id / 4.0)::DOUBLE::VARCHAR END"


@query(f"SELECT vec_id, try_cast({_odd_number} AS DOUBLE) AS number FROM embeddings")
def tolerant_numbers(spark, sf_dir):
    k = F.col("vec_id") % 3
    odd = F.when(k == 0, F.concat(F.lit("x"), F.col("vec_id").cast("string"))).when(k == 1, "").otherwise((F.col("vec_id") / 4).cast("string"))
    return _read(spark, sf_dir, "embeddings").select("vec_id", text.number(odd).alias("number"))


@query(f"WITH t AS (SELECT doc_id, {_headed_sql} AS t FROM documents) SELECT doc_id, md5(regexp_replace(regexp_replace(t, '^\\s*Gemini said\\s*', ''), '^\\s+|\\s+$', '', 'g')) AS audit_md5 FROM t")
def audit_cleaned(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", text.header_removed(_headed()).alias("t"))
    return rows.select("doc_id", F.md5(F.col("t").cast("binary")).alias("audit_md5"))


# audit lookups

_asked_sql = "SELECT doc_id, source AS y, 'Well, I am ' || CASE WHEN doc_id % 11 = 3 THEN 'x' ELSE source END || '.' AS q, text FROM documents"


@query(f"WITH a AS ({_asked_sql}), p AS (SELECT *, CASE WHEN doc_id % 13 = 4 THEN text ELSE q || chr(10) || text END AS prompt FROM a) SELECT doc_id FROM p WHERE NOT coalesce(contains(q, 'I am ' || y || '.'), false) OR NOT coalesce(contains(prompt, q), false)")
def identity_mismatches(spark, sf_dir):
    d = F.col("doc_id")
    rows = _read(spark, sf_dir, "documents").withColumn("q", F.concat(F.lit("Well, I am "), F.when(d % 11 == 3, "x").otherwise(F.col("source")), F.lit(".")))
    rows = rows.withColumn("prompt", F.when(d % 13 == 4, F.col("text")).otherwise(F.concat("q", F.lit("\n"), "text")))
    return rows.where(text.identity_mismatch(F.col("source"), F.col("q"), F.col("prompt"))).select("doc_id")


@query(f"WITH w AS (SELECT doc_id, {_words_sql} AS n, {_words_sql} + (doc_id % 9 = 2)::INT AS stored FROM documents) SELECT doc_id, stored, n AS recounted FROM w WHERE stored <> n")
def stored_count_mismatches(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("recounted"))
    return rows.withColumn("stored", F.col("recounted") + (F.col("doc_id") % 9 == 2).cast("int")).where("stored <> recounted").select("doc_id", "stored", "recounted")


@query(f"WITH w AS (SELECT doc_id % 4 AS stream, {_words_sql} AS n FROM documents) SELECT stream, count(*) FILTER (WHERE n < 100 OR n > 150) AS outside, count(*) AS n FROM w GROUP BY stream")
def range_violations(spark, sf_dir):
    rows = obs_text(spark, sf_dir).select("stream", text.word_count(F.col("text")).alias("words"))
    return rows.groupBy("stream").agg(F.count_if(~text.in_range(F.col("words"))).alias("outside"), F.count("*").alias("n"))


_anchors_sql = "anchors AS (SELECT stream, cell, substr(text, 3, 12) AS evidence, 'reviewed ' || doc_id AS reason FROM obs WHERE doc_id % 97 = 5)"


@query(f"WITH {TEXT_SQL}, {_anchors_sql} SELECT o.stream, o.cell, a.reason, a.reason IS NOT NULL AS suspected FROM obs o LEFT JOIN anchors a USING (stream, cell)")
def anchored_rows(spark, sf_dir):
    rows = obs_text(spark, sf_dir)
    anchors = rows.where("doc_id % 97 = 5").select("stream", "cell", F.substring("text", 3, 12).alias("evidence"), F.concat(F.lit("reviewed "), F.col("doc_id").cast("string")).alias("reason"))
    return quality.anchored(rows, anchors, ["stream", "cell"], "text").select("stream", "cell", "reason", F.col("reason").isNotNull().alias("suspected"))


@query(
    f"WITH {TEXT_SQL}, f AS (SELECT stream, cell, 'short' AS flag FROM obs WHERE {_words_sql} < 50), g AS (SELECT doc_id, 'french' AS flag FROM obs WHERE lang = 'fr' UNION ALL SELECT doc_id, 'even' FROM obs WHERE doc_id % 2 = 0), c AS (SELECT stream, cell, list_sort(list(DISTINCT flag)) AS l FROM f GROUP BY ALL), r AS (SELECT doc_id, list_sort(list(DISTINCT flag)) AS l FROM g GROUP BY ALL) SELECT o.doc_id, array_to_string(list_concat(coalesce(r.l, []), coalesce(c.l, [])), ';') AS flag_list FROM obs o LEFT JOIN r USING (doc_id) LEFT JOIN c USING (stream, cell)"
)
def flags_of_either_key(spark, sf_dir):
    rows = obs_text(spark, sf_dir)
    by_cell = rows.where(text.word_count(F.col("text")) < 50).select("stream", "cell", F.lit("short").alias("flag"))
    by_run = rows.where("lang = 'fr'").select("doc_id", F.lit("french").alias("flag")).unionAll(rows.where("doc_id % 2 = 0").select("doc_id", F.lit("even").alias("flag")))
    return quality.attached_to_either(rows, by_cell, ["stream", "cell"], by_run, "doc_id").select("doc_id", F.array_join("flag_list", ";").alias("flag_list"))


_hist = lambda c: f"(SELECT array_to_string(list_sort(list(coalesce({c}, '') || '=' || n)), ';') FROM (SELECT {c}, count(*) AS n FROM w v WHERE v.stream = w.stream GROUP BY {c})) AS {c}_labels"


@query(
    f"WITH {TEXT_SQL}, w AS (SELECT *, lpad(doc_id::VARCHAR, 9, '0') AS stamp, {_words_sql} AS raw, {_words_sql} + doc_id % 3 AS clean FROM obs), h AS (SELECT stream, array_to_string(list_sort(list(k)), ';') AS lang_labels FROM (SELECT stream, coalesce(lang, '') || '=' || count(*) AS k FROM w GROUP BY stream, lang) GROUP BY stream), g AS (SELECT stream, array_to_string(list_sort(list(k)), ';') AS source_labels FROM (SELECT stream, coalesce(source, '') || '=' || count(*) AS k FROM w GROUP BY stream, source) GROUP BY stream) SELECT stream, count(*) AS rows, count(DISTINCT cell) AS unique_cells, min(stamp) AS time_min, max(stamp) AS time_max, round(avg(raw), 6) AS raw_mean, round(avg(clean), 6) AS clean_mean, min(clean) AS clean_min, max(clean) AS clean_max, count(*) FILTER (WHERE raw NOT BETWEEN 100 AND 150) AS raw_outside, count(*) FILTER (WHERE clean NOT BETWEEN 100 AND 150) AS clean_outside, count(*) FILTER (WHERE regexp_matches(text, '^\\s*The')) AS headers, any_value(lang_labels) AS lang_labels, any_value(source_labels) AS source_labels FROM w JOIN h USING (stream) JOIN g USING (stream) GROUP BY stream"
)
def audit_by_stream(spark, sf_dir):
    rows = obs_text(spark, sf_dir).withColumn("raw", text.word_count(F.col("text"))).withColumn("clean", F.col("raw") + F.col("doc_id") % 3).withColumn("stamp", F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    found = quality.audit_summary(rows, "stream", "cell", ["lang", "source"], "stamp", "raw", "clean", text.leads_with(F.col("text"), "The"))
    return found.withColumns({c: F.round(c, 6) for c in ("raw_mean", "clean_mean")})


@query("WITH g AS (SELECT text, min(doc_id) AS first_row, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1) SELECT md5(text) AS key, first_row, n, doc_id AS row FROM documents JOIN g USING (text)")
def dup_members(spark, sf_dir):
    return quality.duplicate_members(_read(spark, sf_dir, "documents"), F.col("text"), "doc_id")


_tree = "WITH d AS (SELECT sha256(text) AS h, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark), c AS (SELECT i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM d GROUP BY 1), e AS (SELECT i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM c GROUP BY 1), s AS (SELECT count(*) AS n FROM d)"


@query(_tree + " SELECT CASE WHEN n <= 16 THEN (SELECT max(h) FROM c) WHEN n <= 256 THEN (SELECT max(h) FROM e) ELSE (SELECT sha256(string_agg(h, '' ORDER BY i)) FROM e) END AS corpus_sha256, n FROM s")
def corpus_tree_hash(spark, sf_dir):
    return quality.tree_hash(_read(spark, sf_dir, "benchmark"), "text", "item_id", 16)


@query("SELECT 3::BIGINT AS n, true AS agree")
def hash_agreement(spark, sf_dir):
    rows = _read(spark, sf_dir, "benchmark")
    dealt = rows.repartition(7, "text")
    return validate.hashes_agree(*[quality.tree_hash(x, "text", "item_id") for x in (rows, dealt, rows.orderBy(F.desc("item_id")))])


@query(f"WITH {TEXT_SQL} SELECT stream, cell, doc_id FROM obs WHERE article = 0 AND family = 1 AND cluster = 3 AND dimension = 'd0'")
def condition_lookup(spark, sf_dir):
    return select.condition(obs_text(spark, sf_dir), {"article": 0, "family": 1, "cluster": 3, "dimension": "d0"}).select("stream", "cell", "doc_id")


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def first_rows(spark, sf_dir):
    return select.first_rows(_read(spark, sf_dir, "documents"), ["lang", "source"], "doc_id").select("doc_id", "lang", "source")


@query("SELECT DISTINCT stream FROM (SELECT DISTINCT vec_id % 5 AS stream FROM embeddings UNION ALL SELECT DISTINCT doc_id % 4 + 2 FROM documents)")
def name_union(spark, sf_dir):
    a = _read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("stream"))
    return a.unionAll(_read(spark, sf_dir, "documents").select((F.col("doc_id") % 4 + 2).alias("stream"))).distinct()


@query("WITH a AS (SELECT doc_id FROM labels), b AS (SELECT doc_id FROM documents), x AS (SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_b) SELECT only_a, only_b, only_a = 0 AND only_b = 0 AS equal, only_a = 0 AS subset FROM x")
def set_relation(spark, sf_dir):
    return select.same_rows(_read(spark, sf_dir, "labels").select("doc_id"), _read(spark, sf_dir, "documents").select("doc_id"))


@query("SELECT vec_id, n.name, n.company FROM embeddings e LEFT JOIN (VALUES (0, 's0', 'A'), (1, 's1', 'A'), (2, 's2', 'B'), (3, 's3', 'B')) n(stream, name, company) ON e.vec_id % 5 = n.stream")
def stream_dimension(spark, sf_dir):
    names = spark.createDataFrame([(k, f"s{k}", "AABB"[k]) for k in range(4)], "stream long, name string, company string")
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 5).alias("stream"))
    return design.with_dimension(rows, names, "stream").select("vec_id", "name", "company")


# cases and validation

_cases = f"""kept AS (SELECT * FROM fact WHERE NOT ({EXCLUDED})), same AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY distance, cell) AS r, row_number() OVER (PARTITION BY a, b ORDER BY distance DESC, cell) AS q, count(*) OVER (PARTITION BY a, b) AS n FROM kept WHERE company_a = company_b),
cases AS ((SELECT 'high' AS selection, cell, a, b, distance FROM kept ORDER BY distance DESC, cell, a, b LIMIT 1) UNION ALL (SELECT 'low', cell, a, b, distance FROM kept ORDER BY distance, cell, a, b LIMIT 1) UNION ALL SELECT 'company_median', cell, a, b, distance FROM same WHERE r = n // 2 + 1 UNION ALL SELECT 'company_high', cell, a, b, distance FROM same WHERE q = 1)"""
_label_sql = "SELECT vec_id // 5 AS cell, vec_id % 5 AS stream, label::VARCHAR || ' ' || vec_id AS t FROM embeddings"


def _screened_cases(spark, sf_dir):
    fact = _fact(spark, sf_dir)
    kept = select.without(fact, fact.where(EXCLUDED))
    texts = _read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("cell"), (F.col("vec_id") % 5).alias("stream"), F.concat_ws(" ", F.col("label").cast("string"), F.col("vec_id").cast("string")).alias("t"))
    return fact, select.with_texts(select.selections(kept), texts, "t"), texts


@query(f"WITH {FACT_SQL}, {_cases}, l AS ({_label_sql}) SELECT selection, c.cell, c.a, c.b, round(distance, 6) AS distance, x.t AS text_a, y.t AS text_b FROM cases c JOIN l x ON x.cell = c.cell AND x.stream = c.a JOIN l y ON y.cell = c.cell AND y.stream = c.b")
def case_selections(spark, sf_dir):
    return _screened_cases(spark, sf_dir)[1].select("selection", "cell", "a", "b", *_r("distance"), "text_a", "text_b")


@query(f"WITH {FACT_SQL}, {_cases} SELECT selection, cell, a, b, true AS quoted, true AS distant, NOT ({EXCLUDED}) AS kept FROM cases")
def case_checks(spark, sf_dir):
    fact, cases, texts = _screened_cases(spark, sf_dir)
    return validate.case_checks(cases, fact, texts, "t", fact.where(EXCLUDED))


@query(f"WITH {FACT_SQL}, m AS (SELECT a, b, cluster, avg(distance) AS m FROM fact GROUP BY ALL), {_ci_sql('m', 'a, b', 'cluster', 'm')}, i AS (SELECT a, b, {_ci} FROM t GROUP BY a, b) SELECT 'means' AS name, true AS pass UNION ALL SELECT 'intervals', (SELECT bool_and(ci_low <= ci_high AND ci_low BETWEEN 0 AND 2 AND ci_high BETWEEN 0 AND 2) FROM i)")
def summary_checks(spark, sf_dir):
    fact = _fact(spark, sf_dir)
    summary = agg.pair_means(fact).join(resample.bootstrap(agg.pair_means(fact, "cluster"), ["a", "b"], "cluster", F.col("mean_distance")), ["a", "b"])
    return validate.summary_checks(fact, summary).select(F.col("check").alias("name"), "pass")


@query(f"WITH {FACT_SQL}, k AS (SELECT * FROM fact WHERE NOT ({EXCLUDED})), s AS (SELECT a, b, count(*) AS n FROM k GROUP BY a, b) SELECT 'balanced' AS name, (SELECT min(n) = max(n) AND max(n) = (SELECT count(DISTINCT cell) FROM k) FROM s) AS pass UNION ALL SELECT 'screened means', true")
def screened_checks(spark, sf_dir):
    fact = _fact(spark, sf_dir)
    summary = agg.pair_means(fact.where(f"not ({EXCLUDED})"))
    return validate.screened_checks(fact, fact.where(EXCLUDED), summary).select(F.col("check").alias("name"), "pass")


@query(f"WITH {FACT_SQL}, d AS (SELECT cell, stream, count(*) AS n FROM obs GROUP BY ALL) SELECT 'unique' AS name, (SELECT max(n) = 1 FROM d) AS pass UNION ALL SELECT 'facts', true UNION ALL SELECT 'distance cells', (SELECT count(*) = 0 FROM fact WHERE cell NOT IN (SELECT cell FROM obs)) UNION ALL SELECT 'excluded cells', true UNION ALL SELECT 'screened cells', true")
def board_checks(spark, sf_dir):
    obs, fact = obs_vec(spark, sf_dir), _fact(spark, sf_dir)
    excluded = obs.where(EXCLUDED).select("cell").distinct()
    stay = obs.where(f"not ({EXCLUDED})").select("cell").distinct().count()
    return validate.board_checks(obs, ["cluster", "dimension", "family", "article"], fact, excluded, stay).select(F.col("check").alias("name"), "pass")


# representations

_unit = "raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term)), norm AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM raw GROUP BY doc_id), u AS (SELECT doc_id, r.term, r.w / n.n AS w FROM raw r JOIN norm n USING (doc_id))"


@query(
    f"WITH {TEXT_SQL}, {_terms_sql.replace('50000', '2000')}, {_unit}, spine AS (SELECT x.stream, x.dimension, x.article, x.family, x.doc_id AS i, y.doc_id AS j FROM obs x JOIN obs y ON x.stream = y.stream AND x.dimension = y.dimension AND x.article = y.article AND x.family = y.family AND x.doc_id < y.doc_id), sim AS (SELECT i, j, sum(x.w * y.w) AS s FROM spine JOIN u x ON x.doc_id = i JOIN u y ON y.doc_id = j AND x.term = y.term GROUP BY ALL) SELECT stream, dimension, round(avg(least(greatest(1 - coalesce(s, 0), 0), 2)), 6) AS mean_distance, count(*) AS n FROM spine LEFT JOIN sim USING (i, j) GROUP BY ALL"
)
def tfidf_block_distance(spark, sf_dir):
    """Pairs within blocks at sparse distance; 2,000 terms, as the SQL's join of terms has to end."""
    rows = obs_text(spark, sf_dir)
    pairs = represent.sparse_distances(rows, represent.vocabulary(rows, "text", 2000), "doc_id", "text", ["stream", "dimension", "article", "family"], "doc_id", ["cluster"])
    return pairs.groupBy("stream", "dimension").agg(F.round(F.avg("distance"), 6).alias("mean_distance"), F.count("*").alias("n"))


_bench_terms = _terms_sql.replace("FROM documents", "FROM benchmark").replace("doc_id", "item_id").replace("50000", "300")


@query(f"WITH {_bench_terms}, t AS (SELECT list(term ORDER BY term COLLATE C) AS l, count(*) AS features FROM vocab) SELECT features, sha256('[\"' || array_to_string(l, '\",\"') || '\"]') AS vocabulary_sha256, features AS terms_found, (SELECT sum(cf)::BIGINT FROM vocab) AS occurrences FROM t")
def vocabulary_lock(spark, sf_dir):
    """A vocabulary is frozen, its lock is checked, and its counts are taken anew."""
    rows = _read(spark, sf_dir, "benchmark")
    locked = represent.lock(represent.vocabulary(rows, "text", 300), quality.tree_hash(rows, "text", "item_id"))
    found = represent.locked_vocabulary(rows, "text", json.loads(json.dumps(locked)), quality.tree_hash(rows, "text", "item_id"))
    one = found.agg(F.count("*").alias("terms_found"), F.sum("cf").alias("occurrences"))
    return one.select(F.lit(locked["features"]).cast("long").alias("features"), F.lit(locked["ordered_vocabulary_sha256"]).alias("vocabulary_sha256"), "terms_found", "occurrences")


@query(f"WITH n AS (SELECT {_words_sql} AS n FROM documents) SELECT max(n) AS max_tokens, max(least(n, 220)) AS max_again, sum(greatest(1, (n + 219) // 220))::BIGINT AS chunks, count(*) FILTER (WHERE n > 220) AS multichunk, 0::BIGINT AS changed, sum(n // 220)::BIGINT AS over FROM n")
def chunk_audit(spark, sf_dir):
    """Chunks of 220 white-space tokens against a limit of 219."""
    return represent.chunk_audit(_read(spark, sf_dir, "documents"), "text", str.split, " ".join, 220, 219)
