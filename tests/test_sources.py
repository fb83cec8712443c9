"""Sources, sinks, ledgers and the rest that no query runs."""

import gzip
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.functions import text
from strandwise.operators import order, quality, represent, resample, select, validate
from strandwise.sources import sinks, tables
from strandwise.streaming import flags as streaming


def test_gzip_discovery_and_checksums(spark, tmp_path):
    raw = b"a,b\n1,x\n2,\n"
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "t.csv.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "other.csv").write_bytes(b"a,c\n1,x\n")
    want = hashlib.sha256(raw).hexdigest()
    found = tables.discover(spark, [str(tmp_path / "none.csv"), str(tmp_path / "other.csv")], ["a", "b"], want, below=str(tmp_path))
    assert found.endswith("deep/er/t.csv.gz")
    assert [tuple(r) for r in tables.read_csv_or_gzip(spark, str(tmp_path / "deep/er/t.csv"), ["a", "b"], ("a",)).collect()] == [(1, "x"), (2, "")]
    row = tables.checksums(spark, str(tmp_path / "deep/er")).first()
    assert row.content_sha256 == want != row.sha256
    with pytest.raises(FileNotFoundError, match="1 had"):
        tables.discover(spark, [str(tmp_path / "other.csv"), f"file:{tmp_path}/other.csv"], ["a", "c"], "0")


def test_arrays_json_and_row_index(spark, tmp_path):
    values = np.arange(30, dtype=np.float32).reshape(10, 3)
    np.savez(tmp_path / "e.npz", embeddings=values)
    got = sorted(map(tuple, tables.read_npz(spark, str(tmp_path / "e.npz"), rows=4).collect()))
    assert [k for k, _ in got] == list(range(10)) and np.array_equal([v for _, v in got], values)
    (tmp_path / "x.json").write_text('{"a": 1,\n "b": "é"}')
    assert tables.read_json(spark, str(tmp_path / "x.json")).first().asDict() == {"a": 1, "b": "é"}
    spark.range(0, 100, 1, 5).write.parquet(str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r"))
    indexed = [r.row_ix for r in tables.with_row_index(rows).collect()]
    assert sorted(indexed) == list(range(100))


def test_sinks_and_guards(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text("a,b\n1,2\n")
    rows = tables.read_csv(spark, str(source), ["a", "b"], ())
    sinks.write_guarded(rows, str(tmp_path / "out"), str(source))
    with pytest.raises(ValueError, match="overwrite"):
        sinks.write_csv(rows, f"file:{source}", str(source))
    sinks.write_records(rows.limit(0), str(tmp_path / "empty"), ["b", "z"])
    assert "b,z" in "".join(p.read_text() for p in (tmp_path / "empty").glob("part-*"))
    with pytest.raises(ValueError, match="finite"):
        sinks.as_json(spark.createDataFrame([(float("nan"),)], "x double"))
    report = sinks.audit_report("Audit", spark.createDataFrame([(7, 0.25)], "rows_read long, share double"), {"Flags": rows, "None": rows.limit(0)})
    assert "- rows read: 7" in report and "| 1 | 2 |" in report and "No rows." in report
    assert json.loads(sinks.digest(total=rows.agg(F.count("*").alias("n")))) == {"total": {"n": 1}}
    sinks.write_parquet(rows, str(tmp_path / "p"), "a")
    assert (tmp_path / "p" / "a=1").exists()


def test_dashboard_payload(spark):
    cells = spark.createDataFrame([("c1", "f"), ("c2", "g")], "cell string, family string")
    texts = spark.createDataFrame([("c1", "s", "<x>"), ("c2", "t", "y")], "cell string, stream string, text string")
    facts = spark.createDataFrame([("e", "c2", "s", "t", 0.123456789)], "encoder string, cell string, a string, b string, distance double")
    payload = sinks.positional_payload(["s", "t"], cells, texts, facts)
    assert payload["responses"] == [[0, 0, "<x>"], [1, 1, "y"]] and payload["distances"] == [[0, 1, 0, 1, 0.1234568]]
    page = sinks.as_dashboard("<html>__PAYLOAD__</html>", payload)
    assert "<x>" not in page and json.loads(page[6:-7]) == payload
    with pytest.raises(ValueError, match="unknown"):
        sinks.positional_payload(["s"], cells, texts, facts)


def test_ledger_is_written_before_it_raises(spark, tmp_path):
    frame = spark.createDataFrame([(1,)], "n int")
    ledger = select.checks(("fine", frame, "n = 1"), ("broken", frame, "n = 2"), ("null", frame, "null = 1"))
    with pytest.raises(ValueError, match="broken, null"):
        sinks.write_ledger(ledger, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 3
    (tmp_path / "page.html").write_text("<HTML>" + "x" * 100)
    found = {r.check.rpartition("/")[2]: r["pass"] for r in sinks.artifacts(spark, {f"{tmp_path}/page.html": (50, "<html"), f"{tmp_path}/none.pdf": (1, "%PDF")}).collect()}
    assert found == {"page.html": True, "none.pdf": False}


def test_checks_find_what_is_wrong(spark):
    fact = spark.createDataFrame([(c, 0, 1, 0.1 * c, "A", "A") for c in range(1, 5)], "cell int, a int, b int, distance double, company_a string, company_b string")
    good = spark.createDataFrame([(0, 1, 0.25, 0.1, 0.4, 4)], "a int, b int, mean_distance double, ci_low double, ci_high double, n long")
    bad = spark.createDataFrame([(0, 1, 0.26, 0.5, 0.4, 3)], "a int, b int, mean_distance double, ci_low double, ci_high double, n long")
    passes = lambda ledger: [r["pass"] for r in ledger.collect()]
    assert passes(validate.summary_checks(fact, good)) == [True, True] and passes(validate.summary_checks(fact, bad)) == [False, False]
    out = fact.where("cell = 9")
    assert passes(validate.screened_checks(fact, out, good)) == [True, True] and passes(validate.screened_checks(fact, fact.where("cell = 1"), good)) == [False, False]
    rows = spark.createDataFrame([(c, s, f"f{c}") for c in range(1, 5) for s in (0, 1)], "cell int, stream int, family string")
    assert passes(validate.board_checks(rows, ["family"], fact, out, 4)) == [True] * 5
    odd = rows.unionAll(spark.createDataFrame([(1, 0, "other")], rows.schema)).where("cell <> 4")
    assert passes(validate.board_checks(odd, ["family"], fact, fact.where("cell = 4"), 4)) == [False] * 5
    texts = rows.select("cell", "stream", F.concat("family", "stream").alias("t"))
    cases = select.with_texts(select.selections(fact), texts, "t")
    assert all(r.quoted and r.distant and r.kept for r in validate.case_checks(cases, fact, texts, "t", out).collect())
    wrong = cases.withColumn("text_a", F.lit("x")).withColumn("distance", F.col("distance") + 1)
    assert not any(r.quoted or r.distant for r in validate.case_checks(wrong, fact, texts, "t", out).collect())
    assert select.same_rows(fact, fact).first().equal and not select.same_rows(fact, out).first().subset
    with pytest.raises(ValueError, match="more than one"):
        select.condition(rows, {"stream": 0})
    with pytest.raises(ValueError, match="no cell"):
        select.condition(rows, {"stream": 7})
    anchors = spark.createDataFrame([(1, 0, "gone", "why")], "cell int, stream int, evidence string, reason string")
    with pytest.raises(Exception, match="evidence has changed"):
        quality.anchored(texts, anchors, ["cell", "stream"], "t").collect()


def test_order_in_buckets(spark):
    rng = np.random.default_rng(3)
    values = [float(x) for x in rng.integers(0, 50, 400)] + [None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double")
    got = {r.v: (r.before, r.n) for r in order.value_ranks(rows, "v").collect()}
    full = [v for v in values if v is not None]
    assert got == {v: (sum(x < v for x in full), full.count(v)) for v in set(full)}
    pairs = spark.createDataFrame([(float(a), float(b)) for a, b in rng.integers(0, 9, (300, 2))], "x double, y double")
    assert abs(resample.spearman_of_all(pairs, "x", "y").first().rho - resample.spearman(pairs, "x", "y").first().rho) < 1e-12
    words = spark.createDataFrame([(k, f"t{k}") for k in range(40)], "i long, t string")
    level = [hashlib.sha256(f"t{k}".encode()).hexdigest() for k in range(40)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[k : k + 3]).encode()).hexdigest() for k in range(0, len(level), 3)]
    assert quality.tree_hash(words, "t", "i", 3).first().corpus_sha256 == level[0]
    assert quality.tree_hash(words.limit(0), "t", "i").first().corpus_sha256 == hashlib.sha256(b"").hexdigest()


def test_encoders_caches_and_locks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "b c b")], "i long, t string")
    calls = tmp_path / "calls"
    calls.mkdir()

    def encoder(texts):
        import uuid

        (calls / uuid.uuid4().hex).touch()
        return [[float(len(t)), 1.0] for t in texts]

    for _ in range(2):
        got = represent.cached(rows, "t", encoder, str(tmp_path / "cache"), "toy", "abc")
        assert {r.i: list(r.v) for r in got.collect()} == {1: [3.0, 1.0], 2: [0.0, 1.0], 3: [5.0, 1.0]}
        made = len(list(calls.iterdir())) if _ == 0 else made
    assert len(list(calls.iterdir())) == made
    texts = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (3, ""), (4, None)], "i long, t string")
    every = represent.vocabulary(texts, "t", 9, 1)
    assert [tuple(r) for r in every.collect()] == [("aa", 1, 2), ("bb", 2, 2), ("aa bb", 1, 1), ("bb aa", 1, 1), ("bb cc", 1, 1), ("cc", 1, 1)]
    assert [r.term for r in represent.vocabulary(texts, "t", 3, 1).collect()] == ["aa", "bb", "aa bb"]
    raw = {"aa": (1 + np.log(2)) * (np.log(5 / 2) + 1), "bb": np.log(5 / 3) + 1, "aa bb": np.log(5 / 2) + 1, "bb aa": np.log(5 / 2) + 1}
    got = [r.w for r in represent.weights(texts, every, "i", "t").where("i = 1").collect()]
    assert np.allclose(sorted(got), sorted(np.array(list(raw.values())) / np.linalg.norm(list(raw.values()))))
    here, there = (spark.createDataFrame([(x,)], "corpus_sha256 string") for x in ("h", "t"))
    locked = represent.lock(every, here)
    assert {tuple(r) for r in represent.locked_vocabulary(texts, "t", locked, here).collect()} == {tuple(r) for r in every.collect()}
    with pytest.raises(ValueError, match="corpus"):
        represent.locked_vocabulary(texts, "t", locked, there)
    with pytest.raises(ValueError, match="vocabulary"):
        represent.locked_vocabulary(texts, "t", locked | {"features": 7}, here)
    audit = represent.chunk_audit(rows, "t", str.split, " ".join, 2, 1).first()
    assert tuple(audit) == (3, 2, 4, 1, 0, 2)
    lossy = represent.chunk_audit(rows, "t", str.split, lambda p: " ".join(p)[:1], 2, 5).first()
    assert lossy.changed == 2


def test_scalars(spark):
    row = spark.range(1).select(
        text.leads_with(F.lit("\u00a0\n Gemini said x"), "Gemini said").alias("a"),
        text.identity_mismatch(F.lit("x"), F.lit("I am x."), F.lit("q: I am x. ok")).alias("b"),
        text.identity_mismatch(F.lit("y"), F.lit("I am x."), F.lit("I am x.")).alias("c"),
        text.domains(F.lit("see https://a.b/c_d?x www.e.f/g, h.i")).alias("d"),
        text.joined_evidence({"one": F.lit(True), "two": F.lit(False), "three": F.lit(True)}).alias("e"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (True, False, True, ["https://a.b/c_d", "www.e.f/g"], "one | three")
    with pytest.raises(Exception, match="no article mark"):
        spark.range(1).select(text.body_after(F.concat(F.lit("x"), F.col("id").cast("string")))).collect()


def test_stream_of_first_seen_rows(spark, tmp_path):
    rows = spark.createDataFrame([("k", 1), ("k", 2), ("l", 3)], "k string, s int").select("k", F.timestamp_seconds("s").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    query = streaming.first_seen(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["k"], "ts").writeStream.format("memory").queryName("seen").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.k for r in spark.sql("select * from seen").collect()) == ["k", "l"]


def shuffled_rows(spark, name, action):
    """What ``action`` returns, and the rows that its jobs write to exchanges."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        got = action()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for job in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(job).stageIds}
    return got, sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_vocabulary_shuffles_sums_only(spark):
    words = [f"w{k}" for k in range(60)]
    texts = spark.createDataFrame([(i, " ".join(words)) for i in range(1000)], "i long, t string").repartition(4).cache()
    texts.count()
    got, rows = shuffled_rows(spark, "vocabulary", lambda: represent.vocabulary(texts, "t", 500).collect())
    assert len(got) == 119 and {(r.df, r.cf) for r in got} == {(1000, 1000)}
    assert rows <= 20 * 119  # one row a term and task in each exchange; there are 119,000 terms in all texts


def test_vocabulary_counts_in_parts_and_breaks_ties(spark, monkeypatch):
    from collections import Counter

    rng = np.random.default_rng(3)
    lists = [[f"w{k:02}" for k in rng.zipf(1.4, n) % 40] for n in rng.integers(0, 30, 200)]
    texts = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lists)], "i long, t string").repartition(3)
    grams = [x + [f"{a} {b}" for a, b in zip(x, x[1:], strict=False)] for x in lists]
    cf, df = Counter(g for x in grams for g in x), Counter(g for x in grams for g in set(x))
    for held, named in ((2_000_000, 4_000_000), (7, 4_000_000), (50, 0)):
        monkeypatch.setattr(represent, "HELD", held)
        monkeypatch.setattr(represent, "NAMED", named)
        for size, least in ((1, 1), (25, 2), (120, 1), (10_000, 2)):
            want = sorted(((g, df[g], cf[g]) for g in cf if df[g] >= least), key=lambda r: (-r[2], r[0]))[:size]
            assert [tuple(r) for r in represent.vocabulary(texts, "t", size, least).collect()] == want
    assert represent.vocabulary(texts.limit(0), "t", 5).collect() == []


def test_pair_distances_shuffle_each_text_once(spark, tmp_path):
    from strandwise.plans import queries

    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[i % 7 :]) for i in range(400)]
    texts[5], texts[6] = None, "zz"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source").write.parquet(str(tmp_path / "documents.parquet"))
    got, rows = shuffled_rows(spark, "pairs", lambda: {(r.a, r.b): (r.mean_distance, r.n) for r in queries.tfidf_pair_distance(spark, str(tmp_path)).collect()})
    assert rows <= 400 + 20 * 119 + 200  # 119 terms; all texts have 44,000
    lists = [(t or "").split() for t in texts]
    grams = [x + [f"{a} {b}" for a, b in zip(x, x[1:], strict=False)] for x in lists]
    df = {g: sum(g in x for x in map(set, grams)) for g in {g for x in grams for g in x}}
    unit = [np.array([(g in x) * (np.log(401 / (1 + df[g])) + 1) for g in sorted(df) if df[g] > 1]) for x in map(set, grams)]
    unit = [v / (np.linalg.norm(v) or 1) for v in unit]
    for a in range(4):
        for b in range(a + 1, 4):
            mean = np.mean([min(max(1 - unit[c + a] @ unit[c + b], 0), 2) for c in range(0, 400, 4)])
            assert got[(a, b)][1] == 100 and abs(got[(a, b)][0] - mean) < 2e-6


def test_repeated_rows_of_a_text_pair_as_in_a_join(spark):
    texts = [(1, 0, "aa bb"), (1, 0, "bb cc"), (2, 1, "aa bb cc"), (2, 1, ""), (3, 0, None), (4, None, "aa"), (5, 1, "aa aa dd")]
    rows = spark.createDataFrame(texts, "i long, s int, t string").withColumn("g", F.lit("x"))
    words = spark.createDataFrame([("aa", 3, 4), ("bb", 3, 3), ("bb cc", 2, 2)], "term string, df long, cf long")
    w = {}
    for r in represent.weights(rows, words, "i", "t").collect():
        w.setdefault(r.i, {})[r.term] = r.w
    got = sorted((r.i_a, r.i_b, round(r.distance, 9)) for r in represent.sparse_distances(rows, words, "i", "t", ["g"], "s", ["i"]).collect())
    want, n = [], {1: 2, 2: 2, 3: 1, 5: 1}
    for a, b in ((1, 2), (1, 5), (3, 2), (3, 5)):
        m = n[a] * n[b]
        want += m * [(a, b, round(min(max(1 - m * sum(x * w.get(b, {}).get(k, 0) for k, x in w.get(a, {}).items()), 0.0), 2.0), 9))]
    assert got == sorted(want)


def test_block_distances_shuffle_each_text_once(spark, tmp_path):
    from strandwise.plans import audit

    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[i % 7 :]) for i in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source").write.parquet(str(tmp_path / "documents.parquet"))
    got, rows = shuffled_rows(spark, "blocks", lambda: audit.tfidf_block_distance(spark, str(tmp_path)).collect())
    assert rows <= 400 + 20 * 119 + 200  # 119 terms; all texts have 44,000
    assert {(r.stream, r.dimension): r.n for r in got} == {(s, d): n for s in range(4) for d, n in (("d0", 60), ("d1", 150))}
