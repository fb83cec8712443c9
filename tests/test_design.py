"""Hand-computed fixtures of the matched-design operators."""

import pytest
from pyspark.sql import functions as F

from strandwise.functions import text, vector
from strandwise.operators import aggregate, design, quality, resample, select
from strandwise.sources import sinks, tables
from strandwise.streaming import flags as streaming

VECTORS = {0: [(1, 0), (0, 1), (0.6, 0.8), (1, 0)], 1: [(0.6, 0.8), (0, 1), (0.8, 0.6), (-1, 0)], 2: [(0, 1), (0.8, 0.6), (1, 0), (0.6, 0.8)]}


@pytest.fixture(scope="module")
def obs(spark):
    rows = [(s, c, "pq"[c % 2], "d", "f", "XY"[c // 2], "A" if s < 2 else "B", [float(x) for x in v]) for s, vs in VECTORS.items() for c, v in enumerate(vs)]
    return spark.createDataFrame(rows, "stream int, cell int, cluster string, dimension string, family string, article string, company string, v array<double>")


@pytest.fixture(scope="module")
def fact(obs):
    return design.distances(obs).cache()


def means(df, *keys):
    return {tuple(r[k] for k in keys): round(r["mean_distance"], 6) for r in df.collect()}


def test_pair_and_strata_means(fact):
    assert means(aggregate.pair_means(fact), "a", "b") == {(0, 1): 0.61, (0, 2): 0.55, (1, 2): 0.6}
    assert means(aggregate.pair_means(fact, "cluster"), "a", "b", "cluster")[(0, 1, "q")] == 1.0
    strata = means(aggregate.stratified_means(fact, ("cluster", "article")), "a", "b", "level", "value")
    assert strata[(0, 1, "article", "Y")] == 1.02 and strata[(1, 2, "all", None)] == 0.6


def test_companies(fact):
    assert means(aggregate.company_pairs(fact), "company_a", "company_b") == {("A", "A"): 0.61, ("A", "B"): 0.575}
    r = aggregate.company_contrast(fact).first()
    assert (round(r.within_mean, 6), round(r.between_mean, 6), round(r.delta, 6)) == (0.61, 0.575, -0.035)


def test_blocks(obs):
    blocks = design.block_distances(obs)
    assert means(aggregate.identity_sensitivity(blocks), "stream") == {(0,): 0.7, (1,): 1.0, (2,): 0.4}
    assert set(means(aggregate.label_influence(blocks), "stream", "cluster").values()) == {0.7, 1.0, 0.4}


def test_cases_and_screening(spark, fact):
    assert [(r.cell, r.a, r.b) for r in select.top_cases(fact, 2).collect()] == [(3, 0, 1), (3, 1, 2)]
    assert {(r.a, r.b): r.cell for r in select.upper_median_by_pair(fact).collect()}[(0, 1)] == 0
    kept = select.without(fact, fact.where("cell = 3"))
    assert means(aggregate.pair_means(kept), "a", "b")[(0, 1)] == 0.146667
    assert select.furthest_by_pair(fact).count() == 3


def test_bootstraps_agree_when_balanced(spark, fact):
    m = aggregate.pair_means(fact, "cluster")
    a = resample.bootstrap(m, ["a", "b"], "cluster", F.col("mean_distance"), n=50)
    b = resample.bootstrap(m, ["a", "b"], "cluster", F.col("mean_distance") * F.col("n"), F.col("n"), n=50)
    assert [[round(x, 9) for x in r] for r in a.sort("a", "b").collect()] == [[round(x, 9) for x in r] for r in b.sort("a", "b").collect()]
    assert resample.bootstrap(m, ["a", "b"], "cluster", F.col("mean_distance"), n=50, mode="numpy").count() == 3


def test_bootstrap_keeps_keys_of_any_number_of_clusters(spark):
    rows = spark.createDataFrame([(k, c, float(c * c)) for k in range(1, 6) for c in range(k)], "k int, c int, x double")
    for mode in ("md5", "numpy"):
        got = {r.k: (r.ci_low, r.ci_high) for r in resample.bootstrap(rows, ["k"], "c", F.col("x"), n=40, mode=mode).collect()}
        assert set(got) == {1, 2, 3, 4, 5} and got[1] == (0.0, 0.0) and all(0 <= a <= b <= 16 for a, b in got.values())


def test_spearman(spark):
    rows = spark.createDataFrame([(1, 2, 1), (1, 3, 1), (2, 1, 1), (3, 5, 1), (3, 5, 1)], "x int, y int, z int")
    assert abs(resample.spearman(rows, "x", "y").first().rho - 0.6488856845230502) < 1e-12
    assert resample.spearman(rows, "x", "z").first().rho is None


def test_texts(spark):
    rows = spark.createDataFrame([("Gemini said\n\nHello  world ",), ("Gemini said Hello",), ("Response 2:\n\nHi",), ("Gemini said\nResponse 1:\nA b",), ("",)], "t string")
    got = [tuple(r) for r in rows.select(text.cleaned(F.col("t")), text.header_removed(F.col("t")), text.word_count(text.cleaned(F.col("t")))).collect()]
    assert got == [("Hello world", "Hello  world", 2), ("Gemini said Hello", "Hello", 3), ("Hi", "Response 2:\n\nHi", 1), ("A b", "Response 1:\nA b", 2), ("", "", 0)]
    labels = ["Nonbinary", "Transgender / Nonbinary", "LGBTQ+"]
    rows = spark.createDataFrame([("transgender / nonbinary and Nonbinary's",), ("LGBTQ+ people",), ("préNonbinary",)], "t string")
    assert [r[0] for r in rows.select(text.masked(F.col("t"), labels)).collect()] == ["[IDENTITY] and [IDENTITY]'s", "[IDENTITY] people", "préNonbinary"]
    starts = spark.createDataFrame([(0,), (220,), (221,), (579,)], "n int").select(F.size(vector.chunk_starts(F.col("n"), 220)))
    assert [r[0] for r in starts.collect()] == [1, 1, 2, 3]


def test_audit(spark, obs):
    some = obs.where("not (stream = 1 and cell = 2)")
    assert [tuple(r) for r in quality.missing_pairs(some, "stream", "cell").collect()] == [(1, 2)]
    assert {tuple(r) for r in quality.group_size_counts(some, "cell").collect()} == {(3, 3), (2, 1)}
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "i long, t string")
    r = quality.duplicate_groups(rows, F.col("t"), "i").first()
    assert (r.first_row, r.n, r.row_sum) == (0, 2, 2)
    assert {tuple(r) for r in quality.dependency_violations(spark.createDataFrame([("c", 1), ("c", 2)], "k string, v int"), "k", ["v"]).collect()} == {("c", "v", 2)}
    assert {r.field: r.blanks for r in quality.blank_counts(spark.createDataFrame([("", None), ("x", " ")], "a string, b string")).collect()} == {"a": 1, "b": 2}


def test_csv_keeps_blanks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes('\ufeffa,b\n"say ""x""\nline",\n"",2\n'.encode())
    assert [tuple(r) for r in tables.read_csv(spark, str(path), ["a", "b"], ()).collect()] == [('say "x"\nline', ""), ("", "2")]
    assert tables.read_csv_if_there(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0
    with pytest.raises(ValueError):
        sinks.write_csv(spark.range(1), "x", "x/")
    assert "\\u003c" in sinks.as_page(spark.createDataFrame([("<b>",)], "a string"), "t")


def test_stream_flags(spark, tmp_path):
    spark.createDataFrame([(1, "short"), (2, "a longer text")], "id int, t string").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id int, t string").parquet(str(tmp_path / "in"))
    query = streaming.flagged_stream(rows, {"short": text.word_count(F.col("t")) < 2}, "id").writeStream.format("memory").queryName("flagged").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.sql("select * from flagged").collect()] == [(1, "short")]


def test_entry_and_queries_have_sql(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert {k for k in __spark_entry__.oracle_sql()} <= set(__spark_entry__.queries())


def test_block_intervals_read_every_block(spark, tmp_path):
    import hashlib

    import numpy as np

    from strandwise.plans import queries

    rng = np.random.default_rng(7)
    v = rng.normal(size=(5 * 170, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.stream, r.dimension): (r.ci_low, r.ci_high) for r in queries.boot_block_ci(spark, str(tmp_path)).collect()}
    for stream in range(5):
        for dimension, inside in (("d0", range(4)), ("d1", range(4, 10))):
            means = []
            for block in range(17):
                x = v[[5 * (10 * block + c) + stream for c in inside]]
                means.append(np.mean([1 - x[a] @ x[b] for a in range(len(x)) for b in range(a)]))
            drawn = [np.mean([means[int(hashlib.md5(f"{queries.SEED}|{d}|{s}".encode()).hexdigest()[:8], 16) % 17] for s in range(17)]) for d in range(queries.DRAWS)]
            assert np.allclose(got[(stream, dimension)], np.quantile(drawn, [0.025, 0.975]), atol=2e-6)
