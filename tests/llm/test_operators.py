"""Training-data operators against brute force and on awkward rows: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandwise.llm import common, decontaminate, importance, jaccard_join, language, packing, pii, quality_rules, suffix_dedup, token_files, tokens, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, h1 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"p{k}assage" for k in range(60))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = {"en": ["the", "of", "and"] + [f"wh{k}ing" for k in range(300)], "fr": ["le", "une", "et"] + [f"éa{k}eux" for k in range(300)]}
    out = []
    for k in range(60):
        lang = ("en", "fr")[k % 2]
        out.append((k, " ".join(rng.choice(vocab[lang]) for _ in range(rng.choice([8, 40, 120]))) + ".", lang))
    long = " ".join(rng.choice(vocab["en"]) for _ in range(9000))
    near = out[2][1].split() + [rng.choice(vocab["en"]) for _ in range(80)]
    edited = near[:50] + ["edit"] + near[51:]
    out += [(100, long, "en"), (101, " ".join(near), "en"), (102, " ".join(edited), "en"), (103, " ".join(near), "en"), (104, None, None), (105, "", "en"), (106, "... 12 !!", None), (None, "no id here", "en")]
    out += [(107, "x " + PASSAGE + " y", "en"), (108, "z\n" + PASSAGE + "\nq " + PASSAGE, "en"), (101, " ".join(near), "en"), (109, "one two three", "en"), (110, "ONE two three", "en")]
    out += [(111, "mail bob@x.org or +1 (988) 555-2485 at 1.2.3.4 card 4111 1111 1111 1111 end", "en"), (112, "a@b.c 999.1.1.1 +12 1234567890123456", "en")]
    return [(i, t, g, "s", len(t or ""), "clash", "clash") for i, t, g in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(name, drops):
    t = Tokenizer.from_file(tokens.tokenizer_path(name))  # the library alone, with its own settings
    return lambda x: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")


def test_units_equal_the_library():
    odd = ["a  b", "\n\nfoo\n bar\t baz", " lead", "trail ", "it's <|endoftext|> x", "a\u00a0b", "ΟΔΟΣ ΣΑΣ. É J̌", "x9\x1cq \x85 z", "", "\0a b", "a\r\nb", "日本 語", "end. a, b"]
    for name, drops in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        e, ids = tokens.encoder(tokens.tokenizer_path(name), drops), plain(name, drops)
        for x in odd:
            assert [*e.ids([x])[0].tolist(), 1] == ids(x).tolist(), x


def test_ids_of_odd_texts_equal_the_library():
    bits = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", "İ", "i̇", "é", "\u0301", "a", "b", "The", "don't", "'S", "\0", "\u0085", "\x1c", "\u00a0", "\u200b", "\t", "\r\n", "\n", " ", " ", " ", "  ", ",", ".", "x,", "İ,", "É.", "23", "Σ", "ß", "ﬁ", "日本", "\U0001f600", "\u0345", "\ufeff"]
    rng = random.Random(4)
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(20_000)]
    for name, drops in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        got = tokens.UnitEncoder(tokens.tokenizer_path(name), drops).ids(texts)
        want = Tokenizer.from_file(tokens.tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)
        assert all(g.tolist() == w.ids for g, w in zip(got, want, strict=True))


def test_token_files(spark, docs, none, rows, tmp_path):
    ids = plain("word_bpe_49k.json", True)
    path = str(tmp_path / "t")
    token_files.write_tokens(docs, path, "word_bpe_49k.json", drops_space=True, shard_bytes=6000, segment_tokens=500)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(spark, path).collect()))
    start = 0
    for (at, doc, n, _), i in zip(got, sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0)), strict=True):
        assert (at, doc) == (start, i)
        start += n
    assert sorted((str(r[1]), r[2], r[3]) for r in got) == sorted((str(r[0]), len(ids(r[1])), zlib.crc32(ids(r[1]).tobytes())) for r in rows)
    hot = spark.createDataFrame([(None, f"a{k % 3} b" * 40) for k in range(300)] + [(5, "same " * 50)] * 300, "doc_id long, text string").repartition(4)
    token_files.write_tokens(hot, str(tmp_path / "h"), "word_bpe_49k.json", drops_space=True, shard_bytes=4000)
    assert spark.read.parquet(str(tmp_path / "h")).agg(F.max("n_docs")).first()[0] < 300
    assert token_files.read_tokens(spark, str(tmp_path / "h")).count() == 600
    token_files.write_tokens(none, str(tmp_path / "e"), "word_bpe_49k.json", drops_space=True)
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_codes_give_random_access():
    ids = np.random.default_rng(1).integers(0, 1 << 20, 3000).astype(np.uint32)
    ids[::3] %= 200
    s = token_files.Segment(token_files.segment([7, None], [ids[:1000], ids[1000:]]))
    assert [s.access(k) for k in range(0, 3000, 7)] == ids[::7].tolist()
    assert (s.slice(513, 2049) == ids[513:2049]).all() and s.doc_ids == [7, None]


def test_packing(docs, none, rows):
    ids = plain("byte_bpe_50k.json", False)
    got = packing.packed(docs, "byte_bpe_50k.json").collect()
    whole = Counter((r[0], ids(r[1]).tobytes()) for r in rows)
    total, lengths = 0, Counter()
    texts = {}
    for (i, raw) in whole:
        texts.setdefault(i, []).append(raw)
    for r in got:
        assert any(zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 and len(raw) == 4 * r.doc_tokens for raw in texts[r.doc_id])
        total += r.length
        lengths[r.sequence_id] += r.length
    assert total == sum(len(raw) // 4 * n for (_, raw), n in whole.items())
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths.values())
    assert packing.packed(none, "byte_bpe_50k.json").count() == 0


def test_fill_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        sums = {max(counts)}
        for k, c in counts.items():
            sums = {s + k * n for s in sums for n in range(c + 1 - (k == max(counts))) if s + k * n <= 40}
        chosen = packing.fill(counts, 40)
        assert sum(k * c for k, c in chosen.items()) == max(sums) and all(c <= counts[k] for k, c in chosen.items())


def test_packing_goes_on_when_the_longest_rest_fits_nothing():
    rng = random.Random(8)
    lengths = [2047, 2046] + [rng.randint(20, 700) for _ in range(600)]
    out = packing.pack(lengths, 2048)
    seen = {k: [] for k in range(len(lengths))}
    for pieces in out:
        assert sum(n for *_, n in pieces) == 2048 or len(out) - out.index(pieces) <= 11
        for doc, start, n in pieces:
            seen[doc].append((start, start + n))
    for k, n in enumerate(lengths):
        spans = sorted(seen[k])
        assert [a for a, _ in spans] == [0, *(b for _, b in spans[:-1])] and spans[-1][1] == n
    exact = [p for p in out if sum(n for *_, n in p) == 2048 and all(n == lengths[doc] for doc, _, n in p)]
    assert len(exact) > 0.9 * len(out) and sum(map(len, out)) < len(lengths) + 0.1 * len(out)


def test_url_models_equal_brute_force(spark):
    rng = random.Random(5)
    good = ["^" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(40)]
    bad = ["^" + "".join(rng.choice("bcd") for _ in range(rng.randint(0, 9))) for _ in range(30)]
    seen = spark.createDataFrame([(t[1:], True) for t in good] + [(t[1:], False) for t in bad], "t string, good boolean")

    def chance(texts, text, i):
        p = 1 / url_filter.ALPHABET
        for k in range(1, url_filter.ORDER + 1):
            cut = lambda t, j, k=k: t[max(0, j - k + 1) : j + 1]
            every = [cut(t, j) for t in texts for j in range(1, max(len(t), 2))]
            gram = cut(text, i)
            p = (every.count(gram) + url_filter.STRENGTH * p) / (sum(g[:-1] == gram[:-1] for g in every) + url_filter.STRENGTH)
        return p

    texts = sorted({rng.choice(good + bad)[1:] for _ in range(12)} | {"abab", "dddd", ""})
    got = {r.t: r.score for r in url_filter.scored(spark.createDataFrame([(t,) for t in texts], "t string"), url_filter.fitted(seen)).collect()}
    for t in texts:
        places = range(1, max(len(t) + 1, 2))
        want = np.mean([np.log(chance(good, "^" + t, i)) - np.log(chance(bad, "^" + t, i)) for i in places])
        assert abs(got[t] - want) < 1e-9, t


def test_url_calibration_and_what_models_see(spark):
    urls = [(k, f"http://{'casino' if k % 2 else 'garden'}{k}.example.{'net' if k % 2 else 'com'}/{'es' if k % 2 else 'de'}/{k}") for k in range(400)]
    urls += [(1000 + k, f"http://{x}{k}.example.org/zz/{k}") for k in range(20) for x in ("casino", "garden")]
    got = url_filter.filtered(spark.createDataFrame(urls, "page_id long, url string")).collect()
    assert all((r.verdict == "block") == r.host.startswith("casino") for r in got)
    blind = [(k, f"http://h{k // 2}.example.{'net' if k % 2 else 'com'}/{'es' if k % 2 else 'de'}/") for k in range(400)] + [(1000 + k, f"http://h{k}.example.org/zz/") for k in range(40)]
    got = url_filter.filtered(spark.createDataFrame(blind, "page_id long, url string")).collect()
    assert all(r.verdict == "allow" for r in got if r.rule is None)
    host = F.lit("a.b.example.com")
    row = spark.range(1).select(url_filter.seen(F.lit("HTTP://A.b.example.com/En/X?q#r"), host).alias("x"), url_filter.seen(F.lit("no scheme"), F.lit("")).alias("y"), url_filter.seen(F.lit("http://com/"), F.lit("com")).alias("z")).first()
    assert tuple(row) == ("a.b/x?q#r", "no scheme", "//")


def test_url_filter(spark):
    urls = [(k, f"http://h{k}.example.com/{'en' if k % 3 else 'de'}/{k}") for k in range(60)] + [(100, None), (101, "none"), (102, ""), (103, "http://WWW.Example.com/en/a?b"), (104, "x://a.net/fr/#q"), (105, "x://com"), (106, "http://t.example.org/zz"), (106, "http://t.example.org/zz")]
    got = {(r.page_id, r.host, r.path, r.rule): r.verdict for r in url_filter.filtered(spark.createDataFrame([(*u, "clash") for u in urls], "page_id long, url string, score string")).collect()}
    assert len(got) == len(set(urls)) and set(got.values()) <= {"allow", "block"}
    assert got[(103, "www.example.com", "/en/a", "www.example.com/en/")] == "allow" and got[(104, "a.net", "/fr/", "net/fr/")] == "block"
    assert (100, "", "", None) in got and (101, "", "", None) in got and (105, "com", "", None) in got
    assert url_filter.filtered(spark.createDataFrame([], "page_id long, url string")).count() == 0
    plain_ = [p for p in url_filter.filtered(spark.createDataFrame(urls[:60], "page_id long, url string")).collect()]
    assert all((r.rule == "example.com/en/") == (r.verdict == "block") for r in plain_)


def test_pii(docs, none, rows):
    got = {(r.doc_id, r.spans) for r in pii.found(docs).select("doc_id", "spans").collect()}
    t = next(r[1] for r in rows if r[0] == 111)
    spans = dict(s.split(":", 1) for s in next(s for i, s in got if i == 111).split(","))
    cut = {k: t[slice(*map(int, v.split(":")))] for k, v in spans.items()}
    assert cut == {"email": "bob@x.org", "phone": "+1 (988) 555-2485", "ip": "1.2.3.4", "card": "4111 1111 1111 1111"}
    assert next(s for i, s in got if i == 112) == "email:0:5"
    assert pii.found(docs).count() == len(rows) and pii.found(none).count() == 0
    out = pii.redacted(docs)
    assert out.columns == docs.columns and "<EMAIL>" in out.where("doc_id = 111").first().text and out.count() == len(rows)


def test_pii_recall_and_clean_texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioustnrl") for _ in range(rng.randint(2, 8)))
    plant = {
        "email": lambda: f"{word()}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com",
        "phone": lambda: f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "secret": lambda: 'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"',
        "odd secret": lambda: 'token = "' + "".join(rng.choice("ghjkmnp") for _ in range(20)) + '"',
    }
    docs, truth = [], {}
    for k in range(600):
        words = [word() for _ in range(60)]
        kind = "odd secret" if k % 40 == 4 else [*plant, None, None, None][k % 8] if k % 8 != 4 else None
        if kind:
            truth[k] = plant[kind]()
            words.insert(rng.randint(0, 60), truth[k])
        docs.append((k, " ".join(words) + "."))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.found(frame).collect()}
    assert sum(got[k].n_spans > 0 for k in truth) >= 0.98 * len(truth)
    assert not any(r.n_spans for k, r in got.items() if k not in truth)
    left = {r.doc_id: r.text for r in pii.redacted(frame.withColumn("id", F.lit(1)).withColumn("row", F.lit("x"))).collect()}
    assert sum(truth[k].split('"')[-2 if '"' in truth[k] else -1] in left[k] for k in truth) <= 0.02 * len(truth)
    assert all(left[k] == dict(docs)[k] for k in left if k not in truth)


def test_pii_learns_contexts(spark):
    seen = [(k, f"please call me today on +1 (988) 555-{2000 + k} and thank you") for k in range(8)]
    new = [(100, "please call me today on 0049 5552486 and thank you"), (101, "in 19800 5552486 ways")]
    got = {r.doc_id: r.n_context for r in pii.found(spark.createDataFrame(seen + new, "doc_id long, text string")).collect()}
    assert got[100] == 1 and got[101] == 0 and all(got[k] == 0 for k, _ in seen)


def test_decontaminate(spark, docs, none):
    rng = random.Random(9)
    item = [f"q{rng.randint(0, 999)}" for _ in range(40)]
    edited = item[:10] + ["new"] + item[10:25] + item[27:]
    more = spark.createDataFrame([(500, "pre " * 30 + " ".join(item).upper() + " post" * 9), (501, "a " + " ".join(edited) + " b"), (502, " ".join(item[:12])), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string")
    every = docs.select("doc_id", "text").unionAll(more)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(every, bench).collect()} == {(500, 1), (501, 1)}
    assert decontaminate.decontaminated(every, bench).count() == every.count() - 2
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(every, bench.limit(0)).count() == 0


def test_edited_copies_score_as_full_alignment_does():
    rng = random.Random(12)
    vocab = [f"d{k}" for k in range(400)]
    items, texts = [], []
    for k in range(90):
        n = (40, 25, 12, 5, 3, 1)[k % 6]
        item = [rng.choice(vocab) for _ in range(n)]
        every, how = rng.choice([2, 3, 4, 5, 6]), k % 4
        copy = []
        for j, x in enumerate(item):
            hit = j % every == every - 1
            copy += [[f"new{j}"], [x, f"new{j}"], [], [x]][how] if hit else [x]
        items.append((k, " ".join(item)))
        texts.append(" ".join([rng.choice(vocab) for _ in range(rng.randint(0, 60))] + copy + [rng.choice(vocab) for _ in range(rng.randint(0, 60))]))
    block = decontaminate.Items(items, 0.6)
    whole, want = decontaminate.word_block(texts), {}
    found = []
    for counts in (None, np.random.default_rng(1).integers(0, 90, len(block.grams)), np.arange(len(block.grams))):
        seeds = decontaminate.Items(items, 0.6)
        if counts is not None:
            seeds.keep_rare(counts)
            assert len(seeds.item) < len(block.item)
        rows = list(decontaminate.hits(texts, seeds))
        for d, k, score, _, a, b in rows:  # the passage named aligns with that score by itself
            own = whole.hash[whole.first[d] + a : whole.first[d] + b]
            assert decontaminate.align(block.words[k], own)[0] == score * 2 * len(block.words[k])
            assert decontaminate.align(block.words[k], own[1:])[0] < score * 2 * len(block.words[k])
        found.append({(d, k): score for d, k, score, *_ in rows})
    for d in range(len(texts)):
        for k, x in enumerate(block.words):
            share = decontaminate.align(x, whole.hash[whole.first[d] : whole.first[d + 1]])[0] / (2 * len(x))
            if share >= 0.6:
                want[(d, k)] = share
    assert all(x == want for x in found) and sum(0.6 <= v < 0.8 for v in want.values()) > 20


def test_alignment_scores():
    def slow(a, b):
        h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
                best = max(best, h[i + 1][j + 1])
        return best

    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(1, 30))
        assert decontaminate.align(a, b)[0] == slow(a.tolist(), b.tolist())


def test_suffix_dedup(docs, none, rows, monkeypatch):
    raws = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(raw[s : s + 400] for _, raw in raws for s in range(len(raw) - 399))
    want = []
    for i, raw in raws:
        mask = np.zeros(len(raw), bool)
        for s in range(len(raw) - 399):
            if seen[raw[s : s + 400]] > 1:
                mask[s : s + 400] = True
        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
        want.append((str(i), len(raw), int(mask.sum()), int((np.diff(mask.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    for many in (2000, 1):
        monkeypatch.setattr(suffix_dedup, "MANY", many)
        got = suffix_dedup.deduplicated(docs).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert suffix_dedup.deduplicated(none).count() == 0


def test_suffix_order():
    data = np.frombuffer(b"abababababcababababab" * 40, np.uint8)
    s = suffix_dedup.Suffixes(data, 100)
    start = np.arange(0, 700, 3)
    order = s.order(np.zeros(len(start), int), start)
    raw = [bytes(s.data[k : k + 100]) for k in start[order]]
    assert raw == sorted(raw)


def test_quality_rules(docs, none, rows):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.cleaned(docs).collect()}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        g = Counter(zip(w, w[1:], w[2:]))
        cover = {k + j for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[(i, len(w))]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.cleaned(none).count() == 0


def test_quality_rules_keep_lines_wherever_they_stand(spark):
    rng = random.Random(6)
    docs = []
    for k in range(6):
        lines = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 12))) + rng.choice([".", ".", ".", ""]) for _ in range((5, 30, 200, 400)[k % 4])]
        docs.append((k, "\n".join(lines)))
    got = {r.doc_id: r for r in quality_rules.cleaned(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, text in docs:
        lines = text.split("\n")
        good = [x for x in lines if len(x.split()) >= 3 and x.endswith(".")]
        assert (got[k].n_lines, got[k].n_lines_kept, got[k].clean_text) == (len(lines), len(good), "\n".join(good))
        assert got[k].kept == (len(text.split()) >= 50 and 2 * sum(map(len, good)) >= sum(map(len, lines)))


def test_quality_rules_count_capitals_and_end_phrases_at_words(spark):
    good = ["one sign inside the house.", "the login5 of it.", "the logins were here.", "Ab ÉÀ éàz xy.", "one two 12 3.", "ΑΒΓ αβγ δ."]
    bad = ["BUY NOW CHEAP PILLS today.", "please log in.", "please login.", "you may sign up, now.", "ΑΒΓΔ αβγ one ΖΗΘΙΚΛ.", "ALL IN CAPITALS."]
    got = quality_rules.cleaned(spark.createDataFrame([(1, "\n".join(x for p in zip(good, bad, strict=True) for x in p))], "doc_id long, text string")).first()
    assert got.clean_text.split("\n") == good


def test_importance(spark, docs, none, rows):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    got = importance.sampled(docs, labels, share=0.5).collect()
    assert len(got) == len(rows) and not any(r.kept for r in got if not r.n_features)
    keys = sorted((r.key for r in got if r.key is not None), reverse=True)
    cut = keys[round(len(rows) * 0.5) - 1]
    assert all(r.kept == (r.key is not None and r.key >= cut) for r in got)
    french = [r.log_weight for r in got if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 2]
    assert sum(x > 0 for x in french) > 0.9 * len(french)
    assert importance.sampled(none, labels).count() == 0 and importance.sampled(docs, labels.limit(0)).count() == len(rows)


def test_language(docs, none, rows):
    model = language.fitted(docs)
    got = language.identified(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if not r.text or not re.search(r"[^\W\d_]", r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and r.doc_id < 60:
            assert r.lang_pred == r.lang and 0 <= r.score <= 1
    assert language.identified(none, model).count() == 0 and language.fitted(none).langs == ["und"]


def brute_components(rows, words, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(lower))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    ids = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            ids[find(k)] = min(ids.get(find(k), 1 << 60), r[0])
    return sorted((str(r[0]), len(sets[k]), str(ids.get(find(k)) if sets[k] else r[0])) for k, r in enumerate(rows))


def test_jaccard_join(spark, docs, none, rows):
    rng = random.Random(11)
    small = []
    for k in range(300):
        base = [f"s{rng.randint(0, 3)}"] * 1 + [f"t{j}" for j in range(rng.randint(3, 24))]
        if rng.random() < 0.7:
            base[rng.choice([0, len(base) - 1])] = f"u{rng.randint(0, 2)}"
        small.append((1000 + k, " ".join(base), None, None, None, None, None))
    every = rows + small
    got = jaccard_join.joined(docs.unionAll(spark.createDataFrame(small, SCHEMA))).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(every, 4, 85)
    assert jaccard_join.joined(none).count() == 0
    out = jaccard_join.deduplicated(docs)
    assert out.columns == docs.columns
    left = Counter(r.doc_id for r in out.collect())
    want = {int(c) for _, n, c in brute_components(rows, 5, 80) if n and c != "None"} | {104, 105}
    assert set(left) - {None} == want and max(left.values()) == 1


def test_deduplicated_keeps_unlinked_texts_of_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"v{k}x{j}" for j in range(30))
    docs = [(None, text(k)) for k in range(5)] + [(None, text(0)), (7, text(10)), (7, text(11)), (7, text(11)), (8, text(4)), (9, text(11) + " end"), (None, None), (None, ""), (10, "")]
    out = jaccard_join.deduplicated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    want = [(None, text(k)) for k in range(4)] + [(7, text(10)), (7, text(11)), (8, text(4)), (None, None), (None, ""), (10, "")]
    assert Counter(map(tuple, out.collect())) == Counter(want)


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not found & {104, 105, 106, 107, 108} and {0, 1, 100, 111} <= found and len(found & {101, 102, 103}) == 1


def test_base_queries_equal_their_sql(spark):
    from strandwise.llm import registry
    from tests.test_queries import TABLES, rows_of

    data = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    for name, sql in registry.SQL.items():
        assert rows_of(registry.QUERIES[name](spark, data).toPandas()) == rows_of(duck.execute(sql).df()), name


def test_importance_weights_equal_brute_force(spark, rows):
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    good = {1, 3, 5, 100}
    ratio = importance.model(frame, spark.createDataFrame([(k,) for k in good], "doc_id long"))
    raw, target, own = Counter(), Counter(), {}
    for i, t, *_ in rows:
        found = importance.features([t or ""])[1].tolist()
        own.setdefault(i, []).append(found)
        raw.update(found)
        if i in good:
            target.update(found)
    log = lambda c, b: np.log((c[b] + 1) / (sum(c.values()) + importance.BUCKETS))
    for r in importance.weighed(frame, ratio).collect():
        want = [sum(log(target, b) - log(raw, b) for b in f) if f else None for f in own[r.doc_id]]
        assert any(w is None and r.log_weight is None or w is not None and r.log_weight is not None and abs(w - r.log_weight) < 1e-6 for w in want)
        if r.log_weight is not None:
            assert -5 < r.key - r.log_weight < 40  # a Gumbel draw


def test_language_forward_pass_and_held_out_rows(spark, docs):
    model = language.fitted(docs)
    for text in ("the of wh3ing", "le une éa7eux et", "x"):
        codes = Counter()
        raw = bytes(language._PLAIN[b] for b in f" {text.lower()} ".encode())
        for n in language.SIZES:
            for k in range(len(raw) - n + 1):
                if (gram := raw[k : k + n]) != b" " * n:
                    codes[((int.from_bytes(gram, "big") + n) * 0x9E3779B1 % 2**32) >> (32 - language.BUCKETS.bit_length() + 1)] += 1
        logits = sum(model.table[b] * n for b, n in codes.items()) / sum(codes.values()) + model.bias
        e = np.exp((logits - logits.max()) / model.temperature)
        assert np.allclose(model.probabilities([text])[0], e / e.sum())
    lied = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert "xx" not in language.fitted(lied).langs and np.array_equal(language.fitted(lied).table, model.table)
    odd = spark.createDataFrame([(1, "qqq zzz xxx jjj"), (2, "the of and wh1ing wh2ing")], "doc_id long, text string")
    sure = language.Model(model.langs, model.table, model.bias, model.temperature, 0.99)
    scores = {r.doc_id: (r.lang_pred, r.score) for r in language.identified(odd, sure, reject=True).collect()}
    assert all((lang == "und") == (score < 0.99) for lang, score in scores.values())


def test_pipeline_masks_packs_and_takes_awkward_tables(spark, docs, none, tmp_path):
    import corpus_pipeline

    bench = spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string")
    full = docs.withColumn("_h1", F.lit("clash")).withColumn("row", F.lit(1))
    for name, frame in (("full", full), ("none", none)):
        full_dir = str(tmp_path / name)
        bench.write.parquet(f"{full_dir}/benchmark.parquet")
        kept = frame
        for stage, function in corpus_pipeline.STAGES[:-1]:
            kept = function(spark, kept, full_dir)
            kept.write.parquet(f"{full_dir}/{stage}")
            kept = spark.read.parquet(f"{full_dir}/{stage}")
            assert kept.columns == frame.columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, kept, full_dir).collect()
        texts = {r.doc_id: r for r in kept.collect()}
        assert len(texts) == kept.count()
        if name == "none":
            assert not pieces and not texts
            continue
        assert "<EMAIL>" in texts[111].text and "<CARD>" in texts[111].text and texts[111].n_chars == len(texts[111].text)
        ids = plain("byte_bpe_50k.json", False)
        whole = {k: ids(r.text) for k, r in texts.items()}
        assert sum(r.length for r in pieces) == sum(map(len, whole.values()))
        assert all(zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)


def test_jaccard_join_does_not_depend_on_partitions(spark):
    rng = random.Random(13)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    docs = []
    for k in range(300):  # near copies of an original that is not there
        text = list(words)
        for _ in range(rng.choice([1, 1, 2, 3])):
            text[rng.randrange(120)] = f"n{rng.randint(0, 10**6)}"
        docs.append((k, " ".join(text)))
    docs += [(1000 + k, " ".join(f"z{rng.randint(0, 10**6)}" for _ in range(30)) + " " + " ".join(words[:10])) for k in range(100)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_components(docs, 4, 85)
    for parts in (2, 23):
        got = jaccard_join.joined(frame.repartition(parts)).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


def test_long_texts_are_read_in_pieces_that_cover_each_window_once(monkeypatch):
    rng = random.Random(21)
    texts = ["".join(rng.choice("abé ") for _ in range(n)) for n in (0, 100, 399, 400, 1200, 5000)] + ["ab" * 2000]
    batch = pa.RecordBatch.from_pydict({"text": [*texts, None]})
    found = []
    for size in (1 << 18, 300, 1000):
        monkeypatch.setattr(suffix_dedup, "PIECE", size)
        windows, total = {}, 0
        for raws, places in suffix_dedup.blocks([batch]):
            for own, (piece, start, count, k, inside, data, begin) in suffix_dedup.pieces(raws, places):
                for p, a, n, key, at, b in zip(piece, start, count, k, inside, begin, strict=True):
                    doc, first = own[p]
                    total += int(n)
                    assert data[b : b + n + 399].tobytes() == raws[doc][first + a : first + a + n + 399]
                    windows.update({(doc, first + a + j): (int(key), int(at) - j) for j in range(n)})
        assert total == len(windows)
        found.append(windows)
    assert set(found[0]) == {(d, j) for d, t in enumerate(texts) for j in range(len(t.encode()) - 399)}
    assert found[0] == found[1] == found[2]


def test_tasks_empty_the_token_caches_of_earlier_operators():
    class Here:
        """A frame whose tasks run in this process, on no batches."""

        def drop(self, *names):
            return self

        schema = type("Empty", (), {"fields": []})

        def mapInArrow(self, task, schema):
            return list(task(iter(())))

    code = tokens.encoder(tokens.tokenizer_path("byte_bpe_50k.json"), False)
    code.ids(["one two three"])
    assert code.known
    common.arrow(Here(), lambda batches: batches, "n long", keeps=True)
    assert code in tokens._loaded.values()
    assert language.identified(Here(), None) == [] and not tokens._loaded
    again = tokens.encoder(tokens.tokenizer_path("byte_bpe_50k.json"), False)
    common.arrow(Here(), lambda batches: batches, "n long")
    assert not tokens._loaded and again is not code


def test_packing_then_another_operator_in_one_worker(spark):
    one = spark.createDataFrame([(k, f"one two {k}") for k in range(4)], "doc_id long, text string").coalesce(1)
    assert packing.packed(one, "byte_bpe_50k.json").count() == 4

    def left(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(tokens._loaded)] * batch.num_rows)], names=["n"])

    assert {r.n for r in common.arrow(one.select("doc_id"), left, "n long").collect()} == {0}
