"""Language ID, quality rules, compression quality, near duplicates, packing, mixing, sharding and fingerprints on small tables."""

import hashlib
import itertools
import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tessella.llm import compression_quality as CQ
from tessella.llm import fingerprints as FP
from tessella.llm import language_id as LI
from tessella.llm import mixing as MX
from tessella.llm import near_duplicates as ND
from tessella.llm import packing as PK
from tessella.llm import quality_rules as QR
from tessella.llm import sharding as SH

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, sf=SF, name="documents"):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frame(spark, rows):
    """rows of (doc_id, text) with other columns, and one named like an output."""
    full = [(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 5 else None, len(t or "")) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).withColumn("score", F.lit("clash")).withColumn("shard", F.lit(-1)).withColumn("kept", F.lit("clash"))


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "word " * 30_000), (6, "same text here again and again"), (7, "same text here again and again"), (7, "same text here again and again"), (None, "no id here"), (9, "日本語 のテキスト"), (10, "é́ 1234 !!")]


# ---- quality rules


def slow_statistics(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)]


def test_statistics_match_the_definition(spark):
    texts = [r.text for r in table(spark).select("text").limit(80).collect()] + [t for _, t in ODD] + ["a b c a b c", "x\x1cy z", "l\nl\n \nl", "a a a a"]
    for t in texts:
        assert QR.statistics(t)[0] == slow_statistics(t)


def test_forest_against_a_walk_of_each_row():
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=400), rng.normal(size=400), np.zeros(400)])
    forest = QR.fit_forest(x, np.array([1.0, 1.0, 0.0]), trees=20, points=64)
    rows = [[0, 0, 0], [5, 0, 0], [0, -7, 3], *x[:20]]
    for row, score in zip(rows, forest.scores(np.array(rows, dtype=float)), strict=True):
        paths = []
        for f, v in zip(forest.feature, forest.value, strict=True):
            at = 0
            while f[at] >= 0:
                at = 2 * at + (2 if row[f[at]] >= v[at] else 1)
            paths.append(v[at])
        assert score == pytest.approx(2 ** (-sum(paths) / len(paths) / QR.expected_path(64)))
    assert min(forest.scores(np.array(rows[1:3], dtype=float))) > np.median(forest.scores(x)) and 2 not in forest.feature
    for t, f in enumerate(forest.feature):  # a leaf's value is its depth and what its share of the tree's points adds
        own = x[np.random.default_rng(11).choice(400, 64, replace=False)] if t == 0 else None
        todo = [(0, own, 0)] if t == 0 else []
        while todo:
            at, held, d = todo.pop()
            if f[at] < 0:
                assert forest.value[t, at] == pytest.approx(d + QR.expected_path(len(held))) and (d == 6 or len(held) <= 1)
                continue
            right = held[:, f[at]] >= forest.value[t, at]
            todo += [(2 * at + 1, held[~right], d + 1), (2 * at + 2, held[right], d + 1)]


def test_threshold_is_the_cheapest():
    rng = np.random.default_rng(5)
    good, bad = rng.normal(0.3, 0.1, 60).round(2), rng.normal(0.5, 0.1, 30).round(2)

    def cost(c):
        return 5 * np.mean(good > c) + np.mean(bad <= c)

    assert cost(QR.threshold_of(good, bad, 5.0)) == pytest.approx(min(cost(c) for c in np.linspace(-0.1, 1.1, 2401)))
    assert QR.threshold_of(good, good[:0], 5.0) > good.max() and QR.threshold_of(good[:0], bad, 5.0) is None


def test_cheapest_cut_of_a_table(spark):
    rng = np.random.default_rng(6)
    for good, bad in ((rng.normal(0.4, 0.05, 900), rng.normal(0.5, 0.05, 500)), (rng.integers(0, 9, 60) / 8, rng.integers(0, 9, 40) / 8), (rng.random(5), rng.random(0)), (rng.random(0), rng.random(5))):
        table = spark.createDataFrame([(float(min(max(s, 0), 1)), g) for g, part in ((True, good), (False, bad)) for s in part], "score double, good boolean")
        want = QR.threshold_of(np.clip(good, 0, 1), np.clip(bad, 0, 1), 5.0)
        assert QR.cheapest_cut(table.repartition(5), 5.0) == (want if want is None else pytest.approx(want, abs=1e-12))


def test_all_labelled_rows_are_fitted_and_calibrated_on(spark, monkeypatch):
    """Every tree holds each good row that passes the base rules, the threshold is that of all labelled rows, and neither depends on
    how rows are dealt."""
    docs = spark.range(21_000).selectExpr(
        "id AS doc_id",
        "CASE WHEN id % 100 = 7 THEN 'too short' ELSE array_join(transform(sequence(1, cast(50 + id % 30 AS int)), i -> substr(md5(concat(id, '-', i)), 1, cast(1 + (id * 7 + i * i) % (3 + id % 9) AS int))), if(id % 10 = 3, '! ', ' ')) END AS text",
    )
    labels = docs.selectExpr("doc_id", "int(doc_id % 10 <> 3) AS quality")
    seen, cut = [], QR.cheapest_cut
    monkeypatch.setattr(QR, "cheapest_cut", lambda scores, weight: seen.append(scores.toPandas()) or cut(scores, weight))
    forest = QR.QualityRules().fit(docs, labels).forest
    rows = [(r.doc_id % 10 != 3, QR.statistics(r.text)) for r in docs.collect()]
    rows = [(good, x) for good, (base, x) in rows if base[0] >= 50 and 100 * base[4] <= 50 * base[0]]
    x = np.array([x for good, x in rows if good])
    assert len(rows) > 20_000 and forest.expected == pytest.approx(float(QR.expected_path(len(x))))
    for f, v in zip(forest.feature, forest.value, strict=True):
        at = np.zeros(len(x), dtype=int)
        for _ in range(forest.depth):
            at = np.where(f[at] >= 0, 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f[at], 0)] >= v[at]), at)
        spot, held = np.unique(at, return_counts=True)
        assert v[spot] == pytest.approx(np.floor(np.log2(spot + 1)) + QR.expected_path(held))
    (scores,) = seen
    assert Counter(scores["good"]) == Counter(good for good, _ in rows)
    assert forest.threshold == pytest.approx(QR.threshold_of(scores["score"][scores["good"]].to_numpy(), scores["score"][~scores["good"]].to_numpy(), 5.0), abs=1e-12)
    few = docs.filter("doc_id < 500")
    one, other = (QR.QualityRules().fit(few.repartition(n), labels.repartition(n)).forest for n in (1, 7))
    assert (one.feature == other.feature).all() and (one.value == other.value).all() and one.threshold == other.threshold


def test_forest_on_unseen_labels(spark):
    """Error rates among rows that pass the base rules, on the half of the labels that is not fitted, both ways."""
    docs, labels = table(spark, "/root/testdata/sf0.1"), table(spark, "/root/testdata/sf0.1", "labels")
    rate = Counter()
    half = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2))
    for k in (0, 1):
        rules = QR.QualityRules().fit(docs, labels.filter(half == k))
        unseen = rules.judged(docs.join(labels.filter(half != k), "doc_id")).filter("NOT base_failed")
        for r in unseen.groupBy("quality").agg(F.sum(F.col("kept").cast("int")).alias("k"), F.count("*").alias("n")).collect():
            rate[r.quality, "kept"] += r.k
            rate[r.quality, "all"] += r.n
    assert rate[1, "kept"] / rate[1, "all"] >= 0.99 and rate[0, "kept"] / rate[0, "all"] <= 0.05, rate


def test_rules_query_keeps_its_contract(spark):
    docs = {r.doc_id: r.text for r in table(spark).select("doc_id", "text").collect()}
    got = QR.query(spark, SF)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly", "kept"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        want = slow_statistics(docs[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)


def test_rules_on_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 1), (99, 0), (None, 1)], "doc_id long, quality int")
    d = frame(spark, ODD)
    rules = QR.QualityRules(min_words=2).fit(d, labels)
    out = {(r.doc_id, r.n_words): r for r in rules.judged(d).collect()}
    assert len(out) == 10 and rules.judged(d).count() == 11
    assert out[(1, 0)].base_failed and not out[(1, 0)].kept and out[(5, 30_000)].base_failed
    assert rules.kept(d).columns == d.columns
    assert rules.judged(d.limit(0)).count() == 0
    assert QR.QualityRules().fit(d.limit(0), labels.limit(0)).judged(d).count() == 11


# ---- language ID


def test_language_accuracy_and_mixture(spark):
    docs = table(spark, "/root/testdata/sf0.01").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    lid = LI.LanguageID().fit(docs.filter(~held))
    own = docs.filter(held).select("lang", lid.predicted(F.col("text")).alias("v"))
    assert own.agg(F.avg((F.col("v.lang_pred") == F.col("lang")).cast("double"))).head()[0] > 0.98
    by = {r.lang: r.t for r in docs.filter("length(text) > 1500").groupBy("lang").agg(F.max_by("text", "doc_id").alias("t")).collect()}
    mixed = " ".join((by["fr"].split()[:150]) + (by["de"].split()[:50]))
    lang, score, share = lid.model.infer(mixed)
    share = dict(zip(lid.model.langs, share, strict=True))
    assert lang == "fr" and share["fr"] == pytest.approx(0.75, abs=0.12) and share["de"] == pytest.approx(0.25, abs=0.12) and score == pytest.approx(share["fr"])
    assert lid.model.infer(by["es"])[2][lid.model.langs.index("es")] == 1.0


def test_em_finds_the_best_mixture():
    rng = np.random.default_rng(0)
    ll = rng.normal(size=(200, 3))
    ll[:120, 0] += 3
    ll[120:, 1] += 3
    share, value = LI.em(ll, np.ones(200), rounds=500, tol=1e-9)
    grid = [(a, b, 1 - a - b) for a in np.linspace(0, 1, 51) for b in np.linspace(0, 1, 51) if a + b <= 1]
    best = max(np.log(np.exp(ll) @ np.array(g) + 1e-300).sum() for g in grid)
    assert value >= best - 1e-6 and share.sum() == pytest.approx(1)
    picked, alone = LI.mixture(ll, np.ones(200), 1.0)
    assert picked[0] > 0.5 and picked[1] > 0.3 and picked[2] == 0 and len(alone) == 3


def test_language_on_odd_rows(spark):
    d = frame(spark, ODD)
    lid = LI.LanguageID().fit(d)
    got = [(r.v.lang_pred, r.v.score) for r in d.filter("doc_id IN (1, 2, 3)").select(lid.predicted(F.col("text")).alias("v")).collect()]
    assert got == [("und", 0.0)] * 3
    assert lid.kept(d).columns == d.columns and lid.kept(d.limit(0)).count() == 0
    nothing = LI.LanguageID().fit(d.limit(0))
    assert {(r.v.lang_pred, *r.v.languages) for r in d.select(nothing.predicted(F.col("text")).alias("v")).collect()} == {("und",)}
    assert nothing.kept(d).count() == d.count()


def test_language_query_keeps_its_contract(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in table(spark, sf).select("doc_id", "text", "lang").collect()}
    got = LI.query(spark, sf)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "languages", "shares"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    model = LI.LanguageID().fit(table(spark, sf).filter("pmod(crc32(cast(doc_id as string)), 4) <> 2")).model
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        lang, score, share = model.infer(docs[r.doc_id].text)
        assert r.lang_pred == lang and r.score == pytest.approx(score) and 0 <= r.score <= 1
        assert dict(zip(r.languages, r.shares, strict=True)) == pytest.approx({x: s for x, s in zip(model.langs, share, strict=True) if s > 0})
        assert r.shares == sorted(r.shares, reverse=True) and (lang == "und" or sum(r.shares) == pytest.approx(1) and r.languages[0] == lang)


# ---- compression


def test_compression_separates_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1"), table(spark, "/root/testdata/sf0.1", "labels")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = CQ.CompressionQuality().fit(docs, labels.filter(~held))
    rows = docs.join(labels.filter(held), "doc_id").select("quality", model.score(F.col("text")).alias("s")).toPandas()
    rank = rows.s.rank()
    n1, n0 = (rows.quality == 1).sum(), (rows.quality == 0).sum()
    assert (rank[rows.quality == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.97
    assert ((rows.s >= 0.3) & (rows.quality == 1)).sum() / n1 > 0.97


def test_compression_by_plain_sizes(spark):
    """The operator's scores and the query's columns against zstandard called text by text."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in table(spark, sf).select("doc_id", "text").collect()}
    labels = table(spark, sf, "labels")
    got = CQ.query(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    model = CQ.CompressionQuality().fit(table(spark, sf), labels.filter("pmod(crc32(cast(doc_id as string)), 5) <> 0"))
    for r in rows:
        raw, x = docs[r.doc_id].encode(), []
        for pair in model.pairs:
            good, bad = (len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d)).compress(raw)) for d in pair)
            x += [(bad - good) / (len(raw) + 16), (bad - good) / min(good, bad), math.log1p(abs(bad - good)) * (1 if bad >= good else -1)]
        z = sum((a - m) / s * w for a, m, s, w in zip(x, model.mean, model.scale, model.weights)) + model.weights[-1]
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)
        assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_compression_learns_from_bounded_bytes(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(("alpha beta gamma", "delta epsilon")[k % 2].split()) for _ in range(60)), k % 2) for k in range(200)]
    rows.append((999, "x" * 500_000, 1))
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    seen = []
    model = CQ.CompressionQuality(fit_bytes=5_000)
    build = model.build
    model.build = lambda good, bad: seen.extend((good, bad)) or build(good, bad)
    model.fit(d.select("doc_id", "text"), d.select("doc_id", "quality"))
    assert all(0 < sum(map(len, part)) <= 5_000 for part in seen)
    got = d.select("quality", model.score(F.col("text")).alias("s")).filter("doc_id < 999").collect()
    assert all((r.s >= 0.5) == (r.quality == 1) for r in got)


def test_compression_on_odd_rows(spark):
    d = frame(spark, ODD).withColumn("__h", F.lit(1)).withColumn("__q", F.lit(1)).withColumn("__n", F.lit(1))
    none = CQ.CompressionQuality().fit(d, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.s for r in d.select(none.score(F.col("text")).alias("s")).collect()} == {0.5}
    one = CQ.CompressionQuality().fit(d, spark.createDataFrame([(4, 1), (5, 1)], "doc_id long, quality int"))
    assert {r.s for r in d.select(one.score(F.col("text")).alias("s")).collect()} == {1.0}
    many = d.unionByName(d.selectExpr("doc_id + 100 AS doc_id", *[c for c in d.columns if c != "doc_id"]))
    few = CQ.CompressionQuality().fit(many, many.filter("doc_id IS NOT NULL").selectExpr("doc_id", "int(doc_id % 2) AS quality").distinct())
    assert few.constant is None
    got = many.select("text", few.score(F.col("text")).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in got) and len({r.s for r in got if r.text == "same text here again and again"}) == 1
    assert many.limit(0).select(few.score(F.col("text")).alias("s")).count() == 0


# ---- near duplicates


def slow_similarity(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a.get(e, 0) / a[k], b.get(e, 0) / b[k]) for e in keys) for k in set(a) & set(b))


def weighted(text):
    w = (text or "").lower().encode().split()
    grams = [tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    return {g: 1 + math.log(n) for g, n in Counter(grams).items()}


def test_similarity_and_signature():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    for _ in range(30):
        a = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        b = a[:]
        for _ in range(rng.randint(0, 6)):
            b[rng.randrange(len(b))] = rng.choice(words)
        x, y = (ND.shingles(ND.words_of(" ".join(t))) for t in (a + a[:10], b + b[:10]))
        exact = slow_similarity(weighted(" ".join(a + a[:10])), weighted(" ".join(b + b[:10])))
        assert ND.similarity(ND.unpacked(ND.packed(*x)), ND.unpacked(ND.packed(*y))) == pytest.approx(exact)
        s = [ND.signature(h, ND.weights(c), 4096) for h, c in (x, y)]
        assert (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.05)


def planted(rng, n_words=120):
    base = [[f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n_words)] for _ in range(25)]
    rows = []
    for k, words in enumerate(base):
        for copy in range(rng.randint(1, 12)):
            w = words[:]
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5))):
                w[rng.randrange(n_words)] = f"x{rng.randrange(9999)}"
            rows.append(" ".join(w) if copy % 3 else " ".join(w).upper())
    rng.shuffle(rows)
    return [(10 + 3 * i, t) for i, t in enumerate(rows)]


def shared_edits(rng, n_words=90, copies=70):
    """Copies of one text, some of whose words recur, with several edits each out of a few, so that many pairs lie around 0.8."""
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(n_words)]
    words += words[:12] + words[30:37]
    edits = [(rng.randrange(n_words), rng.choice(("", "the", "and"))) for _ in range(14)]
    rows = []
    for _ in range(copies):
        w = words[:]
        for at, new in sorted(rng.sample(edits, rng.randint(0, 6)), reverse=True):
            w[at : at + 1] = [new] if new else []
        rows.append(" ".join(w))
    return [(5 + 2 * i, t) for i, t in enumerate(rows)]


def components(rows):
    """The smallest id of each text's class, from all pairs."""
    sets = {i: weighted(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if set(sets[a]) & set(sets[b]) and slow_similarity(sets[a], sets[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("make", "options"), [(planted, {}), (shared_edits, {}), (shared_edits, {"at_once": 1})])
def test_classes_match_brute_force(spark, make, options):
    rows = make(random.Random(5))
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.class_id for r in ND.NearDuplicates(**options).classes(d).collect()}
    want = components(rows)
    assert got == want and 1 < len(set(want.values())) < len(rows)


def test_needed_shingles_bound_the_similarity(spark):
    """No pair of weighted sets is as alike as the threshold with fewer common shingles than needed() says."""
    rng, nd, rows, tight = random.Random(12), ND.NearDuplicates(), [], 0
    for _ in range(400):
        base = {k: rng.choice((1, 1, 1, 2, 3, 9)) for k in range(rng.randint(5, 60))}
        x, y = ({k: c if rng.random() < 0.9 else c + 1 for k, c in base.items() if rng.random() < 0.95} | {(s, k): 1 for k in range(rng.randint(0, 6))} for s in "xy")
        wx, wy = ({k: 1 + math.log(c) for k, c in z.items()} for z in (x, y))
        if x and y and slow_similarity(wx, wy) >= 0.8:
            rows += [(len(x), sum(wx.values()), len(y), sum(wy.values()), len(set(x) & set(y)))]
    own = spark.createDataFrame(rows, "n long, w double, size long, total double, c long")
    for r in own.select("n", "c", nd.needed(F.col("n"), F.col("w") - F.col("n"), *ND.size_class()).alias("least")).collect():
        assert r.c >= r.least
        tight += r.least > 0.8 * r.n
    assert tight > len(rows) / 3


def test_ids_of_any_type_and_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(30))
    d = spark.createDataFrame([("b", text, 1, 2), ("a", text.upper(), 3, 4), ("c", "else", 5, 6)], "doc_id string, text string, h_0 int, __g int")
    assert {r.doc_id: r.class_id for r in ND.NearDuplicates().classes(d).collect()} == {"a": "a", "b": "a", "c": "c"}
    kept = ND.NearDuplicates().kept(d)
    assert kept.columns == d.columns and sorted(r.h_0 for r in kept.collect()) == [3, 5]


def test_near_duplicates_on_odd_rows(spark):
    d = frame(spark, ODD)
    got = Counter((r.doc_id, r.class_id) for r in ND.NearDuplicates().classes(d).collect())
    assert got == Counter({(1, 1): 1, (2, 1): 1, (3, 1): 1, (4, 4): 1, (5, 5): 1, (6, 6): 1, (7, 6): 2, (None, None): 1, (9, 9): 1, (10, 10): 1})
    kept = ND.NearDuplicates().kept(d)
    assert kept.columns == d.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 9, 10]
    assert ND.NearDuplicates().classes(d.limit(0)).count() == 0


# ---- packing


def slow_best_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= n]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - n)
        else:
            bins.append(size - n)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(200):
        size = rng.choice([5, 16, 31, 100])
        lengths = [rng.randint(1, size - 1) for _ in range(rng.randint(0, 90))]
        runs, bins = PK.plan(dict(Counter(lengths)), size)
        held = defaultdict(list)
        for n, rank, count, first, offset in runs:
            for k in range(count):
                held[first + k].append((offset, n))
        for own in held.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
        assert bins == len(held) and sorted(size - sum(n for _, n in own) for own in held.values()) == slow_best_fit(lengths, size)


def test_segment_tree_finds_the_tightest():
    tree, rng, have = PK.Capacities(50), random.Random(4), Counter()
    for _ in range(500):
        if have and rng.random() < 0.5:
            need = rng.randint(0, 50)
            want = min((c for c in have if c >= need), default=-1)
            assert tree.tightest(need) == want
            if want >= 0:
                tree.take(want, 1)
                have[want] -= 1
                have = +have
        else:
            c = rng.randint(0, 50)
            tree.put(c, 0, 1)
            have[c] += 1


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [*ODD, (11, "x <|endoftext|> y"), (12, "tail  spaces  "), *[(100 + k, "some words of text " * (k * 7 % 90)) for k in range(60)]]
    d = frame(spark, rows)
    got = PK.pack(d, size=64).toPandas()
    tok = Tokenizer.from_file(PK.vocabulary_files()[0])
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 64 or min(64, len(ids))
        edges = [0, first, *range(first + 64, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(itertools.pairwise(edges)):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))] += 1
    assert Counter((None if x[0] != x[0] else int(x[0]), *map(int, x[1:])) for x in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"].to_numpy() == np.concatenate([[0], own["length"].cumsum().to_numpy()[:-1]])).all() and own["length"].sum() <= 64
    lengths = [k[3] for k in want.elements()]
    assert got.sequence_id.nunique() == len(slow_best_fit([n for n in lengths if n < 64], 64)) + lengths.count(64)
    assert PK.pack(d.limit(0)).count() == 0


# ---- fingerprints


def slow_canonical(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return " ".join(t.split())


def test_fingerprints_fold_case_space_and_form(spark):
    rows = [(1, "Straße  ﬁn É"), (2, "STRASSE fin é"), (3, " strasse\u00a0fin\ne\u0301 "), (4, "strasse fin e"), (5, None), (6, " \t"), (7, "")]
    got = {r.doc_id: r.fingerprint for r in FP.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == got[3] != got[4] and got[5] == got[6] == got[7]


def brute_fingerprints(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        e = t[: n - n // 3] + nxt[: n // 3]
        out[i] = (n, hashlib.sha256(e.encode()).hexdigest(), slow_canonical(t), slow_canonical(e), float(slow_canonical(t) == slow_canonical(e)), float(slow_canonical(t) == slow_canonical(nxt)))
    return out


@pytest.mark.parametrize("per_bucket", [3, 4096])
def test_edited_texts_match_brute_force(spark, tmp_path, monkeypatch, per_bucket):
    rng = random.Random(2)
    rows = [(r.doc_id * 7 % 1009 - 50, r.text[:400]) for r in table(spark).select("doc_id", "text").limit(60).collect()]
    rows += [(2000, None), (2001, ""), (2002, "ab"), (2003, "ab"), (2004, "aaaaaa"), (2005, "aaaaaa"), (2006, "AAAAAA")]
    rng.shuffle(rows)
    monkeypatch.setattr(FP.with_next, "__defaults__", (per_bucket, 4096))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in FP.query(spark, str(tmp_path)).collect()}
    want = brute_fingerprints(rows)
    assert set(got) == set(want)
    names = {}
    for i, (n, sha, own, new, near, nxt) in want.items():
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == (n, sha, near, nxt)
        assert names.setdefault(own, r.fingerprint) == r.fingerprint and names.setdefault(new, r.edited_fingerprint) == r.edited_fingerprint
    assert len(set(names.values())) == len(names)


def test_clashing_hashes_are_told_apart_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(FP, "wide", lambda c: F.lit("0" * 32))
    rows = [(1, "abc abc"), (2, "abc  ABC"), (3, "xyz"), (4, "q")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in FP.fingerprints(d).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 3
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in FP.query(spark, str(tmp_path)).collect()}
    assert got[1].fingerprint == got[2].fingerprint and len({r.fingerprint for r in got.values()}) == 3 and got[2].near_next == 1.0 and got[3].near_next == 0.0


def test_edited_texts_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(None, "only one without an id"), (1, "a b c d e f"), (1, "a b c d e f"), (1, "A  B c d e F"), (2, "x y z"), (2, None), (3, "a b c d e f")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = FP.query(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 3)}) == 1 and all(0 <= r.near_next <= 1 for r in got)
    none = spark.createDataFrame([(None, "p"), (None, "p")], "doc_id long, text string")
    none.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert FP.query(spark, f"{tmp_path}/none").count() == 2


def test_columns_that_clash_pass_through(spark):
    d = frame(spark, ODD).withColumns({c: F.lit(7) for c in ("__v", "verdict_0", "src_0", "h_0", "canon_0", "sha_0", "__h", "copy_0")})
    labels = spark.createDataFrame([(1, 1), (9, 0)], "doc_id long, quality int")
    rules = QR.QualityRules().fit(d, labels)
    assert rules.kept(d).columns == d.columns and set(d.columns) < set(rules.judged(d).columns) and rules.judged(d).count() == d.count()
    mixed, printed = MX.apply(d), FP.fingerprints(d)
    assert mixed.columns == d.columns and mixed.count() >= d.count()
    assert printed.columns == [*d.columns, "fingerprint"] and {r["verdict_0"] for r in printed.collect()} == {7}


def test_fingerprints_of_nothing_and_one(spark, tmp_path):
    for k, rows in enumerate(([], [(5, "abcdef")])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        got = FP.query(spark, f"{tmp_path}/{k}").collect()
        assert len(got) == k and all(r.near_next == 1.0 for r in got)


# ---- sharding


def test_shards_are_even_and_slots_gapless(spark):
    rng = random.Random(8)
    rows = [(k, "x" * rng.randint(0, 300), "en", "hot" if k % 3 == 0 else f"s{k % 7}", 1) for k in range(3000)] + [(k, "copy of one text" * 8, "en", "hot", 1) for k in range(3000, 4500)]
    got = SH.shard(spark.createDataFrame(rows, SCHEMA), shards=13).toPandas()
    assert len(got) == 4500 and set(got["shard"]) == set(range(13)) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    size = got.groupby("shard")["size"].sum()
    assert size.max() / size.min() < 1.03
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert got.set_index("doc_id").loc[3000, "text_crc32"] == zlib.crc32(b"copy of one text" * 8)


def test_equal_texts_share_a_shard(spark):
    """Whatever their source and language; only a text with more bytes than a shard is in several."""
    rng = random.Random(18)
    texts = [" ".join(rng.choice(("ab", "cde", "\u00e9t\u00e9", "x\ny")) for _ in range(rng.randint(1, 60))) for _ in range(900)]
    rows = [t for t in texts for _ in range(rng.choice((1, 1, 1, 2, 5, 9)))] + ["one text of which there are many"] * 2500
    rng.shuffle(rows)
    d = spark.createDataFrame([(k, t, rng.choice(("en", "fr", None)), f"s{k % 23}", 1) for k, t in enumerate(rows)], SCHEMA)
    got = SH.shard(d, shards=17).toPandas()
    got["text"] = got["doc_id"].map(dict(enumerate(rows)))
    size, parts = got.groupby("shard")["size"].sum(), got.groupby("text")["shard"].nunique()
    assert size.max() / size.mean() < 1.03 and size.min() / size.mean() > 0.97
    assert parts.pop("one text of which there are many") <= math.ceil(2500 * 49 / size.mean()) + 2 and set(parts) == {1}
    real = SH.query(spark, SF).join(table(spark).select("doc_id", "text"), "doc_id").toPandas()
    assert real["shard"].between(0, 39).all() and real.groupby("text")["shard"].nunique().max() == 1


def test_cuts_are_the_nearest_to_the_median(spark):
    """Each node of the tree is cut at the place that a search through all its rows finds best, to the tolerance."""
    rng = random.Random(19)
    rows = spark.createDataFrame([(rng.randint(1, 90), *(rng.randrange(1 << rng.choice((10, 40, 62))) for _ in range(2))) for _ in range(700)], "size long, d0 long, d1 long")
    local, root = [tuple(r) for r in rows.collect()], SH.Node(0, 8, [(0, 1 << 62)] * 2)
    while SH.split(rows, root, ["d0", "d1"], 0.0):
        pass

    def walk(node, own):
        if node.left is None:
            return
        goal = sum(r[0] for r in own) / 2
        miss = {d: min(abs(sum(r[0] for r in own if r[1 + d] < cut) - goal) for cut in {r[1 + d] for r in own} | {1 << 62}) for d in (0, 1)}
        sides = [r for r in own if r[1 + node.dim] < node.cut], [r for r in own if r[1 + node.dim] >= node.cut]
        assert abs(sum(r[0] for r in sides[0]) - goal) == pytest.approx(miss[node.dim])
        assert miss[node.dim] <= SH.LOOSE * goal / (node.shards / 2) or miss[node.dim] == min(miss.values())
        walk(node.left, sides[0])
        walk(node.right, sides[1])

    walk(root, local)


def test_shards_on_odd_rows(spark):
    d = frame(spark, ODD).drop("shard")
    got = SH.shard(d, shards=4).toPandas()
    assert len(got) == 11 and got["shard"].between(0, 3).all() and set(got.loc[got.doc_id == 1, "size"]) == {16}
    assert SH.shard(d.limit(0), shards=4).count() == 0
    same = spark.createDataFrame([(1, "t", None, None, 1)] * 10, SCHEMA)
    assert SH.shard(same, target_bytes=40).count() == 10


# ---- mixing


def test_exponent_meets_its_limit():
    tokens = {"a": 1000, "b": 100, "c": 10}
    p = MX.plan(tokens, None, 1.5, None)
    used = {s: p.budgets[s] / tokens[s] for s in tokens}
    assert min(used.values()) == 1 and max(used.values()) == pytest.approx(1.5, abs=0.05)
    p = MX.plan(tokens, 1110, None, 0.9)
    assert MX.entropy(p.weights) == pytest.approx(0.9, abs=1e-6) and sum(p.budgets.values()) == pytest.approx(1110, abs=2)
    assert MX.plan(tokens, None, 1000.0, None).exponent == 0 and MX.plan(tokens, None, 1.0, None).exponent == pytest.approx(1)
    assert MX.plan({"a": 0}, None, 1.5, None).exponent == 1


@pytest.mark.parametrize("per_block", [4, 1024])
def test_mixture_uses_whole_passes_then_part(spark, per_block):
    rng = random.Random(9)
    rows = [(k, " ".join(["w"] * rng.randint(0, 20)), "en", rng.choice(["big"] * 6 + ["small", None]), 1) for k in range(800)]
    d = spark.createDataFrame(rows, SCHEMA)
    uses, made = MX.mixture(d, most_repetitions=2.5, rows_per_block=per_block)
    got = uses.toPandas()
    docs = {r[0]: (r[3] or MX.NO_SOURCE, len(r[1].split())) for r in rows}
    for src, own in got.groupby("src"):
        assert set(own["id"]) == {k for k, (s, _) in docs.items() if s == src}
        spent, longest = own["tok"].sum(), own["tok"].max()
        assert made.budgets[src] <= spent < made.budgets[src] + longest or made.budgets[src] == spent
        whole = made.budgets[src] // made.tokens[src]
        some = {k for k, (s, n) in docs.items() if s == src and n}
        times = own[own["tok"] > 0].groupby("id").size()
        assert set(times.index) == some and times.min() == whole and times.max() <= whole + 1
    assert got["position"].between(0, 1).all()
    assert MX.apply(d, most_repetitions=2.5, rows_per_block=per_block).count() == len(got)


def test_mixing_on_odd_rows(spark):
    d = frame(spark, ODD)
    out = MX.apply(d)
    assert out.columns == d.columns and out.count() >= 11
    assert MX.apply(d.limit(0)).count() == 0
    assert MX.apply(d.filter("doc_id < 4")).count() == 3


def test_mixing_drops_nothing_and_repeats_by_the_plan(spark):
    d = table(spark)
    once = {r.doc_id for r in d.select("doc_id").collect()}
    got = Counter(r.doc_id for r in MX.apply(d).select("doc_id").collect())
    assert set(got) == once and max(got.values()) == 2


def test_query_and_stage_mix_up_to_four_repetitions(spark, monkeypatch):
    rows = [(k, " ".join(["w"] * 10), "en", "hot" if k % 3 == 0 else f"s{k % 12}", 1) for k in range(1200)]
    d = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(MX, "table", lambda *_: d)
    uses = MX.query(spark, "").toPandas()
    want = MX.plan(uses.drop_duplicates("doc_id").groupby("source")["n_tokens"].sum().to_dict(), None, 4.0, None)
    weights = uses.groupby("source")["weight"].first().to_dict()
    assert weights == pytest.approx(want.weights) and want.exponent == 0 and weights["hot"] == pytest.approx(1 / 9)
    assert uses["doc_id"].nunique() == 1200
    got = Counter(r.doc_id for r in MX.stage(spark, d, "").select("doc_id").collect())
    assert len(got) == 1200 and got == Counter(uses["doc_id"])
    assert max(got.values()) == 4 and {got[k] for k in range(0, 1200, 3)} == {1}


# ---- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs, n = table(spark), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        n.append((name, docs.count(), out.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert sorted(out.dtypes) == sorted(docs.dtypes)
            docs = spark.createDataFrame(out.collect(), docs.schema)
    kept = {name: (a, b) for name, a, b in n}
    assert kept["quality_rules"][1] < kept["quality_rules"][0] and kept["near_duplicates"][1] <= kept["near_duplicates"][0] and kept["mixing"][1] >= kept["mixing"][0]
    assert corpus_pipeline.run(spark, SF).count() == n[-1][2]


def test_types_and_registry(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names
