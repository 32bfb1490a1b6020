"""Vector codes and nearest neighbours against plain versions."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import neighbours as NB
from tessella.llm import vector_codes as VC

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).withColumn("vec", F.lit("clash")).withColumn("code", F.lit(1)).withColumn("score", F.lit("clash")).withColumn("rank", F.lit(7))


ODD = [
    (None, [0.5] * 8, 1), (1, None, 1), (2, [], 1), (3, [1.0] * 7 + [None], 1), (4, [float("nan")] * 8, 1), (5, [float("inf")] * 8, 1), (600, [1.0] * 4, 1), (7, [1e30] * 8, 1),
    *[(9, [0.25] * 8, None)] * 3, (10, [0.25] * 8, 2), (10, [-0.25] * 8, 2), (11, [0.0] * 8, 2), (12, [-1e-9] * 8, None),
]


# ---- vector codes


@pytest.mark.parametrize("spread", [2, 30, 10**7])
def test_exponion_finds_the_nearest_first_entry(spread):
    rng = np.random.default_rng(spread)
    entries, x = rng.integers(-spread, spread + 1, (3, 20, 4)), rng.integers(-spread, spread + 1, (500, 3, 4))
    entries[:, 7], entries[:, 3], x[:60] = entries[:, 2], entries[:, 2], entries[:, rng.integers(0, 20, 60)].transpose(1, 0, 2)
    code, error = VC.Codebook(entries).nearest(x, rng.integers(0, 20, (500, 3)))
    d = ((x[:, :, None] - entries[None]) ** 2).sum(3)
    assert (code == d.argmin(2)).all() and (error == d.min(2)).all()


def slow_codes(rows, parts, entries, rounds, size):
    """vec_id, code, error, label_error, sha of (vec_id, vector, label) rows."""
    limit = math.sqrt(2**62 / size) / 512
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) < limit for x in v)]
    first = {}
    for i, v, _ in kept:
        first[i] = min(v, first.get(i, v))
    ids = sorted(first, key=lambda i: (i is None, i or 0))[:entries]
    w = size // parts
    cut = lambda v, p: tuple(v[p * w : p * w + w])
    book = {p: [cut(first[i], p) for i in ids] for p in range(parts)}
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, v: min((square(v, e), k) for k, e in enumerate(book[p]))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                own[p, near(p, cut(v, p))[1]].append(cut(v, p))
        for (p, k), vs in own.items():
            book[p][k] = tuple(sum(c) // len(vs) for c in zip(*vs, strict=True))
    sha = hashlib.sha256(",".join(str(x) for p in range(parts) for e in book[p] for x in e).encode()).hexdigest()
    done = [(i, lab, [near(p, cut(v, p)) for p in range(parts)]) for i, v, lab in kept]
    total = defaultdict(int)
    for _, lab, at in done:
        total[lab] += sum(d for d, _ in at)
    return sorted(((i, "".join(f"{k:02x}" for _, k in at), sum(d for d, _ in at), total[lab], sha) for i, lab, at in done), key=str)


def codes(df, *args):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in VC.VectorCodes(*args)(df).collect()), key=str)


def test_codes_of_odd_rows(spark, monkeypatch):
    rng = random.Random(3)
    rows = ODD + [(20 + k, np.float32([rng.gauss(0, 1) for _ in range(8)]).tolist(), rng.choice([1, 2, None])) for k in range(120)]
    want = slow_codes(rows, 4, 10, 2, 8)
    assert codes(frame(spark, rows), 4, 10, 2) == want
    whole = VC.looked_up
    monkeypatch.setattr(VC, "looked_up", lambda *a: whole(*a, most=0))
    monkeypatch.setattr(VC, "AT_ONCE", 7)
    assert codes(frame(spark, rows).repartition(5), 4, 10, 2) == want
    # more entries than ids
    assert codes(frame(spark, rows[:14]), 2, 64, 3) == slow_codes(rows[:14], 2, 64, 3, 8)


def test_codes_of_no_rows(spark):
    for rows in ([], ODD[1:6], [(None, None, None)]):
        df = VC.VectorCodes()(frame(spark, rows))
        assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and df.count() == 0


def test_code_query_follows_the_contract(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in VC.query(spark, SF).collect()), key=str)
    assert got == slow_codes(rows, 16, 64, 2, 64)


# ---- nearest neighbours


def slow_neighbours(rows, k, every):
    """All (query id, [(score, id) in order]) by row, over the rows that take part."""
    kept = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    size = len(min(kept, key=lambda r: (r[0], len(r[1])))[1]) if kept else 0
    kept = [r for r in kept if len(r[1]) == size]
    x = np.array([v for _, v in kept], float).reshape(len(kept), -1)
    out = []
    for n, (i, _) in enumerate(kept):
        if i % every == 0:
            d = np.sqrt(((x - x[n]) ** 2).sum(1))
            out.append((i, sorted((float(s), j) for m, (s, (j, _)) in enumerate(zip(d, kept, strict=True)) if m != n)[:k]))
    return sorted(out)


def neighbours(df, every, **options):
    """The same, of the operator; rows of one query id are put apart by their ranks."""
    found = NB.Neighbours(**options)(df, lambda i: F.pmod(i, F.lit(every)) == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    by = defaultdict(lambda: defaultdict(list))
    for r in found.collect():
        by[r["query_id"]][r["rank"]].append((r["score"], r["vec_id"]))
    return {q: {k: sorted(v) for k, v in ranks.items()} for q, ranks in by.items()}


def by_rank(found):
    out = defaultdict(lambda: defaultdict(list))
    for q, nearest in found:
        for k, x in enumerate(nearest, 1):
            out[q][k].append(x)
    return {q: {k: sorted(v) for k, v in ranks.items()} for q, ranks in out.items()}


def test_chi_square_quantiles():
    for m, chance, value in ((2, 0.95, 5.991), (8, 0.9, 13.362), (12, 0.95, 21.026)):
        assert NB.chi_square_quantile(chance, m) == pytest.approx(value, abs=1e-3)


def test_a_tree_puts_each_point_in_its_leaf():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 4, (700, 3)).astype(float)
    tree = NB.KdTree(points, 10).ready()
    assert sorted(tree.order.tolist()) == list(range(700))
    leaf = tree.leaf_of(points)
    assert all((leaf[tree.order[lo:hi]] == k).all() for k, (lo, hi) in enumerate(zip(tree.ends[:-1], tree.ends[1:], strict=True)))
    assert all(len({tuple(p) for p in points[leaf == k]}) == 1 or (leaf == k).sum() <= 10 for k in set(leaf.tolist()))
    assert len(NB.KdTree(np.zeros((0, 3)), 5).ends) == 2 and NB.KdTree(np.ones((9, 3)), 2).ready().leaf_of(np.ones((2, 3))).tolist() == [0, 0]


def test_neighbours_of_odd_rows_copies_and_ties(spark):
    # a grid has many ties; a chance of nearly 1 verifies all that can be near
    rng = random.Random(6)
    rows = [(i, v) for i, v, _ in ODD] + [(100 + k, [float(rng.randrange(3)) for _ in range(8)]) for k in range(150)]
    rows += [(1000 + k, [0.5] * 8) for k in range(60)] + [(1010, [0.5] * 8), (1010, [2.0] * 8)]  # copies, and one id twice
    df = frame(spark, [(i, v, 1) for i, v in rows])
    want = by_rank(slow_neighbours(rows, 10, 10))
    for options in ({}, {"cell_rows": 8, "block_rows": 4}):
        got = neighbours(df, 10, chance=1 - 1e-12, **options)
        assert got.keys() == want.keys()
        for q in want:
            assert {k: [i for _, i in v] for k, v in got[q].items()} == {k: [i for _, i in v] for k, v in want[q].items()}
            assert [s for v in got[q].values() for s, _ in v] == pytest.approx([s for k in got[q] for s, _ in want[q][k]])


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    assert neighbours(frame(spark, [(*r, 1) for r in rows]), 1) == by_rank(slow_neighbours(rows, 10, 1))
    for rows in ([], [(0, [0.0, 0.0]), (1, None)], [(0, [1.0])]):
        assert neighbours(frame(spark, [(*r, 1) for r in rows]), 1) == {}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall_of_the_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = dict(slow_neighbours(rows, 10, 100))
    got = defaultdict(list)
    for r in NB.query(spark, sf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got.keys() == want.keys() and all(len(v) == 10 and v == sorted(v) for v in got.values())
    hits = [len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want]
    assert sum(hits) / len(hits) >= 9.3
    exact = dict(rows)
    for q, found in got.items():
        for s, i in found:
            assert s == pytest.approx(math.dist(exact[q], exact[i]), rel=1e-12)
