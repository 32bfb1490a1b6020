"""The byte-level tokenizer and the divergences of sources against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import divergence as DV

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def slow(docs, least_docs, top=10):
    """rows of (text, lang, source) by dictionaries and Python's integers."""
    docs = [tuple(x or "" for x in d) for d in docs]
    seen, n, groups = Counter(), Counter(), {(d[1], d[2]) for d in docs}
    for text, lang, source in docs:
        for t in set(terms_of(text)):
            seen[lang, t] += 1
        for t in terms_of(text):
            n[lang, source, t] += 1
    out = set()
    for lang in {d[1] for d in docs}:
        kept = sorted(t for (x, t), k in seen.items() if x == lang and k >= least_docs)
        own = sorted(s for x, s in groups if x == lang)
        total = {s: sum(n[lang, s, t] for t in kept) for s in own}
        share = lambda c, total: 1 + 10**9 * (c + 2) // (total + 2 * len(kept))  # noqa: B023, E731
        p = {(s, t): share(n[lang, s, t], total[s]) for s in own for t in kept}
        q = {t: share(sum(n[lang, s, t] for s in own), sum(total.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            items = {"pair": [(sum(f(p[s, t], p[o, t]) for t in kept), o) for o in own if o != s], "term": [(f(p[s, t], q[t]), t) for t in kept if n[lang, s, t] and p[s, t] > q[t]]}
            for part, rows in items.items():
                rows.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k) for k, (v, item) in enumerate(rows, 1) if part == "pair" or k <= top}
    return out


def found(spark, docs, **options):
    df = spark.createDataFrame([(k, *d, 0) for k, d in enumerate(docs)], SCHEMA).withColumn("part", F.lit("clash")).withColumn("term", F.lit(1)).withColumn("n", F.lit(1))
    rows = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in DV.divergences(df, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def batch(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def test_hashes_are_xxhash64():
    rng = random.Random(1)
    words = [bytes(rng.randrange(128, 256) for _ in range(n)) for n in [*range(1, 70), *range(1, 70)]]
    ends = np.cumsum([len(w) for w in words])
    got = DV.hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], np.array([len(w) for w in words]))
    assert got.tolist() == [xxhash.xxh64_intdigest(w) for w in words]


def random_texts(seed, n):
    rng = random.Random(seed)
    alphabet = "aAbBzZ@[`{~ \x00\x7f0é日ßİ𝄞\n"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("weak", [False, True])
def test_counts_of_a_batch(monkeypatch, weak):
    if weak:  # nearly all hashes collide
        whole = DV.hashes
        monkeypatch.setattr(DV, "hashes", lambda *a: whole(*a) & np.uint64(1))
    texts = ["", "", *random_texts(2, 300), "", "End", "end"]
    data, offsets = batch(texts)
    group = np.arange(len(texts)) % 3
    got = Counter(), Counter()
    for g, terms, n, docs in DV.counted(data, offsets, group):
        for x, t, a, b in zip(g.tolist(), terms, n.tolist(), docs.tolist(), strict=True):
            got[0][x, t.decode()] += a
            got[1][x, t.decode()] += b
    want = Counter(), Counter()
    for k, t in enumerate(texts):
        want[0].update((k % 3, w) for w in terms_of(t))
        want[1].update((k % 3, w) for w in set(terms_of(t)))
    assert got == want


def test_windows_and_long_documents_change_nothing(monkeypatch):
    texts = [*random_texts(3, 50), "x" * 500 + " y" * 200, "é" * 300, "a b " * 100]
    data, offsets = batch(texts)

    def total():
        c = defaultdict(lambda: np.zeros(2, int))
        for g, terms, n, docs in DV.counted(data, offsets, np.arange(len(texts)) % 2):
            for x, t, a, b in zip(g.tolist(), terms, n.tolist(), docs.tolist(), strict=True):
                c[x, t] += (a, b)
        return {k: tuple(v.tolist()) for k, v in c.items()}

    whole = total()
    monkeypatch.setattr(DV, "WINDOW_BYTES", 64)
    assert total() == whole


def test_shares_are_exact_for_large_counts():
    rng = random.Random(4)
    for _ in range(200):
        total = rng.randrange(1, 8 * 10**15)
        count, terms = rng.randrange(total + 1), rng.randrange(1, 10**9)
        assert DV.shares(np.array([count]), total, terms)[0] == 1 + 10**9 * (count + 2) // (total + 2 * terms)


def test_against_a_plain_version(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{chr(97 + k)}" for k in range(26)] + ["Été", "日本", "É", "zz"]
    docs = [(" ".join(rng.choices(vocabulary[k % 3 * 4 :], k=rng.randrange(1, 30))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "S3", None, "é"])) for k in range(250)]
    docs += [(None, "en", "silent"), ("", "de", "a"), ("only once", "de", "b"), (None, None, None), *[("same same", "en", "s1")] * 12, ("long " * 30_000, "fr", "s2"), ("1 2 3", "xx", "alone")]
    want = slow(docs, 10)
    assert found(spark, docs) == want
    # many blocks, and the join of a large table of languages
    monkeypatch.setattr(DV, "BLOCK_CELLS", 20)
    monkeypatch.setattr(DV, "looked_up", lambda rows, few, on, spread: looked(rows, few, on, spread, most=0))
    assert found(spark, docs) == want


looked = DV.looked_up


def test_an_empty_table(spark):
    assert found(spark, []) == set()
    assert found(spark, [(None, None, None)]) == set()
