"""The queries' columns and the pipeline's stages against SQL or brute force over whole tables."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import language_id as LI
from tessella.llm import mixing as MX
from tessella.llm import near_duplicates as ND
from tessella.llm import packing as PK
from tessella.llm import quality_rules as QR
from tessella.llm import sharding as SH
from tests.llm.test_documents import ODD, components, frame, slow_best_fit, slow_similarity, slow_statistics, weighted

SF = "/root/testdata/sf0.001"


def texts_of(sf):
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{sf}/documents.parquet'").fetchall())


def test_near_duplicate_query_loses_no_link(spark):
    """Recall of the links of ids divisible by 50 to all rows, and no class without a link."""
    sf = "/root/testdata/sf0.01"
    got = ND.query(spark, sf)
    assert got.columns == ["doc_id", "class_id"]
    of = {r.doc_id: r.class_id for r in got.collect()}
    sets = {i: weighted(t) for i, t in texts_of(sf).items()}
    assert set(of) == set(sets)
    linked = lambda a, b: a != b and bool(sets[a].keys() & sets[b].keys()) and slow_similarity(sets[a], sets[b]) >= 0.8
    links = [(a, b) for a in sets if a % 50 == 0 for b in sets if linked(a, b)]
    assert all(of[a] == of[b] for a, b in links)
    members = defaultdict(list)
    for i, c in of.items():
        members[c].append(i)
    for c, own in members.items():
        assert c == min(own)
        assert len(own) == 1 or all(any(linked(a, b) or sets[a] == sets[b] for b in own if a != b) for a in own)


def test_packing_query(spark):
    from tokenizers import Tokenizer

    got = PK.query(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert dict(got.dtypes)["piece"] == "int" and all(t == "bigint" for c, t in got.dtypes if c not in ("doc_id", "piece"))
    rows, tok = got.toPandas(), Tokenizer.from_file(PK.vocabulary_files()[0])
    by = {i: own.sort_values("piece") for i, own in rows.groupby("doc_id")}
    texts = texts_of(SF)
    assert set(by) == set(texts)
    for i, t in texts.items():
        ids, own = tok.encode(t, add_special_tokens=False).ids + [0], by[i]
        assert list(own["piece"]) == list(range(len(own))) and list(own["start"]) == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() == len(ids)
        assert set(own["length"][1:]) <= {2048} and own["length"].iloc[0] <= 2048
        assert [zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes()) for s, n in zip(own["start"], own["length"], strict=True)] == list(own["ids_crc32"])
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert list(own["offset"]) == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 2048
    assert rows["sequence_id"].nunique() == len(slow_best_fit(rows["length"], 2048))


def test_sharding_query(spark):
    """Size, checksum and slots by SQL and brute force; equal texts together; shards near the mean."""
    sf = "/root/testdata/sf0.01"
    got = SH.query(spark, sf)
    assert set(got.columns) == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    rows = got.toPandas()
    sizes = dict(duckdb.sql(f"select doc_id, coalesce(strlen(text), 0) + 16 from '{sf}/documents.parquet'").fetchall())
    texts = texts_of(sf)
    assert dict(zip(rows["doc_id"], rows["size"], strict=True)) == sizes
    assert all(zlib.crc32(texts[i].encode()) == c for i, c in zip(rows["doc_id"], rows["text_crc32"], strict=True))
    assert set(rows["law"]) == {"bytes"} and rows["grown_shard"].isna().all() and set(rows["shard"]) <= set(range(40))
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    shard = dict(zip(rows["doc_id"], rows["shard"], strict=True))
    together, bytes_of = defaultdict(set), Counter()
    for i, t in texts.items():
        together[t].add(shard[i])
        bytes_of[t] += sizes[i]
    mean = sum(sizes.values()) / 40
    assert all(len(s) == 1 for t, s in together.items() if bytes_of[t] <= mean)
    held = rows.groupby("shard")["size"].sum()
    assert len(held) == 40 and held.max() <= mean + max(bytes_of.values())


def test_pipeline_against_brute_force(spark):
    """Each stage's rows from what the one before kept, by plain loops over the fitted models and all pairs."""
    docs, stages = spark.read.parquet(f"{SF}/documents.parquet"), dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    own = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns

    rules = QR.QualityRules().fit(docs, labels)
    want = set()
    for i, r in own.items():
        base = slow_statistics(r.text)
        if base[0] >= 50 and 100 * base[4] <= 50 * base[0] and rules.forest.scores(np.array([QR.statistics(r.text)[1]]))[0] <= rules.forest.threshold:
            want.add(i)
    docs = stages["quality_rules"](spark, docs, SF)
    assert docs.columns == columns and Counter(r.doc_id for r in docs.collect()) == Counter(want) and 0 < len(want) < len(own)

    docs = spark.createDataFrame(docs.collect(), docs.schema)
    model = LI.LanguageID().fit(docs).model
    found = {i: model.infer(own[i].text) for i in want}
    want = {i for i, (lang, score, _) in found.items() if lang != LI.UNKNOWN and score >= 0.5}
    docs = stages["language_id"](spark, docs, SF)
    assert docs.columns == columns and Counter(r.doc_id for r in docs.collect()) == Counter(want)

    docs = spark.createDataFrame(docs.collect(), docs.schema)
    want = set(components([(i, own[i].text) for i in sorted(want)]).values())
    docs = stages["near_duplicates"](spark, docs, SF)
    assert docs.columns == columns and Counter(r.doc_id for r in docs.collect()) == Counter(want)

    docs = spark.createDataFrame(docs.collect(), docs.schema)
    uses, made = MX.mixture(docs, most_repetitions=MX.MOST_REPETITIONS)
    docs = stages["mixing"](spark, docs, SF)
    times = Counter(r.doc_id for r in docs.collect())
    assert docs.columns == columns and set(times) == want and times == Counter(r.id for r in uses.collect())
    tokens = Counter()
    for i, n in times.items():
        tokens[own[i].source or MX.NO_SOURCE] += n * (len((own[i].text or "").split()) or 0)
    longest = max(len(own[i].text.split()) for i in want)
    assert all(made.budgets[s] <= n < made.budgets[s] + longest + 1 for s, n in tokens.items())

    out = stages["packing"](spark, docs, SF).toPandas()
    firsts = Counter(out.loc[out["piece"] == 0, "doc_id"])
    assert firsts == times and out["sequence_id"].nunique() == len(slow_best_fit(out["length"], 2048))
    assert corpus_pipeline.run(spark, SF).count() == len(out)


@pytest.mark.parametrize("rows", [ODD, []])
def test_pipeline_on_odd_rows_and_empty_tables(spark, tmp_path, rows):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns; then tables without rows."""
    good = [(1000 + k, f"Line {k} of it. " + " ".join(f"word{(k * 7 + j * j) % 400}" for j in range(80))) for k in range(8 if rows else 0)]
    schema = frame(spark, ODD).schema
    d = frame(spark, [*rows, *good, *good[:1]]) if rows else spark.createDataFrame([], schema)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i, _ in good], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == d.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").collect()} <= {i for i, _ in good}
    assert out.count() >= (1 if rows else 0) and (rows or out.count() == 0)
    assert out.filter(F.col("length") > 2048).count() == 0
