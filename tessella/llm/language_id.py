"""Language ID by mixture inference.

A document is a bag of words, a word a draw from one of its languages. Each language has a character trigram model; a word's
likelihood is that of its trigrams (with word marks). Expectation-maximisation estimates the document's language proportions,
and among the nested language sets left by dropping the weakest language the one with the best penalised likelihood (BIC)
is kept.

Defined results. A null text, an empty one and one without any letter get the language `und`, score 0 and no languages. Equal
texts get equal results, ties between languages go to the first in alphabetical order, an empty table gives an empty result.
Without labelled rows every text is `und`, and kept() keeps every row, as there is no language to reject one by. Texts are read
whole; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import struct_of, table, unused

UNKNOWN = "und"

#: Trigrams overlap, so their summed log likelihood counts each letter about three times.
OVERLAP = 3.0

#: Odd multipliers that spread the three letters of a trigram over 32 bits.
SPREAD = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each letter of the lower-cased text the hash row of (letter before, letter, letter after), 0 standing for a word's
    edge; and where in that list each word starts."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    at = np.flatnonzero(letters()[points])
    padded = np.zeros(len(points) + 2, dtype=np.uint32)
    padded[at + 1] = points[at]
    h = padded[at] * SPREAD[0] + padded[at + 1] * SPREAD[1] + padded[at + 2] * SPREAD[2]
    h ^= h >> np.uint32(15)
    return (h * SPREAD[1]) >> np.uint32(32 - bits), np.flatnonzero(np.diff(at, prepend=-2) != 1)


@dataclass
class Model:
    """Log likelihoods [trigram row, language]."""

    langs: list[str]
    logp: np.ndarray
    bits: int
    penalty: float = 1.0

    def infer(self, text: str | None) -> tuple[str, float, list[float]]:
        """Language, score and proportions by language of a whole text."""
        rows, starts = trigrams(text or "", self.bits)
        if not len(rows) or not self.langs:
            return UNKNOWN, 0.0, [0.0] * len(self.langs)
        ll = np.add.reduceat(self.logp[rows], starts, axis=0, dtype=np.float64) / OVERLAP
        share, alone = mixture(ll, np.ones(len(ll)), self.penalty)
        k = int(np.argmax(share))
        # the score is the language's share, or its weight against every other language when it is the only one
        weight = np.exp(np.minimum(alone - alone[k], 0)).sum()
        return self.langs[k], float(1 / weight if share[k] == 1 else share[k]), share.tolist()


def em(ll: np.ndarray, counts: np.ndarray, rounds: int = 60, tol: float = 1e-4) -> tuple[np.ndarray, float]:
    """Mixing proportions that maximise sum(counts * log(exp(ll) @ share)), and that maximum."""
    peak = ll.max(axis=1)
    p = np.exp(ll - peak[:, None])
    total, share, last = counts.sum(), np.full(ll.shape[1], 1 / ll.shape[1]), -np.inf
    for _ in range(rounds):
        mix = p @ share
        now = float(counts @ np.log(mix))
        share = share * ((counts / mix) @ p) / total
        if now - last < tol * max(1.0, abs(total)) * 1e-2:
            break
        last = now
    return share, float(counts @ np.log(p @ share) + counts @ peak)


def mixture(ll: np.ndarray, counts: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Proportions over all languages (0 for those not selected), and the log likelihood of each language alone.

    The language set is chosen by log likelihood - penalty / 2 * (languages - 1) * log(words). The log likelihood is concave in
    the proportions, so no mixture exceeds the best single language by more than its steepest slope there; where that bound is
    below one penalty, no expectation-maximisation is run.
    """
    n, k = ll.shape
    alone = counts @ ll
    best = int(np.argmax(alone))
    step = penalty / 2 * np.log(counts.sum() + 1)
    share = np.zeros(k)
    share[best] = 1.0
    if k == 1 or (counts @ np.expm1(np.minimum(ll - ll[:, [best]], 600))).max() <= step:
        return share, alone
    top, active = alone[best], np.arange(k)
    while len(active) > 1:
        own, value = em(ll[:, active], counts)
        if value - step * (len(active) - 1) > top:
            top, share = value - step * (len(active) - 1), np.zeros(k)
            share[active] = own / own.sum()
        active = np.delete(active, int(np.argmin(own)))
    return share, alone


OUT = struct_of(lang_pred=T.StringType(), score=T.DoubleType(), languages=T.ArrayType(T.StringType()), shares=T.ArrayType(T.DoubleType()))


class LanguageID:
    """fit() on rows with a language, then predicted() on any text column."""

    def __init__(self, docs_per_lang: int = 1500, bits: int = 18, penalty: float = 1.0, smoothing: float = 0.3):
        """docs_per_lang: expected bound of the training sample, by the hash of the id, for each language. bits: trigrams share
        2 ** bits rows, which with the number of languages bounds the model and what reaches the driver."""
        self.docs_per_lang, self.bits, self.penalty, self.smoothing = docs_per_lang, bits, penalty, smoothing
        self.model: Model | None = None

    def fit(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageID:
        rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"), F.col(lang_col).alias("__l")).filter("__l IS NOT NULL AND __t IS NOT NULL")
        counts = {r["__l"]: r["count"] for r in rows.groupBy("__l").count().collect()}
        langs, bits = sorted(counts), self.bits
        cut = F.lit(0)
        for lang in langs:
            cut = F.when(F.col("__l") == lang, F.lit(min(2**32, int(self.docs_per_lang / counts[lang] * 2**32)))).otherwise(cut)
        few = rows.filter(F.pmod(F.xxhash64(F.lit(1), F.col("__id")), F.lit(2**32)) < cut)

        def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = {lang: np.zeros(2**bits, dtype=np.int64) for lang in langs}
            for b in batches:
                for lang, text in zip(b["__l"], b["__t"], strict=True):
                    sums[lang] += np.bincount(trigrams(text, bits)[0], minlength=2**bits)
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "row": at, "n": n[at]})

        table = np.full((2**bits, len(langs)), self.smoothing)
        if langs:
            at = {x: i for i, x in enumerate(langs)}
            for r in few.select("__t", "__l").mapInPandas(counted, "lang string, row long, n long").groupBy("lang", "row").agg(F.sum("n").alias("n")).collect():
                table[r["row"], at[r["lang"]]] += r["n"]
        self.model = Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32), bits, self.penalty)
        return self

    def predicted(self, text: Column) -> Column:
        """A struct of lang_pred, score, languages (the document's set, the largest share first) and shares (their proportions)."""
        model = self.model
        assert model is not None, "fit() comes first"

        @F.pandas_udf(OUT)
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = []
                for lang, score, share in map(model.infer, b):
                    own = sorted((k for k, x in enumerate(share) if x > 0), key=lambda k: -share[k])
                    found.append((lang, score, [model.langs[k] for k in own], [share[k] for k in own]))
                yield pd.DataFrame(found, columns=OUT.fieldNames())

        return of(text)

    def kept(self, docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
        """The rows of docs with a language whose score is at least `least`, with docs' own columns only; all rows if no language
        was learned."""
        if self.model is not None and not self.model.langs:
            return docs
        [v] = unused(docs.columns, "verdict")
        return docs.withColumn(v, self.predicted(F.col(text_col))).filter((F.col(f"{v}.lang_pred") != UNKNOWN) & (F.col(f"{v}.score") >= least)).drop(v)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    lid = LanguageID().fit(docs.filter(~held))
    return docs.select("doc_id", held.alias("held_out"), lid.predicted(F.col("text")).alias("v")).select("doc_id", "held_out", "v.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with one clear main language; learned from the same rows' own marks."""
    return LanguageID().fit(docs).kept(docs)
