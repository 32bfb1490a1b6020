"""Quality by compression: how much better good text's dictionary packs a document than bad text's.

Pairs of zstandard dictionaries, of several sizes, are built from labelled good and bad texts. A document is compressed whole
with each of them; the differences of a pair's sizes, normalised in three ways, are calibrated to a probability on labelled
rows kept out of the dictionaries. Nothing but these differences is in the score: no length, no share of compression alone.

Defined results. A null or empty text has no size difference and gets the calibration's score there. Equal texts get equal
scores, an empty table an empty result. If the dictionaries or the calibration miss either label, the score is the share of
label 1 (0.5 without labels). Extra columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import sampled, table


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A dictionary of at most `size` bytes; where there is too little text to train on, the joined texts themselves."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


class Differences:
    """Normalised differences of one text's compressed sizes with pairs of (good, bad) dictionaries."""

    def __init__(self, pairs: list[tuple[bytes, bytes]], level: int):
        self.pairs = [tuple(self.compressor(d, level) for d in pair) for pair in pairs]

    @staticmethod
    def compressor(d: bytes, level: int) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d)) if d else zstandard.ZstdCompressor(level=level)

    def features(self, text: str | None) -> list[float]:
        """For each pair the difference per byte of text, per byte of the smaller result, and its signed logarithm."""
        raw, out = (text or "").encode("utf-8", "surrogatepass"), []
        for pair in self.pairs:
            good, bad = (len(c.compress(raw)) for c in pair)
            diff = bad - good
            out += [diff / (len(raw) + 16), diff / min(good, bad), math.copysign(math.log1p(abs(diff)), diff)]
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (the intercept last) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), ridge * len(x) * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class CompressionQuality:
    """fit() on labelled texts, then score() of any text column."""

    def __init__(
        self, fit_rows: int = 12_000, fit_bytes: int = 16_000_000, dict_bytes: tuple[int, ...] = (2_048, 8_192, 32_768), level: int = 3
    ):
        """fit_rows bounds the labelled texts that are read at all (chosen by the hash of their id), fit_bytes the bytes of one
        label's texts that a dictionary is built from, on the driver."""
        self.fit_rows, self.fit_bytes, self.dict_bytes, self.level = fit_rows, fit_bytes, dict_bytes, level
        self.pairs: list[tuple[bytes, bytes]] = []
        self.mean = self.scale = self.weights = None
        self.constant: float | None = None

    def build(self, good: list[bytes], bad: list[bytes]) -> CompressionQuality:
        self.pairs = [(dictionary(good, size), dictionary(bad, size)) for size in self.dict_bytes]
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> CompressionQuality:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.weights = logistic((x - self.mean) / self.scale, y)
        return self

    def fit(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> CompressionQuality:
        """Half of the labelled rows (by hash) build the dictionaries, as many bytes of good as of bad text; the other half
        calibrates. Dictionary texts come to the driver, of the others only their differences."""
        labels = labels.select(F.col(id_col).alias("__id"), F.col("quality").alias("__q")).filter("__q IN (0, 1) AND __id IS NOT NULL")
        few = sampled(labels, F.col("__id"), self.fit_rows, labels.count(), salt=6)
        rows = (
            docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
            .join(few, "__id")
            .select("__q", "__t", F.xxhash64(F.lit(9), "__id", "__t").alias("__h"), F.octet_length("__t").alias("__n"))
        )
        found = sorted((r["__q"], r["__h"], r["__n"]) for r in rows.select("__q", "__h", "__n").collect())
        count = Counter((q, h % 2) for q, h, _ in found)
        if not all(count[q, part] for q in (0, 1) for part in (0, 1)):
            ones = sum(q for q, _, _ in found)
            self.constant = ones / len(found) if found else 0.5
            return self
        sizes = {q: [(h, n) for p, h, n in found if p == q and h % 2 == 0 and n <= self.fit_bytes] for q in (0, 1)}
        most = min(self.fit_bytes, *(sum(n for _, n in own) for own in sizes.values()))
        wanted = F.lit(False)
        for q, own in sizes.items():
            own = [(h, n) for h, n in own if n <= most]
            fits = [h for (h, _), total in zip(own, accumulate(n for _, n in own), strict=True) if total <= most]
            if fits:
                wanted |= (F.col("__q") == q) & (F.col("__h") <= fits[-1]) & (F.col("__n") <= most)
        texts = sorted((r["__q"], r["__h"], r["__t"].encode("utf-8", "surrogatepass")) for r in rows.filter("pmod(__h, 2) = 0").filter(wanted).collect())
        self.build(*([t for q, _, t in texts if q == label and t] for label in (1, 0)))
        rest = rows.filter("pmod(__h, 2) = 1").select("__q", "__h", self.differences(F.col("__t")).alias("x")).collect()
        rest = sorted((r["__h"], r["__q"], tuple(r["x"])) for r in rest)
        return self.calibrate(np.array([x for _, _, x in rest]), np.array([q for _, q, _ in rest], dtype=float))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def differences(self, text: Column) -> Column:
        pairs, level = self.pairs, self.level

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = Differences(pairs, level)
            for b in batches:
                yield pd.Series([own.features(t) for t in b], dtype=object)

        return of(text)

    def score(self, text: Column) -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        own = self

        @F.pandas_udf(T.DoubleType())
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            differences = Differences(own.pairs, own.level)
            for b in batches:
                yield pd.Series(own.scores(np.array([differences.features(t) for t in b]).reshape(len(b), len(own.mean))))

        return of(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the quality score of every document, learned from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = CompressionQuality().fit(docs, table(spark, sf_dir, "labels").filter(~held))
    scored = docs.select("doc_id", held.alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
