"""Quality rules: rule statistics of whole texts, judged by an isolation forest.

Defined results. A null text has no words; it and every text of under `min_words` words fail the base rules. Repeated rows
get equal verdicts, an empty table gives an empty result, columns beyond the text pass through untouched (a column named
like an output gives way to it). Texts are read whole, whatever their length.
"""

from __future__ import annotations

import itertools
import math
import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessella.llm.common import materialise, struct_of, table, unused

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The coordinates in which the forest splits.
RATIOS = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "shouts", "distinct")


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found at least twice in the list."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    k = len(seen)
    pairs = ids[:-1] * k + ids[1:]
    if k >= 1_500_000:  # a third factor could leave 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * k + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(keys)] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base statistics of a whole text and the ratios the forest reads."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    some, length = max(n, 1), max(len(text), 1)
    caps = sum(map(str.isupper, text)) if n else 0
    ratios = [
        math.log1p(n), chars / some, symbols / some, dup / max(len(lines), 1), repeats / some, caps / length,
        sum(map(text.count, "0123456789")) / length, sum(map(text.count, ".,;:")) / some, text.count("!") / some, len(set(words)) / some,
    ]
    return [n, chars, symbols, dup, repeats], ratios


@dataclass(frozen=True)
class Forest:
    """Isolation trees in flat arrays [tree, node]; a node with feature -1 is a leaf and `value` its path length."""

    feature: np.ndarray
    value: np.ndarray
    depth: int
    expected: float
    threshold: float = 0.6

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path), 0 to 1; high values are anomalous."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for f, v in zip(self.feature, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                split = f[at]
                inner = split >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(split, 0)] >= v[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            total += v[at]
        return np.exp2(-(total / max(len(self.feature), 1)) / max(self.expected, 1e-9))


def expected_path(n: np.ndarray | int) -> np.ndarray:
    """The mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    more = np.maximum(n, 3)
    return np.where(n < 2, 0.0, np.where(n < 3, 1.0, 2 * (np.log(more - 1) + 0.5772156649015329) - 2 * (more - 1) / more))


#: What a level of trees is grown from: measure(feature, value, k, reached) gives of each of its nodes the points held and the least and
#: greatest value of feature k among them.
Measure = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def tallies(columns: np.ndarray, feature: np.ndarray, value: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree's next level from the points in columns [feature, point]: of each node the points held and the range of feature k.
    A point that ended in a leaf above is counted in some node that the level doesn't reach."""
    n, width = columns.shape[1], len(k)
    flat, point = columns.ravel(), np.arange(n)
    start = np.maximum(feature, 0).astype(np.int64) * n
    at = np.zeros(n, dtype=np.int64)
    for _ in range(width.bit_length() - 1):
        split = start.take(at)
        split += point
        right = flat.take(split) >= value.take(at)
        at += at
        at += 1
        at += right
    at -= width - 1
    own = flat.take(k.take(at) * n + point)
    low, high = np.full(width, np.inf), np.full(width, -np.inf)
    np.minimum.at(low, at, own)
    np.maximum.at(high, at, own)
    return np.bincount(at, minlength=width), low, high


def grown(measure: Measure, trees: int, depth: int, scale: np.ndarray, pad: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Feature and value of random trees, all grown level by level. A split is uniform over the node's range widened by pad * scale
    on both sides, so that a statistic without spread among the fitted rows (symbols, say) can still set other rows apart. Nodes
    without points end there, those with one point from depth 3 on."""
    size = 2 ** (depth + 1) - 1
    feature, value = np.full((trees, size), -1, dtype=np.int8), np.zeros((trees, size))
    usable = np.flatnonzero(scale > 0)
    reached = np.ones((trees, 1), dtype=bool)
    for d in range(depth + 1):
        level, width = slice(2**d - 1, 2 ** (d + 1) - 1), 2**d
        last = d == depth or not len(usable)
        k = np.zeros((trees, width), dtype=np.int64) if last else usable[rng.integers(len(usable), size=(trees, width))]
        held, low, high = measure(feature[:, : width - 1], value[:, : width - 1], k, reached)
        leaf = np.ones_like(reached) if last else (held == 0) | (held == 1) & (d > 2)
        value[:, level] = np.where(reached & leaf, d + expected_path(held), 0.0)
        inner = reached & ~leaf
        if not inner.any():
            break
        low, high = np.where(inner, low, 0.0), np.where(inner, high, 0.0)
        cut = rng.uniform(low - pad * scale[k], high + pad * scale[k])
        feature[:, level] = np.where(inner, k, -1)
        value[:, level] += np.where(inner, cut, 0.0)
        reached = np.repeat(inner, 2, axis=1)
    return feature, value


def fit_forest(x: np.ndarray, scale: np.ndarray, trees: int = 120, points: int = 2048, pad: float = 1.0, seed: int = 11) -> Forest:
    """Random trees over rows x that are at hand, each from `points` of them."""
    rng = np.random.default_rng(seed)
    points = min(points, len(x))
    depth = max(1, math.ceil(math.log2(max(points, 2))))
    own = [np.ascontiguousarray(x[rng.choice(len(x), points, replace=False)].T) for _ in range(trees)]

    def measure(feature: np.ndarray, value: np.ndarray, k: np.ndarray, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held, low, high = zip(*map(tallies, own, feature, value, k), strict=True)
        return np.array(held), np.array(low), np.array(high)

    return Forest(*grown(measure, trees, depth, scale, pad, rng), depth, float(expected_path(points)))


def threshold_of(good: np.ndarray, bad: np.ndarray, good_weight: float) -> float | None:
    """The score above which a row is rejected: the middle of the range where good_weight times the share of good rows
    rejected plus the share of bad rows kept is least. None without good rows."""
    if not len(good):
        return None
    both = np.unique(np.concatenate([good, bad]))
    cuts = np.append((both[1:] + both[:-1]) / 2, both[-1] + 0.02)
    lost = 1 - np.searchsorted(np.sort(good), cuts, side="right") / len(good)
    kept = np.searchsorted(np.sort(bad), cuts, side="right") / max(len(bad), 1)
    cost = good_weight * lost + kept
    return float(np.median(cuts[cost <= cost.min() + 1e-12]))


def cheapest_cut(scores: DataFrame, good_weight: float) -> float | None:
    """threshold_of over a table of (score, good), scores from 0 to 1. Rows of one score are one; running counts are kept inside 4096
    parts of the range, and their starts are sums over the parts."""
    by = materialise(scores.groupBy("score").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")), "scores")
    by = by.withColumn("part", F.floor(F.col("score") * 4096).cast("int"))
    order = Window.orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = by.groupBy("part").agg(F.sum("g").alias("gs"), F.sum("b").alias("bs"), F.min("score").alias("first"))
    total = parts.agg(F.coalesce(F.sum("gs"), F.lit(0)), F.coalesce(F.sum("bs"), F.lit(0))).head()
    assert total is not None
    if not total[0]:
        return None
    parts = parts.select("part", F.coalesce(F.sum("gs").over(before), F.lit(0)).alias("gs"), F.coalesce(F.sum("bs").over(before), F.lit(0)).alias("bs"), F.lead("first").over(order).alias("after"))
    inside = Window.partitionBy("part").orderBy("score")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    cuts = by.select("part", "score", F.sum("g").over(upto).alias("g"), F.sum("b").over(upto).alias("b"), F.lead("score").over(inside).alias("next"))
    cuts = cuts.join(F.broadcast(parts), "part").select(
        F.coalesce((F.col("score") + F.coalesce("next", "after")) / 2, F.col("score") + 0.02).alias("cut"),
        (F.lit(good_weight) * (1 - (F.col("gs") + F.col("g")) / total[0]) + (F.col("bs") + F.col("b")) / max(total[1], 1)).alias("cost"),
    )
    least = cuts.agg(F.min("cost")).head()
    assert least is not None
    middle = cuts.filter(F.col("cost") <= least[0] + 1e-12).agg(F.median("cut")).head()
    assert middle is not None
    return float(middle[0])


#: Rows that a task walks down the trees at once.
WALKED = 20_000


def points_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """fold, good and x [row, feature] of about WALKED rows at a time."""
    held: list[pa.RecordBatch] = []
    for b in itertools.chain(batches, [None]):
        if b is not None:
            held.append(b)
        if held and (b is None or sum(map(len, held)) >= WALKED):
            t = pa.Table.from_batches(held).combine_chunks()
            x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), len(RATIOS))
            yield t["fold"].to_numpy(), t["good"].to_numpy(), x
            held = []


def measured(rows: DataFrame, each: int) -> Measure:
    """Levels of forests of `each` trees from all rows (fold, good, x), as one aggregation a level: the first forest's trees hold every
    row, those of the forest after it all but fold 0, and so on."""

    def measure(feature: np.ndarray, value: np.ndarray, k: np.ndarray, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        trees, width = k.shape
        sent = zlib.compress(pickle.dumps((feature, value, np.where(reached, k, 0), reached)), 1)  # most nodes are never reached

        def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            feature, value, k, reached = pickle.loads(zlib.decompress(sent))
            held, low, high = np.zeros(k.shape, dtype=np.int64), np.full(k.shape, np.inf), np.full(k.shape, -np.inf)
            for fold, _, x in points_of(batches):
                parts = [np.ascontiguousarray(x[fold != g - 1].T) for g in range(trees // each)]
                for t in range(trees):
                    h, a, b = tallies(parts[t // each], feature[t], value[t], k[t])
                    held[t] += h
                    np.minimum(low[t], a, out=low[t])
                    np.maximum(high[t], b, out=high[t])
            node = np.flatnonzero(reached & (held > 0))
            yield pa.RecordBatch.from_pydict({"node": node, "held": held.ravel()[node], "low": low.ravel()[node], "high": high.ravel()[node]})

        kinds = struct_of(node=T.LongType(), held=T.LongType(), low=T.DoubleType(), high=T.DoubleType())
        got = rows.mapInArrow(level, kinds).groupBy("node").agg(F.sum("held").alias("held"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        out = np.zeros(trees * width, dtype=np.int64), np.full(trees * width, np.inf), np.full(trees * width, -np.inf)
        for whole, name in zip(out, ("held", "low", "high"), strict=True):
            whole[got["node"].to_numpy()] = got[name].to_numpy()
        return out[0].reshape(k.shape), out[1].reshape(k.shape), out[2].reshape(k.shape)

    return measure


def cross_fitted(rows: DataFrame, good_weight: float, folds: int = 5, trees: int = 120, most_depth: int = 11, pad: float = 1.0, seed: int = 11) -> Forest:
    """From a table of (fold, good, x): the forest of all good rows, with the threshold from scores that each row gets from a forest of
    the other folds' good rows. Every tree holds every such row, down to most_depth levels. Without any good row the trees are of all
    rows and the threshold is the forest's default."""
    x = [F.col("x")[i] for i in range(len(RATIOS))]
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.array(*[F.count_if(F.col("good") & (F.col("fold") != k)) for k in range(folds)]).alias("others"),
        F.array(*[F.when(F.min(c) < F.max(c), F.stddev_pop(c)).otherwise(0.0) for c in x]).alias("scale"),
    ).head()
    assert facts is not None
    scale = np.array([float(f"{v or 0.0:.9g}") for v in facts["scale"]])  # the order of summation is left out
    points = [facts["good"] or facts["n"], *(facts["others"] if facts["good"] else [])]
    depth = min(most_depth, max(1, math.ceil(math.log2(max(points[0], 2)))))
    own = rows.filter("good") if facts["good"] else rows
    feature, value = grown(measured(own, trees), trees * len(points), depth, scale, pad, np.random.default_rng(seed))
    forests = [Forest(feature[i * trees : (i + 1) * trees], value[i * trees : (i + 1) * trees], depth, float(expected_path(n))) for i, n in enumerate(points)]
    if not facts["good"]:
        return forests[0]
    sent = zlib.compress(pickle.dumps([forest if n else forests[0] for forest, n in zip(forests[1:], points[1:], strict=True)]), 1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = pickle.loads(zlib.decompress(sent))
        for fold, good, x in points_of(batches):
            score = np.zeros(len(x))
            for k, forest in enumerate(judges):
                score[fold == k] = forest.scores(x[fold == k])
            yield pa.RecordBatch.from_pydict({"score": score, "good": good})

    cut = cheapest_cut(rows.mapInArrow(scored, struct_of(score=T.DoubleType(), good=T.BooleanType())), good_weight)
    return forests[0] if cut is None else replace(forests[0], threshold=cut)


OUT = struct_of(
    n_words=T.LongType(), word_chars=T.LongType(), n_symbols=T.LongType(), n_dup_lines=T.LongType(), n_repeat_words=T.LongType(),
    base_failed=T.BooleanType(), anomaly=T.DoubleType(), kept=T.BooleanType(),
)


class QualityRules:
    """fit() on labelled rows, then judged() on any table with a text column."""

    def __init__(self, min_words: int = 50, max_repeat_percent: int = 50, good_weight: float = 5.0, folds: int = 5):
        """A lost good row counts as much as good_weight kept bad ones (as shares)."""
        self.min_words, self.max_repeat, self.good_weight, self.folds = min_words, max_repeat_percent, good_weight, folds
        self.forest: Forest | None = None

    def ratios(self, text: Column) -> Column:
        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series([statistics(t)[1] for t in b], dtype=object)

        return of(text)

    def fit(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityRules:
        """Trees from all good rows (label 1), the threshold from all rows of both labels by cross-fitting. Rows that the base rules
        reject are left out of both."""
        labels = labels.select(F.col(id_col).alias("__id"), F.col("quality").alias("__q")).filter("__q IN (0, 1) AND __id IS NOT NULL")
        # whole texts stay where they are read: what is joined is numbers
        x = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), self.ratios(F.col(text_col)).alias("x"))
        fold = F.pmod(F.xxhash64(F.lit(2), "__id"), F.lit(self.folds)).cast("int")
        rows = x.join(labels, "__id").select(fold.alias("fold"), (F.col("__q") == 1).alias("good"), "x")
        some = (F.round(F.expm1(F.col("x")[RATIOS.index("log_words")])) >= self.min_words) & (100 * F.col("x")[RATIOS.index("repeats")] <= self.max_repeat)
        self.forest = cross_fitted(materialise(rows, "labelled").filter(some), self.good_weight, self.folds)
        return self

    def verdict(self, text: Column) -> Column:
        """A struct with the base statistics, base_failed, the anomaly score and kept."""
        forest, min_words, most = self.forest, self.min_words, self.max_repeat
        assert forest is not None, "fit() comes first"

        @F.pandas_udf(OUT)
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for b in batches:
                both = [statistics(t) for t in b]
                out = pd.DataFrame(np.array([x[0] for x in both], dtype=np.int64).reshape(len(both), len(BASE)), columns=list(BASE))
                score = forest.scores(np.array([x[1] for x in both], dtype=float).reshape(len(both), len(RATIOS)))
                failed = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > most * out["n_words"])
                yield out.assign(base_failed=failed, anomaly=score, kept=~failed & (score <= forest.threshold))

        return of(text)

    def judged(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with the verdict's fields as columns."""
        d = docs.drop(*[c for c in OUT.fieldNames() if c != text_col])
        [v] = unused(d.columns, "verdict")
        return d.withColumn(v, self.verdict(F.col(text_col))).select(*d.columns, f"{v}.*")

    def kept(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows of docs that are kept, with docs' own columns only."""
        [v] = unused(docs.columns, "verdict")
        return docs.withColumn(v, self.verdict(F.col(text_col))).filter(f"{v}.kept").drop(v)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document with its statistics and verdict."""
    docs = table(spark, sf_dir, "documents")
    rules = QualityRules().fit(docs, table(spark, sf_dir, "labels"))
    return rules.judged(docs.select("doc_id", "text")).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    return QualityRules().fit(docs, table(spark, sf_dir, "labels")).kept(docs)
