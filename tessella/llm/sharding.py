"""Sharding by a k-d tree over metadata.

The tree's root holds all documents and is to become `shards` leaves of equal bytes. A node of k leaves is split along its
widest metadata dimension, at the weighted quantile that gives floor(k / 2) leaves' bytes to one side; with k a power of two that
is the weighted median. Quantiles are found by distributed histograms of a bounded number of bins, which are refined until the
cut is exact to a small share of a leaf, so no node's rows meet in one task and nothing is sampled. Where a group of equal texts
lies across the quantile of the widest dimension, the node is split where a cut comes nearest: along another dimension, or in
one of a few orders of the texts' hashes.

Dimensions are what a text tells of itself: the logarithms of its bytes and lines, its bytes per character (the script) and
characters per word. Equal texts are equal in all of them, and rows that are equal in a dimension are ordered by their text's
hash, so equal texts stay in one shard. Only a group with more bytes than a shard is cut, in the order of its ids' hashes.

Defined results. A null text has the size of an empty one and the checksum 0. Repeated rows fall into one shard and get slots of
their own. An empty table gives an empty result; with fewer rows than shards some shards stay empty. Columns beyond those
named are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import materialise, numbered, table

#: A row's place along a dimension is its coordinate, then its order among equal coordinates: the bits of both. A histogram
#: has 2 ** FIRST bins for each dimension of a node, and 2 ** FURTHER where it is refined.
COORD, TAIL, FIRST, FURTHER = 22, 40, 10, 13
#: A cut that misses its quantile by more than this share of a leaf is held against cuts along the other dimensions.
LOOSE = 0.01
#: Orders by hash, for nodes that no dimension cuts well.
ORDERS = 3


@dataclass
class Node:
    """A node of the tree: a leaf has one shard; others a cut in one dimension and two children."""

    first: int
    shards: int
    #: The places that a row of the node can have, for each dimension: from, and up to.
    box: list[tuple[int, int]]
    dim: int = 0
    cut: int = 0
    left: Node | None = None
    right: Node | None = None

    def expression(self, dims: list[str], leaf) -> Column:
        if self.left is None:
            return leaf(self)
        return F.when(F.col(dims[self.dim]) < F.lit(self.cut), self.left.expression(dims, leaf)).otherwise(self.right.expression(dims, leaf))

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()


def scaled(value: Column, low: float, high: float) -> Column:
    """A coordinate of COORD bits."""
    top = 2**COORD - 1
    return F.least(F.lit(top), F.floor((value - F.lit(low)) / F.lit(max(high - low, 1e-9)) * F.lit(top))).cast("long")


@dataclass
class Search:
    """The search for one node's quantile along one dimension: the cut lies in 2 ** bits places from low, and before is the weight
    below them."""

    node: Node
    dim: int
    goal: float
    leaf: float
    low: int
    before: int
    bits: int
    cut: int = 0
    miss: float = math.inf
    single: bool = False

    def narrowed(self, bins: dict[int, tuple[int, bool]], bits: int) -> None:
        """After a histogram with bins of 2 ** bits places: the bytes of each, and whether all lie in one place."""
        upto = self.before
        for k in sorted(bins):
            upto += bins[k][0]
            if upto >= self.goal:
                break
        over, under = upto - self.goal, self.goal - (upto - bins[k][0])
        # the cut stands after this bin or before it, whichever is nearer
        self.low, self.before, self.bits = self.low + (k << bits), upto - bins[k][0], bits
        self.single = bins[k][1]
        self.cut, self.miss = (self.low + (1 << bits), over) if over <= under else (self.low, under)

    def near(self, tolerance: float) -> bool:
        return self.single or self.miss <= tolerance * self.leaf


def histogram(at: DataFrame, dims: list[str], wanted: list[tuple[int, int, int, int, int]]) -> dict[int, dict[int, tuple[int, bool]]]:
    """For each wanted (node, dimension, low, bits, width) the bytes in its bins of 2 ** bits places, of 2 ** width places from low,
    and whether all of a bin lie in one place."""
    # a local table of some entries for each node, so that every pass runs the same compiled code
    entries = ", ".join(f"({k}, {node}, {dim}, {low}L, {bits}, {width})" for k, (node, dim, low, bits, width) in enumerate(wanted))
    entries = at.sparkSession.sql(f"SELECT * FROM VALUES {entries} AS w (k, node, dim, low, bits, width)")
    off = at.join(F.broadcast(entries), "node").select("k", "size", "bits", "width", (F.get(F.array(*dims), F.col("dim")) - F.col("low")).alias("off"))
    sums = off.filter("off >= 0 AND shiftright(off, width) = 0").groupBy("k", F.expr("shiftright(off, bits)").alias("bin")).agg(F.sum("size").alias("bytes"), (F.min("off") == F.max("off")).alias("single"))
    found: dict[int, dict[int, tuple[int, bool]]] = {k: {} for k in range(len(wanted))}
    for r in sums.collect():  # at most 2 ** FURTHER bins for each
        found[r["k"]][r["bin"]] = r["bytes"], r["single"]
    return found


def split(rows: DataFrame, root: Node, dims: list[str], tolerance: float) -> bool:
    """Split every leaf that has more than one shard; whether there was one."""
    todo = {n.first: n for n in root.leaves() if n.shards > 1}
    if not todo:
        return False
    at = rows.withColumn("node", root.expression(dims, lambda n: F.lit(n.first if n.shards > 1 else -1))).filter("node >= 0")
    boxes = [(f, k, lo, max(0, (hi - lo).bit_length() - FIRST), 62) for f, n in todo.items() for k, (lo, hi) in enumerate(n.box)]
    found, searches = histogram(at, dims, boxes), {f: [] for f in todo}
    for (f, k, lo, bits, _), bins in zip(boxes, found.values(), strict=True):
        if bins:
            n, total = todo[f], sum(x for x, _ in bins.values())
            x = Search(n, k, total * (n.shards // 2) / n.shards, total / n.shards, lo, 0, COORD + TAIL)
            searches[f].append((max(bins) - min(bins) + 1 << bits >> TAIL, -k, x))
            x.narrowed(bins, bits)
    ranked = {f: [x for *_, x in sorted(own, key=lambda s: s[:2], reverse=True)] for f, own in searches.items()}

    def refined(some: list[Search]) -> None:
        while some := [x for x in some if not x.near(tolerance)]:
            wanted = [(x.node.first, x.dim, x.low, max(0, x.bits - FURTHER), x.bits) for x in some]
            for (*_, bits, _), x, bins in zip(wanted, some, histogram(at, dims, wanted).values(), strict=True):
                x.narrowed(bins, bits)

    refined([own[0] for own in ranked.values() if own])
    refined([x for own in ranked.values() if own and own[0].miss > LOOSE * own[0].leaf for x in own[1:]])
    for f, n in todo.items():
        # the widest dimension, unless another one's cut is nearer by more than the tolerance
        own = ranked[f]
        x = own[0] if own and own[0].miss <= LOOSE * own[0].leaf else min(own, key=lambda x: x.miss, default=None)
        n.dim, n.cut = (x.dim, x.cut) if x else (0, 1)
        k = n.shards // 2
        n.left, n.right = Node(f, k, list(n.box)), Node(f + k, n.shards - k, list(n.box))
        lo, hi = n.box[n.dim]
        n.left.box[n.dim], n.right.box[n.dim] = (lo, min(hi, n.cut)), (max(lo, n.cut), hi)
    return True


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, tolerance: float = 2e-3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot and grown_shard.

    Give the number of shards, or the bytes a shard should have. A split misses its quantile by at most `tolerance` of a shard,
    unless a document, or a group of equal texts, is larger than that.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, chars = (F.octet_length(text) + 16).cast("long"), F.char_length(text)
    gaps, lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(x))) for x in (" ", "\n"))
    measures = [F.log2(size.cast("double")), F.log2(lines + 1.0), (F.octet_length(text) + 1.0) / (chars + 1.0), F.log2((chars + 1.0) / (gaps + 1.0))]
    raw, dims = [f"m{k}" for k in range(len(measures))], [f"d{k}" for k in range(len(measures))]
    crc = F.coalesce(F.crc32(F.col(text_col)), F.lit(0).cast("long"))
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("crc"), F.xxhash64(text).alias("t"), *[m.alias(c) for m, c in zip(measures, raw, strict=True)])
    rows = materialise(rows, "sizes")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), *[f(c).alias(f"{f.__name__}_{c}") for c in raw for f in (F.min, F.max)]).head()
    n = shards or max(1, math.ceil((whole["bytes"] or 0) / target_bytes))
    # fewer groups than shards are larger than a shard
    large = [r["t"] for r in rows.groupBy("t").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > F.lit((whole["bytes"] or 0) / n)).collect()]
    # the order among equals: 40 bits of the text's hash; in a large group 20 of them, then 20 of the id's hash
    half = lambda k, c: F.pmod(F.xxhash64(F.lit(k), c), F.lit(2**20))
    tail = lambda k: F.shiftleft(half(k, F.col("t")), 20) + F.when(F.col("t").isin(large), half(0, F.col("id"))).otherwise(half(k + 1, F.col("t")))
    places = [(F.shiftleft(scaled(F.col(c), whole[f"min_{c}"] or 0.0, whole[f"max_{c}"] or 0.0), TAIL) + tail(1)).alias(d) for c, d in zip(raw, dims, strict=True)]
    for k in range(ORDERS):  # no wider than a single coordinate, so never the widest
        dims.append(f"o{k}")
        places.append(tail(2 * k + 3).alias(dims[-1]))
    # written once more, so that the tree's expressions stand on plain columns
    rows = materialise(rows.select("id", "size", "crc", *places), "places")
    root = Node(0, n, [(0, 1 << COORD + TAIL)] * len(dims))
    while split(rows, root, dims, tolerance):
        pass
    placed = rows.select("id", "size", "crc", root.expression(dims, lambda x: F.lit(x.first)).cast("int").alias("shard"))
    slots = numbered(placed, ["shard"], F.struct("id", "crc"), "slot", whole["n"])
    return slots.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents in 40 shards of near equal bytes."""
    return shard(table(spark, sf_dir, "documents"), shards=40)
