"""Near duplicates by ProbMinHash.

A text is the weighted set of its shingles, five words in a row (lower case, split at ASCII white space; a text of fewer words
is one shingle), each with weight 1 + ln(count). Two texts are linked if their probability Jaccard similarity is at least 0.8;
classes are the connected components of all links, and texts with equal words always share one.

Signatures. Every shingle has a Poisson process of arrivals, at a rate equal to its weight, each at a random register; a
register keeps the shingle that arrives first. Two signatures agree in a register with the probability Jaccard similarity.
Arrivals are made up to a time horizon, and once every register is taken within it no later arrival matters: generation ends
early and exactly. Registers are grouped in bands; texts that agree in a whole band meet in a bucket. At 30 bands of 5 a pair
at 0.8 is missed with probability 7e-6.

Verification, without all pairs of a bucket. Copies are one node from the start. In every bucket each node is compared with one
leader, by exact similarity of whole texts, and what failed once more with the bucket's most central node. 1 - similarity is a
metric, so nodes whose similarities s, s' to a common leader differ by more than 0.2 cannot be linked to each other; nodes
already in one class need no link. What is still open meets by its rarest shingles: if c of x's n shingles are common to x and
y, and their weights are X of them in x (Y in y) of a total W (V in y), then similarity <= 1 / (W/X + V/Y - 1). So a
link needs a number of common shingles that follows from the sizes, and two linked texts have one among the first n - c + 1 of
either, in one order of all shingles. The rarest come first, so edited copies of one text meet only where they share an edit. All
pairs that meet are compared. So no pair of a bucket is left out, none is capped, and a bucket of n alike texts costs about n
comparisons.

Defined results. A null text is an empty one; texts without words are one class. Repeated rows share a class. A class is named
by its smallest document id (null if none has one). An empty table gives an empty result. Columns beyond id and text are not
read by classes(); kept() passes them through. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessella.llm.common import materialise, numbered, struct_of, table, unused

SHINGLE = 5
#: Texts are put into classes of size (shingles) by this factor, and of excess weight by this share of it.
STEP, EXCESS = 1.005, 0.01
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers evenly (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * MULTIPLIERS[1]
    x = (x ^ (x >> np.uint64(27))) * MULTIPLIERS[2]
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def digest_of(words: list[bytes]) -> np.ndarray:
    """128 bits that stand for a list of words."""
    return np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), dtype=np.int64)


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the different shingles, and their counts."""
    if not words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype=np.uint64), np.ones(1, dtype=np.int64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))
    n = len(words) - SHINGLE + 1
    total = h[:n] * MULTIPLIERS[0]
    for k in range(1, SHINGLE):
        total = mixed(total) + h[k : k + n] * MULTIPLIERS[k]
    return np.unique(mixed(total), return_counts=True)


def weights(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def signature(hashes: np.ndarray, rates: np.ndarray, registers: int) -> np.ndarray:
    """For each register the hash of the shingle that arrives first; hashes must not be empty."""
    taken, owner = np.full(registers, np.inf), np.zeros(registers, dtype=np.uint64)
    horizon = registers * (np.log(registers) + 2) / rates.sum()
    seen, clock, own, rate = np.zeros(len(hashes), dtype=np.uint64), np.zeros(len(hashes)), hashes, rates
    while True:
        waiting = []
        while len(own):
            # as many arrivals at once as most shingles have up to the horizon
            mean = rate.mean() * (horizon - clock.min())
            block = max(1, int(np.ceil(min(mean + 2 * np.sqrt(mean), 8192 / len(own) + 1))))
            steps = seen[:, None] + np.arange(1, block + 1, dtype=np.uint64)
            bits = mixed(own[:, None] + steps * GOLDEN)
            gaps = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
            times = clock[:, None] + np.cumsum(gaps, axis=1)
            row, col = np.nonzero(times <= horizon)
            at, when = (mixed(bits[row, col] + MULTIPLIERS[3]) % np.uint64(registers)).astype(np.int64), times[row, col]
            sooner = when < taken[at]
            row, at, when = row[sooner], at[sooner], when[sooner]
            order = np.argsort(-when, kind="stable")  # the soonest is written last
            taken[at[order]], owner[at[order]] = when[order], own[row[order]]
            more = times[:, -1] <= horizon
            if not more.all():
                # a shingle whose block runs past the horizon goes on from its first arrival beyond it, if there is need
                waiting.append((own[~more], rate[~more], seen[~more] + (times[~more] <= horizon).sum(axis=1).astype(np.uint64), times[~more], clock[~more]))
            own, rate, seen, clock = own[more], rate[more], seen[more] + np.uint64(block), times[more, -1]
        if np.isfinite(taken).all():
            return owner
        horizon *= 2
        own = np.concatenate([w[0] for w in waiting])
        rate = np.concatenate([w[1] for w in waiting])
        seen = np.concatenate([w[2] for w in waiting])
        # the time of the last arrival inside the old horizon
        clock = np.concatenate([np.maximum(np.where(t <= horizon / 2, t, 0).max(axis=1), c) for _, _, _, t, c in waiting])


def band_keys(owner: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    rows = owner.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64) * GOLDEN
    for k in range(rows.shape[1]):
        key = mixed(key + rows[:, k])
    return key.view(np.int64)


def packed(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """A text's shingles as bytes: their number, the sorted hashes, then place and count of those that occur more than once."""
    many = np.flatnonzero(counts > 1)
    return np.uint32(len(hashes)).tobytes() + hashes.tobytes() + many.astype(np.uint32).tobytes() + counts[many].astype(np.uint32).tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights."""
    n = int(np.frombuffer(blob, dtype=np.uint32, count=1)[0])
    hashes = np.frombuffer(blob, dtype=np.uint64, count=n, offset=4)
    rest = np.frombuffer(blob, dtype=np.uint32, offset=4 + 8 * n)
    w = np.ones(n)
    if len(rest):
        many, counts = rest.reshape(2, -1)
        w[many] = weights(counts)
    return hashes, w


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability Jaccard similarity of two weighted sets: over common elements d, the sum of 1 / sum over all elements e
    of max(a_e / a_d, b_e / b_d)."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = wa[i], wb[j]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    above = np.cumsum(x[::-1])[::-1] + (wa.sum() - x.sum())  # elements with at least this ratio, and those of a only
    below = np.cumsum(y) - y + (wb.sum() - y.sum())
    return float((1 / (above / x + below / y)).sum())


def small(keys: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """A table of keys, to be broadcast while it is small (it is counted); a larger one is shuffled."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def excess() -> Column:
    """The weight of a text beyond one for each shingle."""
    return F.greatest(F.col("total") - F.col("size"), F.lit(0.0))


def size_class() -> list[Column]:
    """nc, ec: the classes of a text's size and of its excess weight."""
    return [F.floor(F.log("size") / math.log(STEP)).cast("int").alias("nc"), F.ceil(excess() / F.col("size") / EXCESS - 1e-9).cast("int").alias("ec")]


class NearDuplicates:
    """Classes of near-duplicate documents."""

    def __init__(self, threshold: float = 0.8, bands: int = 30, rows: int = 5, at_once: int = 64):
        """at_once: open nodes of a bucket of rare shingles that meet its other nodes in the first round; each further round takes
        twice as many, until all have. It bounds the work of a round, not what is found."""
        self.threshold, self.bands, self.rows, self.at_once = threshold, bands, rows, at_once

    # ---- nodes: one for each different list of words

    def described(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, h, g, t, d1, d2, keys) of every row: hashes of the row and of its text, the digest of its words, its band keys."""
        bands, registers = self.bands, self.bands * self.rows

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                digests, keys = [], []
                for text in b.column("x").to_pylist():
                    words = words_of(text)
                    digests.append(digest_of(words))
                    hashes, counts = shingles(words)
                    keys.append(band_keys(signature(hashes, weights(counts), registers), bands) if len(hashes) else None)
                both = np.array(digests, dtype=np.int64).reshape(len(digests), 2)
                own = [b.column(c) for c in ("id", "h", "g", "t")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(keys, type=pa.list_(pa.int64()))], ["id", "h", "g", "t", "d1", "d2", "keys"])

        text = F.coalesce(F.col(text_col), F.lit(""))
        h, g = row_hashes(id_col, text_col)
        rows = docs.select(F.col(id_col).alias("id"), h.alias("h"), g.alias("g"), F.xxhash64(text).alias("t"), text.alias("x"))
        long = T.LongType()
        return rows.mapInArrow(of, struct_of(id=rows.schema["id"].dataType, h=long, g=long, t=long, d1=long, d2=long, keys=T.ArrayType(long)))

    def blobs(self, docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
        """(node, blob, size, total) of the given nodes (node, t, d1, d2): their texts are found by hash, and made into shingles once
        more; size and total are the number and the weight of the shingles."""

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                digests, made, sizes = [], [], []
                for text in b.column("x").to_pylist():
                    words = words_of(text)
                    digests.append(digest_of(words))
                    hashes, counts = shingles(words)
                    made.append(packed(hashes, counts))
                    sizes.append((len(hashes), float(weights(counts).sum())))
                both = np.array(digests, dtype=np.int64).reshape(len(digests), 2)
                n, total = np.array(sizes, dtype=float).reshape(len(sizes), 2).T
                columns = [both[:, 0], both[:, 1], pa.array(made, type=pa.binary()), n.astype(np.int64), total]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["d1", "d2", "blob", "size", "total"])

        text = F.coalesce(F.col(text_col), F.lit(""))
        wanted = nodes.select(F.col("t").alias("w")).distinct()
        found = docs.select(text.alias("x")).join(small(wanted), F.xxhash64("x") == F.col("w"), "left_semi")
        made = found.mapInArrow(of, "d1 long, d2 long, blob binary, size long, total double").groupBy("d1", "d2").agg(*[F.first(c).alias(c) for c in ("blob", "size", "total")])
        return made.join(nodes.select("node", "d1", "d2"), ["d1", "d2"]).select("node", "blob", "size", "total")

    # ---- comparisons

    def compared(self, pairs: DataFrame, blobs: DataFrame) -> DataFrame:
        """(a, b, s) of the pairs (a, b): b is the leader, whose text meets each of its pairs."""

        @F.pandas_udf(T.DoubleType())
        def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for x, y in batches:
                seen: dict[bytes, tuple] = {}  # leaders come again and again
                out = []
                for p, q in zip(x, y, strict=True):
                    if q not in seen:
                        seen = {q: unpacked(q)}
                    out.append(similarity(unpacked(p), seen[q]))
                yield pd.Series(out, dtype="float64")

        # only the texts that are compared are moved
        pairs = materialise(pairs, "pairs")
        own = {c: blobs.join(small(pairs.select(F.col(c).alias("node")).distinct()), "node", "left_semi").select(F.col("node").alias(c), F.col("blob").alias(f"blob_{c}")) for c in ("a", "b")}
        return pairs.join(own["a"], "a").join(own["b"], "b").select("a", "b", of("blob_a", "blob_b").alias("s"))

    def merged(self, labels: DataFrame, sims: DataFrame) -> DataFrame:
        """labels (node, comp) after joining what the links among sims (a, b, s) connect.

        Each round hooks every class that has a smaller neighbour to its smallest one, flattens the hooks by pointer jumping,
        and renames; links inside a class drop out, until none is left.
        """
        links = materialise(sims.filter(F.col("s") >= self.threshold).select("a", "b"), "links")
        while True:
            ends = links.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").filter("ca <> cb")
            hooks = ends.groupBy(F.greatest("ca", "cb").alias("child")).agg(F.min(F.least("ca", "cb")).alias("root"))
            hooks = materialise(hooks, "hooks")
            if not hooks.head(1):
                return labels
            while True:
                up = hooks.select(F.col("child").alias("c2"), F.col("root").alias("r2"))
                jumped = materialise(hooks.join(up, F.col("root") == F.col("c2"), "left").select("child", F.coalesce("r2", "root").alias("root"), F.col("r2").isNotNull().alias("moved")), "hooks")
                hooks = jumped.select("child", "root")
                if not jumped.filter("moved").head(1):
                    break
            labels = materialise(labels.join(hooks, F.col("comp") == F.col("child"), "left").select("node", F.coalesce("root", "comp").alias("comp")), "labels")

    def still_open(self, rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Of rows (key, node, s) those that could have a link to another class in their bucket, with comp. s is the similarity
        to the bucket's first leader."""
        slack = 1 - self.threshold
        tops = materialise(rows.groupBy("key").agg(F.max(F.when(F.col("s") < self.threshold, F.col("s"))).alias("f")).filter("f IS NOT NULL"), "tops")
        near = rows.join(tops, "key").filter((F.col("s") < self.threshold) | (F.col("s") - F.col("f") <= slack)).drop("f")
        return self.undecided(materialise(near.join(labels, "node"), "near"))

    def undecided(self, near: DataFrame) -> DataFrame:
        """The rows of buckets with more than one class and with a failed node. near is a written table: its counts and its rows
        reach their join by exchanges of their own, which Spark can split."""
        counts = near.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count_if(F.col("s") < self.threshold).alias("nf"))
        counts = materialise(counts.filter("lo <> hi AND nf > 0").select("key"), "counts")
        return materialise(near.join(counts, "key"), "open")

    def needed(self, n: Column, e: Column, nc: Column, ec: Column) -> Column:
        """The shingles that a text of n, whose weight is n + e, must share with a text of size class nc, ec to be linked: the
        least c with (n + e) / (c + e) + (m + f) / (c + f) <= 1 + 1 / threshold, m the class's least size and f its largest
        excess weight."""
        k, m, f = F.lit(1 + 1 / self.threshold), F.ceil(F.pow(F.lit(STEP), nc) * (1 - 1e-9)), ec * EXCESS * F.pow(F.lit(STEP), nc + 1) * (1 + 1e-9)
        p, q = k * (e + f) - (n + e) - (m + f), k * e * f - (n + e) * f - (m + f) * e
        c = (F.sqrt(p * p - 4 * k * q) - p) / (2 * k)
        return F.greatest(F.ceil(c - 1e-6), F.lit(1))

    def shingle_rows(self, nodes: DataFrame, blobs: DataFrame) -> DataFrame:
        """(h, node, nc, ec) of every shingle of the nodes, with the node's size class."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for node, blob, size, total in zip(*[b.column(c).to_pylist() for c in names], strict=True):
                    hashes, _ = unpacked(blob)
                    own = [np.full(len(hashes), x) for x in (node, size, total)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hashes.view(np.int64), *own)], ["h", "node", "size", "total"])

        names = ["node", "blob", "size", "total"]
        rows = blobs.join(small(nodes), "node", "left_semi").select(*names).mapInArrow(each, "h long, node long, size long, total double")
        return rows.select("h", "node", *size_class())

    def bounded(self, rest: DataFrame, blobs: DataFrame) -> DataFrame:
        """The open rows that can have a link at all, with n, e (weight above n), nc, ec (size class), lone (how many of the text's
        shingles no other open text has) and classes, the size classes of the bucket."""
        nodes = materialise(rest.select("node").distinct(), "nodes")
        lone = self.shingle_rows(nodes, blobs).groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).filter("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
        facts = blobs.select("node", "size", "total").join(small(nodes), "node", "left_semi").join(lone, "node", "left")
        facts = materialise(facts.select("node", F.col("size").alias("n"), excess().alias("e"), *size_class(), F.coalesce("lone", F.lit(0)).alias("lone")), "facts")
        rest = materialise(rest.join(facts, "node"), "rest")
        sizes = materialise(rest.groupBy("key").agg(F.collect_set(F.struct("nc", "ec")).alias("classes")), "classes")
        can = F.exists("classes", lambda x: self.needed(F.col("n"), F.col("e"), x.nc, x.ec) <= F.col("n") - F.col("lone"))
        return self.undecided(materialise(rest.join(sizes, "key").filter(can), "bounded"))

    def meetings(self, rest: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Who can be linked to whom, by rare shingles. First (h, nc, ec, node, own): a node outside the largest class of its bucket,
        in class own, is to meet the texts of size class (nc, ec) that have its shingle h. Second (h, nc, ec, node): the texts to be met."""
        main = rest.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"))
        apart = rest.join(materialise(main.select("key", F.col("m.comp").alias("main")), "main"), "key").filter("comp <> main")
        apart = apart.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "e", "comp")], F.array_distinct(F.flatten(F.collect_list("classes"))).alias("classes"))
        apart = materialise(apart, "apart")
        rows = materialise(self.shingle_rows(materialise(rest.select("node").distinct(), "nodes"), blobs), "shingles")
        many = materialise(rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "counts")
        own = rows.select("h", "node").join(small(apart.select("node")), "node", "left_semi").join(many, "h")
        # the shingles that no other open text has come first, then the rarer of the others
        order = Window.partitionBy("node")
        found = own.withColumn("at", F.row_number().over(order.orderBy("c", "h")) - F.count(F.lit(1)).over(order) - 1).join(apart, "node")
        last = F.transform("classes", lambda x: F.struct(x.nc.alias("nc"), x.ec.alias("ec"), self.needed(F.col("n"), F.col("e"), x.nc, x.ec).alias("c")))
        found = found.select("h", "node", "comp", F.explode(F.filter(last, lambda x: F.col("at") <= -x.c)).alias("x"))
        met = materialise(found.select("h", "x.nc", "x.ec", "node", F.col("comp").alias("own")), "met")
        wanted = materialise(met.select("h").distinct(), "wanted")
        theirs = rows.join(small(wanted), "h", "left_semi").join(materialise(met.select("h", "nc", "ec").distinct(), "buckets"), ["h", "nc", "ec"], "left_semi")
        return met, materialise(theirs.select("h", "nc", "ec", "node"), "theirs")

    def settled(self, rest: DataFrame, blobs: DataFrame, labels: DataFrame) -> DataFrame:
        """labels after all links among the open rows. In each round, some nodes of each bucket of rare shingles meet the bucket's
        other nodes; buckets of one class are done."""
        met, theirs = self.meetings(rest, blobs)
        turns, bucket = self.at_once, ["h", "nc", "ec"]
        while met.head(1):
            turn = F.row_number().over(Window.partitionBy(*bucket).orderBy("a"))
            now = materialise(met.withColumnRenamed("node", "a").withColumn("turn", turn).filter(F.col("turn") <= turns).drop("turn"), "now")
            pairs = now.join(theirs.join(labels, "node").withColumnRenamed("node", "b"), bucket).filter("own <> comp")
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            labels = self.merged(labels, materialise(self.compared(pairs, blobs), "tested"))
            left = materialise(met.join(now.select(*bucket, F.col("a").alias("node")), [*bucket, "node"], "left_anti"), "met")
            if not left.head(1):
                return labels
            comps = theirs.join(labels, "node").groupBy(*bucket).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            left = left.drop("own").join(labels.withColumnRenamed("comp", "own"), "node").join(comps, bucket).filter("lo <> hi OR lo <> own").drop("lo", "hi")
            met, turns = materialise(left, "met"), 2 * turns
        return labels

    def labelled(self, docs: DataFrame, reps: DataFrame, text_col: str) -> DataFrame:
        """(node, comp) of the nodes that met another one."""
        members = reps.select("node", F.explode("keys").alias("key"))
        leaders = materialise(members.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "lead"), "leaders")
        members = materialise(members.join(leaders, "key"), "members")
        blobs = materialise(self.blobs(docs, reps.join(members.select("node").distinct(), "node"), text_col), "blobs")
        labels = materialise(blobs.select("node", F.col("node").alias("comp")), "labels")
        tested = materialise(self.compared(members.filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct(), blobs), "tested")
        labels = self.merged(labels, tested)
        # nodes that share a leader are one bucket, however many bands they share it in
        rest = self.still_open(tested.select(F.col("b").alias("key"), F.col("a").alias("node"), "s"), labels)
        if not rest.head(1):
            return labels
        # nodes that can have a link meet the node of their bucket that has the fewest shingles of its own
        rest = self.bounded(rest, blobs)
        central = materialise(rest.groupBy("key").agg(F.min(F.struct("lone", F.col("node").alias("b"), F.col("comp").alias("cb"))).alias("l")).select("key", "l.b", "l.cb"), "central")
        probes = rest.join(central, "key").filter("comp <> cb").select(F.col("node").alias("a"), "b").distinct()
        labels = self.merged(labels, materialise(self.compared(probes, blobs), "tested"))
        rest = self.still_open(rest.select("key", "node", "s"), labels)
        return self.settled(self.bounded(rest, blobs), blobs, labels) if rest.head(1) else labels

    # ---- results

    def rows_with_class(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, h, g, class_id, first) of every row; first is the (id, h, g) by which a class's one kept row is known."""
        rows = materialise(self.described(docs, id_col, text_col), "signatures")
        known = F.struct(F.col("id").isNull().alias("none"), "id", "h", "g")
        reps = rows.groupBy("d1", "d2").agg(F.first("keys").alias("keys"), F.min("t").alias("t"), F.min(known).alias("k"))
        total = rows.count()
        reps = materialise(numbered(reps.withColumn("all", F.lit(0)), ["all"], F.struct("d1", "d2"), "node", total).drop("all"), "nodes")
        labels = self.labelled(docs, reps, text_col)
        named = reps.select("node", "d1", "d2", "k").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        names = named.groupBy("comp").agg(F.min("k").alias("first"))
        classes = named.select("d1", "d2", "comp").join(names, "comp").select("d1", "d2", "first")
        return rows.select("id", "h", "g", "d1", "d2").join(classes, ["d1", "d2"]).select("id", "h", "g", "first")

    def classes(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, class_id) of every row."""
        return self.rows_with_class(docs, id_col, text_col).select(F.col("id").alias(id_col), F.col("first.id").alias("class_id"))

    def kept(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row of each class, that with the smallest id, with docs' own columns."""
        found = self.rows_with_class(docs, id_col, text_col)
        h, g, r = unused(docs.columns, "h", "g", "r")
        first = found.filter((F.col("h") == F.col("first.h")) & (F.col("g") == F.col("first.g"))).select(F.col("h").alias(h), F.col("g").alias(g)).distinct()
        keyed = docs.withColumns(dict(zip((h, g), row_hashes(id_col, text_col), strict=True))).join(first, [h, g])
        return keyed.withColumn(r, F.row_number().over(Window.partitionBy(h, g).orderBy(h))).filter(F.col(r) == 1).select(*docs.columns)


def row_hashes(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two 64-bit hashes that stand for a row's id and text."""
    return F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the class of every document."""
    return NearDuplicates().classes(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class."""
    return NearDuplicates().kept(docs)
