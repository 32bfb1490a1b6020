"""Approximate nearest neighbours by stable projections: vectors are projected to a few Gaussian dimensions, which keep squared distances
up to a chi-square factor, and kd-trees index the projections.

A query meets projected neighbours in the order of their boxes and verifies them by the original vectors. It stops when the next
box is so far that a vector in it, were it nearer than the last of the nearest found, would project nearer with the given chance: the
projected squared distance over the found one has passed the chi-square quantile. A missed neighbour is one that projects
farther than that, so each is found with at least this chance.

Equal vectors are one unit with its smallest ids, so a group of copies is compared once. A kd-tree of a bounded sample deals
all units to cells; units of a cell beyond its size are dealt to chunks by hash. A query searches its own cell first, then, with
the distance found there, the cells that the test doesn't rule out. Cells and queries meet in blocks: a task holds one chunk, whose
own kd-tree it builds, and one block of queries, both of bounded size. Driver and tasks know the cells' boxes, at most MOST_CELLS.

Defined results. Null and zero vectors, those with null or non-finite components, those without an id, and those of another
length than the vector of the smallest id take no part. A repeated row is a row: a copy of the query's row is a candidate, the query's
own row (one with its id and vector) isn't. Ties go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessella.llm.common import materialise, sampled, struct_of, table

DIMENSIONS, CHANCE, SEED = 12, 0.95, 1
#: Units of a cell and of a leaf, queries of a block; cells at most; units of the sample that the cells are fitted on.
CELL_ROWS, LEAF_ROWS, BLOCK_ROWS, MOST_CELLS, SAMPLE_ROWS = 4_096, 64, 4_096, 4_096, 100_000
SALTS = 8

FOUND = struct_of(q=T.LongType(), score=T.ArrayType(T.DoubleType()), id=T.ArrayType(T.LongType()), reach=T.DoubleType())


def chi_square_quantile(chance: float, dimensions: int) -> float:
    """Of an even number of degrees of freedom, by bisection of the closed form."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dimensions // 2))
    lo, hi = 0.0, 1.0
    while below(hi) < chance:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < chance else (lo, mid)
    return hi


class KdTree:
    """Median splits along the widest dimension. Leaf k holds the points order[ends[k]:ends[k + 1]]."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order, self.splits, ends = np.arange(len(points)), [], [0]
        # a node is (dimension, value, left, right); a child below 0 is leaf -1 - child
        stack = [(0, len(points), -1, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            own = points[self.order[lo:hi]]
            wide = own.max(0) - own.min(0) if hi > lo else np.zeros(1)
            at = int(wide.argmax())
            if hi - lo <= leaf or wide[at] == 0:
                child = -len(ends)
                ends.append(hi)
            else:
                mid = (hi - lo) // 2
                part = np.argpartition(own[:, at], mid)
                cut = own[part[mid], at]
                if cut == own[:, at].min():  # so that both sides have points
                    cut = own[own[:, at] > cut, at].min()
                left = own[:, at] < cut
                self.order[lo:hi] = np.concatenate([self.order[lo:hi][left], self.order[lo:hi][~left]])
                child = len(self.splits)
                self.splits.append([at, float(cut), 0, 0])
                mid = lo + int(left.sum())
                stack += [(mid, hi, child, 3), (lo, mid, child, 2)]
            if parent >= 0:
                self.splits[parent][side] = child
        self.ends = np.array(ends)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point falls in."""
        node = np.zeros(len(points), np.int64) if self.splits else np.full(len(points), -1)
        while (open_ := np.flatnonzero(node >= 0)).size:
            at = node[open_]
            right = points[open_, self._dims[at]] >= self._cuts[at]
            node[open_] = np.where(right, self._right[at], self._left[at])
        return -1 - node

    def ready(self) -> KdTree:
        """For leaf_of."""
        s = np.array(self.splits, float).reshape(-1, 4)
        self._dims, self._cuts, self._left, self._right = s[:, 0].astype(int), s[:, 1], s[:, 2].astype(int), s[:, 3].astype(int)
        return self


def box_distances(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    d = np.maximum(np.maximum(low - point, point - high), 0.0)
    return (d * d).sum(-1)


class Chunk:
    """Units of one chunk with their kd-tree."""

    def __init__(self, vectors: np.ndarray, projected: np.ndarray, ids: list[list[int]], need: int, factor: float):
        tree = KdTree(projected, LEAF_ROWS)
        self.vectors, self.projected = vectors[tree.order], projected[tree.order]
        self.ids = [ids[k] for k in tree.order.tolist()]
        self.weights, self.first = np.array([len(i) for i in self.ids]), np.array([i[0] for i in self.ids])
        self.ends, self.need, self.factor = tree.ends, need, factor
        self.low, self.high = np.minimum.reduceat(self.projected, tree.ends[:-1]), np.maximum.reduceat(self.projected, tree.ends[:-1])

    def nearest(self, query: np.ndarray, projected: np.ndarray, reach: float) -> tuple[list[tuple[float, int]], float]:
        """The (distance, id) of the query's nearest ids, no more than needed, and the distance within which so many are (or that
        given)."""
        away = box_distances(projected, self.low, self.high)
        leaves = np.argsort(away, kind="stable")
        score, unit = np.empty(0), np.empty(0, np.int64)
        at, step = 0, 1
        while at < len(leaves) and away[leaves[at]] <= self.factor * reach * reach:
            near = [k for k in leaves[at : at + step].tolist() if away[k] <= self.factor * reach * reach]
            rows = np.concatenate([np.arange(self.ends[k], self.ends[k + 1]) for k in near])
            rows = rows[((self.projected[rows] - projected) ** 2).sum(1) <= self.factor * reach * reach]
            d = np.sqrt(((self.vectors[rows] - query) ** 2).sum(1))
            score, unit = np.concatenate([score, d[d <= reach]]), np.concatenate([unit, rows[d <= reach]])
            best = np.lexsort((self.first[unit], score))[: self.need]
            score, unit = score[best], unit[best]
            have = np.cumsum(self.weights[unit])
            full = int(np.searchsorted(have, self.need))
            if full < len(unit):
                reach = float(score[full])
            at, step = at + step, 2 * step
        found = sorted((s, i) for s, u in zip(score.tolist(), unit.tolist(), strict=True) for i in self.ids[u])
        return found[: self.need], reach


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of equal length as rows of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


class Neighbours:
    """The nearest neighbours of some rows of a table among all its rows."""

    def __init__(self, k: int = 10, dimensions: int = DIMENSIONS, chance: float = CHANCE, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, seed: int = SEED):
        if k < 1 or dimensions < 2 or dimensions % 2 or not 0 < chance < 1:
            raise ValueError("k from 1, an even number of dimensions, a chance between 0 and 1")
        self.need, self.dimensions, self.cell_rows, self.block_rows, self.seed = k + 1, dimensions, cell_rows, block_rows, seed
        self.factor = chi_square_quantile(chance, dimensions)

    def valid(self, df: DataFrame, vec: str, vec_id: str) -> DataFrame:
        """id and vec of the rows that take part."""
        size = F.size("vec")
        sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
        rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vec).alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(sound, F.lit(False)))
        first = rows.orderBy("id", size).select(size.alias("n")).first()
        return rows.filter(size == (first["n"] if first else -1))

    def units(self, rows: DataFrame) -> DataFrame:
        """unit, vec, ids: each vector once, with its smallest ids. The rank's limit works before the shuffle, so copies don't meet."""
        rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
        few = rows.withColumn("r", rank).filter(F.col("r") <= self.need)
        return materialise(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("unit", F.monotonically_increasing_id()), "units")

    def __call__(self, df: DataFrame, asks: Callable[[Column], Column], vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
        """query_id, rank, vec_id, score: for each row whose id satisfies `asks`."""
        rows = self.valid(df, vec, vec_id)
        units = self.units(rows)
        total = units.count()
        head = units.select(F.size("vec").alias("size")).first()
        directions = np.random.default_rng(self.seed).standard_normal((head["size"] if head else 1, self.dimensions))
        wanted = min(MOST_CELLS, -(-total // self.cell_rows))

        def projections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (matrix(b.column("vec")) @ directions).T], names=axes)

        # the sample comes projected, so that it is as small for long vectors as for short ones
        axes = [f"p{k}" for k in range(self.dimensions)]
        sample = sampled(units, F.col("unit"), SAMPLE_ROWS, total).select("vec").mapInArrow(projections, struct_of(**{a: T.DoubleType() for a in axes})).toArrow()
        points = np.column_stack([sample[a].to_numpy() for a in axes])
        tree = KdTree(points, max(1, -(-len(points) // max(1, wanted)))).ready()
        n_cells = len(tree.ends) - 1

        # ---- cells: their units, and boxes of these
        def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = matrix(b.column("vec")) @ directions
                cell = tree.leaf_of(p)
                order = np.argsort(cell, kind="stable")
                known, first, n = np.unique(cell[order], return_index=True, return_counts=True)
                if len(known):
                    ends = [*np.minimum.reduceat(p[order], first).T, *np.maximum.reduceat(p[order], first).T]
                    yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(n), *[pa.array(e) for e in ends]], names=names)

        sides = [f"{s}{k}" for s in ("low", "high") for k in range(self.dimensions)]
        names = ["cell", "n", *sides]
        measured = units.select("vec").mapInArrow(boxes, struct_of(cell=T.LongType(), n=T.LongType(), **{s: T.DoubleType() for s in sides}))
        measured = measured.groupBy("cell").agg(F.sum("n").alias("n"), *[(F.min if s[0] == "l" else F.max)(s).alias(s) for s in sides]).collect()  # at most MOST_CELLS
        low, high, chunks = np.full((n_cells, self.dimensions), np.inf), np.full((n_cells, self.dimensions), np.inf), np.zeros(n_cells, np.int64)
        for r in measured:
            bounds = np.array([r[s] for s in sides]).reshape(2, -1)
            room = 1e-6 * (1 + np.abs(bounds))  # the same vector may be projected with other rounding
            low[r["cell"]], high[r["cell"]], chunks[r["cell"]] = bounds[0] - room[0], bounds[1] + room[1], -(-r["n"] // (2 * self.cell_rows))

        def placed(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
            def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield b.append_column(key, pa.array(tree.leaf_of(matrix(b.column("vec")) @ directions)))

            return of

        with_chunks = lambda cell: F.get(F.lit(chunks.tolist()), F.col(cell).cast("int"))
        cells = units.mapInArrow(placed("cell"), T.StructType([*units.schema.fields, T.StructField("cell", T.LongType())]))
        cells = cells.withColumn("chunk", F.pmod(F.xxhash64("unit"), with_chunks("cell"))).select("cell", "chunk", "vec", "ids")

        # ---- queries: each vector once, in blocks of neighbouring cells
        own = rows.filter(asks(F.col("id")))
        asked = own.select("vec").distinct().withColumn("q", F.monotonically_increasing_id())
        asked = materialise(asked.mapInArrow(placed("home"), T.StructType([*asked.schema.fields, T.StructField("home", T.LongType())])), "asked")
        counts = {r["home"]: r["count"] for r in asked.groupBy("home").count().collect()}  # at most MOST_CELLS
        first, parts, block, filled = [0] * n_cells, [1] * n_cells, 0, 0
        for c in range(n_cells):
            n = counts.get(c, 0)
            if filled and filled + n > self.block_rows:
                block, filled = block + 1, 0
            first[c], parts[c] = block, max(1, -(-n // self.block_rows))
            block, filled = block + parts[c] - 1, filled + n if parts[c] == 1 else self.block_rows
        home = F.col("home").cast("int")
        asked = asked.withColumn("block", F.get(F.lit(first), home) + F.pmod(F.xxhash64("q"), F.get(F.lit(parts), home))).withColumn("reach", F.lit(None).cast("double"))

        # ---- each query's own cell, then those within reach
        every = lambda pairs: pairs.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), with_chunks("cell") - 1)))
        mine = asked.withColumn("cell", F.col("home"))
        pairs = every(mine.select("cell", "block").distinct().filter(with_chunks("cell") > 0))
        near = materialise(self.searched(cells.join(pairs, ["cell", "chunk"]), mine.join(pairs, ["cell", "block"]), directions), "near")
        reached = near.groupBy("q").agg(F.min("reach").alias("reach"))
        asked = materialise(asked.drop("reach").join(reached, "q", "left"), "reached")

        def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p, out = matrix(b.column("vec")) @ directions, set()
                for point, blk, at, reach in zip(p, b.column("block").to_pylist(), b.column("home").to_pylist(), b.column("reach").to_pylist(), strict=True):
                    hit = np.flatnonzero((chunks > 0) & (box_distances(point, low, high) <= (math.inf if reach is None else self.factor * reach * reach)))
                    out |= {(blk, c) for c in hit.tolist() if c != at}
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in sorted(out)], pa.int64()) for k in (0, 1)], names=["block", "cell"])

        pairs = asked.mapInArrow(within, struct_of(block=T.LongType(), cell=T.LongType())).distinct()
        pairs = materialise(every(pairs), "pairs")
        far = self.searched(cells.join(pairs, ["cell", "chunk"]), asked.join(pairs, "block").filter("cell <> home"), directions)

        # ---- the nearest of all, for each query's rows
        each = near.unionByName(far).select("q", F.explode(F.arrays_zip("score", "id")).alias("x")).select("q", "x.score", "x.id")
        each = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))).filter(F.col("r") <= self.need)
        lists = each.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("nearest"))
        lists = asked.select("q", "vec").join(lists, "q").select("vec", "nearest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        done = own.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(lists, ["vec", "salt"])
        itself = F.array_position(F.transform("nearest", lambda x: (x.score == 0) & (x.id == F.col("id"))), F.lit(True))
        others = done.withColumn("own", itself).select(F.col("id").alias("query_id"), F.slice(F.filter("nearest", lambda x, i: i + 1 != F.col("own")), 1, self.need - 1).alias("nearest"))
        return others.select("query_id", F.posexplode("nearest").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))

    def searched(self, cells: DataFrame, asked: DataFrame, directions: np.ndarray) -> DataFrame:
        """What each query finds in each chunk it meets: q, score and id by distance, reach."""
        need, factor = self.need, self.factor

        def of(units: pa.Table, queries: pa.Table) -> pa.Table:
            out: list[tuple[int, list[float], list[int], float | None]] = []
            if units.num_rows and queries.num_rows:
                vectors, wanted = matrix(units["vec"]), matrix(queries["vec"])
                chunk = Chunk(vectors, vectors @ directions, units["ids"].to_pylist(), need, factor)
                for q, v, p, reach in zip(queries["q"].to_pylist(), wanted, wanted @ directions, queries["reach"].to_pylist(), strict=True):
                    found, reach = chunk.nearest(v, p, math.inf if reach is None else reach)
                    if found:
                        out.append((q, [s for s, _ in found], [i for _, i in found], None if math.isinf(reach) else reach))
            kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.float64()]
            return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=FOUND.names)

        key = ["cell", "chunk", "block"]
        # both sides come from one table of pairs: aliases keep their columns apart
        queries = asked.select(*[F.col(c).alias(c) for c in [*key, "q", "vec", "reach"]])
        return cells.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(of, FOUND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Neighbours()(table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(100)) == 0)
