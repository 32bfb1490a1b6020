"""Vector code compression: each part of a vector becomes the number of its codebook's nearest entry, found by exponion search.

Vectors are made integers, so all distances are exact. A part is sought from the entry it had before: an entry nearer than that one
lies in a ball around it whose radius is the sum of the part's distances to that entry and to the best one so far, so the entry's list of
neighbours, sorted by distance, is scanned up to this radius and no further. Codebooks are parts x entries small vectors whatever the
table's size; they go out with each task, and tasks send back sums by part and entry. A round starts again from the vectors and
follows them through the earlier codebooks, so nothing is written between rounds and a lost executor costs its own tasks only.

Defined results. Null vectors and those with null or non-finite components go, as do those too large for `error` to fit a long (from
about 10^5 on, by the number of components) and those whose length isn't that of the kept vector of the smallest id, or no multiple of
the number of parts. Of rows with one id the smallest vector starts a codebook; rows without an id are one id, the last. Repeated
rows are rows each. With fewer ids than entries, codebooks are smaller. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import looked_up, materialise, struct_of, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are searched at once; bounds a task's memory.
AT_ONCE = 2_000


class Codebook:
    """Entries (parts x entries x width, integers) with each entry's neighbours by distance."""

    def __init__(self, entries: np.ndarray):
        parts, n, width = entries.shape
        d = ((entries[:, :, None] - entries[:, None]) ** 2).sum(3)
        near = np.argsort(d, axis=2, kind="stable")
        self.size, self.entries = n, entries
        self.flat, self.neighbours = entries.reshape(parts * n, width), near.reshape(parts * n, n)
        self.distances = np.take_along_axis(d, near, 2).reshape(parts * n, n).astype(float)

    def nearest(self, vectors: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part of each vector (rows x parts x width), the first of equally near ones, and its squared
        distance; previous has the entries to start at."""
        rows, parts, width = vectors.shape
        x = vectors.reshape(-1, width)
        book = np.tile(np.arange(parts) * self.size, rows)
        at = book + previous.reshape(-1)
        from_start = ((x - self.flat[at]) ** 2).sum(1)
        best, code = from_start.copy(), previous.reshape(-1).copy()
        radius = np.sqrt(from_start)
        # squared, with room for rounding: the search goes a little further at most
        reach = (2 * radius) ** 2 * (1 + 1e-12) + 1
        live = np.arange(len(x))
        for k in range(self.size):
            live = live[self.distances[at[live], k] <= reach[live]]
            if not len(live):
                break
            entry = self.neighbours[at[live], k]
            d = ((x[live] - self.flat[book[live] + entry]) ** 2).sum(1)
            better = (d < best[live]) | ((d == best[live]) & (entry < code[live]))
            won = live[better]
            best[won], code[won] = d[better], entry[better]
            reach[won] = (radius[won] + np.sqrt(best[won])) ** 2 * (1 + 1e-12) + 1
        return code.reshape(rows, parts), best.reshape(rows, parts)


def integers(vectors: pa.Array, parts: int) -> np.ndarray:
    """floor(SCALE x) of lists of equal length, rows x parts x width."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(vectors), parts, -1)


def coded(batches: Iterator[pa.RecordBatch], books: list[Codebook], parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batches with their integer vectors, and their codes and squared distances after all codebooks in turn."""
    for whole in batches:
        for lo in range(0, whole.num_rows, AT_ONCE):
            b = whole.slice(lo, AT_ONCE)
            x = integers(b.column("vec"), parts)
            code = np.zeros(x.shape[:2], np.int64)
            for book in books:
                code, error = book.nearest(x, code)
            yield b, x, code, error


class VectorCodes:
    """Codebooks of a table of vectors, and the table's codes."""

    def __init__(self, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
        if not 1 <= entries <= 256:
            raise ValueError("a code has two hex digits: 1 to 256 entries")
        self.parts, self.n, self.rounds = parts, entries, rounds

    def kept(self, df: DataFrame, vec: Column, *columns: Column) -> DataFrame:
        """The columns, and `vec` where it can be coded."""
        size = F.size("vec")
        limit = F.sqrt(F.lit(2.0**62) / size) / (2 * SCALE)
        sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
        rows = df.select(*columns, vec.alias("vec")).filter(F.col("vec").isNotNull() & (size > 0) & (size % self.parts == 0) & F.coalesce(sound, F.lit(False)))
        first = rows.orderBy(F.col("vec_id").asc_nulls_last(), size).select(size.alias("n")).first()
        return rows.filter(size == (first["n"] if first else -1))

    def start(self, rows: DataFrame) -> np.ndarray:
        """The vectors of the smallest ids, cut into parts."""
        ids = [r["vec_id"] for r in rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(self.n).collect()]
        chosen = F.col("vec_id").isin([i for i in ids if i is not None]) | (F.col("vec_id").isNull() & F.lit(None in ids))
        found = {r["vec_id"]: r["v"] for r in rows.filter(chosen).groupBy("vec_id").agg(F.min("vec").alias("v")).collect()}
        x = [[math.floor(SCALE * c) for c in found[i]] for i in ids]
        return np.array(x, np.int64).reshape(len(x), self.parts, len(x[0]) // self.parts if x else 0).transpose(1, 0, 2)

    def moved(self, rows: DataFrame, books: list[Codebook]) -> np.ndarray:
        """Entries replaced by the floored means of the parts assigned to them by the last codebook."""
        parts, n, width = books[-1].entries.shape

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((parts * n, width), np.int64), np.zeros(parts * n, np.int64)
            for _, x, code, _ in coded(batches, books, parts):
                at = (code + np.arange(parts) * n).reshape(-1)
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                total[used] += np.add.reduceat(x.reshape(-1, width)[order], first)
                count += np.bincount(at, minlength=parts * n)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *[pa.array(c) for c in total[used].T]], names=names)

        names = ["at", "n", *[f"s{k}" for k in range(width)]]
        partial = rows.select("vec").mapInArrow(sums, struct_of(**{c: T.LongType() for c in names}))
        out = books[-1].entries.reshape(parts * n, width).copy()
        for r in partial.groupBy("at").agg(*[F.sum(c).alias(c) for c in names[1:]]).collect():  # a row an entry
            out[r["at"]] = [r[c] // r["n"] for c in names[2:]]
        return out.reshape(parts, n, width)

    def __call__(self, df: DataFrame, vec: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
        """vec_id, code, error, label_error, codebooks_sha256 of each kept row."""
        spark, parts = df.sparkSession, self.parts
        rows = self.kept(df, F.col(vec), F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"))
        schema = struct_of(vec_id=T.LongType(), label=T.StringType(), code=T.StringType(), error=T.LongType())
        entries = self.start(rows)
        if not entries.size:
            done = spark.createDataFrame([], schema)
            return done.select("vec_id", "code", "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        books = [Codebook(entries)]
        for _ in range(self.rounds):
            books.append(Codebook(self.moved(rows, books)))

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, _, code, error in coded(batches, books, parts):
                text = [bytes(c).hex() for c in code.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), b.column("label"), pa.array(text, pa.string()), pa.array(error.sum(1))], names=schema.names)

        done = materialise(rows.mapInArrow(codes, schema), "codes").withColumns({"key": F.coalesce("label", F.lit("")), "known": F.col("label").isNotNull()})
        totals = done.groupBy("key", "known").agg(F.try_sum("error").alias("label_error"))
        sha = hashlib.sha256(",".join(map(str, books[-1].entries.reshape(-1).tolist())).encode()).hexdigest()
        return looked_up(done, totals, ["key", "known"], F.col("vec_id")).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VectorCodes()(table(spark, sf_dir, "embeddings"))


def sql() -> str:
    """For vectors of 64 components."""
    x = ["a", "b", "c", "d"]
    distance = " + ".join(f"(v.{c} - e.{c}) * (v.{c} - e.{c})" for c in x)
    floors = ", ".join(f"((sum({c}) - ((sum({c}) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS {c}" for c in x)
    rounds = f"a0 AS MATERIALIZED (SELECT v.row, v.part, min(({distance}) * 64 + e.entry) AS m FROM v JOIN e0 e USING (part) GROUP BY ALL)"
    for k in range(1, ROUNDS + 1):
        rounds += f""", e{k} AS MATERIALIZED (SELECT e.part, e.entry, {", ".join(f"coalesce(s.{c}, e.{c}) AS {c}" for c in x)} FROM e{k - 1} e LEFT JOIN
          (SELECT part, m % 64 AS entry, {floors} FROM v JOIN a{k - 1} USING (row, part) GROUP BY ALL) s ON s.part = e.part AND s.entry = e.entry),
        a{k} AS MATERIALIZED (SELECT v.row, v.part, min(({distance}) * 64 + e.entry) AS m FROM v JOIN e{k} e USING (part) GROUP BY ALL)"""
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS f FROM embeddings
      WHERE embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) for x in embedding])),
    v AS MATERIALIZED (SELECT row, vec_id, part, {", ".join(f"f[4 * part + {k + 1}] AS {c}" for k, c in enumerate(x))} FROM kept, range(16) t(part)),
    e0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, a, b, c, d FROM v WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
    {rounds},
    coded AS (SELECT vec_id, label, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, sum(m // 64)::BIGINT AS error FROM a{ROUNDS} JOIN kept USING (row) GROUP BY row, vec_id, label)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
      (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY part, entry)) FROM e{ROUNDS}) AS codebooks_sha256 FROM coded"""
