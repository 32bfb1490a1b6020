"""Best-fit decreasing packing of tokenised documents into sequences.

A document is its token ids and a closing 0. Documents longer than a sequence are cut into full sequences, their first piece
taking the rest. Best-fit decreasing depends on nothing but the pieces' lengths, and a length is at most the sequence's. So the
pieces are counted by length (one row per length, whatever the corpus), a plan is made over these counts, and each piece looks
up its place by its length and its number among the pieces of that length.

The plan is exact best-fit decreasing: lengths from long to short, each piece into the tightest open bin that holds it, found
by a segment tree over the remaining capacities. Bins with the same contents are one class with a count, and equal pieces
are placed a run at a time, which gives the same bins as one at a time. A piece that fills a sequence needs no plan.

Defined results. A null text is an empty one: its one piece is the closing 0. Equal pieces may swap places, repeated rows are
packed as often as they occur, an empty table gives an empty result, extra columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import materialise, numbered, struct_of, table

SEPARATOR = bytes(4)


class Encoder:
    """Token ids as little-endian 32-bit bytes. The ranks file holds the JSON file's vocabulary and encodes it several times
    faster; a text with a special token's string goes through the JSON tokenizer itself, which reads that string as the token."""

    def __init__(self, json_file: str, ranks_file: str, special: str = "<|endoftext|>"):
        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.json_file, self.special, self.json = json_file, special, None
        self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.special in text:
            return self.by_json(text)
        return np.array(self.plain.encode_ordinary(text), dtype="<u4").tobytes()

    def by_json(self, text: str) -> bytes:
        if self.json is None:
            from tokenizers import Tokenizer

            self.json = Tokenizer.from_file(self.json_file)
        ids = self.json.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


@cache
def encoder(json_file: str, ranks_file: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(json_file, ranks_file)


def vocabulary_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


PIECE = struct_of(piece=T.IntegerType(), start=T.LongType(), length=T.LongType(), ids_crc32=T.LongType())


def cut(ids: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids: full pieces, the first one with what is left."""
    n = len(ids) // 4
    first = n % size or min(n, size)
    bounds = [0, first, *range(first + size, n + 1, size)]
    return [(k, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]


def pieces(docs: DataFrame, size: int, files: tuple[str, str], id_col: str, text_col: str) -> DataFrame:
    """One row per piece: the id column and PIECE."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files)
        for b in batches:
            at, rows = [], []
            for k, text in enumerate(b.column("__t").to_pylist()):
                own = cut(encode(text) + SEPARATOR, size)
                rows += own
                at += [k] * len(own)
            columns = zip(*rows, strict=True) if rows else [()] * len(PIECE)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("__id").take(pa.array(at, type=pa.int64())), *[pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)]], ["__id", *PIECE.fieldNames()])

    read = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    schema = T.StructType([T.StructField("__id", read.schema["__id"].dataType), *PIECE.fields])
    return read.mapInArrow(of, schema).withColumnRenamed("__id", id_col)


class Capacities:
    """A segment tree over the remaining capacities 0 to size; a leaf holds the bin classes open at that capacity."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.open = np.zeros(2 * self.width, dtype=bool)
        self.classes: list[list[list]] = [[] for _ in range(self.width)]

    def set(self, at: int) -> None:
        node = at + self.width
        self.open[node] = bool(self.classes[at])
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least `need` with an open bin, or -1."""
        node = need + self.width
        if self.open[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.width
            node //= 2
        return -1

    def put(self, at: int, first: int, count: int) -> None:
        self.classes[at].append([first, count])
        self.set(at)

    def take(self, at: int, most: int) -> tuple[int, int]:
        """Up to `most` bins of one class at this capacity: (first bin, count)."""
        own = self.classes[at][-1]
        first, n = own[0], min(most, own[1])
        if n == own[1]:
            self.classes[at].pop()
        else:
            own[0] += n
            own[1] -= n
        self.set(at)
        return first, n


def plan(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, ranks, first bin, offset) of best-fit decreasing over pieces counted by length, and the bins
    used. Bins of a class have consecutive numbers: rank r of a run goes to bin first bin + r - first rank."""
    tree, runs, bins = Capacities(size), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = tree.tightest(length)
            room = size if at < 0 else at
            # a bin that gets a piece becomes the tightest, until it holds no further one: bins are filled one after the other
            fit = room // length
            n, deep = (left // fit, fit) if left >= fit else (1, left)
            if at < 0:
                first, bins = bins, bins + n
            else:
                first, n = tree.take(at, n)
            runs += [(length, rank + k * n, n, first, size - room + k * length) for k in range(deep)]
            tree.put(room - deep * length, first, n)
            rank, left = rank + n * deep, left - n * deep
    return runs, bins


def pack(docs: DataFrame, size: int = 2048, files: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id and offset.

    The plan's runs are bounded by the sequence's size alone (at most two new bin classes per length), so the table of runs
    that is broadcast does not grow with the corpus.
    """
    spark = docs.sparkSession
    cuts = materialise(pieces(docs, size, files or vocabulary_files(), id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, full = sum(counts.values()), counts.pop(size, 0)
    runs, bins = plan(counts, size)
    assert len(runs) <= 4 * size * size
    runs_df = spark.createDataFrame(runs, "r_length long, r_rank long, r_n long, r_bin long, r_offset long")
    ranked = numbered(cuts, ["length"], F.struct(id_col, "piece", "ids_crc32"), "rank", total)
    # runs of a length are disjoint and cover its ranks: the last one that starts at or before a rank holds it
    by_length = runs_df.groupBy("r_length").agg(F.sort_array(F.collect_list(F.struct("r_rank", "r_bin", "r_offset"))).alias("runs"))
    at = """aggregate(array(2097152,1048576,524288,262144,131072,65536,32768,16384,8192,4096,2048,1024,512,256,128,64,32,16,8,4,2,1), 0,
      (p, s) -> IF(p + s < size(runs) AND runs[least(p + s, size(runs) - 1)].r_rank <= rank, p + s, p))"""
    placed = ranked.join(F.broadcast(by_length), F.col("length") == F.col("r_length"), "left").withColumn("run", F.expr(f"runs[{at}]"))
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32",
        F.when(F.col("length") == size, F.lit(bins) + F.col("rank")).otherwise(F.col("run.r_bin") + F.col("rank") - F.col("run.r_rank")).alias("sequence_id"),
        F.when(F.col("length") == size, F.lit(0).cast("long")).otherwise(F.col("run.r_offset")).alias("offset"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every piece of every document with its place."""
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places; the last stage."""
    return pack(docs)
