"""Source divergence audit: how far the sources of a language are from each other, and by which terms.

A byte-level tokenizer reads the concatenated UTF-8 buffers of a batch through a table of 256 entries: a byte of 0 ends a term,
any other is the term's (lower-cased) byte. Slices are grouped by xxhash64, computed for all slices at once from eight-byte
lanes, and each slice's bytes are compared with those of its group, so a collision of hashes joins nothing. Counts by (language,
source, term) are summed by Spark. Kept terms are dealt to blocks of bounded size; a block is a CSR matrix (sources by terms) in
which all pairs of sources get their part of the divergence by reduceat, in exact integers.

Defined results. Null text, lang and source are ''. A document without a term counts for its group only. Repeated rows are
documents each. A source without a peer in its language has no `pair` rows; a language without kept terms has `pair` rows of
value 0 and no `term` rows. Texts of any length are read in windows that end between terms. Columns beyond text, lang and source
aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessella.llm.common import looked_up, materialise, struct_of, table

LEAST_DOCS, TOP = 10, 10
#: Bytes of text that one window holds, and cells (source, term) of one block.
WINDOW_BYTES, BLOCK_CELLS = 8 << 20, 200_000

#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Slices from this length on go through the library one by one.
LONG = 32

COUNTS = struct_of(lang=T.StringType(), source=T.StringType(), term=T.StringType(), n=T.LongType(), docs=T.LongType())
PARTS = struct_of(lang=T.StringType(), source=T.StringType(), part=T.StringType(), item=T.StringType(), value=T.LongType())


def byte_table() -> np.ndarray:
    """The folded byte of each byte: 0 for ASCII that is no letter, lower case for A-Z, itself for the rest."""
    t = np.arange(256, dtype=np.uint8)
    upper, lower, wide = (t >= 65) & (t <= 90), (t >= 97) & (t <= 122), t >= 128
    return np.where(upper, t + 32, np.where(lower | wide, t, 0)).astype(np.uint8)


TABLE = byte_table()


def term_slices(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document of each term; folded holds the documents' bytes, document k's from offsets[k] on."""
    inside = folded != 0
    starts, ends = inside.copy(), np.zeros(len(folded) + 1, dtype=bool)
    starts[1:] &= ~inside[:-1]
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(folded))]  # a term ends where its document does
    starts[cuts], ends[cuts] = inside[cuts], inside[cuts - 1]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) - at, np.searchsorted(offsets, at, side="right") - 1


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashes(folded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of each slice; slices of one length go through each step together."""
    padded = np.concatenate([folded, np.zeros(8, np.uint8)])
    lanes = np.ndarray(shape=(len(folded) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(lengths, kind="stable")
    known, first = np.unique(lengths[order], return_index=True)
    with np.errstate(over="ignore"):
        for size, rows in zip(known.tolist(), np.split(order, first[1:]), strict=True):
            if size >= LONG:
                out[rows] = [xxhash.xxh64_intdigest(folded[s : s + size].tobytes()) for s in starts[rows].tolist()]
                continue
            at = starts[rows]
            h = np.full(len(rows), P5 + np.uint64(size))
            for k in range(0, size - size % 8, 8):
                h = rotated(h ^ (rotated(lanes[at + k] * P2, 31) * P1), 27) * P1 + P4
            k = size - size % 8
            if size % 8 >= 4:
                h = rotated(h ^ ((lanes[at + k] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
                k += 4
            for j in range(k, size):
                h = rotated(h ^ (padded[at + j].astype(np.uint64) * P5), 11) * P1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[rows] = h ^ (h >> np.uint64(32))
    return out


def same_bytes(folded: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the slices of these lengths at a and at b hold the same bytes."""
    padded = np.concatenate([folded, np.zeros(8, np.uint8)])
    lanes = np.ndarray(shape=(len(folded) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    same = np.ones(len(a), bool)
    live = np.arange(len(a))
    for k in range(0, int(lengths.max(initial=0)), 8):
        live = live[lengths[live] > k]
        left = np.minimum(lengths[live] - k, 8).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8))
        same[live] &= ((lanes[a[live] + k] ^ lanes[b[live] + k]) & mask) == 0
    return same


def term_codes(folded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice's term, and the terms: groups of equal hash whose bytes are equal."""
    _, first, code = np.unique(hashes(folded, starts, lengths), return_index=True, return_inverse=True)
    like = first[code]
    alike = lengths == lengths[like]
    alike[alike] = same_bytes(folded, starts[alike], starts[like[alike]], lengths[alike])
    terms = [folded[s : s + n].tobytes() for s, n in zip(starts[first].tolist(), lengths[first].tolist(), strict=True)]
    apart: dict[bytes, int] = {}  # slices whose hash is another term's
    for i in np.flatnonzero(~alike).tolist():
        word = folded[starts[i] : starts[i] + lengths[i]].tobytes()
        code[i] = apart.setdefault(word, len(terms) + len(apart))
    return code, terms + list(apart)


def counted(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """Groups, terms, occurrences and documents of each (group, term) of a batch, a window of whole documents at a time; a document
    beyond a window is read in pieces, whose counts are put together."""
    k = 0
    while k < len(offsets) - 1:
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + WINDOW_BYTES, side="right")) - 1)
        lo, hi = int(offsets[k]), int(offsets[end])
        if hi - lo > WINDOW_BYTES:  # one long document
            whole: Counter[bytes] = Counter()
            while lo < hi:
                cut = min(hi, lo + WINDOW_BYTES)
                while cut < hi and TABLE[data[cut]]:
                    cut += 1
                folded = TABLE[data[lo:cut]]
                at, size, _ = term_slices(folded, np.array([0]))
                code, terms = term_codes(folded, at, size)
                whole.update(dict(zip(terms, np.bincount(code, minlength=len(terms)).tolist(), strict=True)))
                lo = cut
            yield np.full(len(whole), group[k]), list(whole), np.array(list(whole.values()), np.int64), np.ones(len(whole), np.int64)
        elif hi > lo:
            folded = TABLE[data[lo:hi]]
            at, size, doc = term_slices(folded, offsets[k:end] - lo)
            code, terms = term_codes(folded, at, size)
            pairs, n = np.unique(doc * max(1, len(terms)) + code, return_counts=True)
            doc, code = pairs // max(1, len(terms)), pairs % max(1, len(terms))
            cells, back = np.unique(group[k:end][doc] * max(1, len(terms)) + code, return_inverse=True)
            of = np.zeros(len(cells), np.int64)
            np.add.at(of, back, n)
            yield cells // max(1, len(terms)), [terms[c] for c in (cells % max(1, len(terms))).tolist()], of, np.bincount(back, minlength=len(cells)).astype(np.int64)
        k = end


def strings(words: list[bytes]) -> pa.Array:
    """UTF-8 bytes as Arrow strings, as they are."""
    ends = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]).astype(np.int32)
    return pa.Array.from_buffers(pa.utf8(), len(words), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(words))])


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of batches with text, lang and source."""
    for b in batches:
        text = b.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        names = [b.column(c).dictionary_encode() for c in ("lang", "source")]
        width = max(1, len(names[1].dictionary))
        group = names[0].indices.to_numpy().astype(np.int64) * width + names[1].indices.to_numpy()
        for g, terms, n, docs in counted(data, offsets, group):
            who = [pc.take(names[0].dictionary, pa.array(g // width)), pc.take(names[1].dictionary, pa.array(g % width))]
            yield pa.RecordBatch.from_arrays([*who, strings(terms), pa.array(n), pa.array(docs)], names=COUNTS.names)


def shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), three digits at a time: nothing overflows below 9 * 10^15 occurrences."""
    whole, left, below = np.zeros_like(count), count + 2, total + 2 * terms
    for _ in range(3):
        left = left * 1000
        whole, left = whole * 1000 + left // below, left % below
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def summed(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the rows of a CSR matrix by reduceat; empty rows are 0."""
    out = np.zeros(len(ends) - 1, np.int64)
    full = np.flatnonzero(ends[1:] > ends[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, ends[:-1][full])
    return out


def block_parts(terms: list[bytes], of_lang: np.ndarray, indptr: np.ndarray, columns: np.ndarray, counts: np.ndarray, totals: np.ndarray, lang_total: int, kept: int, top: int = TOP):
    """For each source of a CSR block: its divergence from each later source over the block's terms, and its `top` terms (number,
    value) beyond the language's share."""
    p = np.concatenate([shares(counts[lo:hi], int(t), kept) for lo, hi, t in zip(indptr[:-1], indptr[1:], totals, strict=True)] or [counts])
    p0 = np.array([shares(np.zeros(1, np.int64), int(t), kept)[0] for t in totals]) if kept else np.ones(len(totals), np.int64)
    q = shares(of_lang, lang_total, kept) if kept else of_lang
    row = np.repeat(np.arange(len(totals)), np.diff(indptr))
    for a in range(len(totals)):
        own, lo = columns[indptr[a] : indptr[a + 1]], int(indptr[a + 1])
        mine = np.full(len(terms), p0[a], np.int64)
        mine[own] = p[indptr[a] : indptr[a + 1]]
        rest = p0[a + 1 :]
        # as if the later sources had no term of the block ...
        base = (len(terms) - len(own)) * apart(p0[a], rest)
        if len(own) and len(rest):
            base = base + np.array([int(apart(mine[own], x).sum()) for x in rest])
        # ... and what their own terms change
        at, them = columns[lo:], row[lo:]
        change = apart(mine[at], p[lo:]) - apart(mine[at], p0[them])
        ahead = np.flatnonzero(mine[own] > q[own])
        value = apart(mine[own[ahead]], q[own[ahead]])
        best = ahead[np.lexsort((own[ahead], -value))[:top]]
        yield base + summed(change, indptr[a + 1 :] - lo), own[best], apart(mine[own[best]], q[own[best]])


def compared(block: pa.Table, groups: pa.Table) -> pa.Table:
    """The parts of one block of terms of one language: block has term, n and cells (source, n), groups its sources."""
    g = groups.sort_by("source").to_pydict()
    at = {s: k for k, s in enumerate(g["source"])}
    rows = sorted(zip([t.encode() for t in block.column("term").to_pylist()], block.column("n").to_pylist(), block.column("cells").to_pylist(), strict=True), key=lambda x: x[0])
    terms = [r[0] for r in rows]
    triple = np.array([(at[c["source"]], k, c["n"]) for k, r in enumerate(rows) for c in r[2]], np.int64).reshape(-1, 3)
    triple = triple[np.lexsort((triple[:, 1], triple[:, 0]))]
    indptr = np.concatenate([[0], np.cumsum(np.bincount(triple[:, 0], minlength=len(at)))]).astype(np.int64)
    done = block_parts(terms, np.array([r[1] for r in rows], np.int64), indptr, triple[:, 1], triple[:, 2], np.array(g["total"], np.int64), g["lang_total"][0], g["kept"][0])
    out: list[tuple[str, str, str, int]] = []
    for a, (pairs, best, value) in enumerate(done):
        me = g["source"][a]
        out += [(me, "pair", other, v) for other, v in zip(g["source"][a + 1 :], pairs.tolist(), strict=True)]
        out += [(me, "term", terms[t].decode(errors="replace"), v) for t, v in zip(best.tolist(), value.tolist(), strict=True)]
    columns = list(zip(*out, strict=True)) or [()] * 4
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.Table.from_arrays([pa.array([g["lang"][0]] * len(out), pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=PARTS.names)


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents with text, lang and source."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    cells = rows.mapInArrow(term_counts, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("cells"))
    kept = materialise(kept.filter(F.col("docs") >= least_docs).drop("docs"), "terms")
    # a row for each source and language
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"), F.ceil(F.sum(F.size("cells")) / BLOCK_CELLS).alias("blocks"))
    totals = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialise(groups.fillna({"total": 0, "kept": 0, "lang_total": 0, "blocks": 1}), "groups")
    blocks = groups.groupBy("lang").agg(F.max("blocks").alias("blocks"))
    dealt = looked_up(kept, blocks, ["lang"], F.col("term")).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).drop("blocks")
    spread = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    parts = materialise(dealt.groupBy("lang", "block").cogroup(spread.groupBy("lang", "block")).applyInArrow(compared, PARTS), "parts")
    half = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    w = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = both.unionByName(parts.filter("part = 'term'")).withColumn("rank", F.row_number().over(w))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


def sql() -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    words AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= {LEAST_DOCS}),
    langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
    cells AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    groups AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS lang_total, coalesce((SELECT sum(n) FROM cells c WHERE c.lang = g.lang AND c.source = g.source), 0)::BIGINT AS total
      FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs USING (lang)),
    shares AS (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, 1 + 1000000000::BIGINT * (coalesce(c.n, 0) + 2) // (total + 2 * v) AS p, 1 + 1000000000::BIGINT * (k.n + 2) // (lang_total + 2 * v) AS q
      FROM groups g JOIN kept k USING (lang) LEFT JOIN cells c USING (lang, source, term)),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
        ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    items AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM items
    QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= {TOP}"""
