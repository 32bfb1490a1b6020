"""Exact fingerprints of canonical texts, in DataFrame functions only.

The canonical form is Unicode compatibility composition (NFKC), full case folding, composition again, and white space folded to
single spaces without any at the ends; composition and folding are ICU's, called by the SQL function `reflect`. The fingerprint
is a wide hash, two 64-bit xxhash values of the canonical text. Texts whose hashes are equal are compared byte by byte inside
their bucket: should two different texts ever share a bucket, each gets its rank among the bucket's texts appended, so a
fingerprint stands for one canonical text exactly.

Defined results. A null text is an empty one; texts of white space only share the empty text's fingerprint. Repeated rows get
equal fingerprints. An empty table gives an empty result. Columns beyond those named are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import materialise, table, unused

#: Code points that count as white space in the canonical form.
SPACES = r"[\s\x{85}\p{Z}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text that is not null."""
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    # text in ASCII is its own composition, and its lower case is its folding
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(compose(fold))
    return F.trim(F.regexp_replace(folded, SPACES, " "))


def wide(text: Column) -> Column:
    """128 bits of xxhash as 32 hex digits."""
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(digits(F.xxhash64(text)), digits(F.xxhash64(F.lit(0x9E3779B97F4A7C15 - 2**64), text)))


def within(rows: DataFrame, keys: DataFrame, on: str, broadcast_rows: int = 2_000_000) -> DataFrame:
    """The rows whose value of `on` is among keys: filtered in place while the keys are few enough to be broadcast (they are
    counted), by a shuffled semi-join otherwise."""
    return rows.join(F.broadcast(keys) if keys.count() <= broadcast_rows else keys, on, "left_semi")


def mixed_buckets(rows: DataFrame, digest: str, text: str) -> DataFrame:
    """The digests that stand for two different texts, by comparing bytes: of each task and bucket only the smallest and the
    largest text go on, and where these are equal at the end the whole bucket is equal."""
    return rows.groupBy(digest).agg(F.min(text).alias("__a"), F.max(text).alias("__b")).filter("__a <> __b").select(digest)


def ranked(rows: DataFrame, mixed: DataFrame, digest: str, text: str) -> DataFrame:
    """(digest, sha, rank) of the texts in mixed buckets."""
    own = rows.join(mixed, digest, "left_semi").select(digest, text).distinct()
    return own.select(F.col(digest).alias("__cd"), F.sha2(text, 256).alias("__sha"), F.dense_rank().over(Window.partitionBy(digest).orderBy(text)).alias("__rank"))


def settled(rows: DataFrame, ranks: DataFrame, digest: str, sha: str) -> DataFrame:
    """rows with the ranks of clashing texts appended to their digests."""
    names = unused(rows.columns, "d", "sha", "rank")
    d, own, rank = names
    out = rows.join(ranks.toDF(*names), (F.col(digest) == F.col(d)) & (F.col(sha) == F.col(own)), "left")
    return out.withColumn(digest, F.concat(digest, F.coalesce(F.concat(F.lit("-"), F.col(rank).cast("string")), F.lit("")))).drop(*names)


def shared_digests(digests: DataFrame) -> DataFrame:
    """The digests (column `d`) that occur more than once: only these buckets can hold two texts."""
    return materialise(digests.groupBy("d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("d"), "buckets")


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the column `out`."""
    form, own = unused(docs.columns, "canon", "sha")
    rows = docs.withColumn(form, canonical(F.coalesce(F.col(text_col), F.lit("")))).withColumn(out, wide(F.col(form)))
    texts = rows.select(F.col(out).alias("d"), F.col(form).alias("c"))
    texts = within(texts, shared_digests(texts.select("d")), "d")
    mixed = materialise(mixed_buckets(texts, "d", "c"), "mixed")
    if not mixed.head(1):
        return rows.drop(form)
    return settled(rows.withColumn(own, F.sha2(form, 256)), ranked(texts, mixed, "d", "c"), out, own).drop(form, own)


def bounds(ids: DataFrame, key: str, rows_per_bucket: int, most: int) -> list[int]:
    """Ids that cut the table into ranges of about equal rows: at most `most` of them."""
    n = ids.count()
    k = min(most, max(1, n // rows_per_bucket))
    cuts = ids.agg(F.percentile_approx(key, [i / k for i in range(1, k)] or [0.5], max(10_000, 4 * k)).alias("q")).head()["q"] if n else None
    return sorted(set(cuts or []))


def constant(values: list[int]) -> Column:
    """An array of whole numbers, one constant after folding however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below key, by binary search."""
    if not cuts:
        return F.lit(0)
    array = constant(cuts)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    return F.reduce(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(array, at + step - 1) <= key), at + step).otherwise(at))


def last_third_replaced(text: Column, by: Column) -> Column:
    """text with its last floor(n / 3) code points replaced by the first as many of `by`."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(by, F.lit(1), third))


def with_next(docs: DataFrame, id_col: str, carried: dict[str, Column], rows_per_bucket: int = 4096, most_buckets: int = 65_536) -> DataFrame:
    """(__id, carried columns, and as next_* the id and carried columns of the next document by descending id; after the last
    the first).

    Documents go once to ranges of ids, with the highest document of each range sent to the range above as well. Inside a
    range a window looks one row back; the lowest document of all finds the highest one the same way. Rows with one id follow
    in the order of their carried columns' hashes; rows without an id stand below all ids.
    """
    order = F.coalesce(F.col(id_col), F.lit(-(2**63)))
    rows = docs.select(F.col(id_col).alias("__id"), order.alias("__o"), *[c.alias(n) for n, c in carried.items()])
    ids = docs.select(order.alias("__o"))
    cuts = bounds(ids, "__o", rows_per_bucket, most_buckets)
    own = bucket_of(F.col("__o"), cuts)
    tops = sorted(r["top"] for r in ids.groupBy(own.alias("b")).agg(F.max("__o").alias("top")).collect())
    if not tops:
        return rows.drop("__o").select("*", *[F.col(n).alias(f"next_{n}") for n in ("__id", *carried)])
    at = [bisect_right(cuts, t) for t in tops]
    # a range's highest document is a guest in the next range that has rows; the last range's is one in the first
    top, guest = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for k, (t, b) in enumerate(zip(tops, at, strict=True)):
        top[b], guest[b] = t, at[(k + 1) % len(at)]
    place = lambda b, g: F.struct(b.cast("int").alias("b"), F.lit(g).alias("guest"))
    places = F.when(F.col("__o") == F.get(constant(top), own), F.array(place(own, False), place(F.get(constant(guest), own), True))).otherwise(F.array(place(own, False)))
    sent = rows.withColumn("__p", F.explode(places)).select("__id", "__o", *carried, F.col("__p.b").alias("__b"), F.col("__p.guest").alias("__guest"))
    # guests come first: their ids are below the range's, or they are the table's highest document before its lowest
    w = Window.partitionBy("__b").orderBy(F.col("__guest").desc(), "__o", F.xxhash64(*carried))
    back = sent.select("*", *[F.lag(n).over(w).alias(f"next_{n}") for n in ("__id", *carried)])
    return back.filter("NOT __guest").drop("__b", "__guest", "__o")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: fingerprints of every document and of its edited text."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    both = with_next(docs, "doc_id", {"t": text, "d": wide(canonical(text))})
    edited = both.withColumn("e", last_third_replaced(F.col("t"), F.col("next_t"))).withColumn("ec", canonical(F.col("e")))
    # a document is found again by the hash of its id and text, so repeated and null ids do no harm
    keys = [F.xxhash64("__id", "t").alias("k"), F.xxhash64("next___id", "next_t").alias("next_k")]
    rows = materialise(
        edited.select(
            F.col("__id").alias("doc_id"), *keys, F.char_length("t").cast("long").alias("n_chars"), F.sha2("e", 256).alias("edited_sha256"),
            "d", "next_d", wide(F.col("ec")).alias("ed"),
        ),
        "fingerprints",
    )
    # buckets of two or more, over own and edited texts; the texts in them are made again and compared
    shared = shared_digests(rows.select("d").unionByName(rows.select(F.col("ed").alias("d"))))
    own = within(docs.select(canonical(text).alias("c")).withColumn("d", wide(F.col("c"))), shared, "d")
    pairs = within(rows.select(F.col("ed").alias("d"), "k", "next_k", "edited_sha256"), shared, "d").drop("d").distinct()
    pairs = materialise(pairs, "pairs")
    needed = pairs.select("k").unionByName(pairs.select(F.col("next_k").alias("k"))).distinct()
    texts = within(docs.select(F.xxhash64(F.col("doc_id"), text).alias("k"), text.alias("t")), needed, "k").dropDuplicates(["k"])
    made = pairs.join(texts, "k").join(texts.select(F.col("k").alias("next_k"), F.col("t").alias("next_t")), "next_k")
    made = made.withColumn("e", last_third_replaced(F.col("t"), F.col("next_t"))).filter(F.sha2("e", 256) == F.col("edited_sha256"))
    made = made.select(canonical(F.col("e")).alias("c")).withColumn("d", wide(F.col("c")))
    compared = own.unionByName(made)
    mixed = materialise(mixed_buckets(compared, "d", "c"), "mixed")
    if mixed.head(1):
        ranks = ranked(compared, mixed, "d", "c")
        shas = both.withColumn("e", last_third_replaced(F.col("t"), F.col("next_t"))).select(
            *keys, *[F.sha2(canonical(F.col(c)), 256).alias(f"sha_{c}") for c in ("t", "next_t", "e")],
        )
        rows = rows.join(shas.distinct(), ["k", "next_k"])
        for digest, sha in (("d", "sha_t"), ("next_d", "sha_next_t"), ("ed", "sha_e")):
            rows = settled(rows, ranks, digest, sha)
    alike = lambda c: F.when(F.col("d") == F.col(c), 1.0).otherwise(0.0)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.col("d").alias("fingerprint"), F.col("ed").alias("edited_fingerprint"), alike("ed").alias("near_edited"), alike("next_d").alias("near_next")
    )
