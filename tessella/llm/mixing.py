"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source's share of the corpus's tokens, raised to an exponent between 0 and 1 and normalised, is its weight: 1 keeps the corpus
as it is, 0 gives all sources the same weight. The exponent is bisected to the smallest one (the flattest mixture) that keeps
a repetition limit, or to the one that meets a target entropy. Weights become a sequence of tokens by budgeted block
permutations: a source's documents are dealt to blocks by hash, the blocks are permuted anew for each pass over the source,
and passes are taken until the source's budget (weight times the whole budget) is used up; in the last pass the budget ends
within one block, which is taken document by document. Sources are interleaved by how much of their budget is used, so every
stretch of the result holds about the target weights.

Tokens are words (runs without ASCII white space); a document without words costs none and is taken in every pass that reaches
its block.

Defined results. A null source is a source of its own. Repeated rows are dealt as often as they occur. An empty table gives an
empty result; a corpus without words keeps every row once. With `budget` None, the budget is the smallest that uses every
document at least once, so nothing is lost and only repetitions are added. Columns beyond id, text and source pass through
apply(); mixture() returns its own columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import WORD, materialise, table, unused

#: Stands for a null source inside the operator.
NO_SOURCE = "\x00"
#: How much more often than the least repeated source the most repeated one may be used, in the query and the stage.
MOST_REPETITIONS = 4.0


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Plan:
    """The exponent, and by source its tokens, weight and budget in tokens."""

    exponent: float
    tokens: dict[str, int]
    weights: dict[str, float]
    budgets: dict[str, int]


def weights_at(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Normalised powers of the token shares; a source without tokens has weight 0."""
    total = sum(tokens.values())
    raised = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    return {s: w / sum(raised.values()) for s, w in raised.items()}


def entropy(weights: dict[str, float]) -> float:
    """In nats."""
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def repetitions(tokens: dict[str, int], weights: dict[str, float], budget: float | None) -> dict[str, float]:
    """How often each source is used; without a budget, as often as the least used one is used once."""
    ratio = {s: weights[s] / n for s, n in tokens.items() if n}
    scale = budget if budget is not None else 1 / min(ratio.values())
    return {s: r * scale for s, r in ratio.items()}


def plan(tokens: dict[str, int], budget: int | None, most_repetitions: float | None, target_entropy: float | None, rounds: int = 60) -> Plan:
    """Bisect the exponent. Both limits fall monotonically: repetitions and entropy shrink as the exponent grows to 1."""
    if not sum(tokens.values()):
        return Plan(1.0, tokens, dict.fromkeys(tokens, 0.0), dict.fromkeys(tokens, 0))

    def flat_enough(x: float) -> bool:
        """Whether the exponent is as high as the limits ask."""
        w = weights_at(tokens, x)
        if target_entropy is not None and entropy(w) > target_entropy:
            return False
        return most_repetitions is None or max(repetitions(tokens, w, budget).values()) <= most_repetitions

    low, high = 0.0, 1.0
    if flat_enough(low):
        high = low
    for _ in range(rounds if high > low else 0):
        mid = (low + high) / 2
        low, high = (low, mid) if flat_enough(mid) else (mid, high)
    w = weights_at(tokens, high)
    used = repetitions(tokens, w, budget)
    return Plan(high, tokens, w, {s: round(used.get(s, 0.0) * n) for s, n in tokens.items()})


def source_of(source_col: str) -> Column:
    return F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))


def hashes_of(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two 64-bit hashes that stand for a row's id and text."""
    return F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col))


def mixture(
    docs: DataFrame, budget: int | None = None, most_repetitions: float | None = 1.25, target_entropy: float | None = None, seed: int = 9, rows_per_block: int = 1024,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, Plan]:
    """One row per use of a document: id, src, tok (its tokens), h and g (hashes of id and text), pass, block and position (0 to 1,
    the share of the source's budget used before it); and the plan.

    A source has as many blocks as its rows ask for, so a block is bounded. What is summed in order are blocks, not rows, and
    these sums are taken in two steps (groups of blocks, then inside a group), so no source is one task. Only the one block per
    source in which its budget ends is summed document by document.
    """
    h, g = hashes_of(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), source_of(source_col).alias("src"), tokens_of(F.col(text_col)).alias("tok"), h.alias("h"), g.alias("g"))
    rows = materialise(rows, "tokens")
    found = rows.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("tok").alias("tok")).collect()
    made = plan({r["src"]: r["tok"] for r in found}, budget, most_repetitions, target_entropy)
    blocks = {r["src"]: max(1, -(-r["n"] // rows_per_block)) for r in found}
    return deal(rows, made, blocks, seed), made


def lookup(values: dict[str, float | int], kind: str) -> Column:
    """A constant per source; sources are the mixture's components and stay few."""
    if not values:
        return F.lit(None).cast(kind)
    return F.create_map(*[x for s, v in values.items() for x in (F.lit(s), F.lit(v).cast(kind))])[F.col("src")]


def deal(rows: DataFrame, made: Plan, blocks: dict[str, int], seed: int) -> DataFrame:
    """(id, src, tok, h, g, pass, block, position) of every use."""
    n_blocks, budgets, tokens = lookup(blocks, "long"), lookup(made.budgets, "long"), lookup(made.tokens, "long")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "h"), n_blocks))
    sums = rows.groupBy("src", "block").agg(F.sum("tok").alias("btok"))
    # each pass has its own permutation; a source without tokens has one pass
    passes = F.when(tokens > 0, F.ceil(budgets / tokens)).otherwise(F.lit(1)).cast("int")
    turns = sums.withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(passes, F.lit(1)) - 1)))
    turns = turns.withColumn("order", F.xxhash64(F.lit(seed + 1), "src", "pass", "block"))
    # running sums: groups of blocks by the high bits of their order, then inside a group
    turns = turns.withColumn("group", F.shiftright("order", 54))
    groups = turns.groupBy("src", "pass", "group").agg(F.sum("btok").alias("gtok"))
    before = F.coalesce(F.sum("gtok").over(Window.partitionBy("src", "pass").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("src", "pass", "group", before.alias("gstart"))
    inside = F.coalesce(F.sum("btok").over(Window.partitionBy("src", "pass", "group").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("inside", inside).join(groups, ["src", "pass", "group"])
    turns = turns.withColumn("start", F.col("pass") * tokens + F.col("gstart") + F.col("inside")).filter((F.col("start") < budgets) | (tokens == 0) | (F.col("btok") == 0) & (F.col("pass") == 0))
    turns = turns.select("src", "block", "pass", "start", (F.col("start") + F.col("btok") > budgets).alias("last"))
    used = rows.join(turns, ["src", "block"])
    # documents inside a block by hash; only in the block where the budget ends does their running sum decide
    w = Window.partitionBy("src", "block", "pass").orderBy(F.xxhash64(F.lit(seed + 2), "pass", "h"), "h", "id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum("tok").over(w), F.lit(0))
    used = used.withColumn("at", at).filter(~F.col("last") | (F.col("at") < budgets) | (F.col("at") == 0))
    return used.select("id", "src", "tok", "h", "g", "pass", "block", (F.col("at") / F.greatest(budgets, F.lit(1))).alias("position"))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with every row as often as the mixture uses it.

    Rows meet their uses by source and a 128-bit hash of id and text. k rows that are equal in these and have u uses in all get
    u // k uses each, the first u % k of them one more.
    """
    uses, _ = mixture(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    *names, n, all_, own, copy = unused(docs.columns, "src", "h", "g", "uses", "equal", "turn", "copy")
    counts = uses.groupBy(*[F.col(c).alias(name) for c, name in zip(("src", "h", "g"), names, strict=True)]).agg(F.count(F.lit(1)).alias(n))
    keyed = docs.withColumns(dict(zip(names, (source_of(source_col), *hashes_of(id_col, text_col)), strict=True)))
    same = Window.partitionBy(*names)
    both = keyed.join(counts, names).withColumns({all_: F.count(F.lit(1)).over(same), own: F.row_number().over(same.orderBy(names[1]))})
    times = F.floor(F.col(n) / F.col(all_)) + F.when(F.col(own) <= F.col(n) % F.col(all_), 1).otherwise(0)
    return both.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias(copy)).drop(copy)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every use of a document in the mixture, with its source's weight."""
    uses, made = mixture(table(spark, sf_dir, "documents"), most_repetitions=MOST_REPETITIONS)
    return uses.select(
        F.col("id").alias("doc_id"), F.when(F.col("src") != NO_SOURCE, F.col("src")).alias("source"), F.col("tok").alias("n_tokens"), "pass", "block", "position",
        lookup(made.weights, "double").alias("weight"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture uses them."""
    return apply(docs, most_repetitions=MOST_REPETITIONS)
