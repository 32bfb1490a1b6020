"""Choices in which each depends on the one before: of items in order, each takes its first option at or after the point where the last taken
one ended.

The state that goes from item to item is one number, and an option ends a bounded number of bars after its item's first one. So what a
block of bars does to the state is a map of span + 1 numbers: where it leaves off for each point at which it may be entered.
Maps of blocks are made side by side, put together by super-blocks, and again over these; then each block knows where it
is entered and settles its own items. No task holds more than a block's items or a super-block's maps, whatever a key's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.stage import staged

#: Bars of a block, and blocks of a super-block.
BLOCK, SUPER = 256, 2_048


def option(at: Column, free: Column) -> Column:
    """An option at a bar, after which the next may start at bar `free`."""
    return F.struct(at.cast("long").alias("at"), free.cast("long").alias("free"))


def leaves(state: Column, options: Column) -> Column:
    """The state after an item."""
    return F.coalesce(F.get(F.filter(options, lambda o: o["at"] >= state), F.lit(0))["free"], state)


def first_come(items: DataFrame, keys: tuple[str, ...], first: str, options: str, order: list[Column], span: int, block: int = BLOCK, super_: int = SUPER) -> DataFrame:
    """The items that take an option, with `__at` and `__free` of it in place of `options`.

    `first` is the earliest bar at which an item could take one and must rise with `order`; `options` is an array of option() in
    the order in which an item would take them, none of which may end more than `span` bars after `first`.
    """
    names = [c for c in items.columns if c != options]
    # the blocks are written once, as their maps and their own choices both read them
    key = ["__k"]
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(options).alias("options"), F.struct(*names).alias("row"))
    longest = F.array_max(F.transform(options, lambda o: o["free"])) - F.col(first)
    at = F.coalesce(F.floor(F.when(F.coalesce(longest, F.lit(0)) <= span, F.col(first)).otherwise(F.raise_error(F.lit("an option ends beyond the span")).cast("long")) / block), F.lit(0).cast("long"))
    d = items.select(F.struct(*(keys or [F.lit(0)])).alias("__k"), at.alias("__block"), ranked.alias("item"))
    blocks = staged(d.groupBy("__k", "__block").agg(F.sort_array(F.collect_list("item")).alias("items")), "blocks")
    start = F.col("__block") * block
    late = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(span).cast("long")), lambda o: start + o)
    ends = F.reduce("items", late, lambda states, i: F.transform(states, lambda s: leaves(s, i["options"])))
    maps = blocks.select(*key, "__block", start.alias("start"), ends.alias("ends"))

    # where a block or super-block that is entered at a state leaves off; one entered beyond its map is passed over
    through = lambda s, m: F.get(m["ends"], F.greatest(s - m["start"], F.lit(0)).cast("int"))
    passed = lambda s, m: F.when(s - m["start"] < F.size(m["ends"]), through(s, m)).otherwise(s)
    entered = lambda states, m: F.concat(states, F.array(passed(F.element_at(states, -1), m)))
    supers = maps.groupBy(*key, F.coalesce(F.floor(F.col("__block") / super_), F.lit(0).cast("long")).alias("__super")).agg(F.sort_array(F.collect_list(F.struct("__block", "start", "ends"))).alias("maps"))
    whole = F.reduce("maps", F.get("maps", F.lit(0))["ends"], lambda states, m: F.when(m["start"] == F.col("maps")[0]["start"], states).otherwise(F.transform(states, lambda s: passed(s, m))))
    chain = supers.select(*key, F.struct("__super", F.col("maps")[0]["start"].alias("start"), whole.alias("ends")).alias("m"))
    # late entries of a super-block's first block are those of the super-block
    chain = chain.groupBy(*key).agg(F.sort_array(F.collect_list("m")).alias("ms"))
    lowest = F.array(F.lit(-(2**62)).cast("long"))
    at_super = chain.select(*key, F.explode(F.arrays_zip(F.col("ms.__super").alias("__super"), F.slice(F.reduce("ms", lowest, entered), 1, F.size("ms")).alias("state"))).alias("x")).select(*key, "x.__super", "x.state")
    at_block = supers.join(at_super, [*key, "__super"])
    states = F.slice(F.reduce("maps", F.array("state"), entered), 1, F.size("maps"))
    at_block = at_block.select(*key, F.explode(F.arrays_zip(F.col("maps.__block").alias("__block"), states.alias("state"))).alias("x")).select(*key, "x.__block", "x.state")

    # each block's own items
    taken = F.struct(F.col("state").alias("state"), F.array().cast(f"array<int>").alias("which"), F.array().cast("array<struct<at:bigint,free:bigint>>").alias("options"))

    def settle(a: Column, x: Column) -> Column:
        o = F.get(F.filter(x["item"]["options"], lambda o: o["at"] >= a["state"]), F.lit(0))
        took = F.struct(o["free"].alias("state"), F.concat(a["which"], F.array(x["n"])).alias("which"), F.concat(a["options"], F.array(o)).alias("options"))
        return F.when(o.isNull(), a).otherwise(took)

    numbered = F.transform("items", lambda i, n: F.struct(n.alias("n"), i.alias("item")))
    done = blocks.join(at_block, [*key, "__block"]).withColumn("t", F.reduce(numbered, taken, settle))
    done = done.select(F.explode(F.arrays_zip(F.transform("t.which", lambda n: F.get("items", n)["row"]).alias("row"), F.col("t.options").alias("o"))).alias("x"))
    return done.select("x.row.*", F.col("x.o.at").alias("__at"), F.col("x.o.free").alias("__free"))


def greedy(entries: DataFrame, keys: tuple[str, ...], span: int, start: str = "bar", free: str = "next_free") -> DataFrame:
    """The entries that are taken when each is refused while an earlier taken one runs: start at or after its `free` bar, which is at
    most `span` bars after its start. Entries of one key with one start are tied: the one with the smallest `free` comes first, then
    that with the smallest hash of its row, and what ties with a taken entry is refused."""
    items = entries.withColumn("__options", F.array(option(F.col(start), F.col(free))))
    order = [F.col(start), F.col(free), F.xxhash64(*entries.columns)]
    return first_come(items, keys, start, "__options", order, span).select(*entries.columns)
