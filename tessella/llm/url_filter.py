"""URL filters by Bloom filter cascades, in DataFrame functions only.

A list of keys is held as a cascade of Bloom filters: the first encodes the listed keys, the second the keys of the corpus that
the first lets through wrongly, the third the listed keys that the second catches, and so on until no key of the corpus's
complete key universe is misjudged. Membership of every key in the corpus is then exact, and is tested by an expression on
constants, without a join.

Keys of a URL are what a list could name: each suffix of its host (whole labels) with each prefix of its path that is as long
as some listed path, and the words of its host. So one cascade answers for rules of any host and path, another for words.

Defined results. Host and path of a null URL, or of one without `://`, are empty; no rule fits it and it is allowed. Repeated
rows get equal verdicts, an empty table gives an empty result, an empty list matches nothing. Hosts and paths may be of any
length; columns beyond the URL pass through.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import table, unused

HASHES = 7
#: Keys of one cascade, so that its filters stay some megabytes; a longer list becomes several cascades.
MOST_KEYS = 5_000_000

#: A word of the host that says what a site is for; keys of words begin with this mark, which no host has.
WORD_MARK = "#"
STANDARD_WORDS = ("ads", "adult", "bets", "betting", "casino", "malware", "phishing", "pills", "porn", "spam", "track", "viagra", "warez", "xxx")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z (and no other letters) lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_keys(host: Column, path: Column, lengths: Iterable[int], most_labels: int) -> Column:
    """All keys host suffix + path prefix, for the given lengths of path prefixes and suffixes of up to most_labels labels."""
    labels = F.split(host, r"\.", -1)
    first = F.greatest(F.lit(1), F.size(labels) - (most_labels - 1))
    suffixes = F.when(host != "", F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))
    heads = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths))] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda h: F.concat(s, h))))


def word_keys(host: Column) -> Column:
    words = F.filter(F.split(host, r"[.\-]", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.concat(F.lit(WORD_MARK), w))


def positions(key: Column, level: int, bits: int) -> Column:
    """The bits of a key in the filter of a level: two hashes, combined (31 bits of each, so that nothing overflows)."""
    low = F.lit(2**31 - 1)
    a, b = F.xxhash64(F.lit(2 * level), key).bitwiseAND(low), F.xxhash64(F.lit(2 * level + 1), key).bitwiseAND(low)
    return F.array(*[F.pmod(a + b * F.lit(i), F.lit(bits)) for i in range(HASHES)])


class Bloom:
    """One level: its bits in 64-bit words."""

    def __init__(self, keys: DataFrame, level: int, bits: int):
        """keys: one column `key`. The words are gathered as one row per word, at most bits / 64."""
        self.level, self.bits = level, bits
        at = F.explode(positions(F.col("key"), level, bits)).alias("at")
        words = keys.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("set")).collect()
        values = ["0"] * (-(-bits // 64))
        for w in words:
            values[w["word"]] = str(w["set"])
        self.words = F.split(F.lit(",".join(values)), ",").cast("array<bigint>")  # folded to one constant by the optimiser

    def has(self, key: Column) -> Column:
        words = self.words
        return F.forall(positions(key, self.level, self.bits), lambda p: F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)


def filter_bits(keys: int, per_key: float) -> int:
    return max(64, min(2**31 - 1, math.ceil(keys * per_key / 64) * 64))


def key_rows(spark: SparkSession, keys: list[str]) -> DataFrame:
    """A table of the keys, from one constant."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(keys)), "array<string>")).alias("key"))


class Cascade:
    """Exact membership in a list for every key of a universe."""

    def __init__(self, spark: SparkSession, listed: Iterable[str], universe: DataFrame, universe_size: int, most_keys: int = MOST_KEYS):
        """universe: one column `key`, repeats allowed. The first level gets so many bits that about as many keys of the universe
        as are listed slip through, so no level outgrows the list as the corpus grows. A list of more than most_keys becomes
        several cascades, each exact for its part."""
        self.levels: list[Bloom] = []
        self.others: list[Cascade] = []
        listed = sorted(set(listed))
        if len(listed) > most_keys:
            parts = [listed[k : k + most_keys] for k in range(most_keys, len(listed), most_keys)]
            self.others = [Cascade(spark, part, universe, universe_size, most_keys) for part in parts]
            listed = listed[:most_keys]
        if not listed:
            return
        own = key_rows(spark, listed)
        per_key = max(10.0, 1.44 * math.log2(max(2.0, universe_size / len(listed))) + 4)
        first = Bloom(own, 0, filter_bits(len(listed), per_key))
        self.levels.append(first)
        # listed and slipped keys are told apart by a grouped union
        passed = universe.filter(first.has(F.col("key"))).select("key", F.lit(0).alias("l")).unionByName(own.withColumn("l", F.lit(1)))
        slipped = [r["key"] for r in passed.groupBy("key").agg(F.max("l").alias("l")).filter("l = 0").select("key").collect()]
        held, caught = listed, slipped
        while caught:
            level = len(self.levels)
            filter_ = Bloom(key_rows(spark, caught), level, filter_bits(len(caught), 10.0))
            self.levels.append(filter_)
            held, caught = caught, [r["key"] for r in key_rows(spark, held).filter(filter_.has(F.col("key"))).collect()]

    def member(self, key: Column) -> Column:
        """The first level that rejects a key decides: an odd one (from 1) rejects what is not listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in reversed(range(len(self.levels))):
            out = F.when(~self.levels[k].has(key), F.lit(k % 2 == 1)).otherwise(out)
        for other in self.others:
            out = out | other.member(key)
        return out


def judge(pages: DataFrame, allow: Iterable[str], block: Iterable[str], words: Iterable[str] = STANDARD_WORDS, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict.

    A rule is `host` + `path prefix` and fits its host and all subdomains; the longest fitting rule wins. Without one, a host with
    a listed word is blocked and any other allowed.
    """
    spark, url = pages.sparkSession, F.col(url_col)
    allow, block = set(allow), set(block)
    lengths = {len(r) - r.index("/") for r in allow | block if "/" in r} | {0 for r in allow | block if "/" not in r}
    labels = max((r.split("/")[0].count(".") + 1 for r in allow | block), default=1)
    kept = [c for c in pages.columns if c == url_col or c not in ("host", "path", "rule", "verdict")]
    at_host, at_path, rules, named_by, found = unused(pages.columns, "host", "path", "rules", "words", "rule")
    parts = pages.select(*kept).withColumns({at_host: host_of(url), at_path: path_of(url)})
    parts = parts.withColumns({rules: rule_keys(F.col(at_host), F.col(at_path), lengths, labels), named_by: word_keys(F.col(at_host))})
    universe = parts.select(F.explode(F.concat(rules, named_by)).alias("key"))
    size = universe.agg(F.approx_count_distinct("key").alias("n")).head()["n"]
    allowed, blocked, named = (Cascade(spark, keys, universe, size) for keys in (allow, block, {WORD_MARK + w for w in words}))
    fits = F.filter(rules, lambda k: allowed.member(k) | blocked.member(k))
    longest = F.reduce(fits, F.lit(None).cast("string"), lambda a, b: F.when(a.isNull() | (F.char_length(b) > F.char_length(a)), b).otherwise(a))
    ruled = parts.withColumn(found, longest)
    verdict = F.when(F.col(found).isNotNull(), F.when(blocked.member(F.col(found)), "block").otherwise("allow")).when(F.exists(named_by, named.member), "block").otherwise("allow")
    return ruled.select(*kept, F.col(at_host).alias("host"), F.col(at_path).alias("path"), F.col(found).alias("rule"), verdict.alias("verdict"))


#: The rules of the query.
ALLOW = ("org/", "com/fr/")
BLOCK = ("example.org/es/", "example.org/en/1", "com/de/")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every page's host, path, rule and verdict."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), ALLOW, BLOCK).drop("url")


def sql() -> str:
    """The same by plain predicates."""
    rules = [(r, "allow") for r in ALLOW] + [(r, "block") for r in BLOCK]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    cases = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{r}'"
        for r, h, p in sorted(((r, r[: r.index("/")], r[r.index("/") :]) for r, _ in rules), key=lambda x: -len(x[0]))
    )
    blocked = ", ".join(f"'{r}'" for r in BLOCK)
    listed = ", ".join(f"'{w}'" for w in STANDARD_WORDS)
    return f"""
      WITH parts AS (
        SELECT page_id,
          translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{upper.lower()}') AS host,
          coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages),
      ruled AS (SELECT *, CASE {cases} END AS rule FROM parts)
      SELECT page_id, host, path, rule,
        CASE WHEN rule IN ({blocked}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
          WHEN list_has_any(regexp_split_to_array(host, '[.\\-]'), [{listed}]) THEN 'block' ELSE 'allow' END AS verdict
      FROM ruled"""
