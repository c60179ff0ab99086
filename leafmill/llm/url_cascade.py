"""URL rules through a Bloom filter cascade, in DataFrame functions only.

Level 1 encodes the listed keys; level 2 those keys of the corpus that level 1 takes wrongly for listed; level 3 the
listed ones that level 2 takes for wrong, and so on, until a level errs on nothing. Over the whole universe of keys that the
corpus holds, the last level that a key passes then says exactly whether it is listed. A level is one array of words, filled by an
aggregation and read as a scalar subquery, so it stands in no text of a plan and never comes to the driver's Python; looking a key up
takes bit tests, no join. Its size depends on the list, not on the corpus, and is checked against MAX_BITS.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

#: verdict, host, path
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Bits of a level at most (64 MB, sent to each executor once); some 40 million listed keys with a false positive in a thousand.
MAX_BITS = 1 << 29
#: Pairs of label count and path length among rules, at most.
MAX_SHAPES = 256


@dataclass(frozen=True)
class Level:
    """A Bloom filter: a one-row table with its 64-bit words as an array, the number of bits and how many bits a key sets."""

    table: DataFrame
    bits: int
    hashes: int
    seed: int

    def has(self, key: Column) -> Column:
        words, test = self.table.scalar(), F.lit(True)
        for at in positions(key, self.bits, self.hashes, self.seed):
            test = test & (F.getbit(F.get(words, F.shiftright(at, 6)), at % 64) == 1)
        return test


def positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    """Two hashes give all positions (Kirsch and Mitzenmacher)."""
    a, b = F.xxhash64(key, F.lit(2 * seed)), F.xxhash64(key, F.lit(2 * seed + 1)).bitwiseOR(F.lit(1))
    mixed = lambda i: F.call_function("shiftright", a, F.lit(20)) + F.call_function("shiftright", b, F.lit(20)) * F.lit(i)
    return [F.pmod(mixed(i), F.lit(bits)).cast("int") for i in range(hashes)]


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter over keys (key) with about this rate of false positives. ValueError if it would pass MAX_BITS."""
    bits = max(64, 64 * math.ceil(n * math.log(1 / rate) / math.log(2) ** 2 / 64))
    if bits > MAX_BITS:
        raise ValueError(f"a filter of {n} keys takes {bits} bits; {MAX_BITS} is the most: split the list, or join with it")
    hashes = max(1, round(bits / max(n, 1) * math.log(2))) if n * 8 > bits else max(1, math.ceil(-math.log2(rate)))
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes, seed))).alias("at"))
    masks = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % 64)).alias("mask"))
    # the words that hold a bit, in order, put into the array of all: a gap is filled by its length
    held = masks.agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("held"))
    word = lambda e, i: F.when(i == 0, e.word).otherwise(e.word - F.get("held", i - 1).word - 1)
    filled = F.flatten(F.transform("held", lambda e, i: F.array_append(F.array_repeat(F.lit(0).cast("long"), word(e, i)), e.mask)))
    return Level(held.select(filled.alias("words")).checkpoint(), bits, hashes, seed)


def member(levels: list[Level], key: Column) -> Column:
    """Whether key, of the universe that the levels were built over, is listed: true if it leaves at an even level."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(~levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def cascade(listed: DataFrame, universe: DataFrame, most: int = 64) -> list[Level]:
    """Levels for exact membership of the keys of `universe` (key) in `listed` (key); both may repeat keys."""
    listed = listed.distinct().checkpoint()
    others = universe.distinct().join(F.broadcast(listed), "key", "left_anti") if listed.count() <= 100_000 else universe.distinct().join(listed, "key", "left_anti")
    others = others.checkpoint()
    n, rest = listed.count(), others.count()
    rate = min(0.5, max(1e-9, n * math.sqrt(0.5) / max(rest, 1)))
    levels: list[Level] = []
    inside, outside = listed, others
    while n:
        if len(levels) == most:
            raise ValueError("the cascade does not end; the keys repeat hash values")
        level = build_level(inside, n, rate, len(levels) + 1)
        levels.append(level)
        inside, outside = outside.filter(level.has(F.col("key"))).checkpoint(), inside
        n, rate = inside.count(), 0.5
    return levels


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z in lower case; path: then up to ?, # or the end. Null or no ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: tuple) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules))))


def shapes_of(rules: DataFrame) -> list[tuple[int, int]]:
    """(labels of the host, length of the path) that rules have, longest first; ValueError beyond MAX_SHAPES, as each is a look-up for each URL."""
    shapes = rules.select((F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("labels"), F.length("path").alias("size")).distinct().limit(MAX_SHAPES + 1).collect()
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"rules of more than {MAX_SHAPES} shapes")
    return sorted(((r.labels, r["size"]) for r in shapes), key=lambda s: (-s[0], -s[1]))


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """Every key that could be a rule of this URL: its last labels by the rules' label counts, its path's start by their path lengths; longest first."""
    return [F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)) for labels, length in shapes]


def judge_urls(pages: DataFrame, rules: tuple | DataFrame = RULES, default: str = "allow") -> DataFrame:
    """pages (page_id, url, ...) to page_id, host, path, rule, verdict.

    rules: tuples, or a table of these columns, with millions of rows if need be. A rule (verdict, host, path) fits its host and all subdomains if the URL's path starts with its path; the longest
    fitting rule wins (more labels, then the longer path). Its two lists, block and allow, are a cascade each. Without a rule the verdict is the method's:
    a key in no list is `default`. Null URLs and URLs without :// have empty host and path and the default verdict.
    URLs of any length are cut whole; a key is as long as the longest rule at most. Repeated rows are judged one by one, other columns are ignored, and no rows give no rows.
    """
    prepare(pages.sparkSession)
    host, path = url_parts(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    spark = pages.sparkSession
    listed = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    keys = candidate_keys(F.col("host"), F.col("path"), shapes_of(listed))
    universe = cut.select(F.explode(F.array(*keys)).alias("key")).distinct().checkpoint()
    verdicts = sorted(r[0] for r in listed.select("verdict").distinct().collect())
    levels = {v: cascade(listed.filter(F.col("verdict") == v).select(F.concat("host", "path").alias("key")), universe) for v in verdicts}
    found = F.coalesce(*(F.when(member(levels[v], k), F.struct(k.alias("rule"), F.lit(v).alias("verdict"))) for k in keys for v in levels))
    return cut.withColumn("hit", found).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


ORACLE = r"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (
  select page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path from u
), r(verdict, h, p) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))
select page_id, host, path,
  (select max_by(h || p, len(h || p)) from r where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)) as rule,
  coalesce((select max_by(verdict, len(h || p)) from r where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)), 'allow') as verdict
from h
"""
