"""URL filter: an exact Bloom filter cascade over the corpus's complete key universe.

A rule is a host and a path prefix with a verdict.  Every url gives candidate
keys: the suffixes of its host, of no more labels than any rule has, each joined
with the prefixes of its path that have the length of some rule's path.  The keys
of all pages are the universe.  Level 1 of a cascade encodes the listed keys that
occur in it; level 2 encodes the unlisted keys that level 1 lets through, level 3
the listed keys that level 2 lets through, and so on until a level lets nothing
through.  As the universe is complete, the cascade's answer is exact for every
page, and pages are judged by bit tests alone: no join, no shuffle.

Size and time: level 1 has as many bits a key as leave about as many false
positives as there are listed keys, so no level is much larger than the first
however many unlisted keys the corpus has.  A filter is one binary value in the
plan; a test reads one byte of it, so a key costs the same in a filter of any
size.  Where the filters would pass MAX_LEVEL_BITS, keys are cut into slices by
hash; each slice has cascades of its own and judges the pages in a pass of its
own, so the driver holds one slice at a time.

Nulls and oddities: a null url, or one without "://", has an empty host and
path, fits no rule and gets the default verdict.  Repeated rows are judged each.
Of two verdicts for one host and path the later by code point holds.  A rule with
a null in a column fits nothing.  Extra columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Bits of a slice's first level: 8 MB as a literal, about 6.7 million listed keys at 10 bits each.
MAX_LEVEL_BITS = 1 << 26
MAX_LEVELS = 64
#: Different verdicts, each a cascade, and different lengths of rules' paths, each a candidate key for every suffix.
MAX_VERDICTS, MAX_PATH_LENGTHS = 16, 2048


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    bytes: bytes
    bits: int
    hashes: int
    seed: int


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: list[int], most_labels: int = 1 << 20) -> Column:
    """Host suffixes of at most `most_labels` labels joined with path prefixes of the given lengths, as (key, host, path) structs."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), n - most_labels + 1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    lengths = F.filter(F.array(*[F.lit(x) for x in path_lengths]), lambda x: x <= F.length(path))
    pairs = F.transform(
        suffixes,
        lambda s: F.transform(lengths, lambda x: F.struct(F.concat(s, F.lit("\n"), F.substring(path, F.lit(1), x)).alias("key"), s.alias("host"), F.substring(path, F.lit(1), x).alias("path"))),
    )
    return F.when((host == "") | (F.size(lengths) == 0), F.array().cast("array<struct<key:string,host:string,path:string>>")).otherwise(F.flatten(pairs))


def _position(key: Column, level_seed: int, i: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level_seed), i), F.lit(bits).cast("long"))


def _encode(keys: DataFrame, n: int, seed: int, bits_per_key: float) -> Level:
    """A Bloom filter of the n keys; bits are or-ed by word on the executors."""
    bits = max(64, math.ceil(n * bits_per_key / 32) * 32)
    hashes = max(1, round(bits_per_key * math.log(2)))
    positions = keys.select(F.explode(F.array(*[_position(F.col("key"), seed, F.lit(i), bits) for i in range(hashes)])).alias("p"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (31 - F.col("p") % 32).cast("int"))
    words = positions.groupBy((F.col("p") / 32).cast("long").alias("word")).agg(F.bit_or(mask).alias("bits"))
    packed = bytearray(bits // 8)
    for row in words.toLocalIterator():  # bits / 32 rows at most
        packed[4 * row["word"] : 4 * row["word"] + 4] = int(row["bits"]).to_bytes(4, "big")
    return Level(bytes(packed), bits, hashes, seed)


def _passes(key: Column, level: Level) -> Column:
    """Whether all of a key's bits are set.  The filter stands in the plan once; a test takes one byte out of it and ends at the first bit not set."""
    blob = F.lit(level.bytes)

    def bit(i: Column) -> Column:
        p = _position(key, level.seed, i, level.bits)
        byte = F.conv(F.hex(F.substring(blob, F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, (7 - p % 8).cast("int")).bitwiseAND(F.lit(1)) == 1

    return F.forall(F.array(*[F.lit(i) for i in range(level.hashes)]), bit)


def _first_bits(n: int, rest: int, bits_per_key: float) -> float:
    """Bits a key of a first level: what lets through about n of the rest, and no fewer than asked for."""
    return max(bits_per_key, math.log2(max(2.0, rest / n)) / math.log(2)) if n else bits_per_key


def build_cascade(universe: DataFrame, seed: int = 1, bits_per_key: float = 10) -> list[Level]:
    """universe(key, listed) with distinct keys -> levels; an empty list means that nothing is listed.

    The first level may have more bits a key: as many as let through about as many
    of the unlisted keys as are listed.
    """
    levels: list[Level] = []
    inside, outside = universe.where("listed").select("key"), universe.where("not listed").select("key")
    n = inside.count()
    rest = outside.count() if n else 0
    while n:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end; are the universe's keys distinct?")
        level = _encode(inside, n, seed + len(levels), bits_per_key if levels else _first_bits(n, rest, bits_per_key))
        levels.append(level)
        inside, outside = written(outside.where(_passes(F.col("key"), level)), "url-level"), inside
        n = inside.count()
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Exact membership for every key of the universe: the first level that refuses the key decides."""
    if not levels:
        return F.lit(False)
    out = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels))):
        out = F.when(~_passes(key, level), F.lit(i % 2 == 1)).otherwise(out)
    return out


def _rule_table(spark, rules: list[UrlRule] | DataFrame) -> DataFrame:
    if isinstance(rules, DataFrame):
        return rules.select("verdict", "host", "path").where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL")
    return spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")


def judge_urls(pages: DataFrame, rules: list[UrlRule] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", bits_per_key: float = 10) -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path of the longest fitting rule, else null), verdict.

    rules: a list, or for many of them a table (verdict, host, path).
    """
    listed = _rule_table(pages.sparkSession, rules)
    split = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    facts = listed.agg(F.collect_set(F.length("path")).alias("lengths"), F.max(F.size(F.split("host", r"\.", -1))).alias("labels"), F.collect_set("verdict").alias("verdicts")).first()
    lengths, verdicts = sorted(facts["lengths"]), sorted(facts["verdicts"])
    if not verdicts:
        return split.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if len(verdicts) > MAX_VERDICTS or len(lengths) > MAX_PATH_LENGTHS:
        raise ValueError(f"at most {MAX_VERDICTS} verdicts and {MAX_PATH_LENGTHS} lengths of paths, not {len(verdicts)} and {len(lengths)}")
    candidates = candidate_keys(F.col("host"), F.col("path"), lengths, facts["labels"])
    keys = split.select(F.explode(candidates["key"]).alias("key")).distinct()
    by_key = listed.groupBy(F.concat("host", F.lit("\n"), "path").alias("key")).agg(F.collect_set("verdict").alias("v"))
    marks = [F.coalesce(F.array_contains("v", v), F.lit(False)).alias(f"is_{i}") for i, v in enumerate(verdicts)]
    universe = written(keys.join(by_key, "key", "left").select("key", *marks), "url-universe")
    is_listed = F.expr(" OR ".join(f"is_{i}" for i in range(len(verdicts))))
    sizes = universe.agg(F.count_if(is_listed).alias("n"), F.count_if(~is_listed).alias("rest")).first()
    slices = max(1, math.ceil(sizes["n"] * _first_bits(sizes["n"], sizes["rest"], bits_per_key) / MAX_LEVEL_BITS))

    best = F.lit(None).cast("struct<n:int,host_n:int,rule:string,verdict:string>")
    judged = split.withColumn("best", best)
    for part in range(slices):
        own = universe.where(_slice(F.col("key"), slices) == part) if slices > 1 else universe
        options = []
        for i, verdict in enumerate(verdicts):
            levels = build_cascade(own.select("key", F.col(f"is_{i}").alias("listed")), seed=1000 * i + 1, bits_per_key=bits_per_key)
            options.append(_fitting(verdict, levels, slices, part))
        judged = judged.withColumn("keys", candidates).withColumn("best", F.array_max(F.concat(F.array("best"), *options))).drop("keys")
        if part + 1 < slices:
            judged = written(judged, "url-judged")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


def _slice(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("slice")), F.lit(slices).cast("long"))


def _fitting(verdict: str, levels: list[Level], slices: int, part: int) -> Column:
    """The candidate keys of column keys that a slice's cascade holds, as structs in the order of precedence."""
    inside = (lambda c: (_slice(c["key"], slices) == part) & member(c["key"], levels)) if slices > 1 else (lambda c: member(c["key"], levels))
    fits = F.filter(F.col("keys"), inside)
    ranked = F.transform(fits, lambda c: F.struct(F.length(c["host"]) + F.length(c["path"]), F.length(c["host"]), F.concat(c["host"], c["path"]), F.lit(verdict)))
    return ranked.cast("array<struct<n:int,host_n:int,rule:string,verdict:string>>")
