"""URL verdicts by rules and by a cascade of Bloom filters: DataFrame functions only.

The cascade's first level encodes the listed keys. Its false positives among the other keys of the universe (all keys
of the corpus) are encoded by the second level, the listed keys that match the second by the third, and so on until
none is left. A key of the universe is listed if the number of levels that it matches, one after the other, is odd:
an exact answer from a few bits a key, with no join of keys.

A level is a row of blocks of 32,768 bits; a key's bits all lie in one block. Up to LITERAL_BYTES all levels are
constants of the plan. Beyond that they stay a table, and each level is looked up by its block's number.

Columns of a given table that are named like a result (host, path, rule, verdict, listed) are replaced.
Defined results: a null url, or one without ://, has an empty host and path; so does its key. Repeated urls are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

BLOCK_BITS = 32_768
#: Keys in a block, and bits of a key: about one false positive in 1,000.
BLOCK_KEYS, KEY_BITS = 2_200, 6
#: Bytes of all levels together that may be part of a plan.
LITERAL_BYTES = 4 << 20
MOST_LEVELS = 40

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Words between dots and hyphens of a host whose keys the query lists.
LISTED_HOST_WORDS = "(^|[.-])(adult|ads|bets|casino|pills|spam)([.-]|$)"


def with_key(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return pages.withColumn("_rest", rest).withColumn("host", host).withColumn(
        "path", F.regexp_extract(F.substring("_rest", F.length("host") + 1, F.length("_rest")), "^[^?#]*", 0)
    ).withColumn("host", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).drop("_rest")


def rule_columns(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that fits best (host and path joined) and its verdict, or nulls. A small list that is part of the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _hashes(key: Column) -> dict[str, Column]:
    return {"_url_h1": F.xxhash64(key), "_url_h2": F.xxhash64(key, F.lit(1))}


def _block(level: int, blocks: int) -> Column:
    return F.pmod(F.xxhash64("_url_h1", F.lit(level)), F.lit(blocks))


def _bits(level: int) -> list[Column]:
    step = F.shiftrightunsigned(F.xxhash64("_url_h2", F.lit(level)), 33)
    start = F.shiftrightunsigned(F.xxhash64("_url_h1", F.lit(level + 1000)), 33)
    return [F.pmod(start + step * j, F.lit(BLOCK_BITS)) for j in range(KEY_BITS)]


def _set(bitmap: Column, offset, bit: Column) -> Column:
    """Whether a bit is set in a bitmap that begins at a byte offset."""
    byte = F.conv(F.hex(F.substring(bitmap, (offset + F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1


@dataclass
class Level:
    blocks: int
    table: DataFrame  #: block, bitmap
    constant: bytes | None


@dataclass
class Cascade:
    levels: list[Level]

    def matches(self, df: DataFrame) -> DataFrame:
        """Adds listed (boolean) to rows with the hashes of `_hashes`."""
        if all(x.constant is not None for x in self.levels):
            listed = F.lit(len(self.levels) % 2 == 1)
            for k in range(len(self.levels) - 1, -1, -1):
                listed = F.when(self.constant_match(k), listed).otherwise(F.lit(k % 2 == 1))
            return df.withColumn("listed", listed)
        df = df.withColumn("_at", F.lit(0))
        for k, level in enumerate(self.levels):
            df = self.table_match(df, k, level)
        return df.withColumn("listed", F.col("_at") % 2 == 1).drop("_at")

    def constant_match(self, k: int) -> Column:
        level = self.levels[k]
        offset = _block(k, level.blocks) * (BLOCK_BITS // 8)
        hit = F.lit(True)
        for bit in _bits(k):
            hit = hit & _set(F.lit(level.constant), offset, bit)
        return hit

    @staticmethod
    def table_match(df: DataFrame, k: int, level: Level) -> DataFrame:
        """_at: levels matched so far without a gap. Rows of one block may be many; AQE splits such partitions."""
        hit = F.col("_at") == k
        for bit in _bits(k):
            hit = hit & _set(F.coalesce(F.col("bitmap"), F.lit(bytes(BLOCK_BITS // 8))), F.lit(0), bit)
        return (
            df.withColumn("_block", _block(k, level.blocks)).join(level.table.withColumnRenamed("block", "_block"), "_block", "left")
            .withColumn("_at", F.when(hit, k + 1).otherwise(F.col("_at"))).drop("_block", "bitmap")
        )


def build(universe: DataFrame, listed: DataFrame, key: str = "key", literal_bytes: int = LITERAL_BYTES) -> Cascade:
    """The cascade for the keys of `listed` within `universe` (a column `key` each; repeated keys and keys of one side only are fine).

    Keys are aggregated once; each level is one pass over the hashes of one side. The driver gets counts, and the bits
    of levels only while they are within literal_bytes.
    """
    keys = universe.select(F.col(key).alias("key"), F.lit(False).alias("in_list")).unionByName(listed.select(F.col(key).alias("key"), F.lit(True).alias("in_list")))
    keys = written(keys.filter("key IS NOT NULL").groupBy("key").agg(F.max("in_list").alias("in_list")).withColumns(_hashes(F.col("key"))).drop("key"), "url-keys")
    sides = [keys.filter("in_list"), keys.filter("NOT in_list")]
    levels: list[Level] = []
    spent = 0
    while n := sides[0].count():
        k = len(levels)
        if k >= MOST_LEVELS:
            raise ValueError("two keys, one of them listed, have the same 128 bits of hashes")
        blocks = -(-n // BLOCK_KEYS)
        table = (
            sides[0].select(_block(k, blocks).alias("block"), F.explode(F.array(*_bits(k))).alias("bit"))
            .groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        )
        spent += blocks * BLOCK_BITS // 8
        constant = None
        if spent <= literal_bytes:
            found = {r.block: bytes(r.bitmap) for r in table.collect()}
            constant = b"".join(found.get(b, bytes(BLOCK_BITS // 8)) for b in range(blocks))
        else:
            table = written(table, "url-level")
        levels.append(Level(blocks, table, constant))
        if constant is not None:
            false = sides[1].filter(Cascade(levels).constant_match(k))
        else:
            false = Cascade.table_match(sides[1].withColumn("_at", F.lit(k)), k, levels[-1]).filter(F.col("_at") == k + 1).drop("_at")
        sides = [written(false, "url-false"), sides[0]]
    if any(x.constant is None for x in levels):
        for x in levels:
            x.constant = None
    return Cascade(levels)


def judge(pages: DataFrame, cascade: Cascade, rules: list[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict to pages: the best rule's verdict, else block for listed keys and allow for others."""
    keyed = with_key(pages, url)
    looked = cascade.matches(keyed.withColumns(_hashes(F.concat("host", "path"))))
    rule, verdict = rule_columns(rules)
    return looked.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow"))).drop("_url_h1", "_url_h2", "listed")


def listed_keys(pages: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """The universe of keys (host and path) of pages, and those on hosts with a listed word."""
    keys = with_key(pages.select(url), url).select("host", F.concat("host", "path").alias("key"))
    return keys.select("key"), keys.filter(F.col("host").rlike(LISTED_HOST_WORDS)).select("key")
