"""Phrase collocations, counted exactly, by SON partitioning.

The corpus is cut into SHARDS shards (every SHARDS-th partition of the input; a shard is as many tasks as it needs). A phrase that occurs
`support` times in all occurs in some shard at least support * (the shard's share of the words) times, so each shard is mined
completely at that lower support, and what any shard finds frequent is a candidate, unless the shards' counts together already
show that it is too rare. Mining goes by length: words, then pairs of words, then longer phrases, each only where its parts are
candidates. Then one pass counts all candidates, exactly, by their own text.

Mining compares phrases by 64-bit digests, and hands candidates to the next pass as bits of a fixed number (FILTER_BITS). Two phrases that
share a digest or a bit can only add candidates; the last pass gives each its own count, so that none of this changes the result. In a block
of the last pass, equal phrases are found by digests that also depend on the language: two different ones agree by chance once in 2**64.

Words are cut from the bytes of many texts at a time, and each distinct one of these is hashed once.

Memory: a task holds the digests of a block of MINE_WORDS words, or the words of one of COUNT_WORDS (each distinct word once, and 4 bytes a place). Phrases are made
from STEP places at a time and counted by RANGES ranges of their digests, so that what is made on the way takes a part of a block only. Counts of shards and phrases are shuffles of
Spark with partial sums, which spill; no shard has to fit a task.

Defined results: null texts count as empty and null languages as 'und'; repeated rows count each by itself. An empty corpus has no phrases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_pieces, mix, written

SUPPORT, MOST_WORDS, COVERED, TOP = 30, 4, 80, 2000
#: Shards: local supports are about SUPPORT / SHARDS.
SHARDS = 6
#: Bits that hold the candidates of a pass, 8 MB at any size of the corpus.
FILTER_BITS = 1 << 26
MINE_WORDS, COUNT_WORDS, BLOCK_BYTES, ROWS_BYTES = 4_000_000, 5_000_000, 2_000_000, 1 << 26
#: Places of a block whose phrases are made at a time, and ranges of digests that are counted one after another.
STEP, RANGES = 1 << 18, 16

_U = np.uint64
#: After lower-casing, the marks that end a piece become line ends and tabs become blanks.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\x0b\x0c\r" + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_PLACES = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class Cut:
    """The words of some texts: `words` in order, as places in a dictionary; `digests` with a 0 after each run of words of a piece; `text`, the number of each digest's text."""

    def __init__(self, texts: pa.Array) -> None:
        raw = np.frombuffer(b"\n".join([*texts.cast(pa.binary()).to_pylist(), b""]).translate(_TABLE), np.uint8)
        line = raw == 10
        inside = ~(line | (raw == 32))
        # The bytes end with a line end, so that each word has its beginning and its end.
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        starts, ends = edges[::2], edges[1::2]
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
        self.words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
        lines = np.cumsum(line, dtype=np.int32)[starts]
        last = np.ones(len(starts), bool)
        last[:-1] = lines[1:] != lines[:-1]
        at = np.arange(len(starts)) + np.cumsum(last) - last
        self.digests = np.zeros(len(starts) + int(last.sum()), _U)
        distinct = self.words.dictionary.to_pylist()
        # No word has the digest 0.
        self.digests[at] = np.maximum(np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), _U, len(distinct)), _U(1))[self.words.indices.to_numpy()]
        before = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1)
        number = np.searchsorted(before, starts, side="right").astype(np.int32)
        self.text = np.zeros(len(self.digests), np.int32)
        self.text[at] = number
        self.text[at[last] + 1] = number[last]


class Languages:
    """Numbers of languages in the order in which a task meets them."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}

    def numbers(self, langs: pa.Array) -> np.ndarray:
        return np.array([self.names.setdefault(x, len(self.names)) for x in langs.to_pylist()], np.int32)

    def salts(self) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.names], _U)


class Block:
    """Digests of the words of some texts, and of their phrases. Breaks between pieces have the digest 0."""

    def __init__(self, digests: list[np.ndarray], languages: list[np.ndarray], salts: np.ndarray) -> None:
        self.words = np.concatenate(digests)
        self.language = np.concatenate(languages)
        self.salts = salts
        self.breaks = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(self.words == 0, out=self.breaks[1:])

    def phrases(self, n: int, keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and digests of the phrases of n words (those that `keep` says), made STEP places at a time: only what is kept is held for a whole block."""
        found = [(np.zeros(0, np.int32), np.zeros(0, _U))]
        m = len(self.words) - n + 1
        for a in range(0, m, STEP):
            b = min(a + STEP, m)
            at = np.flatnonzero(self.breaks[a + n : b + n] == self.breaks[a:b]) + a
            with np.errstate(over="ignore"):
                sums = self.salts[self.language[at]] + _U(n)
                for i in range(n):
                    sums += self.words[at + i] * _PLACES[i]
            digests = mix(sums)
            if keep:
                good = keep(at, digests)
                at, digests = at[good], digests[good]
            found.append((at.astype(np.int32), digests))
        at, digests = zip(*found, strict=True)
        return np.concatenate(at), np.concatenate(digests)

    def made_of(self, n: int, part: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """phrases(n), those of which all parts of `part` words (the phrases themselves, if part is n) may be candidates."""
        may_be = lambda at, digests: held(bits, digests)
        if part == n:
            return self.phrases(n, may_be)
        good = np.zeros(len(self.words) + 1, bool)
        good[self.phrases(part, may_be)[0]] = True
        return self.phrases(n, lambda at, _: np.logical_and.reduce([good[at + i] for i in range(n - part + 1)]))


def ranges(digests: np.ndarray) -> Iterator[np.ndarray]:
    """The places of the digests of each of RANGES ranges, so that equal ones are found together and only a part is sorted at a time."""
    of = (digests >> _U(56)).astype(np.uint8) // np.uint8(256 // RANGES)
    for k in range(RANGES):
        yield np.flatnonzero(of == k)


def held(bits: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Whether each digest's bit is set."""
    place = digests & _U(FILTER_BITS - 1)
    return (bits[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) == 1


def _local_counts(docs: DataFrame, lengths: tuple[int, ...], bits, shards: int) -> DataFrame:
    """shard, lang, digest, n: what each shard has of phrases of these lengths (lang null), and with length 1 its words by language (digest null).

    bits: candidates of one word less than the first of the lengths; phrases with a part that is none are not counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        known, digests, languages, own, size, totals = bits and bits.value, [], [], Languages(), 0, np.zeros(0, np.int64)

        def rows(found: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            m = len(found)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, shard, np.int32)), pa.nulls(m, pa.string()), pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], ["shard", "lang", "digest", "n"]
            )

        def flush() -> Iterator[pa.RecordBatch]:
            block = Block(digests, languages, own.salts())
            for pieces in (digests, languages):  # the block has its own copy
                pieces.clear()
            for n in lengths:
                _, all_of_them = block.phrases(n) if known is None else block.made_of(n, lengths[0] - 1, known)
                for own_range in ranges(all_of_them):
                    found, counts = np.unique(all_of_them[own_range], return_counts=True)
                    for a in range(0, len(found), 200_000):
                        yield rows(found[a : a + 200_000], counts[a : a + 200_000])

        for piece in arrow_pieces(batches, "_text", BLOCK_BYTES):
            cut = Cut(piece.column("_text"))
            digests.append(cut.digests)
            languages.append(own.numbers(piece.column("_lang"))[cut.text])
            size += len(cut.digests)
            if lengths[0] == 1:
                more = np.bincount(languages[-1][cut.digests != 0], minlength=len(own.names))
                more[: len(totals)] += totals
                totals = more
            if size >= MINE_WORDS:
                yield from flush()
                size = 0
        if digests:
            yield from flush()
        if len(totals):
            m = len(totals)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * m, pa.int32()), pa.array(list(own.names), pa.string()), pa.nulls(m, pa.int64()), pa.array(totals.astype(np.int64))], ["shard", "lang", "digest", "n"])

    counts = docs.mapInArrow(run, "shard int, lang string, digest long, n long")
    # Blocks are summed already, and so partial sums would save little: all shards' rows of a digest meet in one place, for this sum and for that over the shards.
    return counts.repartition("digest").groupBy("shard", "lang", "digest").agg(F.sum("n").alias("n"))


def _bits(spark, candidates: DataFrame):
    """The candidates' digests as set bits, broadcast: FILTER_BITS of them at any number of candidates."""
    words = candidates.selectExpr(f"shiftright(digest & {FILTER_BITS - 1}, 6) AS w", "shiftleft(1L, CAST(digest & 63 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b"))
    found = words.toArrow()
    bits = np.zeros(FILTER_BITS >> 6, _U)
    bits[found.column("w").to_numpy()] = found.column("b").to_numpy().view(_U)
    return spark.sparkContext.broadcast(bits)


def _counted(docs: DataFrame, bits, most: int) -> DataFrame:
    """lang, phrase, words, f of all candidates of 1 to `most` words, by their own text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found, digests, languages, own, size = bits.value, [], [], [], Languages(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            block, words, names = Block(digests, languages, own.salts()), pa.chunked_array(found).unify_dictionaries().combine_chunks(), pa.array(list(own.names), pa.string())
            for pieces in (found, digests, languages):  # the block and the words have their own copies
                pieces.clear()
            distinct, codes = words.dictionary, words.indices.to_numpy()
            chars = pc.binary_length(distinct).to_numpy().astype(np.int64)
            for n in range(1, most + 1):
                everywhere, phrases = block.made_of(n, n, known)
                for own_range in ranges(phrases):
                    _, first, counts = np.unique(phrases[own_range], return_index=True, return_counts=True)
                    at = everywhere[own_range[first]]
                    places = at - block.breaks[at]
                    # Rows leave in batches of ROWS_BYTES at most (or one longer phrase), so that long words don't pass what an array may hold.
                    bytes_so_far = np.cumsum(sum(chars[codes[places + i]] for i in range(n)) + 300)
                    cuts = (np.flatnonzero(np.diff(bytes_so_far // ROWS_BYTES)) + 1).tolist()
                    for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
                        parts = [distinct.take(pa.array(codes[places[a:b] + i])) for i in range(n)]
                        phrase = pc.binary_join_element_wise(*parts, b" ").cast(pa.string())
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(block.language[at[a:b]])), phrase, pa.array(np.full(b - a, n, np.int32)), pa.array(counts[a:b].astype(np.int64))], ["lang", "phrase", "words", "n"])

        for piece in arrow_pieces(batches, "_text", BLOCK_BYTES):
            cut = Cut(piece.column("_text"))
            found.append(cut.words)
            digests.append(cut.digests)
            languages.append(own.numbers(piece.column("_lang"))[cut.text])
            size += len(cut.digests)
            if size >= COUNT_WORDS:
                yield from flush()
                size = 0
        if digests:
            yield from flush()

    return docs.mapInArrow(run, "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f"))


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, most: int = MOST_WORDS, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to `most` words with f >= support, and (lang, n) with all words of a language. Both are stored tables."""
    if not 2 <= most <= len(_PLACES):
        raise ValueError(f"phrases have 2 to {len(_PLACES)} words")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    shards = max(1, min(shards, support))
    words = written(_local_counts(rows, (1,), None, shards), "phrase-words")
    totals = written(words.filter("digest IS NULL").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    shares = {r["shard"]: r["n"] for r in words.filter("digest IS NULL").groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    every = sum(shares.values())
    # The least whole number that is not below support * share.
    least = F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, max(1, -(-support * shares.get(s, 0) // max(1, every))))]), F.col("shard"))

    def candidates(local: DataFrame) -> DataFrame:
        by_digest = local.filter("digest IS NOT NULL").groupBy("digest").agg(F.max(F.col("n") >= least).alias("frequent"), F.sum("n").alias("f"))
        return by_digest.filter(F.col("frequent") & (F.col("f") >= support)).select("digest")

    mined = [candidates(words)]
    bits = _bits(spark, mined[0])
    for lengths in [(2,)] + ([tuple(range(3, most + 1))] if most > 2 else []):
        mined.append(written(candidates(_local_counts(rows, lengths, bits, shards)), "phrase-candidates"))
        bits = _bits(spark, mined[-1])
    bits = _bits(spark, mined[0].unionAll(mined[1]).unionAll(mined[2]) if most > 2 else mined[0].unionAll(mined[1]))
    return written(_counted(rows, bits, most).filter(F.col("f") >= support), "phrase-counts"), totals


def _part(phrase: Column, first, n) -> Column:
    """n words of a phrase from the word `first` on (from 1)."""
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def _big(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of all phrases of two words or more: of the cut that scores lowest, then of the shortest first part."""
    parts = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("g"))
    cuts = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", _part(F.col("phrase"), F.lit(1), F.col("k"))).withColumn("rest", _part(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k")))
    side = lambda name, as_: parts.select("lang", F.col("part").alias(name), F.col("g").alias(as_))
    both = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    score = F.expr("CAST((CAST(2000000 AS DECIMAL(8,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "words", "a", "x.l", "x.r", "x.score")


def maximal(phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """Phrases without those whose words lie within a longer one that is at least `covered` per cent as frequent (dropped itself or not)."""
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.struct(i.alias("i"), n.alias("n")))))
    inside = phrases.filter("words > 2").select("lang", "phrase", "a", F.explode(spans).alias("s"))
    most = inside.select("lang", _part(F.col("phrase"), F.col("s.i"), F.col("s.n")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    rows = phrases.join(most, ["lang", "phrase"], "left")
    return rows.filter(F.col("longer").isNull() | (_big(F.col("longer")) * 100 < _big(F.col("a")) * covered)).drop("longer")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, most: int = MOST_WORDS, covered: int = COVERED, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, then frequency, then the phrase's bytes.

    Other columns of docs are not read, so their names don't matter. Ranks are found by partial limits in each task, so a language with most of the phrases does no harm.
    """
    counts, totals = phrase_counts(docs, text, lang, support, most, shards)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = maximal(scored(counts), covered).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
