"""Target-distribution importance resampling: documents drawn by how much likelier their features are in a target than in the corpus.

Features are runs of words, hashed into buckets. A bucket's gain compares its share in the target with that in the whole
corpus; a document's weight is the sum of the gains of its features, read from one array. Seeded noise makes the highest scores a
draw without replacement. The draw is a distributed quickselect: random pivot keys of the rows that are left, exact counts of the
rows below, at and above each, until the k-th key is known. Only the winners are sorted (in ranges) and ranked.

Passes: texts are read once, their buckets stored (an int for each feature); one count by bucket; one pass for the scores;
a few narrow counts for the selection, 1 in PIVOTS or so of the rows left after each; a sort of the winners.

Defined results: a null or wordless text has no features, weight 0 and can't be drawn. A null key counts as the text '' in the noise
and comes after all others in ties; rows with equal score and key (repeated rows) are ranked in the order in which they were stored. An empty corpus
gives no rows; an empty target gives gains against no counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Words: all characters but those of ASCII that are neither letters nor digits, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS, BUCKETS, LEAST_WORDS, SHARE, SEED = 1, 10_000, 20, 10, 2024
#: Pivots of a round of the selection, and winners that a range holds about.
PIVOTS, RANGE_ROWS = 31, 5_000
#: Values of features that a task scores at a time.
BLOCK_VALUES = 1_000_000
#: The composite key, ascending: the highest score first, then the smallest key, then the stored order.
KEY = ["_minus", "_keyless", "_key", "_row"]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))


def feature_buckets(found: Column, runs: int, buckets: int) -> Column:
    """The bucket of every run of 1 to `runs` consecutive words (joined by a blank), repeats included."""
    bucket = lambda x: (F.crc32(x.cast("binary")) % buckets).cast("int")

    def of_length(n: int) -> Column:
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(found, i, n), " ")))

    return F.concat(F.transform(found, bucket), *map(of_length, range(2, runs + 1)))


def _counts(features: DataFrame) -> DataFrame:
    return features.select(F.explode("_buckets").alias("bucket")).groupBy("bucket").count()


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket, from exact counts of both: `buckets` numbers, whatever the corpus."""
    both = []
    for df in (corpus, target):
        counts = np.zeros(buckets, object)
        for r in _counts(df).collect():  # at most a row for each bucket
            counts[r["bucket"]] = r["count"]
        both.append(counts)
    (s, t), (all_s, all_t) = both, (int(x.sum()) for x in both)
    return np.array([math.floor(1000 * math.log(float(int(t[b]) + 1) * float(all_s + buckets) / (float(int(s[b]) + 1) * float(all_t + buckets)))) for b in range(buckets)], np.int64)


def _weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """Adds weight: each row's features index the array of gains, which a task gets once (80 kB for 10,000 buckets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lists = whole.column("_buckets")
            sizes = np.diff(lists.offsets.to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // BLOCK_VALUES)) + 1).tolist(), len(sizes)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                piece = whole.slice(a, b - a)
                sums = np.append(0, np.cumsum(gain[piece.column("_buckets").flatten().to_numpy()]))
                ends = np.cumsum(sizes[a:b])
                columns = [piece.column(c) for c in keep] + [pa.array(sums[ends] - sums[ends - sizes[a:b]], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "weight"])

    keep = [c for c in features.columns if c != "_buckets"]
    kinds = dict(features.dtypes)
    return features.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", weight long")


def _noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of the seed and the key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _composite() -> Column:
    return F.struct(*KEY)


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS) -> tuple | None:
    """The k-th smallest composite key of a stored table, or None if it has fewer rows (or k < 1).

    Each round takes the rows with the smallest seeded digests of those left as random pivots and counts by the number of pivots below a row and
    whether it is one: exact counts of all parts. The part that holds the k-th key is left; keys are distinct, so rounds end.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    literal = lambda key: F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(KEY, key, strict=True)])
    left, before, turn = rows.select(*KEY), 0, 0
    while k > before:
        drawn = left.orderBy(F.xxhash64("_row", F.lit(turn)), "_row").limit(pivots).collect()
        keys = sorted((tuple(r) for r in drawn), key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0, x[3]))
        if not keys:
            return None
        below = reduce(lambda a, b: a + b, [(_composite() > literal(p)).cast("int") for p in keys])
        at = reduce(lambda a, b: a | b, [F.col("_row") == p[3] for p in keys])
        counts = {(r.below, r.at): r["count"] for r in left.groupBy(below.alias("below"), at.alias("at")).count().collect()}
        for i in range(len(keys) + 1):
            inside, is_pivot = counts.get((i, False), 0), counts.get((i, True), 0)
            if before + inside >= k:
                break
            before += inside
            if is_pivot and before + 1 >= k:
                return keys[i]
            before += is_pivot
        else:
            return None
        if i:
            left = left.filter((F.col("_minus") >= keys[i - 1][0]) & (_composite() > literal(keys[i - 1])))
        if i < len(keys):
            left = left.filter((F.col("_minus") <= keys[i][0]) & (_composite() < literal(keys[i])))
        turn += 1
    return None


def ranked(winners: DataFrame, k: int) -> DataFrame:
    """Adds rank, from 1 by the composite key: ranges of about RANGE_ROWS rows are sorted each by itself, and counts of the ranges before are added."""
    spark = winners.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-k // RANGE_ROWS))
    parts = written(winners.repartitionByRange(ranges, *KEY).withColumn("_range", F.spark_partition_id()), "winners")
    starts, n = [], 0
    for r in sorted(parts.groupBy("_range").count().collect(), key=lambda r: r["_range"]):  # a row for each range
        starts.append((r["_range"], n))
        n += r["count"]
    offsets = spark.createDataFrame(starts, "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*KEY))
    return parts.join(F.broadcast(offsets), "_range").withColumn("rank", F.col("_before") + place)  # 12 bytes for each range


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", runs: int = RUNS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED, target_text: str = "text"
) -> DataFrame:
    """Every row's key, n_features, weight, score and rank (1 for the highest score; null if not drawn), all long.

    floor(share * N / 100) of the N rows with at least least_words words are drawn. Other columns of docs are not carried, so their names don't matter.
    """
    if key in ("n_features", "weight", "score", "rank"):
        raise ValueError(f"the key must not be named like a result: {key}")

    def features(df: DataFrame, column: str, *keys: Column) -> DataFrame:
        found = df.select(*keys, words(F.col(column)).alias("_words"))
        return found.select(*[c for c in found.columns if c != "_words"], F.size("_words").alias("_n_words"), feature_buckets(F.col("_words"), runs, buckets).alias("_buckets"))

    stored = written(features(docs, text, F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row")), "buckets")
    gain = gains(stored, features(target, target_text), buckets)
    rows = _weights(stored.select("_key", "_row", "_n_words", F.size("_buckets").cast("long").alias("n_features"), "_buckets"), gain)
    scored = written(rows.withColumn("_minus", -(F.col("weight") + _noise(F.col("_key"), seed))).withColumn("_keyless", F.col("_key").isNull()), "scored")
    fit = F.col("_n_words") >= least_words
    k = scored.filter(fit).count() * share // 100
    last = kth_key(scored.filter(fit), k)
    columns = [F.col("_key").alias(key), "n_features", "weight", (-F.col("_minus")).alias("score")]
    if last is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    kinds = dict(scored.dtypes)
    drawn = fit & (_composite() <= F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(KEY, last, strict=True)]))
    return scored.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(ranked(scored.filter(drawn), k).select(*columns, "rank"))
