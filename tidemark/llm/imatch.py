"""I-Match fingerprints with several randomised lexicons: DataFrame functions only.

The lexicon holds the terms whose document frequency lies in a band (that of an inverse document frequency). A document
has avg terms, so at most avg / LOW terms reach the band's lower end, however many documents there are: the lexicon is
broadcast behind a check of its size, and shuffled beyond it. The lexicon is dealt into SUBSETS random subsets by a hash of
the term, and all are used: few terms each, so that an edit changes some of them. For each subset, the document's distinct
terms in it are sorted (by their hashes) and hashed to 64 bits; the hashes, joined, are the fingerprint. The
likeness of two fingerprints is the share of subsets, of those that either has terms in, whose hashes are equal.

Document frequencies are of distinct texts, so exact copies count once. Terms are runs of letters and digits in lower
case. A text without terms of the lexicon has hashes of all its sorted distinct terms, dealt into the same subsets.

Defined results: a null text counts as empty; empty texts are alike. Equal texts have equal fingerprints. One row comes out
for each row: rows with one id follow each other in the order of a hash of their texts, so of c equal rows the first c - 1
are followed by their like. A row without an id has a fingerprint, but no place in the order of documents: it has no edited text, and likeness 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import removed, sized, written

#: The band, as shares of all documents.
LOW, HIGH = 0.002, 0.05
SUBSETS = 64
#: Rows of a range of ids, about.
RANGE_ROWS = 5_000


def terms(text: Column) -> Column:
    """Distinct terms."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), ""))


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH, key: str = "id") -> DataFrame:
    """term, subset, code (its hash) of the terms in the band. Frequencies are of all distinct texts; counts are summed in each task before they are shuffled.

    docs has no two equal rows. Of each distinct text one row counts: that of the least key (none before all others).
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *[F.xxhash64(F.col(text), F.lit(seed)).alias(f"_h{seed}") for seed in (1, 2)])
    firsts = written(rows.groupBy("_h1", "_h2").agg(F.min(F.struct(F.col("_key").isNotNull().alias("has"), "_key")).alias("x")).select("_h1", "_h2", F.col("x._key").alias("_key")), "distinct-texts")
    n = firsts.count()
    one = sized(firsts, n).alias("one")
    same = (F.col("all._h1") == F.col("one._h1")) & (F.col("all._h2") == F.col("one._h2")) & F.col("all._key").eqNullSafe(F.col("one._key"))
    counts = rows.alias("all").join(one, same, "left_semi").select(F.explode(terms(F.col("_text"))).alias("term")).groupBy("term").count()
    return counts.filter((F.col("count") >= max(2, low * n)) & (F.col("count") <= max(2, high * n))).select(
        "term", F.pmod(F.xxhash64("term", F.lit(17)), F.lit(SUBSETS)).cast("int").alias("subset"), F.xxhash64("term").alias("code")
    )


def _hashes(parts: Column) -> Column:
    """A long for each subset's terms, null for none: a fingerprint as it is stored and shuffled, in half the bytes of its text."""
    return F.transform(parts, lambda p: F.when(F.size(p) > 0, F.xxhash64(p)))


def _against(own: Column, other: Column) -> Column:
    """The differences (XOR) of other hashes from a text's own: 0 where they are equal, which takes little room where it is compressed. Applied twice it gives the other hashes."""
    return F.zip_with(own, other, lambda x, y: F.coalesce(x, F.lit(0).cast("long")).bitwiseXOR(y))


def _joined(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x), 16, "0")), F.lit("-"))), ".")


def fingerprints(texts: DataFrame, lexicon: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and, for the text column of number i, print<i>: null without terms of the lexicon.

    `texts` should be partitioned by the first key: then nothing but the lexicon moves.
    """
    return _hashed(texts, lexicon, keys, columns).select(*keys, *[_joined(F.col(f"hashes{i}")).alias(f"print{i}") for i in range(len(columns))])


def _hashed(texts: DataFrame, lexicon: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """fingerprints() as hashes<i>."""
    lists = F.array(*[F.struct(F.lit(i).alias("which"), terms(F.col(c)).alias("terms")) for i, c in enumerate(columns)])
    rows = texts.select(*keys, F.inline(lists)).select(*keys, "which", F.explode("terms").alias("term"))
    found = (
        rows.join(lexicon, "term").groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("which", "subset", "code"))).alias("found"))
    )

    def of(i: int) -> Column:
        return F.filter("found", lambda x: x["which"] == i).alias(f"own{i}")

    split = found.select(*keys, *[of(i) for i in range(len(columns))])

    def hashes(i: int) -> Column:
        parts = F.transform(
            F.sequence(F.lit(0), F.lit(SUBSETS - 1)),
            lambda j: F.transform(F.filter(F.col(f"own{i}"), lambda x: x["subset"] == j), lambda x: x["code"]),
        )
        return F.when(F.size(f"own{i}") > 0, _hashes(parts))

    return split.select(*keys, *[hashes(i).alias(f"hashes{i}") for i in range(len(columns))])


def _plain_hashes(text: Column) -> Column:
    """For texts without terms of the lexicon: whole hashes of all terms by subset."""
    dealt = F.transform(F.array_sort(terms(text)), lambda t: F.struct(F.pmod(F.xxhash64(t, F.lit(17)), F.lit(SUBSETS)).alias("subset"), t.alias("term")))
    parts = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda j: F.transform(F.filter(dealt, lambda x: x["subset"] == j), lambda x: x["term"]))
    return _hashes(parts)


def _plain(text: Column) -> Column:
    return F.concat(F.lit("all."), _joined(_plain_hashes(text)))


def _print(own: Column) -> Column:
    """The fingerprint as text. own: hashes, and whether they are of all terms (plain)."""
    return F.concat(F.when(own["plain"], "all.").otherwise(""), _joined(own["hashes"]))


def _alike(a: Column, b: Column) -> Column:
    """likeness() of stored fingerprints."""
    used = F.filter(F.arrays_zip(a["hashes"].alias("x"), b["hashes"].alias("y")), lambda p: p["x"].isNotNull() | p["y"].isNotNull())
    same = F.filter(used, lambda p: p["x"].eqNullSafe(p["y"]))
    return F.when(a == b, 1.0).when(a["plain"] != b["plain"], 0.0).otherwise(F.size(same) / F.size(used)).cast("double")


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, from 0 to 1; 1 if they are equal."""
    pairs = F.filter(F.arrays_zip(F.split(a, "\\.").alias("x"), F.split(b, "\\.").alias("y")), lambda p: p["x"] != "all")
    used = F.filter(pairs, lambda p: (p["x"] != "-") | (p["y"] != "-"))
    same = F.filter(used, lambda p: p["x"] == p["y"])
    return F.when(a == b, 1.0).when(F.startswith(a, F.lit("all.")) != F.startswith(b, F.lit("all.")), 0.0).otherwise(F.size(same) / F.size(used)).cast("double")


def followed(rows: DataFrame, n: int) -> DataFrame:
    """Adds next_id and next_h: those of the next row by (id, h), and of the last row the first. The n rows have no two equal pairs.

    Rows are dealt into ranges, and each is ordered by itself. A range's last row is followed by the first of the next one;
    of each range a row comes to the driver.
    """
    ranged = written(rows.repartitionByRange(max(1, -(-n // RANGE_ROWS)), "id", "h").withColumn("_range", F.spark_partition_id()), "ranges")
    firsts = ranged.groupBy("_range").agg(F.min(F.struct("id", "h")).alias("x")).orderBy("_range").collect()
    after = [(r["_range"], *firsts[(i + 1) % len(firsts)].x) for i, r in enumerate(firsts)]
    starts = rows.sparkSession.createDataFrame(after, f"_range int, _id {dict(rows.dtypes)['id']}, _h long")
    by = Window.partitionBy("_range").orderBy("id", "h")
    within = ranged.withColumn("_next", F.lead(F.struct("id", "h")).over(by)).join(sized(starts, len(after)), "_range")
    return within.withColumns({"next_id": F.coalesce("_next.id", "_id"), "next_h": F.coalesce("_next.h", "_h")}).drop("_range", "_next", "_id", "_h")


def compare_edited(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the last quarter gives way to the next document's beginning.

    Texts are shuffled once by (id, h), where h is a hash of the text (both joins use that exchange), beginnings once; terms are
    counted and matched where the texts are. Of rows that are equal one is worked on: with the next row's beginning (kind 0), and with its own (kind 1).
    """
    all_texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    groups = written(all_texts.groupBy("id", "h").agg(F.count("*").alias("copies"), F.first(F.length("text").cast("long")).alias("n_chars")), "rows")
    sizes = groups.agg(F.count("id").alias("n"), F.count(F.when(F.col("copies") > 1, 1)).alias("repeated"), F.count(F.when(F.col("id").isNull(), 1)).alias("loose")).first()
    following = followed(groups.filter("id IS NOT NULL"), sizes.n)
    chain = written(following, "next-rows")
    removed(following)  # the ranges, which only the chain has read
    distinct = all_texts.dropDuplicates(["id", "h"]) if sizes.repeated else all_texts
    words = written(lexicon(distinct), "lexicon")
    words = sized(words, words.count())
    texts = distinct.filter("id IS NOT NULL")  # both joins need the same rows, else the texts would be shuffled for each

    k = F.floor(F.col("n_chars") / 4).cast("int").alias("k")
    asked = chain.select(F.col("next_id").alias("id"), F.col("next_h").alias("h"), F.col("id").alias("owner"), F.col("h").alias("owner_h"), F.lit(0).alias("kind"), "copies", k)
    if sizes.repeated:
        asked = asked.unionByName(chain.filter("copies > 1").select("id", "h", F.col("id").alias("owner"), F.col("h").alias("owner_h"), F.lit(1).alias("kind"), "copies", k))
    heads = texts.join(asked, ["id", "h"]).select(F.col("owner").alias("id"), F.col("owner_h").alias("h"), "kind", "copies", F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.substring(F.col("text"), F.lit(1), F.col("k")).alias("head"))
    length = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (length - F.floor(length / 4)).cast("int")), F.coalesce(F.col("head"), F.lit("")))
    both = texts.join(heads, ["id", "h"]).select("id", "h", "kind", "copies", "next_id", "next_h", "text", edited.alias("edited"))
    keys = ["id", "h", "kind"]
    prints = _hashed(both, words, keys, ["text", "edited"])
    own = lambda i, column: F.struct(F.col(f"hashes{i}").isNull().alias("plain"), F.coalesce(F.col(f"hashes{i}"), _plain_hashes(F.col(column))).alias("hashes"))
    plain = both.select(*keys, "copies", "next_id", "next_h", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2(F.encode("edited", "UTF-8"), 256)).alias("digest"), "text", "edited")
    result = plain.join(prints, keys, "left").select("kind", "id", "h", "copies", "next_id", "next_h", "n_chars", "digest", own(0, "text").alias("own"), own(1, "edited").alias("own_edited"))
    # Most of an edited text's hashes are those of the text: stored and shuffled are its differences.
    edited_hashes = F.struct(F.col("own_edited.plain").alias("plain"), _against(F.col("own.hashes"), F.col("own_edited.hashes")).alias("hashes"))
    result = written(result.withColumn("own_edited", edited_hashes), "prints")
    removed(chain, *([] if sizes.loose else [groups, words]))
    following = result.filter("kind = 0").select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("own").alias("own_next"))
    one = F.col("kind") == 1
    found = result.join(following, ["next_id", "next_h"]).withColumn("_times", F.when(one, F.col("copies") - 1).otherwise(1))
    found = found.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))) if sizes.repeated else found
    found = found.withColumn("own_edited", edited_hashes).select(
        F.col("id").alias(key), "n_chars", F.lower(F.hex("digest")).alias("edited_sha256"), _print(F.col("own")).alias("fingerprint"), _print(F.col("own_edited")).alias("edited_fingerprint"),
        _alike(F.col("own"), F.col("own_edited")).alias("near_edited"),
        F.when(one, 1.0).otherwise(_alike(F.col("own"), F.col("own_next"))).alias("near_next"),
    )
    if not sizes.loose:
        return found
    loose = distinct.filter("id IS NULL")
    prints = loose.join(fingerprints(loose, words, ["h"], ["text"]), "h", "left").select("h", F.coalesce(F.col("print0"), _plain(F.col("text"))).alias("fingerprint"))
    rows = groups.filter("id IS NULL").join(prints, "h").withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return found.unionByName(rows.select(F.col("id").alias(key), "n_chars", "fingerprint", F.lit(0.0).alias("near_edited"), F.lit(0.0).alias("near_next")), allowMissingColumns=True)
