"""Quality rules as a ledger of bits: DataFrame functions only.

`ledger` measures each text and evaluates every rule once: bit k of failed_bits is set if rule k fails. A policy is a
version's name and a mask of rules; `apply_policy` is a bitwise test of the ledger, and `ablation` tells by bitwise
aggregation what each rule of a policy costs. Neither reads a text again.

Defined results: a null or empty text has no words, so it fails `few_words`. Measurements are counts of the whole text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rules in the order of their bits; each is a condition over the measurements under which a text fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_passages": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "n_lines >= 4 AND 10 * n_dup_lines > 4 * n_lines",
    "capitals": "10 * n_capitals > 5 * word_chars",
    "word_length": "word_chars > 20 * n_words OR word_chars < 2 * n_words",
}
#: Versions of the policy: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_passages"),
    "v1": ("few_words", "repeated_passages", "symbols", "repeated_lines", "capitals", "word_length"),
}


def mask(policy: str) -> int:
    return sum(1 << k for k, rule in enumerate(RULES) if rule in POLICIES[policy])


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and the counts n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals (all long)."""
    t = F.col("_text")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    first = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).select(
        F.col(key),
        F.transform(F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), ""), lambda w: F.xxhash64(w)).alias("_words"),
        _without(t, _SPACES).cast("long").alias("word_chars"),
        (F.length(t) - _without(t, _SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(t) - _without(t, _CAPITALS)).cast("long").alias("n_capitals"),
        lines.alias("_lines"),
    )
    words = F.col("_words")
    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, WINDOW)]),
    )
    second = first.select(
        key, "word_chars", "n_symbols", "n_capitals",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
    )
    # Only where a window occurs twice are windows sorted with their places.
    third = second.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    )
    s = F.col("_sorted")
    places = F.array_sort(
        F.transform(
            F.filter(
                F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), ((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])).alias("twice"))),
                lambda x: x["twice"],
            ),
            lambda x: x["i"],
        )
    )
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return third.select(
        key, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(F.when(s.isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"), "n_capitals",
    )


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Measurements and failed_bits (long) of every text."""
    bits = reduce(lambda a, b: a + b, [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())])
    return measure(docs, text, key).withColumn("failed_bits", bits.cast("long"))


def apply_policy(ledger: DataFrame, policy: str) -> DataFrame:
    """Adds kept: whether no rule of the policy fails."""
    return ledger.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(ledger: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that the policy would keep without it alone.

    Rows are first counted by their bits (at most 2 to the number of rules), so the rest is small.
    """
    own = mask(policy)
    by_bits = ledger.groupBy(F.col("failed_bits").bitwiseAND(F.lit(own)).alias("bits")).count()
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, name in enumerate(RULES) if name in POLICIES[policy]])
    return (
        by_bits.select("bits", "count", F.inline(rules))
        .groupBy("rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("count")).otherwise(0)).alias("n_only_this"),
        )
    )
