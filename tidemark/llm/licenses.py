"""License notices: exact phrases of words, and short notices with a bounded number of edits.

A notice of L characters with at most k edits holds at least one of its k + 1 pieces unchanged. The pieces of all
notices are sought at once with an Aho-Corasick automaton; around each hit the regex library's bounded-error matching
verifies the whole notice, counts its edits and gives its span. Characters are code points, in windows as in edits. The
work on a text is linear in its length and its hits.

Texts are lower-cased (A-Z) and cut into words of digits, a-z and characters beyond ASCII; spans are numbers of words.
Defined results: a null or empty text has no words and no spans. Of overlapping spans of a label the one of the best score
stays, then the first. Repeated rows are scanned each by itself; other columns of docs are not carried, so their names don't matter.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import with_made

#: Label and phrase; a phrase's words stand one after the other.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
#: Label and notice. Edits allowed: one for each EDIT_CHARS characters.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license"),
    ("reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
EDIT_CHARS = 14

_table = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Scanner:
    """Built once in each task from lists of labels and phrases or notices."""

    def __init__(self, phrases=PHRASES, notices=NOTICES, edit_chars: int = EDIT_CHARS) -> None:
        import ahocorasick
        import regex

        self.phrases = [(label, f" {phrase} ") for label, phrase in phrases]
        self.notices, self.seeds = [], ahocorasick.Automaton()
        by_seed: dict[str, list[tuple[int, int]]] = {}
        for k, (label, notice) in enumerate(notices):
            edits = len(notice) // edit_chars
            self.notices.append((label, len(notice), edits, regex.compile(f"(?e)(?:{regex.escape(notice)}){{e<={edits}}}")))
            cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                by_seed.setdefault(notice[a:b], []).append((k, a))
        for seed, places in by_seed.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def words(self, text: str | None) -> tuple[int, str]:
        """How many words, and the words between single blanks, one before and one after. Characters beyond ASCII are part of words, so bytes can be cut."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_table).split()
        return len(words), f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "

    @staticmethod
    def blanks(joined: str) -> np.ndarray:
        """Places of the blanks in code points; word i follows the blank of number i."""
        return np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) == 0x20)

    def base(self, joined: str) -> list[tuple[int, str]]:
        """(first word, label) of every place of a phrase."""
        found = []
        for label, phrase in self.phrases:
            at = joined.find(phrase)
            while at >= 0:
                found.append((at, label))
                at = joined.find(phrase, at + 1)
        if not found:
            return found
        places = np.searchsorted(self.blanks(joined), [at for at, _ in found]).tolist()
        return sorted(zip(places, [label for _, label in found], strict=True))

    def windows(self, joined: str) -> dict[int, list[list[int]]]:
        """By notice, the parts of the text around its seeds in which it may lie; they don't overlap."""
        found: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in self.seeds.iter(joined):
            for k, offset in places:
                _, length, edits, _ = self.notices[k]
                a = max(0, end + 1 - size - offset - edits)
                found.setdefault(k, []).append((a, min(len(joined), a + length + 2 * edits + 1)))
        merged: dict[int, list[list[int]]] = {}
        for k, mine in found.items():
            own = merged[k] = []
            for a, b in sorted(mine):
                if own and a <= own[-1][1]:
                    own[-1][1] = max(b, own[-1][1])
                else:
                    own.append([a, b])
        return merged

    def fuzzy(self, joined: str) -> list[tuple[int, int, str, float]]:
        """(first word, word after the last, label, score) of every notice within its edits; the best of overlapping ones of a label."""
        hits = []
        for k, mine in self.windows(joined).items():
            label, length, _, pattern = self.notices[k]
            for a, b in mine:
                hits += [(m.start(), m.end(), label, 1 - sum(m.fuzzy_counts) / length) for m in pattern.finditer(joined, a, b)]
        if not hits:
            return hits
        blanks = self.blanks(joined)
        firsts = np.maximum(np.searchsorted(blanks, [h[0] for h in hits], "right") - 1, 0).tolist()
        ends = np.searchsorted(blanks, [h[1] - 1 for h in hits]).tolist()
        kept: list[tuple[int, int, str, float]] = []
        taken: dict[str, list[tuple[int, int]]] = {}  # by label, in order; they don't overlap, so the two neighbours tell
        for first, end, label, score in sorted(zip(firsts, ends, [h[2] for h in hits], [h[3] for h in hits], strict=True), key=lambda x: (-x[3], x)):
            mine = taken.setdefault(label, [])
            at = bisect_left(mine, (first, end))
            if not any(x < end and first < y for x, y in mine[max(0, at - 1) : at + 1]):
                mine.insert(at, (first, end))
                kept.append((first, end, label, score))
        return sorted(kept)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", phrases=PHRASES, notices=NOTICES, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """key, n_words, base (array of place and label), notices (array of span, label and score), one row per input row; no shuffle."""

    if key in ("n_words", "base", "notices"):
        raise ValueError(f"the key must not be named like a result: {key}")

    def start():
        scanner = Scanner(phrases, notices, edit_chars)

        def make(piece: pa.RecordBatch) -> dict[str, pa.Array]:
            n, base, fuzzy = [], [], []
            for t in piece.column("_text").to_pylist():
                count, joined = scanner.words(t)
                n.append(count)
                base.append([{"word": w, "label": x} for w, x in scanner.base(joined)])
                fuzzy.append([{"first": a, "end": b, "label": x, "score": s} for a, b, x, s in scanner.fuzzy(joined)])
            place, span = pa.struct([("word", pa.int64()), ("label", pa.string())]), pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())])
            return {"n_words": pa.array(n, pa.int64()), "base": pa.array(base, pa.list_(place)), "notices": pa.array(fuzzy, pa.list_(span))}

        return make

    rows = docs.select(F.col(key), F.col(text).alias("_text"))
    made = "n_words long, base array<struct<word: long, label: string>>, notices array<struct<first: long, end: long, label: string, score: double>>"
    return with_made(rows, "_text", 4_000_000, start, made).drop("_text")


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, first and last places and labels; score: 1 with an exact phrase, else the best notice's share of unedited characters."""
    words = F.transform("base", lambda x: x["word"])
    base = F.transform("base", lambda x: x["label"])
    own = F.transform("notices", lambda x: x["label"])
    names = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scanned.select(
        key, "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        names(base).alias("base_labels"), names(F.concat(base, own)).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("notices", lambda x: x["score"])), F.lit(0.0))).alias("score"),
        "notices",
    )
