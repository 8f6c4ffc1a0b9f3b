"""Language of a text by its words first, and by shorter and shorter character n-grams for words never seen.

A known word adds its log frequency in each language. An unseen word is scored by its n-grams (with marks for its
ends) of the greatest length of which any is known, from MOST_GRAM down to 1, as the mean of their log frequencies. The
language of the greatest sum wins; ties go to the first by name. The score is the language's share of the likelihood of
an average word (the sums are divided by the number of words), so it doesn't grow with the text.

The model is learnt from a bounded sample: about LEARN_DOCS documents of each language, chosen by a hash of id and text. Words are
runs of letters in lower case, in learning as in prediction; their n-grams are counted by Spark too. Of each language its MOST_WORDS most
frequent words and MOST_GRAMS n-grams are kept, so a rare language keeps as many as a frequent one; words beyond are
scored as unseen ones are.

Defined results: a null text, or one without letters, is `und` with score 0; so is every text if nothing was learnt. Repeated rows and
ids are learnt and predicted each by itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batches_by_size, with_made

LEARN_DOCS, MOST_WORDS, MOST_GRAMS, MOST_GRAM = 2_000, 25_000, 15_000, 5
#: Unseen words that a worker remembers.
CACHE_WORDS = 100_000
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; other characters that count as parts of words (superscripts, fractions, Roman numerals) end a run."""
    found: list[str] = []
    for w in _LETTERS.findall(text.lower()) if text else ():
        if w.isalpha():
            found.append(w)
        else:
            found += "".join(c if c.isalpha() else " " for c in w).split()
    return found


def grams_of(word: str) -> set[str]:
    marked = f"<{word}>"
    return {marked[i : i + n] for n in range(1, MOST_GRAM + 1) for i in range(len(marked) - n + 1)} - {"<", ">"}


def _logs(names: list[str], counts: dict[str, Counter], totals: dict[str, dict[int, int]], sizes: Counter, group) -> np.ndarray:
    """Log frequencies by name and language, within the names' groups (the length, for n-grams)."""
    languages = sorted(counts)
    table = [[math.log((counts[x][w] + 0.5) / (totals[x].get(group(w), 0) + 0.5 * sizes[group(w)])) for x in languages] for w in names]
    return np.array(table, np.float32).reshape(len(names), len(languages))


class Model:
    """languages: sorted names; words and grams: row numbers of their log frequencies, whose columns are languages."""

    def __init__(self, words: dict[str, Counter], grams: dict[str, Counter] | None = None) -> None:
        """Counts of words, and of n-grams (weighted by the counts of the words that hold them), by language."""
        if grams is None:
            grams = {x: Counter() for x in words}
            for x, counts in words.items():
                for w, n in counts.items():
                    for g in grams_of(w):
                        grams[x][g] += n
        self.languages = sorted(words)
        grams = {x: grams.get(x, Counter()) for x in self.languages}
        names, gram_names = (sorted(set().union(*counts.values())) if counts else [] for counts in (words, grams))
        self.words, self.gram_rows = ({w: i for i, w in enumerate(x)} for x in (names, gram_names))
        self.logs = _logs(names, words, {x: {0: c.total()} for x, c in words.items()}, Counter({0: len(names)}), lambda w: 0)
        by_length: dict[str, dict[int, int]] = {x: defaultdict(int) for x in self.languages}
        for x, c in grams.items():
            for g, n in c.items():
                by_length[x][len(g)] += n
        self.gram_logs = _logs(gram_names, grams, by_length, Counter(map(len, gram_names)), len)

    def unseen(self, word: str) -> np.ndarray:
        marked = f"<{word}>"
        for n in range(MOST_GRAM, 0, -1):
            rows = [r for i in range(len(marked) - n + 1) if (r := self.gram_rows.get(marked[i : i + n])) is not None]
            if rows:
                return self.gram_logs[rows].mean(0)
        return np.zeros(len(self.languages))


class Predictor:
    """A worker's view of a model; it scores each distinct unseen word once, as long as its memory holds."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, len(model.words)
        self.table = np.vstack([model.logs, np.zeros((CACHE_WORDS, len(model.languages)), np.float32)])
        self._forget()

    def _forget(self) -> None:
        outer, self.filled = self, self.known

        class Rows(dict):
            def __missing__(self, word: str) -> int:
                row = outer.filled
                outer.table[row] = outer.model.unseen(word)
                outer.filled += 1
                self[word] = row
                return row

        self.at = Rows(self.model.words)

    def _scores(self, words: list[str]) -> np.ndarray:
        total = np.zeros(len(self.model.languages))
        for i in range(0, len(words), CACHE_WORDS):
            some = words[i : i + CACHE_WORDS]
            if self.filled + len(some) > len(self.table):
                self._forget()
            total += self.table[list(map(self.at.__getitem__, some))].sum(0, dtype=np.float64)
        return total

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not self.model.languages or not words:
            return "und", 0.0
        scores = self._scores(words)
        best = int(np.argmax(scores))
        return self.model.languages[best], float(1 / np.exp((scores - scores[best]) / len(words)).sum())


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", learn_docs: int = LEARN_DOCS) -> Model:
    """A model from rows with a text and a language. Counting is Spark's; the kept counts come to the driver, a bounded number for each language."""
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit(8)).alias("_row"))
    steps = known.groupBy("_lang").agg(F.ceil(F.count("*") / learn_docs).alias("_step"))  # a row for each language
    sample = known.join(F.broadcast(steps), "_lang").filter(F.pmod("_row", "_step") == 0).select("_lang", "_text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches_by_size(frames, "_text", 1_000_000):
            counts: dict[str, Counter] = defaultdict(Counter)
            for x, t in zip(frame["_lang"], frame["_text"], strict=True):
                counts[x].update(words_of(t))
            rows = [(x, w, n, False) for x, c in counts.items() for w, n in c.items()]
            for x, c in counts.items():
                grams: Counter = Counter()
                for w, n in c.items():
                    for g in grams_of(w):
                        grams[g] += n
                rows += [(x, g, n, True) for g, n in grams.items()]
            yield pd.DataFrame(rows, columns=["lang", "name", "n", "gram"])

    counted = sample.mapInPandas(count, "lang string, name string, n long, gram boolean").groupBy("lang", "gram", "name").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "gram").orderBy(F.desc("n"), "name"))
    kept = counted.withColumn("k", rank).filter(F.col("k") <= F.when(F.col("gram"), MOST_GRAMS).otherwise(MOST_WORDS))
    found: dict[bool, dict[str, Counter]] = {False: defaultdict(Counter), True: defaultdict(Counter)}
    for row in kept.drop("k").toLocalIterator():
        found[row.gram][row.lang][row.name] = row.n
    return Model(dict(found[False]), dict(found[True]))


def predict(docs: DataFrame, model: Model, text: str = "text", outputs: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted language and its share of an average word's likelihood. Columns of these names are replaced. One row per input row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_WORDS + MOST_GRAMS rows for each language

    def start():
        own = Predictor(shared.value)

        def make(piece: pa.RecordBatch) -> dict[str, pa.Array]:
            found = [own(t) for t in piece.column(text).to_pylist()]
            return {outputs[0]: pa.array([x[0] for x in found], pa.string()), outputs[1]: pa.array([x[1] for x in found], pa.float64())}

        return make

    return with_made(docs.drop(*outputs), text, 2_000_000, start, f"`{outputs[0]}` string, `{outputs[1]}` double")
