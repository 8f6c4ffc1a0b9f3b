"""Ordinal quality: a cumulative-link regression on graded ratings over hashed words.

P(grade >= j) = logistic(w.x - threshold_j): all grades share the weights w, and the thresholds are ordered. A text's
features are the presence of its words and of their beginnings (lower case, hashed to BUCKETS buckets, each with a weight) and a few
measures of its shape, so one telling word counts alike in a short and in a long text. The model gives the expected
grade and the tail probabilities.

Texts have hundreds of words and most say nothing, so weights are shrunk by evidence: a weight's rate of learning is
(z*z / (z*z + EVIDENCE**2)) ** 3, where z is the greatest z-score by which the grades of the bucket's documents differ from the rest.
No bucket is cut off.

Grades from the table of labels: 0 toxic, 1 of low quality, 2 good. The fit uses FIT_DOCS rated documents at most, the
first by a hash of their id; their features are made by tasks, and the driver gets those of the chosen documents. Every document is scored.

Defined results: a null or empty text has no words, so only its shape is scored; it is never kept (see `select`). If no
document is rated, all scores are null and all documents with a word are kept. Several ratings of one document: the least. Of rated rows
with one id, the fit takes one (the least by its features); all are scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches_by_size, with_made

BUCKETS, GRADES = 1 << 20, 3
FIT_DOCS, ROUNDS, EVIDENCE, L2 = 10_000, 220, 6.0, 0.002
#: Entries that a fit's sums take at a time.
FIT_BLOCK = 1 << 18
#: Lengths of words' beginnings that are features of their own.
BEGINNINGS = (5, 6, 7)
#: Least probability of the best grade at which a document is selected.
LEAST_TAIL = 0.43
#: Words that a worker remembers.
CACHE_WORDS = 100_000
_WORD = re.compile(r"[^\W\d_]+")
SHAPES = 7
_upper: np.ndarray | None = None


def word_buckets(word: str) -> tuple[int, ...]:
    """The buckets of a word: its own and those of its beginnings."""
    names = [word, *(f"{word[:n]}~" for n in BEGINNINGS if len(word) > n)]
    return tuple([zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names])


class _Buckets(dict):
    """word -> its buckets."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = word_buckets(word)
        return found


def capitals(text: str) -> int:
    """Characters in upper case."""
    global _upper
    if _upper is None:
        _upper = np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000)
    return int(np.count_nonzero(_upper[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]))


def shape(text: str, words: list[str], distinct: int) -> list[float]:
    """Measures between 0 and 1: symbols and marks to words, capitals to characters, repetition, shortness."""
    n, chars = len(words), max(1, len(text))
    symbols = sum(map(text.count, "#*$%&|<>"))
    marks = text.count("!")
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [1.0, min(1.0, symbols / max(1, n)), min(1.0, marks / max(1, n)), capitals(text) / chars, min(1.0, 2 * repeats / max(1, n)), 1 - distinct / max(1, n), 1 / (1 + n / 10)]


def features(text: str | None, buckets: _Buckets) -> tuple[np.ndarray, list[float]]:
    """Distinct buckets, ascending, and the shape."""
    text = text or ""
    words = _WORD.findall(text)
    distinct = {*map(str.lower, {*words})}
    at = {*chain.from_iterable(map(buckets.__getitem__, distinct))}
    return np.sort(np.fromiter(at, np.int32, len(at))), shape(text, words, len(distinct))


@dataclass
class Model:
    weights: np.ndarray  #: by bucket
    shapes: np.ndarray
    thresholds: np.ndarray  #: of grades 1 and above, ascending

    def score(self, text: str | None, buckets: _Buckets) -> np.ndarray:
        """Tail probabilities: of grade 1 or more, of grade 2 or more ..."""
        at, own = features(text, buckets)
        z = float(self.weights[at].sum(dtype=np.float64) + self.shapes @ np.array(own))
        return 1 / (1 + np.exp(-np.clip(z - self.thresholds, -30, 30)))


def evidence(places: np.ndarray, owner: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """The greatest z-score, over the grades, of the documents of each place against all."""
    most = int(places.max()) + 1
    parts = [slice(i, i + FIT_BLOCK) for i in range(0, len(places), FIT_BLOCK)]
    n = sum(np.bincount(places[x], minlength=most) for x in parts)
    z = np.zeros(most)
    for j in range(1, GRADES):
        p = float((grade >= j).mean())
        if 0 < p < 1:
            better = sum(np.bincount(places[x], (grade >= j)[owner[x]], most) for x in parts)  # whole numbers, so exact in any order
            z = np.maximum(z, np.abs(better - p * n) / np.sqrt(np.maximum(n, 1) * p * (1 - p)))
    return z


def _blocks(firsts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Groups from, until, and their entries from, until: about FIT_BLOCK entries (or one larger group). firsts: where each group begins, and the end."""
    cuts = [*np.flatnonzero(np.diff(firsts[:-1] // FIT_BLOCK, prepend=-1)).tolist(), len(firsts) - 1]
    return [(a, b, int(firsts[a]), int(firsts[b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def fit(rows: list[tuple[np.ndarray, list[float], int]], rounds: int = ROUNDS, l2: float = L2, strength: float = EVIDENCE) -> Model | None:
    """Full-batch gradient descent with adaptive steps; deterministic. rows: buckets, shape and grade of each document."""
    if not rows:
        return None
    n = len(rows)
    sizes = np.array([len(r[0]) for r in rows])
    places = np.concatenate([*[r[0] for r in rows], np.zeros(0, np.int32)])
    used = np.flatnonzero(np.bincount(places, minlength=BUCKETS))
    number = np.zeros(BUCKETS, np.int32)
    number[used] = np.arange(len(used))
    row, col = np.repeat(np.arange(n, dtype=np.int32), sizes), number[places]
    del places, number
    by_place = np.argsort(col, kind="stable")
    of_place, firsts = row[by_place], np.concatenate(([0], np.cumsum(np.bincount(col, minlength=len(used)))))
    del by_place
    dense, grade = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    z = evidence(col, row, grade) if len(used) else np.zeros(0)
    # Sums go by blocks, as numpy makes 16 bytes of each entry: the driver's memory holds a few copies of 4 bytes an entry.
    by_row, by_word = _blocks(np.concatenate(([0], np.cumsum(sizes)))), _blocks(firsts) if len(used) else []
    rate = 0.1 * (z * z / (z * z + strength * strength)) ** 3
    tails = (grade[:, None] >= np.arange(1, GRADES)[None, :]).astype(float)
    # Rare grades count as much as frequent ones, up to a factor.
    share = np.bincount(grade, minlength=GRADES) / n
    weight = np.minimum(3.0, (1 / GRADES) / np.maximum(share[grade], 1e-9))
    weight /= weight.sum()
    w, s, first, gaps = np.zeros(len(used)), np.zeros(SHAPES), np.array([-1.0]), np.full(GRADES - 2, 0.0)
    squares = [np.full_like(x, 1e-8) for x in (w, s, first, gaps)]
    for _ in range(rounds):
        t = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        z = np.concatenate([np.bincount(row[a:b] - lo, w[col[a:b]], hi - lo) for lo, hi, a, b in by_row]) + dense @ s
        error = (1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -30, 30))) - tails) * weight[:, None]
        g = error.sum(1)
        by_threshold = -error.sum(0)
        of_words = np.concatenate([np.zeros(0), *[np.add.reduceat(g[of_place[a:b]], firsts[lo:hi] - a) for lo, hi, a, b in by_word]])  # every place has a document
        gradients = [of_words + l2 * w / max(1, len(w)), dense.T @ g + l2 * s / SHAPES, by_threshold.sum(keepdims=True), np.cumsum(by_threshold[:0:-1])[::-1] * np.exp(gaps)]
        for x, d, q, r in zip((w, s, first, gaps), gradients, squares, (rate, 0.6, 0.2, 0.2), strict=True):
            q += d * d
            x -= r * d / np.sqrt(q)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return Model(weights, s, np.concatenate([first, first + np.cumsum(np.exp(gaps))]))


def grades(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and grade (0, 1, 2) from quality and toxic; rows without either are left out."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return labels.filter(f"`{key}` IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(key).agg(F.min(grade).alias("grade"))


def learn(docs: DataFrame, ratings: DataFrame, text: str = "text", key: str = "doc_id", fit_docs: int = FIT_DOCS) -> Model | None:
    """The model from at most fit_docs rated documents; those ids are few enough to broadcast. Features are made on the executors."""
    # Ratings of documents that are there: else a pipeline's stage might choose ids that an earlier one has dropped.
    there = ratings.join(docs.select(key), key, "left_semi")
    chosen = there.select(F.col(key), "grade").orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(fit_docs)
    sample = docs.select(F.col(key), F.col(text)).join(F.broadcast(chosen), key).withColumn(key, F.col(key).cast("string"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = _Buckets()
        for frame in batches_by_size(frames, text, 2_000_000):
            found = [features(t, buckets) for t in frame[text]]
            yield pd.DataFrame({"key": frame[key], "at": [x[0].tobytes() for x in found], "shape": [x[1] for x in found], "grade": frame["grade"]})

    # As Arrow has them, features lie in a few buffers that go back to the system after the fit; as rows they would stay in the driver.
    found = sample.mapInPandas(place, "key string, at binary, shape array<double>, grade int").toArrow().combine_chunks()
    keys, at, shapes, marks = found["key"].to_pylist(), found["at"], found["shape"].to_pylist(), found["grade"].to_pylist()
    rows: dict[str, int] = {}
    for i, own in enumerate(keys):
        rows[own] = min(rows.get(own, i), i, key=lambda j: (at[j].as_py(), shapes[j], marks[j])) if own in rows else i  # the least of rows with one id
    return fit([(np.frombuffer(at[i].as_buffer(), np.int32) if len(at[i].as_buffer()) else np.zeros(0, np.int32), shapes[i], marks[i]) for _, i in sorted(rows.items())])


def score(docs: DataFrame, model: Model | None, text: str = "text", outputs: tuple[str, ...] = ("expected_grade", "p_grade_1", "p_grade_2")) -> DataFrame:
    """Adds the expected grade (0 to 2), P(grade >= 1) and P(grade >= 2). Columns of these names are replaced. One row per input row; no shuffle."""
    base = docs.drop(*outputs)
    if model is None:
        return base.withColumns({c: F.lit(None).cast("double") for c in outputs})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each bucket, 4 MB

    def start():
        own, buckets = shared.value, _Buckets()

        def make(piece: pa.RecordBatch) -> dict[str, pa.Array]:
            tails = np.array([own.score(t, buckets) for t in piece.column(text).to_pylist()], float).reshape(piece.num_rows, GRADES - 1)
            return {c: pa.array(x, pa.float64()) for c, x in zip(outputs, [tails.sum(1), *tails.T], strict=True)}

        return make

    return with_made(base, text, 2_000_000, start, ", ".join(f"`{c}` double" for c in outputs))


def select(tail: Column, text: Column, least: float = LEAST_TAIL) -> Column:
    """Whether a document is selected: it has a character other than white space, and its tail probability is at least `least` (or unknown)."""
    return F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]") & (F.coalesce(tail, F.lit(1.0)) >= least)
