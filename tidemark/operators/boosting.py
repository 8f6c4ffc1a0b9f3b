"""Gradient boosting of several classes with one softmax loss, over binned features.

A round grows one tree for each class, all at the same time and level by level. For a level, each task sums the gradients and
Hessians of its rows by (class, node, feature, bin); Spark adds the tasks' sums, and the driver, which gets at most classes * nodes *
features * bins of them whatever the number of rows, picks each node's best cut. Rows hold their bins and the scores of the rounds
before the last refresh; later trees are applied in the tasks, and every REFRESH rounds the scores are stored anew.

Defined results: a missing feature falls into the first bin; rows without a label are left out of a fit. Classes are those that occur;
a class that doesn't has probability 0. A fit needs a labelled row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut

ROUNDS, DEPTH, RATE, BINS, LEAST_ROWS, LEAST_HESSIAN, L2 = 100, 3, 0.05, 64, 20, 1e-3, 0.0
REFRESH = 10
#: Rows that a task of a level's job holds about.
TASK_ROWS = 20_000
_SUMS = "key long, g double, h double, n double"


@dataclass
class Tree:
    """A full tree of its depth: for each inner node (the children of i are 2i+1 and 2i+2) the feature and the last bin that goes left; the leaves' values."""

    feature: np.ndarray
    last: np.ndarray
    values: np.ndarray

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The place within its level that each row reaches after `depth` cuts."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            at = 2 * at + 1 + (bins[rows, self.feature[at]] > self.last[at])
        return at - (2**depth - 1)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.values[self.nodes(bins, int(np.log2(len(self.values))))]


@dataclass
class Boosted:
    """The fitted model: probabilities are the softmax of the first scores and all rounds' trees."""

    columns: list[str]
    edges: list[np.ndarray]
    classes: list[int]
    first: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Per feature the number of edges below the value; 0 for missing ones."""
        found = [np.searchsorted(e, np.where(np.isnan(c), -np.inf, c), side="left") for e, c in zip(self.edges, x.T, strict=True)]
        return np.stack(found, 1).astype(np.int64)

    def add(self, scores: np.ndarray, bins: np.ndarray, start: int = 0) -> np.ndarray:
        """Scores with the trees of the rounds from `start` on."""
        out = scores.copy()
        for trees in self.rounds[start:]:
            for k, tree in enumerate(trees):
                out[:, k] += tree.predict(bins)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A column for each class id from 0 to the greatest."""
        own = _softmax(self.add(np.tile(self.first, (len(x), 1)), self.bins(x)))
        out = np.zeros((len(x), max(self.classes) + 1))
        out[:, self.classes] = own
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds probability (array, by class id) and prediction (the likeliest class, the first of equal ones)."""
        model = self

        @F.pandas_udf("array<double>")
        def probability(x: pd.Series) -> pd.Series:
            rows = np.array([[np.nan if v is None else v for v in r] for r in x], float).reshape(len(x), len(model.columns))
            return pd.Series(list(model.probabilities(rows)))

        found = df.withColumn("probability", probability(_features(self.columns)))
        return found.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))

    def to_json(self) -> str:
        trees = [[[t.feature.tolist(), t.last.tolist(), t.values.tolist()] for t in trees] for trees in self.rounds]
        return json.dumps({"columns": self.columns, "edges": [e.tolist() for e in self.edges], "classes": self.classes, "first": self.first.tolist(), "rounds": trees})

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        x = json.loads(text)
        rounds = [[Tree(np.array(f, np.int64), np.array(b, np.int64), np.array(v, float)) for f, b, v in trees] for trees in x["rounds"]]
        return cls(x["columns"], [np.array(e, float) for e in x["edges"]], x["classes"], np.array(x["first"], float), rounds)


def _features(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _matrix(column, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def edges(df: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """At most bins - 1 distinct quantiles of each feature, from one aggregate of bounded sketches."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array(x if x is not None else [], float)) for x in row]


class _Fit:
    """One fit's shape: what the tasks and the driver must agree on."""

    def __init__(self, model: Boosted, bins: int, depth: int, rate: float, least_rows: int, l2: float) -> None:
        self.model, self.bins, self.depth, self.rate, self.least_rows, self.l2 = model, bins, depth, rate, least_rows, l2
        self.width, self.k = len(model.columns), len(model.classes)

    def sums(self, rows: DataFrame, since: int, trees: list[Tree], level: int) -> np.ndarray:
        """Gradients, Hessians and rows by (class, node, feature, bin) of one level, as an array. The unfinished round's trees have the cuts of the levels above."""
        model, width, k, bins, nodes = self.model, self.width, self.k, self.bins, 2**level
        size = k * nodes * width * bins

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((3, size))
            for b in batches:
                x, s = _matrix(b.column("x"), width, np.int64), _matrix(b.column("s"), k, float)
                y = b.column("y").to_numpy()
                p = _softmax(model.add(s, x, since))
                for c in range(k):
                    at = ((c * nodes + trees[c].nodes(x, level))[:, None] * width + np.arange(width)) * bins + x
                    for i, v in enumerate((p[:, c] - (y == c), p[:, c] * (1 - p[:, c]), np.ones(len(x)))):
                        out[i] += np.bincount(at.ravel(), np.repeat(v, width), size)
            used = np.flatnonzero(out[2])
            yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(v[used]) for v in out]], ["key", "g", "h", "n"])

        found = rows.mapInArrow(run, _SUMS).groupBy("key").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()  # at most `size` rows
        out = np.zeros((3, size))
        out[:, found.column("key").to_numpy()] = [found.column(c).to_numpy() for c in "ghn"]
        return out.reshape(3, k, nodes, width, bins)

    def split(self, sums: np.ndarray, trees: list[Tree], level: int, totals: list[dict]) -> None:
        """Sets the cuts of one level. totals: by class, the gradient and Hessian of the nodes so far; a node that isn't cut passes all on to the left."""
        for c, tree in enumerate(trees):
            for node in range(2**level):
                own = sums[:, c, node]
                left = np.cumsum(own, 2)
                whole = left[:, :1, -1:]
                right = whole - left
                gain = self._part(left) + self._part(right) - self._part(whole)
                fit = (np.minimum(left[2], right[2]) >= self.least_rows) & (np.minimum(left[1], right[1]) >= LEAST_HESSIAN)
                gain = np.where(fit, gain, -np.inf)
                place, best = 2**level - 1 + node, int(np.argmax(gain))
                f, b = divmod(best, self.bins)
                totals[c].setdefault(place, (whole[0, 0, 0], whole[1, 0, 0]))
                g, h = totals[c][place]
                if gain[f, b] > 1e-12:
                    tree.feature[place], tree.last[place] = f, b
                    totals[c][2 * place + 1], totals[c][2 * place + 2] = (left[0, f, b], left[1, f, b]), (right[0, f, b], right[1, f, b])
                else:
                    tree.feature[place], tree.last[place] = 0, self.bins
                    totals[c][2 * place + 1], totals[c][2 * place + 2] = (g, h), (0.0, 0.0)

    def _part(self, x: np.ndarray) -> np.ndarray:
        return np.where(x[1] > 0, x[0] ** 2 / np.where(x[1] > 0, x[1] + self.l2, 1.0), 0.0)

    def grow(self, rows: DataFrame, since: int) -> list[Tree]:
        inner = 2**self.depth - 1
        trees = [Tree(np.zeros(inner, np.int64), np.full(inner, self.bins, np.int64), np.zeros(inner + 1)) for _ in range(self.k)]
        totals: list[dict] = [{} for _ in trees]
        for level in range(self.depth):
            self.split(self.sums(rows, since, trees, level), trees, level, totals)
        for c, tree in enumerate(trees):
            ends = [totals[c][inner + i] for i in range(inner + 1)]
            tree.values[:] = [-self.rate * g / (h + self.l2) if h > 0 else 0.0 for g, h in ends]
        return trees

    def refreshed(self, rows: DataFrame, since: int) -> DataFrame:
        """Rows whose scores hold all rounds so far."""
        model, width, k = self.model, self.width, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = model.add(_matrix(b.column("s"), k, float), _matrix(b.column("x"), width, np.int64), since)
                lists = pa.ListArray.from_arrays(np.arange(len(s) + 1, dtype=np.int32) * k, s.ravel())
                yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), lists], ["x", "y", "s"])

        return cut(rows.mapInArrow(run, rows.schema))


def fit(
    train: DataFrame, columns: list[str], label: str, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, least_rows: int = LEAST_ROWS, l2: float = L2, refresh: int = REFRESH
) -> Boosted:
    """`rounds` rounds of `depth` jobs each, and a stored table of small rows for every `refresh` of them."""
    known = train.filter(F.col(label).isNotNull())
    counts = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}  # a row for each class
    if not counts:
        raise ValueError("no labelled row")
    classes, n = sorted(counts), sum(counts.values())
    model = Boosted(list(columns), edges(known, columns, bins), classes, np.log(np.array([counts[c] / n for c in classes])))
    own = _Fit(model, bins, depth, rate, least_rows, l2)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = model.bins(np.array([[np.nan if v is None else v for v in r] for r in b.column("f").to_pylist()], float).reshape(b.num_rows, own.width))
            lists = lambda m: pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], m.ravel())
            y = np.searchsorted(classes, b.column("y").to_numpy())
            yield pa.RecordBatch.from_arrays([lists(x.astype(np.int16)), pa.array(y.astype(np.int32)), lists(np.tile(model.first, (len(x), 1)))], ["x", "y", "s"])

    rows = cut(known.select(_features(columns).alias("f"), F.col(label).cast("int").alias("y")).mapInArrow(start, "x array<smallint>, y int, s array<double>"))
    rows = rows.coalesce(max(1, -(-n // TASK_ROWS)))
    since = 0
    for r in range(rounds):
        model.rounds.append(own.grow(rows, since))
        if r + 1 < rounds and r + 1 - since >= refresh:
            rows, since = own.refreshed(rows, since), r + 1
    return model
