"""Softmax boosting against a plain version, its probabilities, and its defined results."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import boosting


def _rows(n, seed=1):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        a, b = draw.uniform(-1, 1), draw.choice([0.0, 1.0, 2.0])
        out.append((a, None if i % 17 == 0 else b, (2 if a > 0.3 else 0) if b < 1.5 else 3))
    return out


def _plain(rows, edges, classes, rounds, depth, rate, least):
    """Exact greedy trees over the same bins, row by row; returns the scores."""
    bins = [[sum(e < v for e in edges[j]) if v is not None else 0 for j, v in enumerate(r[:2])] for r in rows]
    n = len(rows)
    first = [math.log(sum(r[2] == c for r in rows) / n) for c in classes]
    scores = [list(first) for _ in rows]

    def grow(ids, g, h, level):
        whole = sum(g[i] for i in ids) ** 2 / sum(h[i] for i in ids)
        best = (1e-12, None)
        if level < depth:
            for j in range(2):
                for b in range(len(edges[j]) + 1):
                    left, right = [i for i in ids if bins[i][j] <= b], [i for i in ids if bins[i][j] > b]
                    if min(len(left), len(right)) >= least and min(sum(h[i] for i in left), sum(h[i] for i in right)) >= 1e-3:
                        gain = sum(sum(g[i] for i in x) ** 2 / sum(h[i] for i in x) for x in (left, right)) - whole
                        if gain > best[0] + 1e-9:
                            best = (gain, (left, right))
        if best[1] is None:
            value = -rate * sum(g[i] for i in ids) / sum(h[i] for i in ids)
            return {i: value for i in ids}
        return grow(best[1][0], g, h, level + 1) | grow(best[1][1], g, h, level + 1)

    for _ in range(rounds):
        p = [[math.exp(x) / sum(math.exp(y) for y in s) for x in s] for s in scores]
        steps = []
        for k, c in enumerate(classes):
            steps.append(grow(list(range(n)), [p[i][k] - (rows[i][2] == c) for i in range(n)], [p[i][k] * (1 - p[i][k]) for i in range(n)], 0))
        for i in range(n):
            for k in range(len(classes)):
                scores[i][k] += steps[k][i]
    return scores


def test_boosting_like_a_plain_version(spark):
    rows = _rows(90)
    df = spark.createDataFrame(rows, "a double, b double, y int").repartition(3)
    model = boosting.fit(df, ["a", "b"], "y", rounds=5, depth=2, rate=0.3, bins=8, least_rows=5, refresh=2)
    assert model.classes == [0, 2, 3] and len(model.rounds) == 5
    x = np.array([[np.nan if v is None else v for v in r[:2]] for r in rows], float)
    got = model.add(np.tile(model.first, (len(x), 1)), model.bins(x))
    assert np.allclose(got, _plain(rows, model.edges, model.classes, 5, 2, 0.3, 5), atol=1e-9)


def test_probabilities_and_predictions(spark):
    df = spark.createDataFrame(_rows(200, 2), "a double, b double, y int")
    model = boosting.fit(df, ["a", "b"], "y", rounds=12, depth=3, rate=0.3)
    again = boosting.Boosted.from_json(model.to_json())
    out = again.transform(df).collect()
    assert all(len(r.probability) == 4 and abs(sum(r.probability) - 1) < 1e-12 and r.probability[1] == 0 for r in out)
    assert all(r.probability[int(r.prediction)] == max(r.probability) for r in out)
    assert sum(r.prediction == r.y for r in out) > 0.9 * len(out)
    assert [r.probability for r in model.transform(df).collect()] == [r.probability for r in out]


def test_fits_without_anything_to_cut(spark):
    df = spark.createDataFrame([(1.0, 5, "k"), (1.0, 5, "k"), (None, None, "k")], "a double, y int, other string")
    model = boosting.fit(df, ["a"], "y", rounds=2)
    assert model.transform(df).first().probability == [0, 0, 0, 0, 0, 1] and model.transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no labelled row"):
        boosting.fit(df.filter("y = 7"), ["a"], "y")
