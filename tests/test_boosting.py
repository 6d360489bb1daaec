"""Boosted trees against a plain loop over rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilake.operators import boosting

NAMES = ["a", "b", "c"]


def made(n=160, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randrange(12), rng.random() * 4, rng.choice([0.0, 1.0])
        label = 0 if a < 4 else (1 if b < 2 else 2)
        rows.append((i, float(a), b if i % 17 else None, c, label if i % 11 else rng.randrange(3), i % 3))
    return rows


def plain(rows, folds, classes, s):
    """The same trees, row by row, in plain Python."""
    n_features = len(NAMES)
    x = [r[1 : 1 + n_features] for r in rows]
    label, fold = [r[4] for r in rows], [r[5] for r in rows]
    edges = []
    for j in range(n_features):
        v = sorted(r[j] for r in x if r[j] is not None)
        edges.append(sorted({v[max(math.ceil(i / s.bins * len(v)) - 1, 0)] for i in range(1, s.bins)}))
    bins = [[0 if r[j] is None else sum(e < r[j] for e in edges[j]) for j in range(n_features)] for r in x]
    out = [None] * len(rows)
    for f in range(folds):
        own = [i for i in range(len(rows)) if fold[i] != f]
        count = [sum(label[i] == c for i in own) for c in range(classes)]
        known = sum(n > 0 for n in count)
        w = [len(own) / (known * n) if n else 0.0 for n in count]
        for c, factor in s.boost:
            w[c] *= factor
        total = sum(w[c] * count[c] for c in range(classes))
        margin = [[math.log(max(w[c] * count[c] / total, 1e-12)) for c in range(classes)] for _ in rows]
        for _ in range(s.rounds):
            prob = [np.exp(np.array(m) - max(m)) for m in margin]
            prob = [e / e.sum() for e in prob]
            new = [list(m) for m in margin]
            for c in range(classes):
                g = {i: round(float(w[label[i]] * (prob[i][c] - (label[i] == c))) * boosting.UNIT) for i in own}
                h = {i: round(float(w[label[i]] * prob[i][c] * (1 - prob[i][c])) * boosting.UNIT) for i in own}
                score = lambda a, b: (a / boosting.UNIT) * (a / boosting.UNIT) / (b / boosting.UNIT + s.ridge)

                def grow(members, everyone, level, g=g, h=h, c=c, score=score, new=new):
                    ga, ha = sum(g[i] for i in members), sum(h[i] for i in members)
                    best = None
                    if level < s.depth:
                        for j in range(n_features):
                            for b in sorted({bins[i][j] for i in members}):
                                left = [i for i in members if bins[i][j] <= b]
                                if len(left) < s.least or len(members) - len(left) < s.least:
                                    continue
                                gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                                gain = score(gl, hl) + score(ga - gl, ha - hl) - score(ga, ha)
                                if best is None or (gain, -j, -b) > best[0]:
                                    best = ((gain, -j, -b), j, b)
                    if best is None or best[0][0] <= 1e-9:
                        for i in everyone:
                            new[i][c] += -s.rate * (ga / boosting.UNIT) / (ha / boosting.UNIT + s.ridge)
                        return
                    _, j, b = best
                    grow([i for i in members if bins[i][j] <= b], [i for i in everyone if bins[i][j] <= b], level + 1)
                    grow([i for i in members if bins[i][j] > b], [i for i in everyone if bins[i][j] > b], level + 1)

                grow(own, list(range(len(rows))), 0)
            margin = new
        for i in range(len(rows)):
            if fold[i] == f:
                e = np.exp(np.array(margin[i]) - max(margin[i]))
                out[i] = e / e.sum()
    return out


@pytest.mark.parametrize("settings", [boosting.Settings(rounds=4, depth=2, bins=8), boosting.Settings(rounds=3, depth=3, bins=16, boost=((2, 1.5),), least=3)])
def test_equal_to_plain_loop(spark, settings):
    rows = made()
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, label int, fold int").repartition(5)
    got = {r["id"]: r for r in boosting.out_of_fold(df, NAMES, 3, 3, settings).collect()}
    want = plain(rows, 3, 3, settings)
    assert len(got) == len(rows)
    for i, p in enumerate(want):
        assert np.allclose(got[i]["probabilities"], p, atol=1e-9) and got[i]["prediction"] == int(np.argmax(p))
    assert sum(got[i]["prediction"] == rows[i][4] for i in range(len(rows))) > 0.75 * len(rows)


def test_fitted_trees_predict_new_rows(spark):
    df = spark.createDataFrame(made(), "id int, a double, b double, c double, label int, fold int")
    s = boosting.Settings(rounds=3, depth=2, bins=8)
    forest, _ = boosting.fitted(df, NAMES, 3, 3, s)
    held = {r["id"]: r["probabilities"] for r in boosting.out_of_fold(df, NAMES, 3, 3, s).where("fold = 1").collect()}
    new = {r["id"]: r["probabilities"] for r in boosting.predicted(df.where("fold = 1"), NAMES, forest, 1, 3).collect()}
    assert new.keys() == held.keys() and all(np.allclose(new[i], held[i]) for i in new)


def test_odd_tables(spark):
    kind = "id int, a double, b double, c double, label int, fold int"
    s = boosting.Settings(rounds=2, depth=2, bins=4)
    assert boosting.out_of_fold(spark.createDataFrame([], kind), NAMES, 3, 3, s).collect() == []
    one = [(i, 1.0, None, 2.0, 0 if i else None, i % 3) for i in range(9)]  # one class, constant and null features, a null label
    got = boosting.out_of_fold(spark.createDataFrame(one, kind).withColumn("n", F.lit("clash")), NAMES, 3, 3, s).collect()
    assert len(got) == 8 and {r["prediction"] for r in got} == {0}
