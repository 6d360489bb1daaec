"""Ablation, elimination and constraint profiles against plain loops."""

import random

from pyspark.sql import functions as F

from vigilake.operators import selection
from vigilake.operators.profile import Constraints, columns, profile

NAMES = ["a", "b", "noise", "c"]


def made(n=300):
    rng = random.Random(8)
    out = []
    for i in range(n):
        label = rng.choice("xyz")
        at = "xyz".index(label)
        out.append((at + rng.random() * 1.5, 2.0 * at + rng.random() * 3 if i % 29 else None, rng.random() * 40, float(rng.randrange(3)), label if i % 31 else None, i % 4))
    return out


def plain_score(rows, kept):
    rows = [r for r in rows if None not in r]
    hits = 0
    for f in {r[5] for r in rows}:
        train = [r for r in rows if r[5] != f]
        scale, mean = {}, {}
        for j, _ in enumerate(NAMES):
            v = [r[j] for r in train]
            scale[j] = max(sum(x * x for x in v) / len(v) - (sum(v) / len(v)) ** 2, 0.0) or 1.0
            for c in "xyz":
                own = [r[j] for r in train if r[4] == c]
                mean[c, j] = sum(own) / len(own)
        for r in rows:
            if r[5] == f:
                away = [sum((r[j] - mean[c, j]) ** 2 / scale[j] for j, n in enumerate(NAMES) if n in kept) for c in "xyz"]
                hits += "xyz"[away.index(min(away))] == r[4]
    return hits / len(rows)


def test_elimination_equals_plain_loop(spark):
    rows = made()
    df = spark.createDataFrame(rows, "a double, b double, noise double, c double, label string, fold int").repartition(3)
    kept = tuple(NAMES)
    want = [(None, kept, plain_score(rows, kept))]
    while len(kept) > 1:
        tries = [(plain_score(rows, [x for x in kept if x != n]), -i, n) for i, n in enumerate(kept)]
        score, _, gone = max(tries)
        if score < max(s for _, _, s in want):
            break
        kept = tuple(x for x in kept if x != gone)
        want.append((gone, kept, score))
    got = [(s.removed, s.kept, s.score) for s in selection.eliminated(df, NAMES)]
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 1e-12 for g, w in zip(got, want, strict=True))
    assert got[1][0] in ("noise", "c") and len(got) > 1
    found = selection.ablation(df, NAMES)
    assert all(abs(found[n] - plain_score(rows, [x for x in NAMES if x != n])) < 1e-12 for n in [None, *NAMES])


def test_elimination_of_odd_tables(spark):
    kind = "a double, b double, noise double, c double, label string, fold int"
    assert [s.score for s in selection.eliminated(spark.createDataFrame([], kind), NAMES)][0] == 0.0
    one = [(1.0, 1.0, 1.0, 1.0, "x", i % 2) for i in range(6)]
    assert selection.eliminated(spark.createDataFrame(one, kind), NAMES, least=2)[-1].score == 1.0


def test_profile_finds_what_is_spoiled(spark):
    parents = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long")
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 9), (None, "c", None), (3, "a", None)], "id long, name string, parent long")
    declared = {"t": Constraints(("id", "name"), (("id",), ("id", "name")), (("parent", "p", "id"),), {"short": "name < 'c'"}), "p": Constraints(unique=(("id",),))}
    got = {(r["table"], r["rule"], r["what"]): (r["n_rows"], r["n_broken"]) for r in profile({"t": rows, "p": parents}, declared).collect()}
    assert got == {("t", "not null", "id"): (5, 1), ("t", "not null", "name"): (5, 1), ("t", "values", "short"): (5, 1), ("t", "unique", "id"): (5, 2), ("t", "unique", "id, name"): (5, 0),
        ("t", "refers", "parent to p.id"): (5, 1), ("p", "unique", "id"): (4, 2)}
    empty = profile({"t": rows.where("false"), "p": parents.where("false")}, declared).collect()
    assert len(empty) == 7 and all(r["n_rows"] == r["n_broken"] == 0 for r in empty)
    assert {(r["column"], r["n_nulls"]) for r in columns({"t": rows.withColumn("a.b", F.lit(None))}).collect()} == {("id", 1), ("name", 1), ("parent", 2), ("a.b", 5)}
