"""Stratified folds of whole groups."""

import random

from pyspark.sql import functions as F

from vigilake.operators import dataset


def worst(rows, folds):
    """The greatest deviation of a class's share in a fold."""
    joined = rows.join(folds, "g")
    totals = {r["c"]: r["count"] for r in joined.groupBy("c").count().collect()}
    found = {(r["fold"], r["c"]): r["count"] for r in joined.groupBy("fold", "c").count().collect()}
    return max(abs(found.get((f, c), 0) / n - 0.2) for f in range(5) for c, n in totals.items())


def made(spark, groups, seed):
    """Few hot groups, many small ones, classes that keep together."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        main = rng.choice("aaabbc")
        for _ in range(rng.choice([1, 2, 3, 5, 8, 200 if g % 40 == 0 else 4])):
            rows.append((g, main if rng.random() < 0.8 else rng.choice("abc")))
    return spark.createDataFrame(rows, "g long, c string")


def test_folds_are_whole_and_even(spark, monkeypatch):
    rows = made(spark, 800, 1)
    by_hash = rows.select("g").distinct().withColumn("fold", F.pmod(F.xxhash64("g"), F.lit(5)).cast("int"))
    for most in (2_000, 300, 1):  # all placed one by one, some, none
        monkeypatch.setattr(dataset, "LARGE_GROUPS", most)
        folds = dataset.stratified_folds(rows.withColumn("main", F.lit("clash")), "g", "c")
        assert folds.select("g").distinct().count() == folds.count() == 800
        if most > 1:
            assert worst(rows, folds) < 0.5 * worst(rows, by_hash)


def test_folds_of_odd_tables(spark):
    assert dataset.stratified_folds(spark.createDataFrame([], "g long, c string"), "g", "c").collect() == []
    rows = spark.createDataFrame([("x", "a"), ("x", "a"), (None, "a"), ("y", None), ("z", "a")], "g string, c string")
    assert {r["g"] for r in dataset.stratified_folds(rows, "g", "c").collect()} == {"x", "z"}
