"""Which features a classifier can do without: ablation and backward elimination (AGG-30).

The classifier is the nearest class mean of scaled features, scored out of fold: a row
is held against means of the other folds only. Means and scales are sums by fold and
class, so they are known after one pass, and a row's distance to a class is a sum over
features. So one pass scores every feature set that a step asks about: each row counts
a hit for each set, and only the counts come back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.session import cut


@dataclass(frozen=True)
class Step:
    """One step of an elimination: the feature that went, and what the rest score."""

    removed: str | None
    kept: tuple[str, ...]
    score: float


def _gaps(rows: DataFrame, names: Sequence[str], classes: Sequence) -> DataFrame:
    """(label, gaps): of each row with a label and no null, for each class an array of the
    squared scaled distances to the class's mean, feature by feature. Classes that the
    other folds do not have are null."""
    known = rows.where("label IS NOT NULL AND fold IS NOT NULL")
    for n in names:
        known = known.where(F.col(n).isNotNull())
    known = cut(known.select("label", "fold", *[F.col(n).cast("double").alias(n) for n in names]), "rows")
    sums = [F.sum(n).alias(f"s_{n}") for n in names] + [F.sum(F.col(n) * F.col(n)).alias(f"q_{n}") for n in names]
    cells = known.groupBy("fold", "label").agg(F.count("*").alias("n"), *sums).collect()  # a row for each fold and class
    folds = sorted({r["fold"] for r in cells})
    out: Column = F.lit(None)
    for f in folds:
        others = [r for r in cells if r["fold"] != f]
        n = sum(r["n"] for r in others)
        scale = {x: max((sum(r[f"q_{x}"] for r in others) / n - (sum(r[f"s_{x}"] for r in others) / n) ** 2), 0.0) or 1.0 for x in names} if n else {}
        per = []
        for c in classes:
            own = [r for r in others if r["label"] == c]
            m = sum(r["n"] for r in own)
            mean = {x: sum(r[f"s_{x}"] for r in own) / m for x in names} if m else None
            per.append(F.array(*[(F.col(x) - mean[x]) * (F.col(x) - mean[x]) / scale[x] for x in names]) if mean else F.lit(None).cast("array<double>"))
        out = F.when(F.col("fold") == f, F.array(*per)).otherwise(out)
    return cut(known.select("label", out.alias("gaps")), "gaps") if folds else known.select("label", F.lit(None).cast("array<array<double>>").alias("gaps"))


def _scores(gaps: DataFrame, names: Sequence[str], classes: Sequence, sets: Sequence[tuple[str, ...]]) -> list[float]:
    """The share of rows whose nearest class is their own, for each set of features; a tie
    goes to the first class. One pass for all sets."""

    def hit(kept: tuple[str, ...]) -> Column:
        places = [names.index(x) for x in kept]
        total = lambda g: F.when(g.isNotNull(), sum((F.get(g, F.lit(i)) for i in places), F.lit(0.0)))
        away = F.transform("gaps", total)
        nearest = F.array_position(away, F.array_min(away))
        return F.count_if(F.get(F.array(*map(F.lit, classes)), (nearest - 1).cast("int")) == F.col("label"))

    found = gaps.agg(F.count("*").alias("n"), F.array(*[hit(s) for s in sets]).alias("hits")).first()
    return [h / found["n"] if found["n"] else 0.0 for h in found["hits"]]


def ablation(rows: DataFrame, names: Sequence[str]) -> dict[str | None, float]:
    """The score of all features (under None), and of all but each. `rows` have the
    features, `label` and `fold`; rows with a null in any of them are left out."""
    classes = [r[0] for r in rows.where("label IS NOT NULL").select("label").distinct().orderBy("label").collect()]  # a row per class
    sets = [tuple(names), *[tuple(x for x in names if x != n) for n in names]]
    found = _scores(_gaps(rows, names, classes), list(names), classes, sets)
    return dict(zip([None, *names], found, strict=True))


def eliminated(rows: DataFrame, names: Sequence[str], least: int = 1, tolerance: float = 0.0) -> list[Step]:
    """Backward elimination: the path from all features down. Each step drops the feature
    without which the others score best (a tie: the first in order), as long as they do
    not score lower than the best so far by more than `tolerance`, and more than `least`
    are left."""
    classes = [r[0] for r in rows.where("label IS NOT NULL").select("label").distinct().orderBy("label").collect()]  # a row per class
    gaps, kept = _gaps(rows, names, classes), tuple(names)
    path = [Step(None, kept, _scores(gaps, list(names), classes, [kept])[0])]
    while len(kept) > least:
        sets = [tuple(x for x in kept if x != n) for n in kept]
        found = _scores(gaps, list(names), classes, sets)
        best = found.index(max(found))
        if found[best] < max(s.score for s in path) - tolerance:
            break
        path.append(Step(kept[best], sets[best], found[best]))
        kept = sets[best]
    return path
