"""Gradient-boosted trees for several classes, all folds side by side (DS-06).

Features are binned once. A round grows a tree for each (fold, class) level by level:
tasks add up gradients and curvatures of their rows by (tree, node, feature, bin), Spark
sums these histograms and finds each node's best split with a window over its bins, and
the driver sees one row for each node, never rows of the table. Sums are taken in
integers, so neither partitions nor retries change a tree. Margins of a round are
written to the shared folder before the next.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.session import cut, ship

#: Gradients are added up as integers of this unit.
UNIT = 1 << 30


@dataclass(frozen=True)
class Settings:
    """Rounds, depth and bins of the trees; shrinkage, ridge on leaves, the rows that a
    leaf must have; factors on the balanced weights of single classes."""

    rounds: int = 12
    depth: int = 3
    bins: int = 32
    rate: float = 0.3
    ridge: float = 1.0
    least: int = 5
    boost: tuple[tuple[int, float], ...] = ()


@dataclass
class Forest:
    """Trees of each round as arrays (tree, node): feature or -1 at a leaf, the last bin
    that goes left, the value of a leaf. Tree f * classes + c is of fold f and class c."""

    edges: list[list[float]]
    base: np.ndarray
    rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def edges_of(rows: DataFrame, names: Sequence[str], bins: int) -> list[list[float]]:
    """Distinct quantiles of each feature, in one pass; a value above n of them is in bin n."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(n).cast("double"), shares, 100_000).alias(f"q{i}") for i, n in enumerate(names)]).first()
    return [sorted(set(found[f"q{i}"] or [])) for i in range(len(names))]


def binned(rows: DataFrame, names: Sequence[str], edges: list[list[float]]) -> DataFrame:
    """`rows` with `binned_`, the bins of the features; a null goes with the smallest."""
    at = lambda n, e: F.coalesce(F.size(F.filter(F.array(*map(F.lit, e)), lambda x: x < F.col(n).cast("double"))), F.lit(0)) if e else F.lit(0)
    return rows.withColumn("binned_", F.array(*[at(n, e) for n, e in zip(names, edges, strict=True)]))


def weights_of(rows: DataFrame, folds: int, classes: int, boost: tuple[tuple[int, float], ...]) -> tuple[np.ndarray, np.ndarray]:
    """(fold, class) weights n / (k n_c) of the rows outside each fold, and the log of each
    class's weighted share. A class that a fold never sees weighs nothing."""
    counts = np.zeros((folds, classes))
    for r in rows.groupBy("fold", "label").count().collect():  # a row for each fold and class
        counts[r["fold"], r["label"]] = r["count"]
    seen = counts.sum(axis=0) - counts
    k = np.maximum((seen > 0).sum(axis=1, keepdims=True), 1)
    weights = np.divide(seen.sum(axis=1, keepdims=True), k * seen, out=np.zeros_like(seen), where=seen > 0)
    for label, factor in boost:
        weights[:, label] *= factor
    total = np.maximum((weights * seen).sum(axis=1, keepdims=True), 1e-12)
    return weights, np.log(np.maximum(weights * seen / total, 1e-12))


def walk(bins: np.ndarray, feature: np.ndarray, last: np.ndarray, depth: int) -> np.ndarray:
    """The node of one tree that each row is in after some levels."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        f = feature[node]
        node = np.where(f < 0, node, 2 * node + 1 + (bins[rows, f] > last[node]))
    return node


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _columns(batch: pd.DataFrame, folds: int, classes: int) -> tuple[np.ndarray, ...]:
    bins, margins = np.stack(batch["binned_"].to_numpy()), np.stack(batch["margins_"].to_numpy())
    return bins, batch["label"].to_numpy(), batch["fold"].to_numpy(), margins.reshape(-1, folds, classes)


def _level(rows: DataFrame, trees: tuple, level: int, weights: np.ndarray, n_bins: int, settings: Settings) -> list:
    """The best split of each node of a level: one row for each node with rows."""
    folds, classes = weights.shape
    shared = rows.sparkSession.sparkContext.broadcast((trees, weights))
    first, nodes = 2**level - 1, 2**level

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (feature, last, _), w = shared.value
        sums = None
        for batch in batches:
            bins, label, fold, margins = _columns(batch, folds, classes)
            if sums is None:
                sums = np.zeros((3, folds * classes, nodes, bins.shape[1], n_bins), np.int64)
            p = softmax(margins)
            for f in range(folds):
                own = fold != f
                weight = w[f, label[own]]
                for c in range(classes):
                    t = f * classes + c
                    node = walk(bins[own], feature[t], last[t], level) - first
                    here = (node >= 0) & (node < nodes) & (weight > 0)
                    g = weight * (p[own, f, c] - (label[own] == c))
                    h = weight * p[own, f, c] * (1 - p[own, f, c])
                    # One count over (node, feature, bin); exact, as a batch's sums stay below 2 ** 53.
                    at = ((node[here, None] * bins.shape[1] + np.arange(bins.shape[1])) * n_bins + bins[own][here]).reshape(-1)
                    for k, values in enumerate((np.rint(g[here] * UNIT), np.rint(h[here] * UNIT), np.ones(len(node[here])))):
                        found = np.bincount(at, np.repeat(values, bins.shape[1]), nodes * bins.shape[1] * n_bins)
                        sums[k, t] += found.reshape(sums.shape[2:]).astype(np.int64)
        if sums is not None:
            t, node, j, b = np.nonzero(sums[2])
            g, h, n = sums[:, t, node, j, b]
            yield pd.DataFrame({"tree": t, "node": node + first, "feature": j, "bin": b, "g": g, "h": h, "n": n})

    parts = rows.select("binned_", "label", "fold", "margins_").mapInPandas(add, "tree int, node int, feature int, bin int, g long, h long, n long")
    bins = parts.groupBy("tree", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    of = Window.partitionBy("tree", "node", "feature")  # bins of one feature: at most settings.bins rows
    upto = {c: F.sum(c).over(of.orderBy("bin")).alias(f"{c}_left") for c in "ghn"}
    each = bins.select("tree", "node", "feature", "bin", *upto.values(), *[F.sum(c).over(of).alias(f"{c}_all") for c in "ghn"])
    score = lambda g, h: (g / UNIT) * (g / UNIT) / (h / UNIT + settings.ridge)
    left = score(F.col("g_left"), F.col("h_left"))
    right = score(F.col("g_all") - F.col("g_left"), F.col("h_all") - F.col("h_left"))
    fits = (F.col("n_left") >= settings.least) & (F.col("n_all") - F.col("n_left") >= settings.least)
    gain = F.when(fits, left + right - score(F.col("g_all"), F.col("h_all")))
    order = F.struct(F.coalesce(gain, F.lit(-1.0)).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    best = each.groupBy("tree", "node").agg(F.max_by(F.struct("feature", "bin", "g_left", "h_left", "g_all", "h_all", gain.alias("gain")), order).alias("s"))
    return best.select("tree", "node", "s.*").collect()


def _grown(rows: DataFrame, weights: np.ndarray, n_bins: int, settings: Settings) -> tuple:
    """The trees of one round."""
    n, size = weights.size, 2 ** (settings.depth + 1) - 1
    trees = (np.full((n, size), -1), np.zeros((n, size), np.int64), np.zeros((n, size)))
    feature, last, value = trees
    leaf = lambda g, h: -settings.rate * (g / UNIT) / (h / UNIT + settings.ridge)
    for level in range(settings.depth):
        for r in _level(rows, trees, level, weights, n_bins, settings):
            t, node = r["tree"], r["node"]
            value[t, node] = leaf(r["g_all"], r["h_all"])
            if r["gain"] is not None and r["gain"] > 1e-9:
                feature[t, node], last[t, node] = r["feature"], r["bin"]
                value[t, 2 * node + 1] = leaf(r["g_left"], r["h_left"])
                value[t, 2 * node + 2] = leaf(r["g_all"] - r["g_left"], r["h_all"] - r["h_left"])
    return trees


def _moved(rows: DataFrame, trees: tuple, folds: int, classes: int, depth: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("array<double>")
    def move(bins: pd.Series, margins: pd.Series) -> pd.Series:
        feature, last, value = shared.value
        if not len(bins):
            return margins
        b, m = np.stack(bins.to_numpy()), np.stack(margins.to_numpy()).copy()
        for t in range(folds * classes):
            m[:, t] += value[t, walk(b, feature[t], last[t], depth)]
        return pd.Series(list(m))

    return rows.withColumn("margins_", move("binned_", "margins_"))


def fitted(rows: DataFrame, names: Sequence[str], folds: int, classes: int, settings: Settings = Settings()) -> tuple[Forest, DataFrame]:
    """Trees of every fold, each fitted without the rows of its fold, and `rows` with
    `margins_` of all folds. `rows` have the features, `label` (0 to classes - 1) and
    `fold` (0 to folds - 1); rows with a null in either are left out."""
    ship(rows.sparkSession)
    kept = rows.where("label IS NOT NULL AND fold IS NOT NULL")
    edges = edges_of(kept, names, settings.bins)
    weights, base = weights_of(kept, folds, classes, settings.boost)
    start = F.array(*[F.lit(float(x)) for x in base.reshape(-1)])
    state = cut(binned(kept, names, edges).withColumn("margins_", start), "boosted")
    forest = Forest(edges, base, [])
    for _ in range(settings.rounds):
        trees = _grown(state, weights, settings.bins, settings)
        forest.rounds.append(trees)
        state = cut(_moved(state, trees, folds, classes, settings.depth), "boosted")
    return forest, state


def _probabilities(margins, first, classes: int):
    own = F.slice(margins, first, classes)
    top = F.array_max(own)
    e = F.transform(own, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def out_of_fold(rows: DataFrame, names: Sequence[str], folds: int, classes: int, settings: Settings = Settings()) -> DataFrame:
    """`rows` with `probabilities` and `prediction` by the trees that were fitted without
    the row's fold. Ties go to the smaller class; an empty table gives an empty result."""
    _, state = fitted(rows, names, folds, classes, settings)
    p = _probabilities(F.col("margins_"), F.col("fold") * classes + 1, classes)
    done = state.withColumn("probabilities", p).drop("binned_", "margins_")
    return done.withColumn("prediction", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int"))


def predicted(rows: DataFrame, names: Sequence[str], forest: Forest, fold: int, classes: int) -> DataFrame:
    """`rows` with `probabilities` and `prediction` by the trees of one fold."""
    folds, depth = len(forest.base), 0
    start = F.array(*[F.lit(float(x)) for x in forest.base.reshape(-1)])
    state = binned(rows, names, forest.edges).withColumn("margins_", start)
    for trees in forest.rounds:
        depth = (trees[0].shape[1] + 1).bit_length() - 2
        state = _moved(state, trees, folds, classes, depth)
    state = state.withColumn("probabilities", _probabilities(F.col("margins_"), F.lit(fold * classes + 1), classes)).drop("binned_", "margins_")
    return state.withColumn("prediction", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int"))
