"""Embedding near-duplicates by an inverted multi-index.

Each half of a unit vector has its own codebook; the pair of nearest codewords is
the vector's cell in the product grid. A query visits cells in ascending order of
a lower bound on their distance (multi-sequence traversal) until the bound passes
a radius that reaches the target recall, and the pairs met there are verified by
cosine in double precision, block by block, as matrix products.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.components import connected
from vigilake.session import cut

THRESHOLD = 0.95
TARGET_RECALL = 0.999
#: Vectors that the codebooks are fitted on, at most; every vector is indexed.
SAMPLE = 4_096
CODEWORDS = 256
PER_CELL = 50
#: Rows of a block's two sides; a cell with more is dealt to more blocks.
INDEX_BLOCK, QUERY_BLOCK = 1_024, 2_048


def usable(v: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(vectors) -> np.ndarray:
    """Rows of length 1, of even width; scaled first so that squares neither
    overflow nor vanish."""
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.pad(x, ((0, 0), (0, x.shape[1] % 2)))


def codebook(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """k-means from seeds spread evenly over the first principal order."""
    order = np.argsort(x @ np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][0], kind="stable")
    c = x[order[np.linspace(0, len(x) - 1, k).astype(int)]].copy()
    for _ in range(rounds):
        near = np.argmin((c**2).sum(axis=1) - 2 * x @ c.T, axis=1)
        for i in range(k):
            if (near == i).any():
                c[i] = x[near == i].mean(axis=0)
    return np.unique(c, axis=0)


@dataclass
class Grid:
    first: np.ndarray
    second: np.ndarray
    radius: float = 0.0  # squared

    def _half(self, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest codeword, and for each codeword the squared distance from x to
        the plane between it and the nearest: no point beyond it is closer."""
        d = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1), 0)
        near = np.argmin(d, axis=1)
        between = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(axis=2), 0))
        gap = d - d[np.arange(len(x)), near][:, None]
        bound = np.divide(gap, 2 * between[near], out=np.zeros_like(gap), where=between[near] > 0)
        return near, bound**2

    def locate(self, x: np.ndarray):
        h = x.shape[1] // 2
        (i, a), (j, b) = self._half(x[:, :h], self.first), self._half(x[:, h:], self.second)
        return i * len(self.second) + j, a, b

    def calibrate(self, x: np.ndarray, threshold: float, recall: float) -> None:
        """The radius at which `recall` of pairs exactly at the threshold (the
        hardest ones) meet, from the sample and random directions."""
        noise = np.random.default_rng(7).standard_normal(x.shape)
        noise -= (noise * x).sum(axis=1, keepdims=True) * x
        y = threshold * x + math.sqrt(1 - threshold**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
        (cx, ax, bx), (cy, ay, by) = self.locate(x), self.locate(y)
        n, rows = len(self.second), np.arange(len(x))
        reach = np.minimum(ax[rows, cy // n] + bx[rows, cy % n], ay[rows, cx // n] + by[rows, cx % n])
        self.radius = float(np.quantile(reach, recall)) * (1 + 1e-9) + 1e-12

    def visits(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Multi-sequence traversal: cells in ascending order of a[i] + b[j], up to the radius."""
        ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        out, seen, heap = [], {(0, 0)}, [(a[ia[0]] + b[ib[0]], 0, 0)]
        while heap:
            s, p, q = heapq.heappop(heap)
            if s > self.radius:
                break
            out.append(int(ia[p] * len(self.second) + ib[q]))
            for n in ((p + 1, q), (p, q + 1)):
                if n[0] < len(ia) and n[1] < len(ib) and n not in seen:
                    seen.add(n)
                    heapq.heappush(heap, (a[ia[n[0]]] + b[ib[n[1]]], *n))
        return out


def fit_grid(reps: DataFrame, n: int, threshold: float, recall: float) -> Grid:
    """Codebooks from at most SAMPLE vectors, the same ones each time."""
    order = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) / float(1 << 30)
    rows = reps.where(order < 0.9 * SAMPLE / n).select("rep", "v").orderBy("rep").limit(SAMPLE).collect()
    rows = rows or reps.select("rep", "v").orderBy("rep").limit(SAMPLE).collect()
    x = unit([r["v"] for r in rows])
    k, h = max(1, min(CODEWORDS, round(math.sqrt(n / PER_CELL)), len(x))), x.shape[1] // 2
    grid = Grid(codebook(x[:, :h], k), codebook(x[:, h:], k))
    grid.calibrate(x, threshold, recall)
    return grid


def located(reps: DataFrame, grid: Grid) -> DataFrame:
    """(rep, mult, v) with its cell and the cells that it visits."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, a, b = grid.locate(unit(batch["v"]))
                yield batch.assign(cell=cell.astype(np.int32), visits=[grid.visits(p, q) for p, q in zip(a, b, strict=True)])

    v = reps.schema["v"].dataType.simpleString()
    return reps.select("rep", "mult", "v").mapInPandas(place, f"rep long, mult long, v {v}, cell int, visits array<int>")


def block_links(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One block: rows that are stored in the cell against rows that visit it.

    Returns per vector the links found here, and the smallest vector of its
    component within the block. A pair that both sides could find is counted by
    each for itself; where only one side visits the other, it counts for both.
    """
    index, query = rows[rows["stored"]], rows[~rows["stored"]]
    if not len(index) or not len(query):
        return pd.DataFrame({"rep": [], "n": [], "root": []}).astype("int64")
    xi, qi = index["rep"].to_numpy(np.int64), query["rep"].to_numpy(np.int64)
    hits = unit(query["v"]) @ unit(index["v"]).T >= threshold
    hits &= qi[:, None] != xi[None]
    q, x = np.nonzero(hits)
    if not len(q):
        return pd.DataFrame({"rep": [], "n": [], "root": []}).astype("int64")
    n_q = hits @ index["mult"].to_numpy(np.float64)
    cells, at = np.unique(query["home"].to_numpy(), return_inverse=True)
    visited = np.array([np.isin(cells, v) for v in index["visits"]])  # stored row by query's own cell
    one_way = ~visited[x, at[q]]
    n_x = np.bincount(x[one_way], weights=query["mult"].to_numpy(np.float64)[q[one_way]], minlength=len(xi))
    of_q, of_x = qi.copy(), xi.copy()
    most = np.iinfo(np.int64).max
    while True:
        new_q = np.minimum(of_q, np.where(hits, of_x[None], most).min(axis=1))
        new_x = np.minimum(of_x, np.where(hits, new_q[:, None], most).min(axis=0))
        if (new_q == of_q).all() and (new_x == of_x).all():
            break
        of_q, of_x = new_q, new_x
    used_q, used_x = hits.any(axis=1), hits.any(axis=0)
    return pd.DataFrame({
        "rep": np.concatenate([qi[used_q], xi[used_x]]), "n": np.concatenate([n_q[used_q], n_x[used_x]]).astype(np.int64),
        "root": np.concatenate([of_q[used_q], of_x[used_x]]),
    })


def search(reps: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """(rep, mult, v) of distinct vectors of one width -> (rep, n, root) rows by block.

    Vectors are usable ones (no nulls, not zero), so there is nothing to leave out; a
    vector links with others only; fewer than two vectors give no rows."""
    n = reps.count()
    if n < 2:
        return reps.select("rep", F.lit(0).cast("long").alias("n"), F.col("rep").alias("root")).limit(0)
    placed = cut(located(reps, fit_grid(reps, n, threshold, recall)), "placed")
    stored = placed.groupBy("cell").agg(F.count("*").alias("n_stored"))
    asked = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("n_asked"))
    blocks = stored.join(asked, "cell").select("cell", F.ceil(F.col("n_stored") / INDEX_BLOCK).cast("int").alias("ni"),
        F.ceil(F.col("n_asked") / QUERY_BLOCK).cast("int").alias("nq"))
    blocks = F.broadcast(cut(blocks, "blocks"))  # a row per cell: CODEWORDS ** 2 at most
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["cell", "ib", "qb", F.col("home"), "stored", "rep", "mult", "v", "visits"]
    index = placed.withColumn("home", F.col("cell")).join(blocks, "cell").withColumn("ib", deal("ni")).withColumn("qb",
        each("nq")).withColumn("stored", F.lit(True))
    query = placed.select("rep", "mult", "v", F.col("cell").alias("home"), F.explode("visits").alias("cell"),
        F.array().cast("array<int>").alias("visits")).join(blocks, "cell")
    query = query.withColumn("qb", deal("nq")).withColumn("ib", each("ni")).withColumn("stored", F.lit(False))
    met = index.select(*columns).unionByName(query.select(*columns))
    return met.groupBy("cell", "ib", "qb").applyInPandas(lambda rows: block_links(rows, threshold), "rep long, n long, root long")


def dedup(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Equal vectors are searched once and counted as often as they have ids. Rows
    whose vector is null, empty or zero, or holds a null or non-finite component,
    and rows with a null id, have no links and are their own component. Vectors of
    different width never link. Rows repeated with the same id are one vector and
    are all returned. An empty table gives an empty result.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    good = rows.where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    reps = cut(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("mult")), "reps")
    widths = sorted(r[0] for r in reps.select(F.size("v")).distinct().collect())
    found = None
    for width in widths:
        part = search(reps.where(F.size("v") == width), threshold, recall)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = cut(found, "links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = connected(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = reps.select("rep", "mult", "v").join(counts, "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    known = cut(known.select("v", F.xxhash64("v").alias("h"), (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n"),
        F.coalesce("component", "rep").alias("c")), "known")
    asked = rows.withColumn("h", F.when(F.col("vec_id").isNotNull() & usable(F.col("v")), F.xxhash64("v"))).alias("r")
    joined = asked.join(known.alias("k"), (F.col("r.h") == F.col("k.h")) & (F.col("r.v") == F.col("k.v")), "left")
    component = F.coalesce("k.c", "r.vec_id")
    return joined.select("r.vec_id", F.coalesce("k.n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("r.vec_id") == component, F.lit(False)).alias("kept"))


#: All pairs, for tables small enough for that.
SQL = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v,
  b.v) >= {THRESHOLD}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, CAST((SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS BIGINT) AS n_links,
       least(e.vec_id, (SELECT min(b) FROM reach r WHERE r.a = e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, (SELECT min(b) FROM reach r WHERE r.a = e.vec_id)) AS kept
FROM embeddings e
"""
