"""Centroid clustering of integer vectors by annulus search.

For a vector x and any centroid c, | |x| - |c| | is at most the distance of x and c.
So with an upper bound on the distance to the nearest centroid, only centroids whose
norm lies within that bound of the vector's own norm (an annulus around the origin)
can be nearest. The centroids are sorted by norm; the bound is the exact distance to
the centroids next to the vector's norm; both ends of the annulus are found by binary
search; and the candidates in it, those on its edge included, are compared exactly
in integers. The bound is taken anew in every round: carrying each vector's last
centroid would tighten it, but means to write all vectors once a round.

A round is one pass over the vectors. Each task adds up its vectors by centroid and
returns a row for each centroid, Spark sums those, and only k sums reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.session import cut, ship

K, ROUNDS, WIDTH, SCALE, SEED = 40, 5, 64, 256, "2:"
#: Components are held within this, so that a squared distance of 64 of them fits a long.
LARGEST = (1 << 27) - 1
MOST = (1 << 63) - 1


def usable(v: Column, width: int) -> Column:
    """Of exactly `width` components, none null or non-finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) == width) & finite, F.lit(False))


def whole(v: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as a double."""
    held = lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(LARGEST).cast("long")), F.lit(-LARGEST).cast("long"))
    return F.transform(v, held)


class Annulus:
    """Centroids sorted by norm, for exact nearest-centroid search."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, np.int64)
        norms = np.sqrt((self.centroids.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.order], self.centroids[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid (the smaller one at a tie) and squared distance
        of each row of integers, and how many distances that took."""
        k, norms = len(self.norms), np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        at = np.searchsorted(self.norms, norms)
        best = np.full(len(x), MOST, np.int64)
        for beside in (np.clip(at - 1, 0, k - 1), np.clip(at, 0, k - 1)):
            best = np.minimum(best, ((x - self.sorted[beside]) ** 2).sum(axis=1))
        # Rounding of the roots must not close the annulus: the slack only adds candidates.
        reach = np.sqrt(best.astype(np.float64)) * (1 + 1e-9) + norms * 1e-9 + 1e-6
        low, high = np.searchsorted(self.norms, norms - reach, "left"), np.searchsorted(self.norms, norms + reach, "right")
        chosen, taken = np.full(len(x), k, np.int64), 0
        for place, number in enumerate(self.order):
            rows = np.flatnonzero((low <= place) & (place < high))
            d = ((x[rows] - self.sorted[place]) ** 2).sum(axis=1)
            better = (d < best[rows]) | ((d == best[rows]) & (number < chosen[rows]))
            best[rows[better]], chosen[rows[better]] = d[better], number
            taken += len(rows)
        return chosen, best, taken


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.int64)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> list:
    """Of each non-empty cluster (number, count, componentwise sums), exactly."""
    shared, width = vectors.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search, counts, sums = Annulus(shared.value), np.zeros(len(shared.value), np.int64), np.zeros(shared.value.shape, np.int64)
        for batch in batches:
            x = _matrix(batch["q"])
            cluster = search.nearest(x)[0]
            counts += np.bincount(cluster, minlength=len(counts))
            np.add.at(sums, cluster, x)
        used = np.flatnonzero(counts)
        if len(used):
            yield pd.DataFrame({"cluster": used.astype(np.int32), "n": counts[used], "s": list(sums[used])})

    wide = "decimal(38,0)"
    total = [F.sum(F.get("s", F.lit(i)).cast(wide)).alias(f"s{i}") for i in range(width)]
    parts = vectors.select("q").mapInPandas(add, "cluster int, n long, s array<long>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect()  # k rows


def seeds(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes; equal ids by their components."""
    h = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(h.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64)


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> np.ndarray:
    """Centroids after some rounds over (vec_id, q). With fewer vectors than k there is
    a centroid for each; without any there is none. Empty clusters keep their centroid."""
    centroids = seeds(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for row in _sums(vectors, centroids):
            moved[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(centroids.shape[1])]
        centroids = moved
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, q) -> (vec_id, cluster, distance) by annulus search."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Annulus(shared.value)
        for batch in batches:
            if len(batch):
                cluster, distance, _ = search.nearest(_matrix(batch["q"]))
                yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": cluster.astype(np.int32), "distance": distance})

    kind = vectors.schema["vec_id"].dataType.simpleString()
    # Ids pass as text: a null among them would turn a batch of long ids into floats.
    rows = vectors.select(F.col("vec_id").cast("string").alias("vec_id"), "q").mapInPandas(near, "vec_id string, cluster int, distance long")
    return rows.withColumn("vec_id", F.col("vec_id").cast(kind))


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another width, or hold a null or non-finite component are
    left out. Repeated rows and equal vectors each count and are all returned; rows with
    a null id are clustered but become seeds only after all others. Ties go to the
    smaller centroid. Components beyond +-(2**27 - 1) after scaling are held there, and
    inertias beyond a long at its largest value. Fewer vectors than k give as many
    centroids; an empty table gives an empty result. Other columns are not read.
    """
    ship(embeddings.sparkSession)
    own = embeddings.select("vec_id", F.col("embedding").alias("v")).where(usable(F.col("v"), width))
    vectors = cut(own.select("vec_id", whole(F.col("v"), scale).alias("q")), "vectors")
    centroids = fit(vectors, k, rounds, seed)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.lit("").alias("centroid_sha256")).limit(0)
    placed = cut(assign(vectors, centroids), "placed")
    sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    of_cluster = [min(sums.get(i, 0), MOST) for i in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    get = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    return placed.select("vec_id", "cluster", "distance", get(of_cluster).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), MOST)).cast("long").alias("inertia"), get(digests).alias("centroid_sha256"))


def sql(k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = SEED) -> str:
    """The same by comparing every vector with every centroid."""
    d = f"list_sum(list_transform(range(1, {width + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    near = f"SELECT row, vec_id, q, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.row, v.vec_id, v.q, c.c, {d} AS d FROM v, c{{n}} c) GROUP BY ALL"
    steps = []
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({near.format(n=n)})")
        steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{n} c LEFT JOIN (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM (
    SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range({width})) AS i FROM a{n}) GROUP BY c, i) GROUP BY c) m ON m.c = c.c)""")
    return f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: greatest(least(CAST(floor({scale} * CAST(x AS DOUBLE)) AS HUGEINT), {LARGEST}),
    -{LARGEST})::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT c, q FROM (SELECT q, row_number() OVER (ORDER BY sha256('{seed}' || vec_id) NULLS LAST, q) - 1 AS c FROM v) WHERE c < {k}),
{", ".join(steps)},
last AS MATERIALIZED ({near.format(n=rounds)})
SELECT vec_id, CAST(l.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY l.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM last l JOIN c{rounds} c ON c.c = l.c"""
