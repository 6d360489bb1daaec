"""Running sums, ranks and exact quantiles without a window over all rows.

Rows are range-partitioned by the order, each partition sums itself, and the sums of
the partitions before (a row per partition) are added: no task holds the whole order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.session import cut


def running(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """`rows` with, for each `name: column` of `sums`, the column's sum over the rows
    before. `order` must end with a unique column; nulls come first."""
    placed = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "placed")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    offsets = totals.select("_part", *[zero(F.sum(f"_{name}").over(before)).alias(f"_{name}") for name in sums])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.select("*", *[zero(F.sum(c).over(own)).alias(name) for name, c in sums.items()])
    joined = summed.join(F.broadcast(offsets), "_part")
    return joined.select(*rows.columns, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in sums])


def quantiles(rows: DataFrame, key: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """(key, n, and a column for each of `wanted`): exact quantiles of each key's values,
    linear between neighbours. Works on the counts of distinct values, so a hot key is
    spread over many tasks. Null values are left out; a null key is a key of its own."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("x")).agg(F.count("*").alias("m"))
    placed = cut(running(counts, ["k", "x"], {"before": "m"}), "ranked")
    groups = placed.groupBy("k").agg(F.min("before").alias("base"), F.sum("m").alias("n")).withColumnRenamed("k", "g")
    joined = placed.join(groups, F.col("k").eqNullSafe(F.col("g")))
    first = F.col("before") - F.col("base")
    holds = lambda rank: (first <= rank) & (rank < first + F.col("m"))
    place = {name: (F.col("n") - 1) * F.lit(p) for name, p in wanted.items()}
    ends = [F.max(F.when(holds(f(p)), F.col("x"))).alias(f"{name}_{end}") for name, p in place.items() for end, f in (("lo", F.floor), ("hi", F.ceil))]
    found = joined.groupBy(F.col("k").alias(key), "n").agg(*ends)
    between = lambda name, p: F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (p - F.floor(p))
    return found.select(key, "n", *[between(name, p).alias(name) for name, p in place.items()])
