"""Merge semantics: what a table holds after a batch, as DataFrames.

Each function gives the whole new table; a file table has one writer, which writes
it to a new path and swaps. Stored and incoming rows are brought together by a
union and one pre-aggregated groupBy on the key, never by row-at-a-time updates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_ignore(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `incoming` whose key is new, one for each key: the least by its other
    columns in their order (SNK-01/02/15/18)."""
    new = incoming.join(stored.select(*keys).distinct(), keys, "left_anti")
    rest = [c for c in incoming.columns if c not in keys]
    if not rest:
        return new.distinct()
    return new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_one")).select(*[F.col(c) if c in keys else F.col(f"_one.{c}").alias(c) for c in incoming.columns])


def conflicts(incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys with more than one distinct value in a batch (SRC-05, SNK-03)."""
    return incoming.groupBy(*keys).agg(F.count_distinct(F.struct(*values)).alias("n_values")).where("n_values > 1")


def newest(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """For each key the whole row that is greatest by `order` (ends with a unique
    column): one pre-aggregated max of a struct, no sort (SET-03, SNK-04/07)."""
    rest = [c for c in rows.columns if c not in keys]
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    ranked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*columns)).alias("_top"))
    return ranked.select(*keys, *[F.col(f"_top.{c}").alias(c) for c in rest])


def merge_monotonic(stored: DataFrame, incoming: DataFrame, keys: list[str], clock: str) -> DataFrame:
    """Incoming replaces stored where its clock is not older (SNK-03, STR-08)."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return newest(both, keys, [clock, "_new"]).drop("_new")


def merge_observations(stored: DataFrame, incoming: DataFrame, keys: list[str], first: str, last: str, tie: str) -> DataFrame:
    """The newest row by (last, tie) wins; first is the least, last the greatest
    (SNK-08, ER-10)."""
    both = stored.unionByName(incoming)
    top = newest(both, keys, [last, F.col(tie).cast("string")]).drop(first)
    return top.join(both.groupBy(*keys).agg(F.min(first).alias(first)), keys)


def changed(old: Column, new: Column) -> Column:
    """IS DISTINCT FROM (FLT-06)."""
    return ~old.eqNullSafe(new)


def diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """insert / update / delete / unchanged by a full outer join (JOIN-08, SNK-19)."""
    a = old.select(*keys, F.struct(*values).alias("_old"))
    b = new.select(*keys, F.struct(*values).alias("_new"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(changed(F.col("_old"), F.col("_new")),
        "update").otherwise("unchanged")
    return a.join(b, keys, "full").select(*keys, action.alias("action"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows replaced by incoming ones of the same key (SNK-13); a batch that holds
    a key with different contents is refused for that key, which stays as it was."""
    rest = [c for c in stored.columns if c not in keys]
    new = incoming.groupBy(*keys).agg(F.count_distinct(F.struct(*rest)).alias("_n"), F.min(F.struct(*rest)).alias("_new"))
    both = stored.select(*keys, F.struct(*rest).alias("_old")).join(new, keys, "full")
    chosen = F.when(F.col("_n") == 1, F.col("_new")).otherwise(F.col("_old"))
    return both.select(*keys, chosen.alias("_x")).where("_x IS NOT NULL").select(*keys, "_x.*")
