"""Declared constraints of tables, and the rows that break them (SNK-21).

Files have no constraints of their own, so they are declared here and looked at: what
must not be null, which values a column may hold, which columns are unique, and which
refer to another table. Nulls, values and sizes of a table take one pass over it;
uniqueness is a grouping, and a reference an anti join that AQE splits where a key is hot.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constraints:
    """Of one table: columns that are not null, unique sets of columns, references
    (column, table, column there), and conditions by name that hold where they are known."""

    required: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    refers: tuple[tuple[str, str, str], ...] = ()
    values: dict[str, str] = field(default_factory=dict)


PROFILE = "table string, rule string, what string, n_rows long, n_broken long"


def columns(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, place, type, n_rows, n_nulls) of every column, a pass a table."""
    out = []
    for name, rows in tables.items():
        nulls = [F.struct(F.lit(f.name).alias("column"), F.lit(n).alias("place"), F.lit(f.dataType.simpleString()).alias("type"),
            F.count_if(F.col(f"`{f.name}`").isNull()).alias("n_nulls")) for n, f in enumerate(rows.schema.fields, 1)]
        one = rows.agg(F.count("*").alias("n_rows"), F.array(*nulls).alias("c")) if nulls else rows.agg(F.count("*").alias("n_rows"), F.array().alias("c"))
        out.append(one.select(F.lit(name).alias("table"), "n_rows", F.explode("c").alias("c")).select("table", "c.column", "c.place", "c.type", "n_rows", "c.n_nulls"))
    return reduce(DataFrame.unionByName, out)


def profile(tables: dict[str, DataFrame], declared: dict[str, Constraints]) -> DataFrame:
    """(table, rule, what, n_rows, n_broken): each declared constraint and how many rows
    break it. A value that is null breaks only `not null`. Rows of a key that stands more
    than once are all broken; a reference is broken by rows whose value is not there."""
    out = []
    for name, c in declared.items():
        rows = tables[name]
        checks = [("not null", x, F.col(x).isNull()) for x in c.required] + [("values", x, ~F.coalesce(F.expr(s), F.lit(True))) for x, s in c.values.items()]
        found = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(what).alias("what"), F.count_if(bad).alias("n")) for rule, what, bad in checks])
        if checks:
            one = rows.agg(F.count("*").alias("n_rows"), found.alias("c")).select("n_rows", F.explode("c").alias("c"))
            out.append(one.select(F.lit(name).alias("table"), "c.rule", "c.what", "n_rows", F.col("c.n").alias("n_broken")))
        for keys in c.unique:
            known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
            each = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(known).alias("k"))
            broken = F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0))
            out.append(each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), broken.alias("n_broken")).select(F.lit(name).alias("table"), F.lit("unique").alias("rule"),
                F.lit(", ".join(keys)).alias("what"), "n_rows", "n_broken"))
        for column, other, there in c.refers:
            sizes = rows.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n"))  # before the join: a hot value is one row
            seen = tables[other].select(F.col(there).alias("k"), F.lit(True).alias("there")).distinct()
            joined = sizes.join(seen, "k", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                F.coalesce(F.sum(F.when(F.col("k").isNotNull() & F.col("there").isNull(), F.col("n"))), F.lit(0)).alias("n_broken"))
            out.append(joined.select(F.lit(name).alias("table"), F.lit("refers").alias("rule"), F.lit(f"{column} to {other}.{there}").alias("what"), "n_rows", "n_broken"))
    return reduce(DataFrame.unionByName, out)
