"""The data dictionary: columns, sizes, nulls and declared constraints of all tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators.profile import Constraints, columns, profile
from vigilake.plans.base import query
from vigilake.session import table

#: What is declared of each table; conditions read the same in Spark and in SQL.
DECLARED = {
    "region": Constraints(("r_regionkey", "r_name"), (("r_regionkey",), ("r_name",))),
    "nation": Constraints(("n_nationkey", "n_regionkey"), (("n_nationkey",),), (("n_regionkey", "region", "r_regionkey"),)),
    "customer": Constraints(("c_custkey", "c_name"), (("c_custkey",), ("c_name",)), (("c_nationkey", "nation", "n_nationkey"),)),
    "supplier": Constraints(("s_suppkey",), (("s_suppkey",),), (("s_nationkey", "nation", "n_nationkey"),), {"balance": "s_acctbal >= 0"}),
    "part": Constraints(("p_partkey", "p_name"), (("p_partkey",), ("p_name", "p_brand")), (), {"size": "p_size BETWEEN 1 AND 50"}),
    "orders": Constraints(("o_orderkey", "o_custkey", "o_orderdate"), (("o_orderkey",),), (("o_custkey", "customer", "c_custkey"),), {"status": "o_orderstatus IN ('F', 'O')"}),
    "lineitem": Constraints(("l_orderkey", "l_partkey", "l_suppkey"), (("l_orderkey", "l_linenumber"),), (("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"),
        ("l_suppkey", "supplier", "s_suppkey")), {"quantity": "l_quantity BETWEEN 1 AND 49", "discount": "l_discount >= 0"}),
    "events": Constraints(("event_id", "ts", "props"), (("event_id",), ("ts",)), (("user_id", "customer", "c_custkey"),), {"value": "value >= 1"}),
    "documents": Constraints(("doc_id", "text", "source"), (("doc_id",), ("text",)), (), {"n_chars": "n_chars = length(text)"}),
    "embeddings": Constraints(("vec_id", "embedding"), (("vec_id",),)),
    "pages": Constraints(("page_id", "url"), (("page_id",), ("url",))),
    "benchmark": Constraints(("item_id", "text"), (("item_id",),)),
    "labels": Constraints(("doc_id", "quality", "toxic"), (("doc_id",),), (("doc_id", "documents", "doc_id"),), {"toxic": "toxic IN (0, 1)"}),
    "conversations": Constraints(("conv_id", "turn"), (("conv_id", "turn"),), (), {"role": "role IN ('user', 'assistant')"}),
}


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in DECLARED}


def _profile_sql() -> str:
    out = []
    for name, c in DECLARED.items():
        row = f"SELECT '{name}' AS \"table\", '{{}}' AS rule, '{{}}' AS what, CAST(count(*) AS BIGINT) AS n_rows, CAST({{}} AS BIGINT) AS n_broken FROM {name}"
        out += [row.format("not null", x, f"count(*) FILTER ({x} IS NULL)") for x in c.required]
        out += [row.format("values", x, f"count(*) FILTER (NOT ({s}))") for x, s in c.values.items()]
        for keys in c.unique:
            k = ", ".join(keys)
            known = " AND ".join(f"{x} IS NOT NULL" for x in keys)
            out.append(row.format("unique", k, f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {name} WHERE {known} GROUP BY {k} HAVING count(*) > 1))"))
        out += [row.format("refers", f"{x} to {t}.{y}", f"count(*) FILTER ({x} IS NOT NULL AND {x} NOT IN (SELECT {y} FROM {t} WHERE {y} IS NOT NULL))") for x, t, y in c.refers]
    return " UNION ALL ".join(out)


@query("constraint_profile", _profile_sql())
def constraint_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each table break each declared constraint (SNK-21)."""
    return profile(_tables(spark, sf_dir), DECLARED)


_NAMES = ", ".join(f"'{t}'" for t in DECLARED)


@query("data_dictionary", f"""SELECT c.table_name AS "table", column_name AS "column", CAST(column_index AS INTEGER) AS place FROM duckdb_columns() c WHERE NOT internal AND c.table_name IN ({_NAMES})""")
def data_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, columns and places (SNK-21)."""
    return columns(_tables(spark, sf_dir)).select("table", "column", "place")


@query("catalog_rows", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in DECLARED))
def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact row counts for the data dictionary (SNK-21, AGG-16)."""
    return columns(_tables(spark, sf_dir)).where("place = 1").select(F.col("table").alias("name"), "n_rows")
