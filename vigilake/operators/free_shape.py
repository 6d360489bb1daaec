"""Fields of free shape as Variant values, read level by level (FN-33, SRC-10).

A value is a text, a list or an object, nested at will. Its nodes are visited breadth
first: each level is one exploding of the level before, for the values of all rows at
once, so there are as many jobs as the deepest value has levels. Columns and SQL
functions only; `functions.nested` has the same rules for one column in Python workers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.nested import KEYS, MOST_LENGTH, MOST_LOCATIONS, MOST_NODES
from vigilake.session import cut

#: What Python's strip takes off.
_EDGES = r"^[\p{IsWhite_Space}\x1c-\x1f]+|[\p{IsWhite_Space}\x1c-\x1f]+$"


def _children(nodes: DataFrame) -> DataFrame:
    """(key, element, path, upto, j) of the nodes below: of a list all in order, of an
    object those of its location keys."""
    v = F.parse_json("j")
    of = nodes.select("key", "element", "path", "upto", v.alias("v"), F.schema_of_variant(v).alias("kind"))
    lists = nodes.sparkSession.sql("SELECT o.key, o.element, o.path, o.upto, e.pos AS at, e.value AS x FROM {of} o, LATERAL variant_explode(o.v) e WHERE o.kind LIKE 'ARRAY%'", of=of)
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("at"), F.try_variant_get("v", f"$.{k}", "variant").alias("x")) for n, k in enumerate(KEYS)]))
    objects = of.where("kind LIKE 'OBJECT%'").select("key", "element", "path", "upto", named.alias("c")).select("key", "element", "path", "upto", "c.at", "c.x")
    objects = objects.where(F.col("x").isNotNull() & ~F.is_variant_null("x"))
    both = lists.select("key", "element", "path", "upto", "at", F.to_json("x").alias("j")).unionByName(objects.select("key", "element", "path", "upto", "at", F.to_json("x").alias("j")))
    return both.select("key", "element", F.concat("path", F.array("at")).alias("path"), "upto", "j")


def locations(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, locations): the texts inside each row's JSON array, element by element,
    breadth first, each once, `MOST_LOCATIONS` at most.

    Texts are trimmed; empty ones and those longer than MOST_LENGTH are left out. An
    element that has more than MOST_NODES nodes before it has given MOST_LOCATIONS
    texts makes the whole null, as does a text that is no JSON array. A null has no
    locations. Keys are unique and not null; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    given = rows.select(F.col(key).alias("key"), F.try_parse_json(value).alias("v"), F.col(value).isNull().alias("none"))
    given = given.withColumn("is_list", F.coalesce(F.schema_of_variant("v").startswith("ARRAY"), F.lit(False)))
    nodes = spark.sql("SELECT g.key, e.pos AS element, to_json(e.value) AS j FROM {given} g, LATERAL variant_explode(g.v) e WHERE g.is_list", given=given)
    nodes = cut(nodes.select("key", "element", F.array().cast("array<int>").alias("path"), F.lit(1).alias("rank"), F.lit(1).alias("upto"), "j"), "nodes")
    found, over = [], []
    while True:
        text = F.when(F.schema_of_variant(F.parse_json("j")) == "STRING", F.regexp_replace(F.variant_get(F.parse_json("j"), "$", "string"), _EDGES, ""))
        within = nodes.where(F.col("rank") <= MOST_NODES)
        found.append(within.select("key", "element", "rank", text.alias("text")).where((F.col("text") != "") & (F.length("text") <= MOST_LENGTH)))
        over.append(nodes.where(F.col("rank") > MOST_NODES).select("key", "element"))
        below = _children(within)
        # Nodes are numbered in the order of a breadth-first walk; those beyond the last that may be visited are not looked into.
        of = Window.partitionBy("key", "element")
        ranked = below.withColumn("rank", F.col("upto") + F.row_number().over(of.orderBy("path"))).where(F.col("rank") <= MOST_NODES + 1)
        nodes = cut(ranked.select("key", "element", "path", "rank", F.max("rank").over(of).alias("upto"), "j"), "nodes")
        if nodes.isEmpty():
            break
    texts = reduce(DataFrame.unionByName, found).groupBy("key", "element", "text").agg(F.min("rank").alias("rank"))
    texts = texts.withColumn("n", F.row_number().over(Window.partitionBy("key", "element").orderBy("rank"))).where(F.col("n") <= MOST_LOCATIONS)
    texts = cut(texts, "texts")
    enough = texts.where(F.col("n") == MOST_LOCATIONS).select("key", "element")
    large = reduce(DataFrame.unionByName, over).distinct().join(enough, ["key", "element"], "left_anti").select("key").distinct().withColumn("large", F.lit(True))
    each = texts.groupBy("key", "text").agg(F.min(F.struct("element", "rank")).alias("at"))
    each = each.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("at"))).where(F.col("n") <= MOST_LOCATIONS)
    listed = each.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("texts"))
    joined = given.select("key", (F.col("none") | F.col("is_list")).alias("fine")).join(listed, "key", "left").join(large, "key", "left")
    fine = F.col("fine") & F.col("large").isNull()
    return joined.select(F.col("key").alias(key), F.when(fine, F.coalesce("texts", F.array().cast("array<string>"))).alias("locations"))
