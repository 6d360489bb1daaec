"""Variant locations against the walk over one value in plain Python."""

import json
import random

from pyspark.sql import functions as F

from vigilake.functions import nested
from vigilake.operators import free_shape


def plain(value):
    if value is None:
        return []
    try:
        read = json.loads(value)
    except ValueError:
        return None
    if not isinstance(read, list):
        return None
    parts = [nested.flattened(x) for x in read]
    return None if None in parts else list(dict.fromkeys(t for p in parts for t in p))[: nested.MOST_LOCATIONS]


def shape(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.4:
        return rng.choice(["a", " b ", "", " c ", "é", "x" * 5_000, 5, None, True, "a/b", "d\n"])
    if kind < 0.7:
        return [shape(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["url", "path", "location", "other"]): shape(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_locations_equal_the_walk(spark):
    rng = random.Random(3)
    values = [None, "", "junk", "{}", '"a"', "[]", "[null]", json.dumps([[["deep", ["er"]]], {"path": [{"url": "u"}, "p"], "url": "v"}])]
    values += [json.dumps([shape(rng, 4) for _ in range(rng.randrange(4))]) for _ in range(150)]
    values.append(json.dumps([[str(n % 7) for n in range(4_200)]]))  # too many nodes, few texts
    values.append(json.dumps([[str(n) for n in range(4_200)], "after"]))  # enough texts before that
    values.append(json.dumps([[str(n) for n in range(600)], [str(n) for n in range(300, 1_500)]]))
    df = spark.createDataFrame(list(enumerate(values)), "id long, value string").withColumn("key", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = {r["id"]: r["locations"] for r in free_shape.locations(df, "id", "value").collect()}
    assert len(got) == len(values)
    for i, value in enumerate(values):
        assert got[i] == plain(value), (i, value if value is None else value[:200])
    assert free_shape.locations(df.where("false"), "id", "value").collect() == []
