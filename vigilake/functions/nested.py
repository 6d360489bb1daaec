"""Fields of feeds whose shape is not fixed: a text, a list of texts, or nested objects.

Arrow-batched; Spark partitions the rows, and plain texts never come here.
"""

from __future__ import annotations

import json
from collections import deque

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How much of a nested value is looked at.
MOST_NODES, MOST_LOCATIONS, MOST_LENGTH = 4_000, 1_000, 4_096
#: Keys of an object that may hold a location.
KEYS = ("url", "path", "location")


def flattened(value: object) -> list[str] | None:
    """Texts inside a nested value, breadth first, each once; null if it is too large."""
    queue, found, nodes = deque([value]), {}, 0
    while queue and len(found) < MOST_LOCATIONS:
        nodes += 1
        if nodes > MOST_NODES:
            return None
        here = queue.popleft()
        if isinstance(here, str):
            text = here.replace("\xa0", " ").strip()
            if text and len(text) <= MOST_LENGTH:
                found.setdefault(text)
        elif isinstance(here, list):
            queue.extend(here)
        elif isinstance(here, dict):
            queue.extend(here[k] for k in KEYS if here.get(k) is not None)
    return list(found)


def locations(c: Column) -> Column:
    """Source locations of a JSON array of values, each value read by itself, each
    location once (FN-33); null if one is nested too deeply to be read. An array of
    plain texts stays on the native path."""

    def every(value: str) -> list[str] | None:
        parts = [flattened(x) for x in json.loads(value)]
        return None if None in parts else list(dict.fromkeys(t for p in parts for t in p))[:MOST_LOCATIONS]

    @F.pandas_udf("array<string>")
    def read(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else every(v))

    nested = c.rlike(r"^.[\s\S]*[\[{]")
    texts = F.transform(F.from_json(c, "array<string>"), lambda x: F.trim(F.replace(x, F.lit("\xa0"), F.lit(" "))))
    plain = F.slice(F.array_distinct(F.filter(texts, lambda x: (x != "") & (F.length(x) <= MOST_LENGTH))), 1, MOST_LOCATIONS)
    return F.when(c.isNull(), F.array().cast("array<string>")).when(nested, read(F.when(nested, c))).otherwise(plain)


def canonical_json(value: str | None) -> str | None:
    """JSON with sorted keys at every level, compact, characters as they are."""
    if value is None:
        return None
    return json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def payload_hash(c: Column) -> Column:
    """SHA-256 of the canonical form of a JSON text, the same for any order of keys
    (FN-15); null for a null."""

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        return values.map(canonical_json)

    return F.sha2(form(c), 256)
