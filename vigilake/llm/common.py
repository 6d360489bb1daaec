"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.session import ship

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, however often the body
    (or a lambda inside it) uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(id_col: str | Column, parts: int = 5) -> Column:
    """crc32 of the id as text modulo `parts`; null ids count as the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % parts


def per_document(docs: DataFrame, run: Callable, more: str) -> DataFrame:
    """`mapInPandas` over rows with a doc_id, whose schema is doc_id and `more`. Ids pass
    as text: a batch that holds a null would turn long ids into floats."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    return own.mapInPandas(run, f"doc_id string, {more}").withColumn("doc_id", F.col("doc_id").cast(kind))


def small(df: DataFrame, rows: int) -> bool:
    """Whether `df` has at most `rows` rows; looks at no more than it must."""
    return df.limit(rows + 1).count() <= rows


def sized_broadcast(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """`df` marked for broadcast if its counted size is within `rows`, else as it
    is, for Spark to join by shuffle (AQE splits skewed keys)."""
    return F.broadcast(df) if small(df, rows) else df
