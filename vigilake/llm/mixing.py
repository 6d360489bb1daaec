"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.common import WORD, sized_broadcast
from vigilake.operators.order import running
from vigilake.session import cut

HASH_BITS = 60
LEVEL_BITS = 12
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3


def doc_hash(id_col: Column) -> Column:
    """60 bits of the md5 of the id as text (null: the empty text)."""
    text = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources in code-point order, null last, weigh `weights` in turn and share the
    sum of all sizes. A target stops at `max_repeats` times its source's size and
    the excess is shared anew by weight: that is the level L for which the sum of
    min(cap, L * weight) is the whole, found by running sums over sources ordered by
    cap / weight. Ranks and sums are taken range by range, so any number of sources
    is spread over many tasks.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    keyed = sizes.withColumn("no_source", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long"))
    ranked = running(keyed, ["no_source", "source"], {"rank": "one"})
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_repeats).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    leveled = cut(running(ranked, ["ratio", "no_source", "source"], {"cap_before": "cap", "weight_before": "weight"}), "leveled")
    sums = leveled.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weight")).first()
    level = (F.lit(sums["total"] or 0) - F.col("cap_before")).cast("double") / (F.lit(sums["weight"] or 1) - F.col("weight_before"))
    found = leveled.where(level <= F.col("ratio")).agg(F.max(level).alias("level")).first()["level"]
    cap = F.col("cap").cast("double")
    target = cap if found is None else F.least(cap, F.lit(found) * F.col("weight"))
    return leveled.select("source", "source_size", target.alias("target"))


def mix_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, size, h) -> (source, source_size, target, whole, below).

    Every document of a source is taken `whole` times, and once more if h <
    `below`. `below` meets the rest of the target: sizes are summed by source and
    leading hash bits, the bucket that crosses the budget is found by a running
    sum over at most 2**12 buckets, and only that bucket is split by the next 12
    bits, until it holds a single hash. That one is taken if it brings the sum
    nearer. Nothing is sorted by document, and thresholds are nested: a larger
    target keeps every document of a smaller one.
    """
    targets = cut(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    plan = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # A bucket is known by the bits above `shift`; at first there is one for each source.
    frontier, done, shift = plan.select("source", "rest", F.lit(0).cast("long").alias("prefix")), None, HASH_BITS
    while shift > 0:
        inside = F.shiftright(F.col("r.h"), shift) == F.col("f.prefix")
        near = rows.alias("r").join(sized_broadcast(frontier).alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")) & inside)
        shift -= LEVEL_BITS
        hist = near.groupBy(F.col("r.source").alias("source"), F.shiftright(F.col("r.h"), shift).alias("prefix")).agg(
            F.sum("r.size").alias("s"), F.min("r.h").alias("low"), F.max("r.h").alias("high"), F.max("f.rest").alias("rest")
        )
        before = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0)))
        crossing = (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("s") > F.col("rest"))
        edge = cut(hist.where(crossing).withColumn("rest", F.col("rest") - F.col("before")), "edge")
        nearer = F.col("s") < 2 * F.col("rest")
        final = F.lit(True) if shift == 0 else F.col("low") == F.col("high")
        below = F.when(nearer, F.col("high") + 1).otherwise(F.col("low"))
        ended = edge.where(final).select("source", below.alias("below"))
        done = ended if done is None else done.unionByName(ended)
        frontier = edge.where(~final).select("source", "rest", "prefix")
        if frontier.isEmpty():
            break
    plan, done = plan.alias("p"), done.alias("d")
    joined = plan.join(done, F.col("p.source").eqNullSafe(F.col("d.source")), "left")
    return cut(joined.select("p.source", "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below")), "plan")


def planned(rows: DataFrame, plan: DataFrame, source: Column, h: Column) -> DataFrame:
    """`rows` beside the plan's columns (struct `plan`), with `copies` in it; the
    columns of `rows` are under `row`, so no name of theirs can clash."""
    one = rows.select(F.struct("*").alias("row"), source.alias("source_of"), h.alias("hash_of"))
    taken = plan.select(F.col("source").alias("source_in_plan"), F.struct("source_size", "target", "whole", "below").alias("plan"))
    joined = one.join(sized_broadcast(taken), F.col("source_of").eqNullSafe(F.col("source_in_plan")))
    copies = F.col("plan.whole") + F.when(F.col("hash_of") < F.col("plan.below"), 1).otherwise(0)
    return joined.select("row", "plan", copies.cast("int").alias("copies"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies.

    Null text has size 0; a null source is a source of its own, ordered last; a
    source whose size is 0 has target 0 and takes 0 words; rows that share an id
    share a hash and are taken alike; an empty table gives an empty result.
    """
    rows = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("h")), "sizes")
    mixed = planned(rows, mix_plan(rows, weights, max_repeats), F.col("source"), F.col("h"))
    return mixed.select(
        "row.doc_id", "row.size", "plan.source_size", "plan.target",
        (F.col("row.size") * F.col("copies")).alias("taken"), "copies",
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """`docs` with each row as often as the mix takes it (0 to `max_repeats` times);
    columns are those of `docs`, whatever their names.

    Null and empty texts weigh nothing and go with their source's copies; a null
    source is a source of its own; rows of one id are taken alike, ties of the hash
    too; an empty table stays empty.
    """
    rows = cut(docs.select("source", word_count(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("h")), "sizes")
    mixed = planned(docs, mix_plan(rows, weights, max_repeats), F.col("source"), doc_hash(F.col("doc_id")))
    taken = mixed.where(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


#: The same rule with a running sum over documents ordered by hash.
SQL = r"""
WITH docs AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM sizes),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS
    level_here
  FROM ranked
  WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE),
         coalesce((SELECT max(level_here) FROM levels WHERE level_here <= CAST(cap AS DOUBLE) / weight) * weight, CAST(cap AS DOUBLE))) AS target
  FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INTEGER) ELSE 0 END AS whole FROM targets),
sums AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.h) AS same
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
taken AS (
  SELECT *, whole + CASE WHEN upto <= rest OR (upto - same <= rest AND same < 2 * (rest - (upto - same))) THEN 1 ELSE 0 END AS copies FROM sums)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies FROM taken
"""
