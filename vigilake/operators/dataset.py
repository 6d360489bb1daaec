"""The labelled URL data set: pools, groups, snapshots, members, and the guard of a
saved model.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators.order import running
from vigilake.session import cut

MAX_RANK = 100_000


class NotUnique(ValueError):
    """A key that had to be unique is not."""


class SnapshotMismatch(ValueError):
    """A snapshot of this name and version exists with another specification."""


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join that refuses repeated keys on either side (JOIN-16)."""
    for side, rows in (("left", left), ("right", right)):
        if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
            raise NotUnique(f"keys {keys} repeat on the {side}")
    return left.join(right, keys, how)


def existing(asked: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Point lookups of many keys at once: each asked key and whether it is stored
    (FLT-13)."""
    known = stored.select(*keys).distinct().withColumn("found", F.lit(True))
    return asked.select(*keys).distinct().join(known, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def registrable_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host) -> (host, group_key): the registrable domain by the rules of a public suffix
    list, else the host itself; IP addresses are their own group (FN-16).

    `rules`: (rule), a line of the list each: `com`, `co.uk`, `*.ck`, `!www.ck`; private
    rules count like others. The longest rule wins, an exception before all. Hosts meet
    rules by an equi join on each of their endings.
    """
    lines = rules.select(F.trim("rule").alias("rule")).where("rule <> '' AND NOT startswith(rule, '//')").distinct()
    exception, wild = F.col("rule").startswith("!"), F.col("rule").startswith("*.")
    bare = F.when(exception, F.substring("rule", 2, 300)).when(wild, F.substring("rule", 3, 300)).otherwise(F.col("rule"))
    # How many labels a match leaves to the suffix, beside those of the rule itself.
    table = lines.select(bare.alias("ending"), F.when(exception, -1).when(wild, 1).otherwise(0).alias("more"))
    address = F.col("host").rlike(r"^[0-9.]+$") | F.col("host").startswith("[")
    named = hosts.select("host").distinct().where(~address).withColumn("labels", F.split("host", r"\."))
    ending = F.transform(F.sequence(F.lit(1), F.size("labels")),
        lambda n: F.struct(n.alias("size"), F.array_join(F.slice("labels", -n, n), ".").alias("ending")))
    each = named.select("host", "labels", F.explode(ending).alias("e")).select("host", "labels", "e.size", "e.ending")
    rank = F.struct((F.col("more") == -1).alias("exception"), (F.col("size") + F.col("more")).alias("suffix"))
    best = each.join(table, "ending").groupBy("host", "labels").agg(F.max(rank).alias("b"))
    size = F.col("b.suffix") + 1
    found = best.select("host", F.when(F.size("labels") >= size, F.array_join(F.slice("labels", -size, size), ".")).alias("domain"))
    return hosts.join(found, "host", "left").select(*hosts.columns, F.coalesce("domain", "host").alias("group_key"))


def candidate_pools(observations: DataFrame, threats: DataFrame, snapshot: str, max_rank: int = MAX_RANK) -> DataFrame:
    """(value_hash, pool): benign are a snapshot's pages of rank up to `max_rank` that no
    threat source knows; a threat belongs to the source that alone knows it (DS-01).
    `observations`: (value_hash, snapshot, rank); `threats`: (value_hash, source)."""
    known = threats.groupBy("value_hash").agg(F.count_distinct("source").alias("n"), F.min("source").alias("pool"))
    benign = observations.where((F.col("snapshot") == snapshot) & (F.col("rank") <= max_rank)).select("value_hash").distinct()
    benign = benign.join(known, "value_hash", "left_anti").withColumn("pool", F.lit("benign"))
    return known.where("n = 1").select("value_hash", "pool").unionByName(benign)


def ensure_snapshot(stored: DataFrame, spec: DataFrame, fields: list[str]) -> DataFrame:
    """The table of snapshots with `spec` in it (SNK-17): a new name and version is added
    as a draft; an existing one must have the same `fields` and stays as it is."""
    keys = ["name", "version"]
    both = spec.alias("n").join(stored.alias("o"), keys)
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"n.{f}").eqNullSafe(F.col(f"o.{f}"))
    if not both.where(differs).isEmpty():
        raise SnapshotMismatch("a snapshot of this name and version has another specification")
    new = spec.join(stored.select(*keys), keys, "left_anti").withColumn("status", F.lit("draft"))
    return stored.unionByName(new)


def persisted_batch(samples: DataFrame, members: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples, members and conflicts after a batch (SNK-16).

    `samples`: (sample_id, label); `members`: (snapshot, sample_id, split); `batch`: both
    together. A sample that is known, or stands in the batch, with another label is a
    label conflict; one that has another split in the snapshot is a member conflict.
    Neither is stored; what is known already is not stored twice.
    """
    labels = samples.select("sample_id", "label").unionByName(batch.select("sample_id", "label"))
    two = labels.groupBy("sample_id").agg(F.count_distinct("label").alias("n")).where("n > 1").select("sample_id")
    bad_label = batch.select("sample_id").distinct().join(two, "sample_id", "left_semi").withColumn("reason", F.lit("label_conflict"))
    splits = members.select("snapshot", "sample_id", "split").unionByName(batch.select("snapshot", "sample_id", "split"))
    other = splits.groupBy("snapshot", "sample_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select("snapshot", "sample_id")
    bad_member = batch.join(other, ["snapshot", "sample_id"], "left_semi").select("sample_id").distinct().withColumn("reason", F.lit("member_conflict"))
    conflicts = bad_label.unionByName(bad_member)
    good = batch.join(conflicts.select("sample_id").distinct(), "sample_id", "left_anti")
    new = good.select("sample_id", "label").distinct().join(samples.select("sample_id"), "sample_id", "left_anti")
    rows = good.select("snapshot", "sample_id", "split").distinct().join(members.select("snapshot", "sample_id"), ["snapshot", "sample_id"], "left_anti")
    return samples.unionByName(new), members.unionByName(rows), conflicts


#: Groups of more than this share of all rows are placed one by one: so there are fewer of them.
LARGE_GROUPS = 2_000


def _passed(at: Column, marks: list[float]) -> Column:
    """How many of the marks a place has passed."""
    return reduce(add, [F.when(at >= m, 1).otherwise(0) for m in marks], F.lit(0))


def stratified_folds(rows: DataFrame, group: str, label: str, folds: int = 5) -> DataFrame:
    """(group, fold): whole groups dealt so that each fold has its share of every class
    (DS-04).

    Groups with more than 1 / LARGE_GROUPS of the rows, fewer than LARGE_GROUPS however
    many rows there are, are placed one by one, the largest first, where the shares of
    the classes stay most even; a tie goes to the first fold. The others are too small
    to matter singly: those of one main class, in the order of a hash, fill the folds one
    after another by what each still lacks of that class. Rows with a null in either
    column are left out; an empty table has no groups.
    """
    counts = rows.where(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    counts = cut(counts, "histograms")
    totals = {r[label]: r["t"] for r in counts.groupBy(label).agg(F.sum("n").alias("t")).orderBy(label).collect()}  # a row per class
    labels, every = list(totals), sum(totals.values())
    main = F.max_by(label, F.struct("n", F.lit(0) - F.array_position(F.array(*map(F.lit, labels)), F.col(label)))) if labels else F.max(label)
    sized = counts.groupBy(group).agg(F.sum("n").alias("size"), main.alias("main"), F.map_from_entries(F.collect_list(F.struct(label, "n"))).alias("h"))
    sized = cut(sized, "groups")
    spark, kind = rows.sparkSession, rows.schema[group].dataType.simpleString()
    large = sized.where(F.col("size") * LARGE_GROUPS > every).orderBy(F.desc("size"), group).collect()
    held = [[0] * len(labels) for _ in range(folds)]
    placed = []
    for r in large:
        n = [r["h"].get(c, 0) for c in labels]
        # What the sum of squared shares grows by.
        cost = [reduce(add, [x * (2 * y + x) / (totals[c] * totals[c]) for x, y, c in zip(n, fold, labels, strict=True)]) for fold in held]
        best = cost.index(min(cost))
        held[best] = [x + y for x, y in zip(n, held[best], strict=True)]
        placed.append((r[group], best))
    small = sized.where(F.col("size") * LARGE_GROUPS <= every).select(group, "main", F.md5(F.col(group).cast("string").cast("binary")).alias("hash_"), "size")
    summed = cut(running(small, ["main", "hash_", group], {"before": "size"}), "summed")
    strata = {r["main"]: r for r in summed.groupBy("main").agg(F.min("before").alias("first"), F.sum("size").alias("rows")).collect()}  # a row per class
    fold = F.lit(0)
    for i, c in enumerate(labels):
        if c in strata:
            lacks = [max(totals[c] / folds - f[i], 0) for f in held]
            lacks = lacks if sum(lacks) > 0 else [1] * folds
            upto = [strata[c]["rows"] * reduce(add, lacks[: k + 1]) / reduce(add, lacks) for k in range(folds - 1)]
            at = F.col("before") - strata[c]["first"]
            fold = F.when(F.col("main") == c, _passed(at, upto)).otherwise(fold)
    dealt = summed.select(group, fold.cast("int").alias("fold"))
    return dealt.unionByName(spark.createDataFrame(placed, f"`{group}` {kind}, fold int"))


def artifact_hash(spark: SparkSession, path: str) -> str:
    """One hash of all files of a saved model, by their names and contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    each = files.where(~F.col("path").rlike(r"/\.[^/]*$")).select(F.concat_ws(":", name, F.sha2("content", 256)).alias("x"))
    return each.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), "\n"), 256)).first()[0]  # a row per file of a model


def guard(found: dict, wanted: dict) -> list[str]:
    """What speaks against using a model (DS-07): its hash, feature list (in order),
    feature version or set of classes is not the expected one."""
    reasons = [k for k in ("sha256", "features", "feature_set_version") if found.get(k) != wanted.get(k)]
    if sorted(found.get("classes") or []) != sorted(wanted.get("classes") or []):
        reasons.append("classes")
    return reasons


def associated_weaknesses(sources: DataFrame, evidence: DataFrame, catalog: DataFrame) -> DataFrame:
    """(vulnerability_id, cwe_id, place): weaknesses that a source names, for the records
    that own its evidence, if the catalog has them; in the source's order, each once
    (JOIN-12, JOIN-13). `sources`: (source, record_key, cwe_ids); `evidence`: (source,
    record_key, vulnerability_id); `catalog`: (cwe_id)."""
    owned = sources.join(evidence, ["source", "record_key"]).select("vulnerability_id", "source", "record_key", F.posexplode("cwe_ids").alias("at", "cwe_id"))
    known = owned.join(catalog.select("cwe_id").distinct(), "cwe_id", "left_semi")
    return known.groupBy("vulnerability_id", "cwe_id").agg(F.min(F.struct("source", "record_key", "at")).alias("first")).select("vulnerability_id",
        "cwe_id", F.col("first.at").alias("place"))


def reference_states(references: DataFrame, catalog: DataFrame, placeholders: tuple[str, ...], normal: Column) -> DataFrame:
    """What becomes of each reference (JOIN-20): (id, refs) -> (id, resolved, placeholder,
    invalid, unresolved, cwe_ids). `normal` is the normal form of the column `ref`."""
    each = references.select("id", F.explode_outer("refs").alias("ref")).withColumn("cwe_id", normal)
    joined = each.join(catalog.select("cwe_id", F.lit(True).alias("known")), "cwe_id", "left")
    asked = F.col("ref").isNotNull()
    idle = F.upper(F.trim("ref")).isin(*placeholders)
    n = lambda c, name: F.count_if(asked & c).alias(name)
    valid = ~idle & F.col("cwe_id").isNotNull()
    return joined.groupBy("id").agg(
        n(valid & F.col("known").isNotNull(), "resolved"), n(idle, "placeholder"), n(~idle & F.col("cwe_id").isNull(), "invalid"),
            n(valid & F.col("known").isNull(), "unresolved"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("known"), F.col("cwe_id")))), ",").alias("cwe_ids"),
    )
