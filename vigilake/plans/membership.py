"""Snapshots, members, catalogs and references over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import text, urls
from vigilake.operators import dataset, free_shape, merge
from vigilake.plans.base import query
from vigilake.session import table

#: Lines of a public suffix list as the list has them; the whole list is a parameter.
SUFFIX_RULES = ("// comment", "com", "net", "org", "uk", "co.uk", "*.ck", "!www.ck", "io", "github.io", "")


@query("registrable_domains", r"""WITH h AS (SELECT page_id, rtrim(lower(regexp_extract(trim(url), '^https?://([^/?#:]*)', 1)), '.') AS h FROM pages),
p AS (SELECT *, array_to_string(string_split(h, '.')[-2:], '.') AS pair, string_split(h, '.')[-1] AS last, string_split(h, '.')[-2] AS label FROM h WHERE h LIKE '%.%')
SELECT page_id, CASE page_id % 6 WHEN 0 THEN h WHEN 1 THEN h || '.co.uk' WHEN 2 THEN h || '.ck' WHEN 3 THEN h || '.www.ck' WHEN 4 THEN h || '.github.io' ELSE '10.0.0.' || page_id % 256 END AS host,
  CASE page_id % 6 WHEN 0 THEN pair WHEN 1 THEN last || '.co.uk' WHEN 2 THEN pair || '.ck' WHEN 3 THEN 'www.ck' WHEN 4 THEN last || '.github.io' ELSE '10.0.0.' || page_id % 256 END AS group_key FROM p""")
def registrable_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrable domains of pages' hosts, also under other suffixes, by a public suffix
    list with wildcards, exceptions and private rules (FN-16)."""
    k, h = F.col("page_id"), F.col("h")
    pages = table(spark, sf_dir, "pages").select("page_id", urls.once(F.trim("url"), urls.host).alias("h")).where(h.contains("."))
    under = F.lit(None).cast("string")
    for n, suffix in enumerate(("", ".co.uk", ".ck", ".www.ck", ".github.io")):
        under = F.when(k % 6 == n, F.concat(h, F.lit(suffix))).otherwise(under)
    hosts = pages.select("page_id", F.coalesce(under, F.concat(F.lit("10.0.0."), (k % 256).cast("string"))).alias("host"))
    rules = spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string")
    return dataset.registrable_domains(hosts, rules)


@query("ensured_snapshots", """WITH s AS (SELECT DISTINCT source AS name FROM documents WHERE source IS NOT NULL)
SELECT name, '1' AS version, 'frozen' AS status FROM s UNION ALL SELECT name, '2', 'draft' FROM s""")  # fmt: skip
def ensured_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of each source are made once; asked for again they must be the same
    (SNK-17)."""
    names = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("name")).distinct()
    spec = lambda v: names.select("name", F.lit(v).alias("version"), F.lit("v1").alias("feature_set_version"), F.lit("{}").alias("targets"))
    fields = ["feature_set_version", "targets"]
    stored = dataset.ensure_snapshot(spec("1").withColumn("status", F.lit("frozen")), spec("1"), fields)
    return dataset.ensure_snapshot(stored, spec("2"), fields).select("name", "version", "status")


def _persisted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers are samples, some known with a label and some members; orders are the
    batch, a few with another label or split."""
    label = lambda key, odd: F.when(odd, "malware").when(key % 3 == 0, "benign").otherwise("phishing").alias("label")
    split = lambda key, odd: F.when((key % 10 < 8) != odd, "train").otherwise("test").alias("split")
    c, k, o, order = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("o_custkey"), F.col("o_orderkey")
    samples = c.where("c_custkey % 3 = 0").select(k.alias("sample_id"), label(k, F.lit(False)))
    members = c.where("c_custkey % 6 = 0").select(F.lit("s1").alias("snapshot"), k.alias("sample_id"), split(k, F.lit(False)))
    batch = table(spark, sf_dir, "orders").select(F.lit("s1").alias("snapshot"), o.alias("sample_id"), split(o, order % 97 == 0), label(o, order % 101 == 0))
    return dataset.persisted_batch(samples, members, batch)


BATCH = """b AS (SELECT o_custkey AS k, o_orderkey % 97 = 0 AS other_split, o_orderkey % 101 = 0 AS other_label, CASE WHEN o_custkey % 10 < 8 THEN 'train' ELSE 'test' END AS split,
  CASE WHEN o_custkey % 3 = 0 THEN 'benign' ELSE 'phishing' END AS label FROM orders),
g AS (SELECT k, any_value(split) AS split, any_value(label) AS label, bool_or(other_split) AND (bool_or(NOT other_split) OR k % 6 = 0) AS two_splits, bool_and(other_split) AS all_split,
  bool_or(other_label) AND (bool_or(NOT other_label) OR k % 3 = 0) AS two_labels, bool_and(other_label) AS all_label FROM b GROUP BY k),
fine AS (SELECT k, CASE WHEN all_split THEN CASE split WHEN 'train' THEN 'test' ELSE 'train' END ELSE split END AS split, CASE WHEN all_label THEN 'malware' ELSE label END AS label
  FROM g WHERE NOT two_splits AND NOT two_labels)"""


@query("persisted_members", f"""WITH {BATCH}, samples AS (SELECT c_custkey AS k, 'benign' AS label FROM customer WHERE c_custkey % 3 = 0
  UNION SELECT k, label FROM fine WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)),
members AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM customer WHERE c_custkey % 6 = 0
  UNION SELECT k, split FROM fine WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 6 = 0))
SELECT k AS sample_id, label, split FROM samples LEFT JOIN members USING (k)""")  # fmt: skip
def persisted_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and members after a batch: new ones once, known ones unchanged (SNK-16,
    JOIN-16)."""
    samples, members, _ = _persisted(spark, sf_dir)
    return dataset.one_to_one(samples, members.select("sample_id", "split"), ["sample_id"], "left")


@query("member_conflicts", f"""WITH {BATCH} SELECT k AS sample_id, 'label_conflict' AS reason FROM g WHERE two_labels UNION ALL SELECT k, 'member_conflict' FROM g WHERE two_splits""")
def member_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose label or split is contradicted (SNK-16)."""
    return _persisted(spark, sf_dir)[2]


def _cwe(c: Column) -> Column:
    return F.concat(F.lit("CWE-"), c.cast("string"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size % 3 <> 0").select(_cwe(F.col("p_size")).alias("cwe_id")).distinct()


@query("owned_weaknesses", """WITH c AS (SELECT DISTINCT p_size AS id FROM part WHERE p_size % 3 <> 0),
e AS (SELECT o_custkey AS v, o_orderkey AS k, unnest([o_custkey % 60, o_orderkey % 55, o_custkey % 60, 9999]) AS id, unnest([0, 1, 2, 3]) AS place FROM orders WHERE o_orderkey % 4 <> 0)
SELECT v AS vulnerability_id, 'CWE-' || id AS cwe_id, CAST(arg_min(place, (k, place)) AS INTEGER) AS place FROM e WHERE id IN (SELECT id FROM c) GROUP BY v, id""")  # fmt: skip
def owned_weaknesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weaknesses of the records that own a source's evidence, by the official catalog,
    in order and once (JOIN-12, JOIN-13, SET-06)."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    ids = F.array(_cwe(F.col("o_custkey") % 60), _cwe(k % 55), _cwe(F.col("o_custkey") % 60), F.lit("CWE-9999"))
    sources = o.select(F.lit("adv").alias("source"), k.alias("record_key"), ids.alias("cwe_ids"))
    evidence = o.where("o_orderkey % 4 <> 0").select(F.lit("adv").alias("source"), k.alias("record_key"), F.col("o_custkey").alias("vulnerability_id"))
    return dataset.associated_weaknesses(sources, evidence, _catalog(spark, sf_dir))


@query("reference_states", """WITH c AS (SELECT DISTINCT p_size AS id FROM part WHERE p_size % 3 <> 0),
o AS (SELECT o_orderkey AS id, o_custkey % 60 + 1 AS a, o_orderkey % 55 + 1 AS b, o_orderkey % 3 = 0 AS idle, o_orderkey % 5 = 0 AS bad, o_orderkey % 7 = 0 AS none FROM orders),
j AS (SELECT o.*, a IN (SELECT id FROM c) AS known_a, b IN (SELECT id FROM c) AS known_b FROM o)
SELECT id, CASE WHEN none THEN 0 ELSE CAST(known_a AS BIGINT) + CAST(known_b AS BIGINT) END AS resolved, CAST(idle AND NOT none AS BIGINT) AS placeholder, CAST(bad AND NOT none AS BIGINT) AS invalid,
  CASE WHEN none THEN 0 ELSE CAST(NOT known_a AS BIGINT) + CAST(NOT known_b AS BIGINT) END AS unresolved,
  CASE WHEN none THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter([CASE WHEN known_a THEN 'CWE-' || a END, CASE WHEN known_b THEN 'CWE-' || b END], lambda x: x IS NOT NULL))), ',') END AS cwe_ids
FROM j""")  # fmt: skip
def reference_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References against the local catalog: resolved, placeholder, invalid, unresolved
    (JOIN-20)."""
    k = F.col("o_orderkey")
    refs = F.array(F.concat(F.lit("cwe-00"), (F.col("o_custkey") % 60 + 1).cast("string")), (k % 55 + 1).cast("string"), F.when(k % 3 == 0, "NVD-CWE-noinfo"), F.when(k % 5 == 0, "what"))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 7 != 0, F.array_compact(refs)).alias("refs"))
    return dataset.reference_states(rows, _catalog(spark, sf_dir), text.CWE_PLACEHOLDERS, text.cwe(F.col("ref")))


@query("catalog_upsert", """WITH b AS (SELECT l_partkey AS k, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem WHERE l_quantity >= 47 GROUP BY 1),
s AS (SELECT p_partkey AS k, p_name AS name FROM part WHERE p_size < 40)
SELECT coalesce(s.k, b.k) AS cwe_id, CASE WHEN b.low = b.high THEN 'line ' || b.low ELSE s.name END AS name, CASE WHEN b.low = b.high THEN '4.2' ELSE '4.1' END AS version
FROM s FULL JOIN b USING (k) WHERE s.k IS NOT NULL OR b.low = b.high""")  # fmt: skip
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weakness catalog after a batch; contradicting rows change nothing (SNK-13)."""
    stored = table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("cwe_id"), F.col("p_name").alias("name"), F.lit("4.1").alias("version"))
    batch = table(spark, sf_dir, "lineitem").where("l_quantity >= 47").select(F.col("l_partkey").alias("cwe_id"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("name"),
        F.lit("4.2").alias("version"))
    return merge.upsert(stored, batch, ["cwe_id"])


FOLDS = 5
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_COUNTS = ", ".join(f"count(*) FILTER (o_orderpriority = '{p}')" for p in PRIORITIES)
STRATIFIED = f"""g AS (SELECT o_custkey AS k, count(*) AS n, [{_COUNTS}] AS h FROM orders GROUP BY 1),
t AS (SELECT sum(n) AS n, [{", ".join(f"sum(h[{i}])" for i in range(1, 6))}]::DOUBLE[] AS t FROM g),
large AS (SELECT k, h, row_number() OVER (ORDER BY g.n DESC, k) AS i FROM g, t WHERE g.n * {dataset.LARGE_GROUPS} > t.n),
walk(i, k, fold, f) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), list_transform(range({5 * FOLDS}), lambda x: CAST(0 AS BIGINT))
  UNION ALL SELECT i, k, fold, list_transform(range(1, {5 * FOLDS + 1}), lambda x: f[x] + CASE WHEN (x - 1) // 5 = fold THEN h[(x - 1) % 5 + 1] ELSE 0 END)
  FROM (SELECT i, k, h, f, list_position(costs, list_min(costs)) - 1 AS fold FROM (SELECT l.i, l.k, l.h, w.f, list_transform(range({FOLDS}), lambda j:
    list_sum(list_transform(range(1, 6), lambda c: l.h[c] * (2 * w.f[j * 5 + c] + l.h[c]) / (t.t[c] * t.t[c])))) AS costs FROM walk w JOIN large l ON l.i = w.i + 1, t))),
small AS (SELECT k, g.n, list_position(h, list_max(h)) AS c, md5(CAST(k AS VARCHAR)) AS hash FROM g, t WHERE g.n * {dataset.LARGE_GROUPS} <= t.n),
summed AS (SELECT k, c, coalesce(sum(n) OVER (PARTITION BY c ORDER BY hash, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY c) AS size FROM small),
lacks AS (SELECT c, list_transform(range({FOLDS}), lambda j: greatest(t.t[c] / {FOLDS} - f[j * 5 + c], 0)) AS d FROM (SELECT f FROM walk ORDER BY i DESC LIMIT 1), t, (SELECT unnest(range(1, 6)) AS c)),
shares AS (SELECT c, CASE WHEN list_sum(d) > 0 THEN d ELSE [1.0, 1.0, 1.0, 1.0, 1.0] END AS d FROM lacks)"""


@query("stratified_folds", f"""WITH RECURSIVE {STRATIFIED} SELECT k AS o_custkey, CAST(fold AS INTEGER) AS fold FROM walk WHERE i > 0
UNION ALL SELECT k, CAST(len(list_filter(range(1, {FOLDS}), lambda j: before >= size * list_sum(d[:j]) / list_sum(d))) AS INTEGER) FROM summed JOIN shares USING (c)""")  # fmt: skip
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines dealt whole to folds that each have their share of every class (DS-04)."""
    return dataset.stratified_folds(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", FOLDS)


@query("nested_locations", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || '|b' WHEN 1 THEN 'u' || p_partkey || '|p1|l' || p_partkey || '|' || p_brand WHEN 2 THEN 'd' || p_partkey || '|z' WHEN 3 THEN '' END AS locations
FROM part""")  # fmt: skip
def nested_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations inside values of free shape: texts, lists, objects within objects, nulls
    and what is no list (FN-33)."""
    k = F.col("p_partkey")
    key, name, brand = k.cast("string"), F.col("p_name"), F.col("p_brand")
    shapes = (
        F.concat(F.lit('["'), name, F.lit('", " '), name, F.lit(' ", "", "b"]')),
        F.concat(F.lit('[{"path": ["p1", {"location": "l'), key, F.lit('"}], "url": "u'), key, F.lit('", "other": "x"}, "'), brand, F.lit('", "p1"]')),
        F.concat(F.lit('[[["d'), key, F.lit('"]], {"location": null, "url": ""}, 5, {"url": {"path": {"location": "z"}}}]')),
    )
    body = F.when(k % 5 == 0, shapes[0]).when(k % 5 == 1, shapes[1]).when(k % 5 == 2, shapes[2]).when(k % 5 == 4, F.concat(F.lit('{"url": "'), key, F.lit('"}')))
    rows = table(spark, sf_dir, "part").select("p_partkey", body.alias("value"))
    return free_shape.locations(rows, "p_partkey", "value").select("p_partkey", F.array_join("locations", "|").alias("locations"))
