"""Pools, groups, snapshots and models of the URL data set, on rows that exercise each
rule. The SQL states the rows that the rules must give, or computes them.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import policies, urls
from vigilake.operators import dataset
from vigilake.operators.order import running
from vigilake.plans.base import query
from vigilake.plans.url_dataset import canonical_pages
from vigilake.session import scratch_path, table


@query("candidate_pools", """WITH o AS (SELECT c_custkey AS v, c_nationkey % 2 AS snap, c_custkey % 150 AS rank FROM customer), t AS (SELECT DISTINCT o_custkey AS v, o_orderstatus
  AS source FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 300000),
k AS (SELECT v, count(*) AS n, min(source) AS pool FROM t GROUP BY v)
SELECT v AS value_hash, 'benign' AS pool FROM o WHERE snap = 1 AND rank <= 100 AND NOT EXISTS (SELECT 1 FROM k WHERE k.v = o.v) UNION ALL SELECT v,
  pool FROM k WHERE n = 1""")  # fmt: skip
def candidate_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benign candidates of one snapshot up to a rank and unknown to threats; threats of
    one source only (DS-01)."""
    o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("value_hash"), (F.col("c_nationkey") % 2).cast("string").alias("snapshot"),
        (F.col("c_custkey") % 150).alias("rank"))
    t = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P' AND o_totalprice > 300000").select(F.col("o_custkey").alias("value_hash"),
        F.col("o_orderstatus").alias("source"))
    return dataset.candidate_pools(o, t, "1", max_rank=100)


@query("stored_keys",
    """SELECT DISTINCT l_partkey AS id, l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) AS found FROM lineitem WHERE l_quantity >= 45""")
def stored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existence of many keys at once (FLT-13)."""
    asked = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("id"))
    return dataset.existing(asked, table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("id")), ["id"])


@query("bounded_pages", """SELECT page_id, length(url) AS n FROM pages WHERE length(url) BETWEEN 25 AND 60 AND (starts_with(url, 'https://') OR starts_with(url, 'http://'))
  AND url BETWEEN 'http' AND 'https://z'""")
def bounded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BETWEEN, prefix and length conditions (FLT-08); range and prefixes reach the scan."""
    url = F.col("url")
    web = url.startswith("https://") | url.startswith("http://")
    rows = table(spark, sf_dir, "pages").where(url.between("http", "https://z") & F.length(url).between(25, 60) & web)
    return rows.select("page_id", F.length(url).cast("long").alias("n"))


@query("stable_places",
    """SELECT doc_id, CAST(row_number() OVER (ORDER BY lang NULLS FIRST, source NULLS FIRST, doc_id) - 1 AS BIGINT) AS place FROM documents""")
def stable_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total order of rows before a split, (label, group, id), as places: range by
    range, no task holds it all (TOP-06)."""
    rows = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", F.lit(1).cast("long").alias("one"))
    return running(rows, ["lang", "source", "doc_id"], {"place": "one"}).select("doc_id", "place")


@query("principal_component", """WITH z AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER () AS a, (l_extendedprice - avg(l_extendedprice) OVER ()) /
  stddev_samp(l_extendedprice) OVER () AS b FROM lineitem)
SELECT round(1 + abs(corr(a, b)), 4) AS variance, round((1 + abs(corr(a, b))) / 2, 4) AS share, round(sqrt(0.5), 4) AS weight FROM z""")  # fmt: skip
def principal_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first principal component of two scaled features as a composite (AGG-30): its
    variance, its share, and the size of its weights. For two scaled features these are
    known: 1 + |r|, half of it, and the root of one half."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    steps = [VectorAssembler(inputCols=rows.columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True),
        PCA(k=2, inputCol="x", outputCol="pc")]
    model = Pipeline(stages=steps).fit(rows)
    first = vector_to_array("pc")[0]
    weight = float(abs(model.stages[-1].pc.toArray()[0, 0]))
    return model.transform(rows).agg(F.round(F.var_samp(first), 4).alias("variance"), F.round(F.var_samp(first) / 2, 4).alias("share"),
        F.round(F.lit(weight), 4).alias("weight"))


FEATURE_SET = ["url_length", "hostname_length", "dot_count", "digit_count", "path_segment_count"]


def _classifier(spark: SparkSession, sf_dir: str):
    """A saved model of three classes, its manifest, and the rows it was fitted on."""
    c = canonical_pages(spark, sf_dir)
    rows = c.select("page_id", *urls.features(F.col("canonical_url")), (F.col("page_id") % 3).cast("double").alias("label"))
    steps = [VectorAssembler(inputCols=FEATURE_SET, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(family="multinomial", maxIter=20)]
    model = Pipeline(stages=steps).fit(rows)
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    manifest = {"sha256": dataset.artifact_hash(spark, path), "features": FEATURE_SET, "feature_set_version": "v1",
        "classes": ["benign", "phishing", "malware"]}
    return model, path, manifest, rows


@query("artifact_guard", "SELECT * FROM (VALUES ('as saved', ''), ('another feature order', 'features'), ('retrained', 'sha256,classes')) AS v(model, reasons)")
def artifact_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved model is used only with the hash, features and classes of its manifest
    (DS-07)."""
    _, path, manifest, _ = _classifier(spark, sf_dir)
    found = {"features": FEATURE_SET, "feature_set_version": "v1", "classes": ["malware", "benign", "phishing"], "sha256": dataset.artifact_hash(spark, path)}
    cases = [
        ("as saved", dataset.guard(found, manifest)), ("another feature order", dataset.guard(found | {"features": FEATURE_SET[::-1]}, manifest)),
        ("retrained", dataset.guard(found | {"sha256": "0", "classes": ["benign"]}, manifest)),
    ]
    return spark.createDataFrame([(name, ",".join(reasons)) for name, reasons in cases], "model string, reasons string")
