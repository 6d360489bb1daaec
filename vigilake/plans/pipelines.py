"""Streams, version ranges and the URL classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import text, urls, versions
from vigilake.plans.base import query
from vigilake.plans.url_dataset import canonical_pages
from vigilake.session import cut, scratch_path, table
from vigilake.streaming import ingest


@query("stream_events", "SELECT event_type AS record_id, count(DISTINCT props) AS n FROM events GROUP BY 1")
def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events drained through the raw landing stream, deduplicated by content
    (STR-01, STR-02, STR-06); what is stored equals the batch answer."""
    root = scratch_path(spark, "events")
    events = table(spark, sf_dir, "events").select("event_type", "props")
    events.repartition(4).write.parquet(f"{root}/incoming")  # a landing folder with several files
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/incoming")
    ingest.drain(stream.select(F.col("event_type").alias("record_id"), F.col("props").alias("payload")), root, "events")
    return spark.read.parquet(f"{root}/raw").groupBy("record_id").agg(F.count("*").alias("n"))


@query("version_keys", """SELECT p_partkey, (p_size // 10, p_size % 10) >= (1, 5) AND (p_size // 10, p_size % 10) < (4, 2) AS hit FROM part""")
def version_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted versions inside a two-sided range (JOIN-07, FN-25)."""
    version = F.concat(F.floor(F.col("p_size") / 10).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", versions.in_range(version, F.lit(">= 1.5, < 4.2.0")).alias("hit"))


@query("identifier_forms", r"""SELECT event_id, CASE WHEN event_id > 0 THEN 'CWE-' || event_id END AS cwe, CASE WHEN regexp_matches(upper(trim(c)), '^CVE-[0-9]{4}-[0-9]{4,19}$')
  THEN upper(trim(c)) END AS cve,
  CASE WHEN event_type = 'click' THEN true WHEN event_type = 'error' THEN false END AS flag FROM (SELECT *, ' cve-2024-' || event_id AS c FROM events)""")  # fmt: skip
def identifier_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier and flag normal forms (FN-01, FN-03, FN-10, FLT-04)."""
    e = table(spark, sf_dir, "events")
    padded = F.concat(F.lit(" cwe-00"), F.col("event_id").cast("string"))
    word = F.when(F.col("event_type") == "click", "Yes ").when(F.col("event_type") == "error", " n").otherwise("maybe")
    return e.select("event_id", text.cwe(padded).alias("cwe"), text.cve(F.concat(F.lit(" cve-2024-"), F.col("event_id").cast("string"))).alias("cve"),
        text.flag(word).alias("flag"))


@query("redacted_text",
    r"""SELECT page_id, 'fetch ' || url || ' failed for [CVE_REDACTED]: Authorization: [REDACTED] api_key=[REDACTED]; ftp://me:[REDACTED]@host/x' AS message
  FROM pages""")
def redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error text without secrets, credentials and vulnerability identifiers (FN-37)."""
    tail = F.lit(" failed for cve-2026-77: Authorization: Basic abc= api_key=k1; ftp://me:pw@host/x")
    said = F.concat(F.lit("fetch "), F.col("url"), tail)
    return table(spark, sf_dir, "pages").select("page_id", text.redacted(said).alias("message"))


N_FOLDS = 5


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw, label, fold) of every page: the 13 features, the site's language path as the
    label, and a fold of whole hosts."""
    c = canonical_pages(spark, sf_dir)
    language = F.regexp_extract(urls.part(F.col("canonical_url"), 3), "^/([a-z]{2})/", 1)
    codes = F.when(language == "en", 0).when(language == "de", 1).when(language == "fr", 2).when(language == "es", 3).otherwise(4).cast("double")
    fold = F.pmod(F.xxhash64("host"), F.lit(N_FOLDS)).cast("int")
    rows = c.select(*urls.features(F.col("canonical_url")), codes.alias("label"), fold.alias("fold"))
    names = [n for n in rows.columns if n not in ("label", "fold")]
    return cut(rows.withColumn("raw", F.array(*[F.col(n).cast("double") for n in names])).select("raw", "label", "fold"), "folds")


def _out_of_fold(rows: DataFrame, stages: list) -> DataFrame:
    """Each fold predicted by a model of the others, with balanced weights: fold, rows,
    accuracy, macro_f1."""
    spark, out = rows.sparkSession, None
    rows = rows.withColumn("raw", array_to_vector("raw"))
    sizes = cut(rows.groupBy("fold", "label").count(), "sizes")
    for k in range(N_FOLDS):
        train, held = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        per = sizes.where(F.col("fold") != k).groupBy("label").agg(F.sum("count").alias("n"))
        if per.limit(2).count() < 2:
            continue
        weight = F.broadcast(per.select("label", (1.0 / F.col("n")).alias("weight")))  # a row per class
        scored = Pipeline(stages=stages).fit(train.join(weight, "label")).transform(held).groupBy("label", "prediction").count()
        hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0))
        true = scored.groupBy("label").agg(F.sum("count").alias("t"), hit.alias("tp"))
        said = scored.groupBy(F.col("prediction").alias("label")).agg(F.sum("count").alias("p"))
        f1 = true.join(said, "label", "left").select("t", "tp", (2 * F.col("tp") / (F.col("t") + F.coalesce("p", F.lit(0)))).alias("f1"))
        one = f1.agg(F.sum("t").alias("rows"), F.round(F.sum("tp") / F.sum("t"), 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("macro_f1"))
        one = cut(one.select(F.lit(k).alias("fold"), "rows", "accuracy", "macro_f1"), "scores")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "fold int, rows long, accuracy double, macro_f1 double")


@query("url_classifier_folds")
def url_classifier_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multinomial logistic regression on scaled features, five folds (DS-06)."""
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    return _out_of_fold(_folds(spark, sf_dir), [scaler, LogisticRegression(family="multinomial", weightCol="weight", maxIter=60)])


@query("url_forest_folds")
def url_forest_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random forest on the same folds, for the tree ensembles (DS-06)."""
    forest = RandomForestClassifier(featuresCol="raw", weightCol="weight", numTrees=20, maxDepth=6, seed=7)
    return _out_of_fold(_folds(spark, sf_dir), [forest])
