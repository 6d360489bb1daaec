"""Boosted trees over URLs, what is measured on three classes, and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import policies, urls
from vigilake.operators import boosting, dataset, selection
from vigilake.plans.base import query
from vigilake.plans.pipelines import N_FOLDS
from vigilake.plans.url_dataset import canonical_pages
from vigilake.session import cut, table

CLASSES = ("benign", "phishing", "malware")


def multiclass_metrics(rows: DataFrame, classes: list[str], *by: str) -> DataFrame:
    """Quality of predictions (truth, guess, probabilities in the order of `classes`) of
    any number of classes (AGG-27): averages by class and by rows, Matthews' correlation,
    kappa, log-loss and Brier score. One pass for the confusion counts; a class that is
    never true or never guessed counts as zero. Rows with a null are left out."""
    rows = rows.where("truth IS NOT NULL AND guess IS NOT NULL AND probabilities IS NOT NULL")
    truth = lambda c: (F.col("truth") == c).cast("double")
    p = lambda i: F.get("probabilities", F.lit(i))
    own = sum((truth(c) * p(i) for i, c in enumerate(classes)), F.lit(0.0))
    loss = -F.log(F.greatest(F.least(own, F.lit(1 - 1e-15)), F.lit(1e-15)))
    brier = sum(((p(i) - truth(c)) ** 2 for i, c in enumerate(classes)), F.lit(0.0))
    sums = {f"t{i}": F.count_if(F.col("truth") == c) for i, c in enumerate(classes)}
    sums |= {f"g{i}": F.count_if(F.col("guess") == c) for i, c in enumerate(classes)}
    sums |= {f"h{i}": F.count_if((F.col("truth") == c) & (F.col("guess") == c)) for i, c in enumerate(classes)}
    m = rows.groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.avg(loss).alias("log_loss"), F.avg(brier).alias("brier"),
        *[x.cast("double").alias(name) for name, x in sums.items()])
    every, k = range(len(classes)), len(classes)
    t, g, h, n = (lambda i: F.col(f"t{i}")), (lambda i: F.col(f"g{i}")), (lambda i: F.col(f"h{i}")), F.col("n")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    total = lambda f: sum((f(i) for i in every), F.lit(0.0))
    f1 = lambda i: ratio(2 * h(i), t(i) + g(i))
    hits, cross = total(h), total(lambda i: t(i) * g(i))
    spread = F.sqrt((n * n - total(lambda i: g(i) * g(i))) * (n * n - total(lambda i: t(i) * t(i))))
    recall = total(lambda i: ratio(h(i), t(i))) / k
    out = {
        "accuracy": hits / n, "balanced_accuracy": recall, "precision_macro": total(lambda i: ratio(h(i), g(i))) / k, "recall_macro": recall,
        "f1_macro": total(f1) / k, "f1_weighted": total(lambda i: f1(i) * t(i)) / n, "mcc": ratio(hits * n - cross, spread),
        "kappa": ratio(hits / n - cross / (n * n), 1 - cross / (n * n)), "log_loss": F.col("log_loss"), "brier": F.col("brier"),
        "false_negative_rate_last": ratio(t(k - 1) - h(k - 1), t(k - 1)),
    }
    return m.where(n > 0).select(*by, *[x.alias(name) for name, x in out.items()])


MULTICLASS_SQL = """WITH x AS (SELECT l_returnflag AS truth, CASE WHEN l_discount >= 0.07 THEN 'A' WHEN l_tax >= 0.04 THEN 'N' ELSE 'R' END AS guess,
  0.1 + 5 * CAST(l_discount AS DOUBLE) AS a, 0.1 + CAST(l_tax AS DOUBLE) AS b FROM lineitem),
k AS (SELECT * FROM (VALUES ('A'), ('N'), ('R')) v(c)), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM x),
m AS (SELECT c, CAST(count(*) FILTER (truth = c) AS DOUBLE) AS t, CAST(count(*) FILTER (guess = c) AS DOUBLE) AS g, CAST(count(*) FILTER (truth = c AND guess = c) AS DOUBLE) AS h
  FROM k CROSS JOIN x GROUP BY c),
s AS (SELECT sum(h) AS hits, sum(t * g) AS crossed, sum(t * t) AS tt, sum(g * g) AS gg, avg(h / t) AS recall, avg(h / g) AS prec, avg(2 * h / (t + g)) AS f1,
  sum(t * 2 * h / (t + g)) AS f1w, max(CASE WHEN c = 'R' THEN (t - h) / t END) AS miss FROM m),
l AS (SELECT avg(-ln(CASE truth WHEN 'A' THEN a WHEN 'N' THEN b ELSE 1 - a - b END)) AS log_loss,
  avg(power(a - CAST(truth = 'A' AS INTEGER), 2) + power(b - CAST(truth = 'N' AS INTEGER), 2) + power(1 - a - b - CAST(truth = 'R' AS INTEGER), 2)) AS brier FROM x)
SELECT round(hits / n, 6) AS accuracy, round(recall, 6) AS balanced_accuracy, round(prec, 6) AS precision_macro, round(recall, 6) AS recall_macro, round(f1, 6) AS f1_macro,
  round(f1w / n, 6) AS f1_weighted, round((hits * n - crossed) / (sqrt(n * n - gg) * sqrt(n * n - tt)), 6) AS mcc,
  round(1 - (1 - hits / n) / (1 - crossed / (n * n)), 6) AS kappa, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round(miss, 6) AS false_negative_rate_last
FROM s, n, l"""


@query("multiclass_metrics", MULTICLASS_SQL)
def multiclass_metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages, correlation, kappa, log-loss and Brier score of three classes (AGG-27)."""
    a, b = 0.1 + 5 * F.col("l_discount").cast("double"), 0.1 + F.col("l_tax").cast("double")
    guess = F.when(F.col("l_discount") >= 0.07, "A").when(F.col("l_tax") >= 0.04, "N").otherwise("R")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("truth"), guess.alias("guess"), F.array(a, b, 1 - a - b).alias("probabilities"))
    found = multiclass_metrics(rows, ["A", "N", "R"])
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


def _class_of(url: Column) -> Column:
    """The class that stands for a page's label: its site's language path."""
    language = F.regexp_extract(urls.part(url, 3), "^/([a-z]{2})/", 1)
    return F.when(language == "en", 0).when(language == "de", 1).otherwise(2)


def scored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, fold, label, probabilities, prediction) of every page, predicted by
    boosted trees that saw no page of its host: 13 features, balanced weights."""
    pages = canonical_pages(spark, sf_dir)
    rows = pages.select("page_id", "host", _class_of(F.col("canonical_url")).alias("label"), *urls.features(F.col("canonical_url")))
    names = [c for c in rows.columns if c not in ("page_id", "host", "label")]
    rows = cut(rows, "features")
    rows = cut(rows.join(dataset.stratified_folds(rows, "host", "label", N_FOLDS), "host"), "folds")
    scored = boosting.out_of_fold(rows, names, N_FOLDS, len(CLASSES), boosting.Settings(rounds=8))
    return scored.select("page_id", "host", "fold", "label", "probabilities", "prediction")


def _name(code: str) -> Column:
    return F.get(F.array(*map(F.lit, CLASSES)), F.col(code))


@query("url_boosted_folds")
def url_boosted_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the boosted trees in each fold of whole hosts (DS-06, AGG-27, AGG-28)."""
    rows = scored_pages(spark, sf_dir).select("fold", _name("label").alias("truth"), _name("prediction").alias("guess"), "probabilities")
    found = multiclass_metrics(rows, list(CLASSES), "fold")
    return found.select("fold", *[F.round(c, 6).alias(c) for c in found.columns if c != "fold"])


@query("url_verdicts")
def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL to class, verdict and confidence, the probability of the class, by trees that
    saw no page of its host (FN-40)."""
    found = _name("prediction")
    return scored_pages(spark, sf_dir).select("page_id", found.alias("threat_class"), policies.verdict(found).alias("verdict"),
        F.round(F.get("probabilities", F.col("prediction")), 6).alias("confidence"))


@query("feature_elimination")
def feature_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which URL features can go: the path of a backward elimination, scored out of fold
    (AGG-30)."""
    pages = canonical_pages(spark, sf_dir)
    rows = pages.select("host", _class_of(F.col("canonical_url")).alias("label"), *urls.features(F.col("canonical_url")))
    names = [c for c in rows.columns if c not in ("host", "label")]
    rows = cut(rows, "features")
    rows = rows.join(dataset.stratified_folds(rows, "host", "label", N_FOLDS), "host").drop("host")
    path = selection.eliminated(rows, names)
    return spark.createDataFrame([(n, s.removed, len(s.kept), round(s.score, 6)) for n, s in enumerate(path)], "step int, removed string, n_kept int, accuracy double")


@query("feature_ablation")
def feature_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each numeric column of an exposure says of its state: the score without
    it, in folds of suppliers (AGG-30)."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    rows = table(spark, sf_dir, "lineitem").select(*names, F.col("l_returnflag").alias("label"), (F.col("l_suppkey") % 5).alias("fold"))
    found = selection.ablation(rows, names)
    return spark.createDataFrame([(n or "none", round(score, 6)) for n, score in found.items()], "without string, accuracy double")
