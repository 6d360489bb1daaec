"""Descriptive and model-quality statistics over labelled numeric features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.operators.order import quantiles, running
from vigilake.plans.base import query
from vigilake.session import cut, table

FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LABEL = "l_returnflag"
LONG_SQL = "long AS (UNPIVOT (SELECT l_returnflag AS label, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE x)"


def long_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, feature, x), one row for each value."""
    rows = table(spark, sf_dir, "lineitem").select(F.col(LABEL).alias("label"), *FEATURES)
    return rows.unpivot("label", list(FEATURES), "feature", "x")


def sample_skewness(c: str) -> Column:
    """Bias-corrected, from the population value."""
    n, g = F.count(c).cast("double"), F.skewness(c)
    return g * F.sqrt(n * (n - 1)) / (n - 2)


def sample_kurtosis(c: str) -> Column:
    n, g = F.count(c).cast("double"), F.kurtosis(c)
    return ((n + 1) * g + 6) * (n - 1) / ((n - 2) * (n - 3))


@query("distribution_stats", f"""WITH {LONG_SQL}
SELECT label, feature, count(*) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS sd, round(quantile_cont(x, 0.9), 4) AS p90,
  round(quantile_cont(x, 0.95), 4) AS p95, round(quantile_cont(x, 0.99), 4) AS p99,
  round(skewness(x), 4) AS skew, round(kurtosis(x), 4) AS kurt FROM long GROUP BY label, feature""")  # fmt: skip
def distribution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments and exact percentiles by class (AGG-19). Percentiles come from running
    counts of distinct values by range, not from one buffer for each class."""
    rows = long_features(spark, sf_dir).withColumn("g", F.struct("label", "feature"))
    moments = rows.groupBy("g").agg(
        F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("sd"),
        F.round(sample_skewness("x"), 4).alias("skew"), F.round(sample_kurtosis("x"), 4).alias("kurt"),
    )
    p = quantiles(rows, "g", "x", {"p90": 0.9, "p95": 0.95, "p99": 0.99}).drop("n")
    joined = moments.join(p, "g")  # a row per class and feature
    return joined.select("g.label", "g.feature", "n", "mean", "sd", *[F.round(c, 4).alias(c) for c in ("p90", "p95", "p99")], "skew", "kurt")


@query("iqr_outliers", f"""WITH {LONG_SQL}, b AS (SELECT feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, quantile_cont(x, 0.99) AS p99 FROM long GROUP BY
  feature)
SELECT feature, round(q1 - 1.5 * (q3 - q1), 4) AS low, round(q3 + 1.5 * (q3 - q1), 4) AS high, count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 +
  1.5 * (q3 - q1)) AS n_outliers, count(*) FILTER (x > p99) AS n_above_p99
FROM long JOIN b USING (feature) GROUP BY feature, q1, q3""")  # fmt: skip
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlier bounds and counts (AGG-20); the bounds are four rows."""
    x = long_features(spark, sf_dir)
    b = cut(quantiles(x, "feature", "x", {"q1": 0.25, "q3": 0.75, "p99": 0.99}).drop("n"), "bounds")
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    joined = x.join(F.broadcast(b), "feature").groupBy("feature", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))
    return joined.agg(F.count_if((F.col("x") < low) | (F.col("x") > high)).alias("n_outliers"), F.count_if(F.col("x") > F.col("p99")).alias("n_above_p99"))


PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
MATRIX_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM %s" for a, b in PAIRS)


@query("pearson", MATRIX_SQL % (("lineitem",) * len(PAIRS)))
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of features in one pass (AGG-21)."""
    return _matrix(table(spark, sf_dir, "lineitem"))


def _matrix(rows: DataFrame) -> DataFrame:
    one = rows.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 4).alias("r")) for a, b in PAIRS]).alias("m"))
    return one.select(F.explode("m").alias("m")).select("m.a", "m.b", "m.r")


STRONG = 0.90


@query("strong_pairs", """WITH x AS (SELECT l_quantity AS a, l_extendedprice AS b, l_quantity * 2 + l_tax AS c, -l_quantity AS d FROM lineitem),
m AS (SELECT 'a' AS x, 'b' AS y, corr(a, b) AS r FROM x UNION ALL SELECT 'a', 'c', corr(a, c) FROM x UNION ALL SELECT 'a', 'd', corr(a, d) FROM x
  UNION ALL SELECT 'b', 'c', corr(b, c) FROM x UNION ALL SELECT 'b', 'd', corr(b, d) FROM x UNION ALL SELECT 'c', 'd', corr(c, d) FROM x)
SELECT x, y, round(r, 6) AS r FROM m WHERE abs(r) >= 0.9""")  # fmt: skip
def strong_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of features that are as good as the same (AGG-21): |r| >= 0.90."""
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(q.alias("a"), F.col("l_extendedprice").alias("b"), (q * 2 + F.col("l_tax")).alias("c"), (-q).alias("d"))
    names = rows.columns
    each = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.corr(x, y).alias("r")) for i, x in enumerate(names) for y in names[i + 1 :]]
    pairs = rows.agg(F.array(*each).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    return pairs.where(F.abs("r") >= STRONG).withColumn("r", F.round("r", 6))


RANKED = "SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("l_quantity",
    "l_discount", "l_tax", "l_extendedprice")) + " FROM lineitem"


@query("spearman", f"WITH r AS ({RANKED}) " + MATRIX_SQL % (("r",) * len(PAIRS)))
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of average ranks (AGG-21, WIN-04). Ranks are running sums over
    the counts of distinct values, range-partitioned first, so no window holds all
    rows in one task: a partition adds the counts of those before it."""
    rows = table(spark, sf_dir, "lineitem").select(*FEATURES)
    for c in FEATURES:
        counts = running(rows.groupBy(c).agg(F.count("*").alias("n")), [c], {"before": "n"})
        ranks = counts.select(F.col(c).alias("v"), (F.col("before") + 1 + (F.col("n") - 1) / 2.0).alias(f"{c}_rank"))
        rows = rows.join(ranks, F.col(c) == F.col("v")).drop("v", c).withColumnRenamed(f"{c}_rank", c)
    return _matrix(rows)


@query("smd", f"""WITH {LONG_SQL}, s AS (SELECT label, feature, avg(x) AS m, var_samp(x) AS v FROM long GROUP BY label, feature)
SELECT a.feature, a.label AS label_a, b.label AS label_b, round(abs(a.m - b.m) / sqrt((a.v + b.v) / 2), 6) AS smd FROM s a JOIN s b ON a.feature =
  b.feature AND a.label < b.label""")  # fmt: skip
def smd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardized mean difference per feature and pair of classes (AGG-22)."""
    s = long_features(spark, sf_dir).groupBy("label", "feature").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    a, b = s.alias("a"), F.broadcast(s).alias("b")  # classes x features rows
    pairs = a.join(b, (F.col("a.feature") == F.col("b.feature")) & (F.col("a.label") < F.col("b.label")))
    return pairs.select("a.feature", F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b"),
        F.round(F.abs(F.col("a.m") - F.col("b.m")) / F.sqrt((F.col("a.v") + F.col("b.v")) / 2), 6).alias("smd"))


@query("smd_matrix", f"""WITH {LONG_SQL}, s AS (SELECT label, feature, avg(x) AS m, var_samp(x) AS v FROM long GROUP BY label, feature),
p AS (SELECT a.feature, a.label || '-' || b.label AS pair, round(abs(a.m - b.m) / sqrt((a.v + b.v) / 2), 6) AS smd FROM s a JOIN s b ON a.feature =
  b.feature AND a.label < b.label)
SELECT feature, max(smd) FILTER (pair = 'A-N') AS a_n, max(smd) FILTER (pair = 'A-R') AS a_r, max(smd) FILTER (pair = 'N-R') AS n_r, max(smd) AS
  largest FROM p GROUP BY feature""")  # fmt: skip
def smd_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differences as a matrix, a column for each pair of classes, and the largest of
    each feature (AGG-22)."""
    pairs = smd(spark, sf_dir).withColumn("pair", F.lower(F.concat_ws("_", "label_a", "label_b")))
    wide = pairs.groupBy("feature").pivot("pair", ["a_n", "a_r", "n_r"]).agg(F.max("smd"))
    return wide.withColumn("largest", F.greatest("a_n", "a_r", "n_r"))


@query("eta_squared", f"""WITH {LONG_SQL}, g AS (SELECT feature, label, count(*) AS n, avg(x) AS m FROM long GROUP BY feature, label), t AS (SELECT feature, avg(x) AS m,
  var_pop(x) * count(*) AS ss FROM long GROUP BY feature)
SELECT feature, round(sum(g.n * (g.m - t.m) * (g.m - t.m)) / any_value(t.ss), 6) AS eta2 FROM g JOIN t USING (feature) GROUP BY feature""")  # fmt: skip
def eta_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between-class share of variance, from one grouped pass (AGG-23)."""
    g = long_features(spark, sf_dir).groupBy("feature", "label").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    w = Window.partitionBy("feature")  # a row per class
    g = g.withColumn("all", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    between = F.sum(F.col("n") * (F.col("m") - F.col("all")) ** 2)
    return g.groupBy("feature").agg(F.round(between / (between + F.sum(F.col("n") * F.col("v"))), 6).alias("eta2"))


@query("zero_rates", f"WITH {LONG_SQL} SELECT feature, label, round(avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_rate, min(x) AS low, max(x) AS high FROM long GROUP BY feature, label")
def zero_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero rate and range by class (AGG-24)."""
    zero = F.round(F.avg(F.when(F.col("x") == 0, 1.0).otherwise(0.0)), 6).alias("zero_rate")
    return long_features(spark, sf_dir).groupBy("feature", "label").agg(zero, F.min("x").alias("low"), F.max("x").alias("high"))


@query("mutual_information", """WITH b AS (SELECT l_returnflag AS label, least(CAST(floor(l_quantity / 5) AS BIGINT), 9) AS bin FROM lineitem), j AS (SELECT label, bin, count(*) AS n
  FROM b GROUP BY 1, 2), t AS (SELECT sum(n) AS n FROM j),
l AS (SELECT label, sum(n) AS n FROM j GROUP BY 1), k AS (SELECT bin, sum(n) AS n FROM j GROUP BY 1)
SELECT 'l_quantity' AS feature, round(sum(j.n / t.n * ln(j.n * t.n / (l.n * k.n))), 6) AS mi FROM j CROSS JOIN t JOIN l USING (label) JOIN k USING
  (bin)""")  # fmt: skip
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information of a binned feature and the label (AGG-30)."""
    bin_ = F.least(F.floor(F.col("l_quantity") / 5), F.lit(9)).alias("bin")
    j = table(spark, sf_dir, "lineitem").groupBy(F.col(LABEL).alias("label"), bin_).agg(F.count("*").cast("double").alias("n"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # classes x bins rows
    t, of_l, of_k = F.sum("n").over(every), F.sum("n").over(Window.partitionBy("label")), F.sum("n").over(Window.partitionBy("bin"))
    part = j.select((F.col("n") / t * F.log(F.col("n") * t / (of_l * of_k))).alias("x"))
    return part.agg(F.round(F.sum("x"), 6).alias("mi")).select(F.lit("l_quantity").alias("feature"), "mi")


CONFUSION = """c AS (SELECT l_linestatus AS truth, CASE WHEN l_discount + l_tax >= 0.1 THEN 'F' ELSE 'O' END AS guess, count(*) AS n FROM lineitem GROUP BY 1, 2)"""


@query("classification_report", f"""WITH {CONFUSION}, k AS (SELECT DISTINCT truth AS label FROM c), m AS (
  SELECT label, CAST(coalesce(sum(n) FILTER (truth = label AND guess = label), 0) AS DOUBLE) AS tp, CAST(coalesce(sum(n) FILTER (truth <> label AND
    guess = label), 0) AS DOUBLE) AS fp,
    CAST(coalesce(sum(n) FILTER (truth = label AND guess <> label), 0) AS DOUBLE) AS fn, CAST(coalesce(sum(n) FILTER (truth <> label AND guess <>
      label), 0) AS DOUBLE) AS tn FROM k CROSS JOIN c GROUP BY label)
SELECT label, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tn / (tn +
  fp), 6) AS specificity,
  round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM m""")  # fmt: skip
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts and what follows from them, by class (AGG-27)."""
    guess = F.when(F.col("l_discount") + F.col("l_tax") >= 0.1, "F").otherwise("O")
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("truth"), guess.alias("guess")).agg(F.count("*").alias("n"))
    labels = sorted(r[0] for r in c.select("truth").distinct().collect())  # a row per class
    n = lambda t, g: F.sum(F.when(t & g, F.col("n")).otherwise(0)).cast("double")

    def counts(label):
        t, g = F.col("truth") == label, F.col("guess") == label
        return F.struct(F.lit(label).alias("label"), n(t, g).alias("tp"), n(~t, g).alias("fp"), n(t, ~g).alias("fn"), n(~t, ~g).alias("tn"))

    m = c.agg(F.array(*map(counts, labels)).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return m.select(
        "label", F.round(tp / (tp + fp), 6).alias("precision"), F.round(tp / (tp + fn), 6).alias("recall"),
            F.round(2 * tp / (2 * tp + fp + fn), 6).alias("f1"), F.round(tn / (tn + fp), 6).alias("specificity"),
        F.round((tp * tn - fp * fn) / F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6).alias("mcc"),
    )


SCORED = """x AS (SELECT l_linestatus AS truth, CASE WHEN l_discount + l_tax >= 0.1 THEN 'F' ELSE 'O' END AS guess, 0.05 + 0.9 * l_discount / 0.1 AS p, l_suppkey
  % 5 AS fold FROM lineitem)"""


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(truth, guess, p, fold): two classes, p the probability of `F`."""
    guess = F.when(F.col("l_discount") + F.col("l_tax") >= 0.1, "F").otherwise("O")
    p, fold = 0.05 + 0.9 * F.col("l_discount") / 0.1, (F.col("l_suppkey") % 5).alias("fold")
    return table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("truth"), guess.alias("guess"), p.alias("p"), fold)


def global_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Quality of two-class predictions (truth, guess, p) in one pass: accuracy, balanced
    accuracy, macro and weighted averages, MCC, kappa, log-loss and Brier score."""
    yes, said = F.col("truth") == "F", F.col("guess") == "F"
    n = lambda c, name: F.count_if(c).cast("double").alias(name)
    y = yes.cast("double")
    sure = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-15)), F.lit(1e-15))
    log_loss = -F.avg(y * F.log(sure) + (1 - y) * F.log(1 - sure)).alias("log_loss")
    c = rows.groupBy(*by).agg(n(yes & said, "tp"), n(~yes & said, "fp"), n(yes & ~said, "fn"), n(~yes & ~said, "tn"), log_loss.alias("log_loss"),
        (2 * F.avg((F.col("p") - y) ** 2)).alias("brier"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    total = tp + fp + fn + tn
    f1, f1_other = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    recall, recall_other = ratio(tp, tp + fn), ratio(tn, tn + fp)
    chance = ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (total * total)
    out = {
        "accuracy": (tp + tn) / total, "balanced_accuracy": (recall + recall_other) / 2, "precision_macro": (ratio(tp, tp + fp) + ratio(tn, tn + fn)) / 2,
        "recall_macro": (recall + recall_other) / 2, "f1_macro": (f1 + f1_other) / 2, "f1_weighted": (f1 * (tp + fn) + f1_other * (tn + fp)) / total,
        "mcc": (tp * tn - fp * fn) / F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), "kappa": ((tp + tn) / total - chance) / (1 - chance),
        "log_loss": F.col("log_loss"), "brier": F.col("brier"), "false_positive_rate": ratio(fp, fp + tn), "false_negative_rate": ratio(fn, fn + tp),
    }
    return c.select(*by, *[x.alias(name) for name, x in out.items()])


METRICS_SQL = """SELECT {by} tp / (tp + fn) AS recall, tn / (tn + fp) AS recall_other, (tp + tn) / n AS accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS
  balanced_accuracy, (tp / (tp + fp) + tn / (tn + fn)) / 2 AS precision_macro,
  (tp / (tp + fn) + tn / (tn + fp)) / 2 AS recall_macro, (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 AS f1_macro, (2 * tp / (2 *
    tp + fp + fn) * (tp + fn) + 2 * tn / (2 * tn + fp + fn) * (tn + fp)) / n AS f1_weighted,
  (tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)) AS mcc, 1 - (1 - (tp + tn) / n) / (1 - ((tp + fn) * (tp + fp)
    + (tn + fp) * (tn + fn)) / (n * n)) AS kappa, log_loss, brier, fp / (fp + tn) AS false_positive_rate, fn / (fn + tp) AS false_negative_rate
  FROM (SELECT {by} CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (truth = 'F' AND guess = 'F') AS DOUBLE) AS tp, CAST(count(*) FILTER (truth =
    'O' AND guess = 'F') AS DOUBLE) AS fp, CAST(count(*) FILTER (truth = 'F' AND guess = 'O') AS DOUBLE) AS fn, CAST(count(*) FILTER (truth = 'O' AND
    guess = 'O') AS DOUBLE) AS tn,
    avg(CASE truth WHEN 'F' THEN -ln(p) ELSE -ln(1 - p) END) AS log_loss, avg(CASE truth WHEN 'F' THEN 2 * (1 - p) * (1 - p) ELSE 2 * p * p END) AS
      brier FROM x {group})"""
METRICS = ("accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted", "mcc", "kappa", "log_loss", "brier",
    "false_positive_rate", "false_negative_rate")
SUMMARY = ("accuracy", "f1_macro", "mcc", "log_loss")


@query("global_metrics", f"WITH {SCORED} SELECT {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)} FROM ({METRICS_SQL.format(by='', group='')})")
def global_metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages, correlation, kappa, log-loss and Brier score (AGG-27)."""
    return global_metrics(scored_rows(spark, sf_dir)).select(*[F.round(m, 6).alias(m) for m in METRICS])


@query("fold_summary", f"WITH {SCORED}, m AS ({METRICS_SQL.format(by='fold,', group='GROUP BY fold')}) " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS sd, round(min({m}), 6) AS low, round(max({m}), 6) AS high FROM m" for m in SUMMARY
))
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each metric over folds: mean, deviation, least, greatest (AGG-28)."""
    folds = global_metrics(scored_rows(spark, sf_dir), "fold").unpivot("fold", list(SUMMARY), "metric", "v")
    r = lambda c, name: F.round(c, 6).alias(name)
    return folds.groupBy("metric").agg(r(F.avg("v"), "mean"), r(F.stddev_samp("v"), "sd"), r(F.min("v"), "low"), r(F.max("v"), "high"))


@query("datetime_quantiles",
    "SELECT o_orderstatus AS source, " + ", ".join(f"round(quantile_cont(epoch(o_orderdate), 0.{q}), 3) AS q{q}0" for q in range(1,
        10)) + " FROM orders GROUP BY 1")
def datetime_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date quantiles per source, q10 to q90 (AGG-31)."""
    seconds = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("x")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("source"), seconds)
    found = quantiles(rows, "source", "x", {f"q{q}0": q / 10 for q in range(1, 10)})
    return found.select("source", *[F.round(f"q{q}0", 3).alias(f"q{q}0") for q in range(1, 10)])


@query("partition_summaries", """WITH d AS (SELECT *, CASE WHEN ('0x' || substr(md5('split:' || coalesce(source, '')), 1, 8))::BIGINT % 10 < 7 THEN 'train' WHEN ('0x' ||
  substr(md5('split:' || coalesce(source, '')), 1, 8))::BIGINT % 10 < 8 THEN 'validation' ELSE 'test' END AS split FROM documents)
SELECT split, count(*) AS n_rows, count(DISTINCT source) AS n_groups, count(DISTINCT lang) AS n_labels, min(n_chars) AS low, max(n_chars) AS high,
  round(avg(n_chars), 4) AS mean, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM d), 6) AS share FROM d GROUP BY split""")  # fmt: skip
def partition_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, groups, labels and sizes of each partition of a data set (AGG-31)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("split:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("long") % 10
    split = F.when(h < 7, "train").when(h < 8, "validation").otherwise("test")
    parts = table(spark, sf_dir, "documents").groupBy(split.alias("split")).agg(
        F.count("*").alias("n_rows"), F.count_distinct("source").alias("n_groups"), F.count_distinct("lang").alias("n_labels"),
        F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.round(F.avg("n_chars"), 4).alias("mean"),
    )
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row per split
    return parts.withColumn("share", F.round(F.col("n_rows") / F.sum("n_rows").over(every), 6))


@query("label_totals", """WITH o AS (SELECT user_id AS sample_id, count(*) AS n, count(DISTINCT event_type) AS n_labels, min(ts) AS first_at FROM events GROUP BY 1)
SELECT c_custkey AS sample_id, coalesce(n, 0) AS n, coalesce(n_labels, 0) AS n_labels, first_at FROM customer LEFT JOIN o ON o.sample_id = c_custkey""")  # fmt: skip
def label_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations summed by sample before they are joined back to every sample
    (JOIN-17)."""
    sums = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sample_id")).agg(F.count("*").alias("n"),
        F.count_distinct("event_type").alias("n_labels"), F.min("ts").alias("first_at"))
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id")).join(sums, "sample_id", "left")
    return every.select("sample_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_labels", F.lit(0)).alias("n_labels"), "first_at")


@query("label_observations",
    "SELECT user_id AS sample_id, event_type AS label, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM events GROUP BY 1, 2")
def label_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last and count of each label observation (AGG-14, JOIN-17)."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sample_id"),
        F.col("event_type").alias("label")).agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("n"))
