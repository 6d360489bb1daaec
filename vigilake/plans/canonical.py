"""Canonical records over observations derived from the star schema, and the same in SQL.

Each part is a vulnerability that several feeds report; one in ten shares an advisory
with its neighbour, some records are stored already, some of them have ended, and some
advisories are withdrawn. The SQL knows from the numbers which belong together.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators import canonical
from vigilake.plans.base import query
from vigilake.plans.derived import _text as text
from vigilake.plans.url_dataset import CANON
from vigilake.session import table

T0 = dt.datetime(2026, 1, 1)


def after(days: Column | int) -> Column:
    """A time some days after the start."""
    days = F.lit(days) if isinstance(days, int) else days
    return F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(days.cast("int"))


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("p_partkey"), table(spark, sf_dir, "part")
    cve, ghsa = text("CVE-2026-", k + 10_000), text("GHSA-", k)
    none, day = F.lit(None).cast("timestamp_ntz"), k % 30

    def row(where: str, source: str, key: Column, ids: Column, letter: str, shift: int, last: Column, hashed: Column, withdrawn: bool = False) -> DataFrame:
        return p.where(where).select(
            key.alias("record_key"), F.lit(source).alias("source"), ids.alias("identifiers"), after(day + shift).alias("observed_at"), last.alias("last_observed_at"),
            F.when(k % 2 == 0, after(day)).alias("published_at"), F.when(k % 3 == 0, after(day + 3)).alias("modified_at"), text("r", k, letter).alias("record_id"),
            F.lit(source).alias("evidence_type"), F.lit("exact").alias("rule"), (F.col("p_size") / 50).alias("confidence"), hashed.alias("record_hash"),
            F.lit(withdrawn).alias("withdrawn"),
        )

    both = F.when((k % 3 != 0) | (k % 4 == 0), F.array(cve, ghsa)).otherwise(F.array(ghsa))
    nothing = F.lit(None).cast("string")
    return (
        row("p_partkey % 4 = 0", "kev", text("k", k), F.array(cve), "k", 5, none, text("h", k))
        .unionByName(row("true", "advisory", text("a", k), both, "a", 3, F.when(k % 5 == 1, after(day + 9)).otherwise(none), nothing))
        .unionByName(row("p_partkey % 2 = 0", "advisory", text("a", k), F.array(ghsa), "b", 4, after(day + 7), text("h", k)))
        .unionByName(row("p_partkey % 10 = 0", "advisory", text("s", k), F.array(ghsa, text("GHSA-", k + 1)), "s", 2, none, nothing))
        .unionByName(row("p_partkey % 7 = 0", "advisory", text("w", k), F.array(text("GHSA-w", k)), "w", 1, none, nothing, True))
    )


OBSERVED = """base AS (SELECT p_partkey AS k, p_partkey % 30 AS day, p_size / 50 AS confidence, 'CVE-2026-' || (p_partkey + 10000) AS cve, 'GHSA-' || p_partkey AS ghsa,
  CASE WHEN p_partkey % 10 = 1 THEN p_partkey - 1 ELSE p_partkey END AS g, TIMESTAMP '2026-01-01' AS t0 FROM part),
o AS (SELECT g, k, 'k' || k AS record_key, 'kev' AS source, [cve] AS ids, t0 + to_days(CAST(day + 5 AS INTEGER)) AS observed_at, NULL AS last_observed_at, 'r' || k || 'k' AS record_id FROM base WHERE k % 4 = 0
  UNION ALL SELECT g, k, 'a' || k, 'advisory', CASE WHEN k % 3 <> 0 OR k % 4 = 0 THEN [cve, ghsa] ELSE [ghsa] END, t0 + to_days(CAST(day + 3 AS INTEGER)),
    CASE WHEN k % 5 = 1 THEN t0 + to_days(CAST(day + 9 AS INTEGER)) END, 'r' || k || 'a' FROM base
  UNION ALL SELECT g, k, 'a' || k, 'advisory', [ghsa], t0 + to_days(CAST(day + 4 AS INTEGER)), t0 + to_days(CAST(day + 7 AS INTEGER)), 'r' || k || 'b' FROM base WHERE k % 2 = 0
  UNION ALL SELECT g, k, 's' || k, 'advisory', [ghsa, 'GHSA-' || (k + 1)], t0 + to_days(CAST(day + 2 AS INTEGER)), NULL, 'r' || k || 's' FROM base WHERE k % 10 = 0),
stored_ids AS (SELECT g, k AS vulnerability_id, cve AS identifier FROM base WHERE k % 5 = 0 UNION ALL SELECT g, k + 1000000, ghsa FROM base WHERE k % 20 = 1),
stored AS (SELECT k AS vulnerability_id, CASE WHEN k % 15 = 0 THEN 'rejected' WHEN k % 2 = 1 THEN 'active' ELSE 'provisional' END AS status, t0 - INTERVAL 20 DAY AS created_at,
  t0 + to_days(CAST(k % 40 AS INTEGER)) AS updated_at FROM base WHERE k % 5 = 0),
named AS (SELECT g, min(record_id) AS component, bool_or(source = 'kev') AS kev, min(observed_at) AS first, max(coalesce(last_observed_at, observed_at)) AS last,
  count(DISTINCT record_key) AS n_evidence FROM o GROUP BY g),
touched AS (SELECT g, list_sort(list(DISTINCT vulnerability_id)) AS ids FROM stored_ids GROUP BY g),
judged AS (SELECT n.*, t.ids, s.vulnerability_id, s.status, s.created_at, s.updated_at, CASE WHEN len(t.ids) > 1 THEN 'several_records'
  WHEN s.status = 'rejected' THEN 'terminal_record' END AS reason FROM named n LEFT JOIN touched t USING (g) LEFT JOIN stored s ON s.vulnerability_id = t.ids[1]),
good AS (SELECT * FROM judged WHERE reason IS NULL),
each AS (SELECT component, identifier, max(was) AS was FROM (SELECT g, unnest(ids) AS identifier, 0 AS was FROM o UNION ALL SELECT g, identifier, 1 FROM stored_ids) JOIN good USING (g) GROUP BY 1, 2)"""


def _correlated(spark: SparkSession, sf_dir: str) -> canonical.Canonical:
    k, p = F.col("p_partkey"), table(spark, sf_dir, "part")
    ids = p.where("p_partkey % 5 = 0").select(text("CVE-2026-", k + 10_000).alias("identifier"), k.alias("vulnerability_id"), F.lit(True).alias("is_primary"))
    ids = ids.unionByName(p.where("p_partkey % 20 = 1").select(text("GHSA-", k).alias("identifier"), (k + 1_000_000).alias("vulnerability_id"), F.lit(True).alias("is_primary")))
    status = F.when(k % 15 == 0, "rejected").when(k % 2 == 1, "active").otherwise("provisional")
    records = p.where("p_partkey % 5 = 0").select(k.alias("vulnerability_id"), status.alias("status"), after(-20).alias("created_at"), after(k % 40).alias("updated_at"))
    evidence = p.where("p_partkey % 5 = 0").select(text("a", k).alias("record_key"), F.lit("advisory").alias("source"), k.alias("vulnerability_id"))
    return canonical.correlated(_observations(spark, sf_dir), ids, records, evidence)


@query("correlated_records", f"""WITH {OBSERVED} SELECT component, vulnerability_id, coalesce(created_at, first) AS created_at, greatest(last, updated_at) AS updated_at,
  CASE WHEN kev OR coalesce(status = 'active', false) THEN 'active' ELSE 'provisional' END AS status, n_evidence FROM good""")  # fmt: skip
def correlated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a batch: identity, times, state (ER-01, ER-03, ER-05, ER-08)."""
    return _correlated(spark, sf_dir).records


@query("correlated_identifiers", f"""WITH {OBSERVED} SELECT component, identifier, row_number() OVER (PARTITION BY component
  ORDER BY NOT starts_with(identifier, 'CVE-'), was DESC, identifier) = 1 AS is_primary FROM each""")  # fmt: skip
def correlated_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of each record and its one primary: a stored CVE stays, a stored
    identifier that is no CVE gives way (ER-03, SNK-05)."""
    return _correlated(spark, sf_dir).identifiers


@query("correlated_conflicts", f"WITH {OBSERVED} SELECT component, array_to_string(ids, ',') AS vulnerability_ids, reason FROM judged WHERE reason IS NOT NULL")
def correlated_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that touch several stored records or one in a terminal state (ER-02)."""
    return _correlated(spark, sf_dir).conflicts


@query("correlated_rejects", "SELECT 'r' || p_partkey || 'w' AS record_id, 'withdrawn' AS reason FROM part WHERE p_partkey % 7 = 0")
def correlated_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Withdrawn advisories are refused (ER-05)."""
    return _correlated(spark, sf_dir).rejects


EVIDENCE = ["source", "record_key", "record_id", "confidence", "observed_at", "last_observed_at", "published_at", "modified_at", "record_hash"]


@query("merged_evidence", """WITH o AS (SELECT l_returnflag AS source, l_partkey AS record_key, l_orderkey || '-' || l_linenumber AS record_id, l_discount AS confidence,
  l_shipdate AS observed_at, CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate + to_days(CAST(l_suppkey % 50 AS INTEGER)) END AS last_observed_at, CASE WHEN l_linenumber > 3 THEN l_shipdate END AS published_at,
  CASE WHEN l_suppkey % 3 = 0 THEN l_shipdate + to_days(CAST(l_linenumber AS INTEGER)) END AS modified_at, CASE WHEN l_tax > 0.04 THEN 'h' || l_suppkey END AS record_hash FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY source, record_key ORDER BY coalesce(last_observed_at, observed_at) DESC, modified_at DESC NULLS LAST, record_id DESC, confidence DESC,
    coalesce(record_hash, '') DESC) AS n,
  row_number() OVER (PARTITION BY source, record_key, record_hash IS NULL ORDER BY coalesce(last_observed_at, observed_at) DESC, modified_at DESC NULLS LAST, record_id DESC, confidence DESC,
    coalesce(record_hash, '') DESC) AS hashed FROM o)
SELECT source, record_key, max(record_id) FILTER (n = 1) AS record_id, max(confidence) FILTER (n = 1) AS confidence, CAST(min(observed_at) AS TIMESTAMP) AS observed_at,
  max(coalesce(last_observed_at, observed_at)) AS last_observed_at, CAST(min(published_at) AS TIMESTAMP) AS published_at, max(modified_at) AS modified_at,
  max(record_hash) FILTER (hashed = 1) AS record_hash FROM f GROUP BY source, record_key""")  # fmt: skip
def merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by seven fields of freshness (ER-04, SNK-05)."""
    line, ship = F.col("l_linenumber"), F.col("l_shipdate").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("source"), F.col("l_partkey").alias("record_key"), F.concat_ws("-", F.col("l_orderkey").cast("string"), line.cast("string")).alias("record_id"),
        F.col("l_discount").alias("confidence"), ship.alias("observed_at"), F.when(line % 2 == 0, ship + F.make_dt_interval((F.col("l_suppkey") % 50).cast("int"))).alias("last_observed_at"),
        F.when(line > 3, ship).alias("published_at"), F.when(F.col("l_suppkey") % 3 == 0, ship + F.make_dt_interval(line)).alias("modified_at"),
        F.when(F.col("l_tax") > 0.04, text("h", F.col("l_suppkey"))).alias("record_hash"), F.lit("advisory").alias("evidence_type"), F.lit("exact").alias("rule"),
    )
    return canonical.merged_evidence(rows).select(*EVIDENCE)


NOW = T0 + dt.timedelta(days=10)


def _web(spark: SparkSession, sf_dir: str) -> canonical.Canonical:
    """Pages as threat observations: of every twenty, two are one source record."""
    k = F.col("page_id")
    source = F.when(k % 3 == 0, "phish").otherwise("malware")
    key = F.when(k % 20 < 2, F.floor(k / 20)).otherwise(k + 1_000_000).cast("string")
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.when(k % 20 < 2, "malware").otherwise(source).alias("source"), key.alias("record_key"))
    seen = F.when(k % 4 != 0, after(k % 9))
    rows = p.select(
        "source", "record_key", F.when(k % 4 == 1, F.concat(F.lit("  "), F.regexp_replace("url", "^https", "HTTPS"))).otherwise(F.col("url")).alias("url"),
        seen.alias("submitted_at"), F.when(k % 2 == 0, after(3)).alias("verified_at"), after(4).alias("normalized_at"), F.when(k % 5 == 2, after(k % 20)).alias("last_observed_at"),
        k.cast("string").alias("record_id"), F.lit("t").alias("threat"), (k % 2 == 0).alias("active"),
    )
    stored = p.where("page_id % 20 >= 2 AND page_id % 5 = 0").select("source", "record_key", F.when(k % 25 == 0, F.concat("url", F.lit("/old"))).otherwise(F.col("url")).alias("url"),
        k.alias("indicator_id"), after(-3).alias("created_at"), after(k % 30).alias("updated_at"))
    return canonical.web_correlated(rows, stored, F.lit(NOW).cast("timestamp_ntz"))


WEB = f"""WITH {CANON},
w AS (SELECT page_id AS k, canonical_url AS u, CASE WHEN page_id % 20 < 2 OR page_id % 3 <> 0 THEN 'malware' ELSE 'phish' END AS source,
  CAST(CASE WHEN page_id % 20 < 2 THEN page_id // 20 ELSE page_id + 1000000 END AS VARCHAR) AS record_key, TIMESTAMP '2026-01-01' AS t0 FROM c),
r AS (SELECT *, CASE WHEN k % 4 <> 0 THEN t0 + to_days(CAST(k % 9 AS INTEGER)) WHEN k % 2 = 0 THEN t0 + INTERVAL 3 DAY ELSE t0 + INTERVAL 4 DAY END AS observed_at,
  CASE WHEN k % 5 = 2 THEN t0 + to_days(CAST(k % 20 AS INTEGER)) END AS last FROM w),
s AS (SELECT source, record_key, CASE WHEN k % 25 = 0 THEN u || '/old' ELSE u END AS u, k AS indicator_id, t0 - INTERVAL 3 DAY AS created_at, t0 + to_days(CAST(k % 30 AS INTEGER)) AS updated_at
  FROM w WHERE k % 20 >= 2 AND k % 5 = 0),
seen AS (SELECT source, record_key, count(DISTINCT u) AS n FROM (SELECT source, record_key, u FROM r UNION ALL SELECT source, record_key, u FROM s) GROUP BY 1, 2),
bad AS (SELECT source, record_key, CASE WHEN (source, record_key) IN (SELECT (source, record_key) FROM s) THEN 'moved_to_another_url' ELSE 'two_identities' END AS reason FROM seen WHERE n > 1),
fine AS (SELECT r.*, greatest(coalesce(last, observed_at), observed_at) AS last_observed_at FROM r ANTI JOIN bad USING (source, record_key))"""


@query("web_records", f"""{WEB}, n AS (SELECT u, count(DISTINCT (source, record_key)) AS n_observations FROM fine GROUP BY u),
old AS (SELECT u, min(indicator_id) AS indicator_id, min(created_at) AS created_at, max(updated_at) AS updated_at FROM s GROUP BY u)
SELECT u AS canonical_url, indicator_id, coalesce(created_at, TIMESTAMP '{NOW}') AS created_at, greatest(coalesce(created_at, TIMESTAMP '{NOW}'), TIMESTAMP '{NOW}', updated_at) AS updated_at,
  n_observations FROM n LEFT JOIN old USING (u)""")  # fmt: skip
def web_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators by URL identity, created when first seen here (ER-07, ER-09, SNK-07,
    FN-13)."""
    return _web(spark, sf_dir).records.drop("value_hash")


@query("web_evidence", f"""{WEB} SELECT source, record_key, arg_max(CAST(k AS VARCHAR), (last_observed_at, CAST(k AS VARCHAR))) AS record_id,
  arg_max(k % 2 = 0, (last_observed_at, CAST(k AS VARCHAR))) AS active, CASE source WHEN 'phish' THEN 'phishing' ELSE 'malware_distribution' END AS label,
  min(observed_at) AS observed_at, max(last_observed_at) AS last_observed_at FROM fine GROUP BY u, source, record_key""")  # fmt: skip
def web_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of each source record: the newest wins, times widen (ER-06, ER-10)."""
    return _web(spark, sf_dir).evidence.drop("value_hash")


@query("web_conflicts", f"{WEB} SELECT source, record_key, reason FROM bad")
def web_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source records with two identities, or stored under another one (ER-07, ER-09)."""
    return _web(spark, sf_dir).conflicts


@query("accepted_forecasts", """WITH stored AS (SELECT p_partkey AS vulnerability_id, p_size / 500 AS score, p_size / 250 AS percentile, DATE '2026-01-02' AS score_date,
  TIMESTAMP '2026-01-01' + to_days(CAST(p_partkey % 50 AS INTEGER)) AS synchronized_at FROM part WHERE p_partkey % 5 <> 0),
incoming AS (SELECT l_partkey AS vulnerability_id, l_quantity / 500 AS score, l_quantity / 250 AS percentile, DATE '2026-01-01' + (l_linenumber % 3) AS score_date,
  TIMESTAMP '2026-01-01' + to_days(CAST(l_suppkey % 50 AS INTEGER)) AS synchronized_at FROM lineitem WHERE l_linenumber < 3 AND l_suppkey % 7 = 0),
latest AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY vulnerability_id ORDER BY score_date DESC, synchronized_at DESC, score DESC) = 1),
b AS (SELECT coalesce(s.vulnerability_id, n.vulnerability_id) AS vulnerability_id, s.vulnerability_id IS NULL OR (n.vulnerability_id IS NOT NULL AND (n.score_date > s.score_date OR
    (n.score_date = s.score_date AND n.synchronized_at >= s.synchronized_at AND n.score <> s.score))) AS replaced, s.score AS a, n.score AS c, s.score_date AS sd, n.score_date AS nd,
    s.synchronized_at AS ss, n.synchronized_at AS ns FROM stored s FULL JOIN latest n ON s.vulnerability_id = n.vulnerability_id)
SELECT vulnerability_id, 'CVE-' || vulnerability_id AS cve_id, CASE WHEN replaced THEN c ELSE a END AS score, CAST(CASE WHEN replaced THEN nd ELSE sd END AS DATE) AS score_date,
  CASE WHEN replaced THEN ns ELSE ss END AS synchronized_at, replaced FROM b""")  # fmt: skip
def accepted_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts replaced by date, then by synchronization if a value differs (SNK-04)."""

    def of(rows: DataFrame, key: str, score: Column, date: Column, days: Column) -> DataFrame:
        return rows.select(F.col(key).alias("vulnerability_id"), text("CVE-", F.col(key)).alias("cve_id"), (score / 500).alias("score"), (score / 250).alias("percentile"),
            date.alias("score_date"), after(days).alias("synchronized_at"))

    first = F.lit(dt.date(2026, 1, 1))
    stored = of(table(spark, sf_dir, "part").where("p_partkey % 5 <> 0"), "p_partkey", F.col("p_size"), F.date_add(first, 1), F.col("p_partkey") % 50)
    incoming = of(table(spark, sf_dir, "lineitem").where("l_linenumber < 3 AND l_suppkey % 7 = 0"), "l_partkey", F.col("l_quantity"), F.date_add(first, F.col("l_linenumber") % 3),
        F.col("l_suppkey") % 50)
    return canonical.accepted_forecasts(stored, incoming).drop("percentile")


@query("merged_weaknesses", """WITH b AS (SELECT p_partkey AS vulnerability_id, 'CWE-' || (p_partkey % 9) AS cwe_id, 'old' AS source, TIMESTAMP '1998-01-01' AS observed_at,
    TIMESTAMP '1999-01-01' + to_days(CAST(p_size * 20 AS INTEGER)) AS last_observed_at, CASE WHEN p_size % 2 = 0 THEN TIMESTAMP '1999-06-01' END AS source_modified_at, 0 AS new FROM part
  UNION ALL SELECT l_partkey, 'CWE-' || (l_suppkey % 9), 'line ' || l_linenumber, l_shipdate, l_shipdate + INTERVAL 30 DAY, CASE WHEN l_linenumber = 2 THEN l_shipdate + INTERVAL 5 DAY END, 1 FROM lineitem)
SELECT vulnerability_id, cwe_id, arg_max(source, (coalesce(source_modified_at, last_observed_at), new, source)) AS source, min(observed_at) AS observed_at,
  max(last_observed_at) AS last_observed_at, max(source_modified_at) AS source_modified_at FROM b GROUP BY 1, 2""")  # fmt: skip
def merged_weaknesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Associations by recency, incoming wins ties, times null-safe (SNK-09)."""
    at = lambda s: F.lit(dt.datetime.fromisoformat(s)).cast("timestamp_ntz")
    k, size, ship = F.col("p_partkey"), F.col("p_size"), F.col("l_shipdate").cast("timestamp_ntz")
    stored = table(spark, sf_dir, "part").select(k.alias("vulnerability_id"), text("CWE-", k % 9).alias("cwe_id"), F.lit("old").alias("source"), at("1998-01-01").alias("observed_at"),
        (at("1999-01-01") + F.make_dt_interval(size * 20)).alias("last_observed_at"), F.when(size % 2 == 0, at("1999-06-01")).alias("source_modified_at"))
    incoming = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("vulnerability_id"), text("CWE-", F.col("l_suppkey") % 9).alias("cwe_id"), text("line ", F.col("l_linenumber")).alias("source"), ship.alias("observed_at"),
        (ship + F.make_dt_interval(F.lit(30))).alias("last_observed_at"), F.when(F.col("l_linenumber") == 2, ship + F.make_dt_interval(F.lit(5))).alias("source_modified_at"),
    )
    return canonical.merged_weaknesses(stored, incoming)
