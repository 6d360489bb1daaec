"""Canonical records from observations, on rows that exercise each rule. The SQL states
the rows that the rules must give.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators import canonical
from rules.base import query
from rules.fixtures import day, expected, fixture, values


def _correlated(spark: SparkSession) -> canonical.Canonical:
    names = ("fx_observations", "fx_stored_identifiers", "fx_stored_records", "fx_stored_evidence")
    return canonical.correlated(*[fixture(spark, n) for n in names])


# k1, a1 (both), a2 share identifiers, and a2 is stored evidence of record 12 (whose row is gone);
# e1 and a5 share a CVE and reach record 7; a3 is known as record 10.
@query("correlated_records", expected(
    "component VARCHAR, vulnerability_id BIGINT, created_at TIMESTAMP, updated_at TIMESTAMP, status VARCHAR, n_evidence BIGINT",
    [
        ("r1", 12, day(2), day(7), "active", 3), ("r7", 7, day(-20), day(9), "active", 2), ("r5", 10, day(-20), day(2), "provisional", 1),
    ],
))
def correlated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a batch: identity, times, state (ER-01, ER-03, ER-05, ER-08)."""
    return _correlated(spark).records


@query("correlated_identifiers", expected(
    "component VARCHAR, identifier VARCHAR, is_primary BOOLEAN",
    [
        ("r1", "CVE-2026-0100", True), ("r1", "GHSA-1111", False), ("r1", "GHSA-2222", False),
        ("r7", "CVE-2026-0200", False), ("r7", "CVE-2026-0201", True), ("r5", "GHSA-3333", True),
    ],
))
def correlated_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of each record and its one primary: a stored CVE stays, a stored
    identifier that is no CVE gives way (ER-03, SNK-05)."""
    return _correlated(spark).identifiers


@query("correlated_conflicts", expected(
    "component VARCHAR, vulnerability_ids VARCHAR, reason VARCHAR", [("r9", "8,9", "several_records"), ("ra", "11", "terminal_record")],
))
def correlated_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that touch several stored records or one in a terminal state (ER-02)."""
    return _correlated(spark).conflicts


@query("correlated_rejects", expected("record_id VARCHAR, reason VARCHAR", [("r6", "withdrawn")]))
def correlated_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Withdrawn advisories are refused (ER-05)."""
    return _correlated(spark).rejects


@query("merged_evidence", f"""WITH {values("fx_observations")}, f AS (SELECT *, coalesce(last_observed_at, observed_at) AS seen,
  row_number() OVER (PARTITION BY source, record_key ORDER BY coalesce(last_observed_at, observed_at) DESC, modified_at DESC NULLS LAST, record_id
    DESC, evidence_type DESC, rule DESC, confidence DESC, coalesce(record_hash, '') DESC) AS n FROM fx_observations)
SELECT source, record_key, max(record_id) FILTER (n = 1) AS record_id, max(confidence) FILTER (n = 1) AS confidence, min(observed_at) AS observed_at,
  max(seen) AS last_observed_at,
  min(published_at) AS published_at, max(modified_at) AS modified_at, coalesce(max(record_hash) FILTER (n = 1), max(record_hash)) AS record_hash FROM
    f GROUP BY source, record_key""")  # fmt: skip
def merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by seven fields of freshness (ER-04, SNK-05)."""
    columns = ["source", "record_key", "record_id", "confidence", "observed_at", "last_observed_at", "published_at", "modified_at", "record_hash"]
    return canonical.merged_evidence(fixture(spark, "fx_observations")).select(*columns)


NOW = day(10)


def _web(spark: SparkSession) -> canonical.Canonical:
    return canonical.web_correlated(fixture(spark, "fx_web"), fixture(spark, "fx_web_stored"), F.lit(NOW).cast("timestamp_ntz"))


@query("web_records", expected(
    "canonical_url VARCHAR, indicator_id BIGINT, created_at TIMESTAMP, updated_at TIMESTAMP, n_observations BIGINT",
    [
        ("http://example.com/a", 1, day(-3), day(99), 2), ("http://xn--bcher-kva.example/ä", None, NOW, NOW, 1),
            ("http://[2001:db8::1]:8080/", None, NOW, NOW, 1),
    ],
))
def web_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators by URL identity, created when first seen here (ER-07, ER-09, SNK-07,
    FN-13)."""
    return _web(spark).records.drop("value_hash")


@query("web_evidence", expected(
    "source VARCHAR, record_key VARCHAR, record_id VARCHAR, active BOOLEAN, label VARCHAR, observed_at TIMESTAMP, last_observed_at TIMESTAMP",
    [
        ("phish", "p1", "02", False, "phishing", day(1), day(6)), ("malware", "m1", "03", True, "malware_distribution", day(2), day(6)),
        ("phish", "p3", "06", True, "phishing", day(5), day(5)), ("phish", "p4", "07", True, "phishing", day(5), day(5)),
    ],
))
def web_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of each source record: the newest wins, times widen (ER-06, ER-10)."""
    return _web(spark).evidence.drop("value_hash")


@query("web_conflicts", expected(
    "source VARCHAR, record_key VARCHAR, reason VARCHAR", [("malware", "m2", "two_identities"), ("malware", "m6", "moved_to_another_url")],
))
def web_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source records with two identities, or stored under another one (ER-07, ER-09)."""
    return _web(spark).conflicts


FORECAST = "vulnerability_id long, cve_id string, score double, percentile double, score_date date, synchronized_at timestamp_ntz"


@query("accepted_forecasts", expected(
    "vulnerability_id BIGINT, cve_id VARCHAR, score DOUBLE, score_date DATE, synchronized_at TIMESTAMP, replaced BOOLEAN",
    [
        (1, "CVE-1", 0.2, dt.date(2026, 1, 3), day(3), True),  # newer date
        (2, "CVE-2", 0.5, dt.date(2026, 1, 2), day(9), False),  # same date, but nothing differs
        (3, "CVE-3", 0.6, dt.date(2026, 1, 2), day(9), True),  # same date, newer, differs
        (4, "CVE-4", 0.5, dt.date(2026, 1, 2), day(5), False),  # same date, older
        (5, "CVE-5", 0.5, dt.date(2026, 1, 2), day(5), False),  # older date
        (6, "CVE-6", 0.8, dt.date(2026, 1, 2), day(4), True),  # new; the latest of the batch
        (7, "CVE-7", None, dt.date(2026, 1, 2), day(5), False),  # only stored
    ],
))
def accepted_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts replaced by date, then by synchronization if a value differs (SNK-04)."""
    d = lambda n: dt.date(2026, 1, n)
    stored = [(1, "CVE-1", 0.1, 0.1, d(2), day(2)), (2, "CVE-2", 0.5, 0.5, d(2), day(9)), (3, "CVE-3", 0.5, 0.5, d(2), day(5)),
        (4, "CVE-4", 0.5, 0.5, d(2), day(5)), (5, "CVE-5", 0.5, 0.5, d(2), day(5)), (7, "CVE-7", None, None, d(2), day(5))]
    incoming = [(1, "CVE-1", 0.2, 0.1, d(3), day(3)), (2, "CVE-2", 0.5, 0.5, d(2), day(10)), (3, "CVE-3", 0.6, 0.5, d(2), day(9)),
        (4, "CVE-4", 0.9, 0.5, d(2), day(4)), (5, "CVE-5", 0.9, 0.5, d(1), day(9)), (6, "CVE-6", 0.7, 0.5, d(1), day(9)), (6, "CVE-6", 0.8, 0.5, d(2), day(4))]
    return canonical.accepted_forecasts(spark.createDataFrame(stored, FORECAST), spark.createDataFrame(incoming, FORECAST)).drop("percentile")


WEAKNESS = "vulnerability_id long, cwe_id string, source string, observed_at timestamp_ntz, last_observed_at timestamp_ntz, source_modified_at timestamp_ntz"


@query("merged_weaknesses", expected(
    "vulnerability_id BIGINT, cwe_id VARCHAR, source VARCHAR, observed_at TIMESTAMP, last_observed_at TIMESTAMP, source_modified_at TIMESTAMP",
    [
        (1, "CWE-79", "new", day(1), day(5), None), (1, "CWE-89", "old", day(2), day(6), day(8)),
        (2, "CWE-20", "new", day(3), day(3), None), (3, "CWE-22", "old", day(1), day(2), None),
    ],
))
def merged_weaknesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Associations by recency, incoming wins ties, times null-safe (SNK-09)."""
    stored = [(1, "CWE-79", "old", day(2), day(5), None), (1, "CWE-89", "old", day(2), day(3), day(8)), (3, "CWE-22", "old", day(1), day(2), None)]
    incoming = [(1, "CWE-79", "new", day(1), day(5), None), (1, "CWE-89", "new", day(4), day(6), None), (2, "CWE-20", "new", day(3), day(3), None)]
    return canonical.merged_weaknesses(spark.createDataFrame(stored, WEAKNESS), spark.createDataFrame(incoming, WEAKNESS))
