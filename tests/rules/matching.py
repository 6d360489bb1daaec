"""Matching of software and the machine pipeline, on rows that exercise each rule. The
SQL states the rows that the rules must give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators import matching
from rules.base import query
from rules.fixtures import T0, expected, fixture, values
from vigilake.session import cut

PYPI, NPM = "github_advisory_pypi_exact_package_version_range_v1", "github_advisory_npm_exact_package_version_range_v1"
KEV = "cisa_kev_exact_vendor_product_v1"


@query("package_matches", expected(
    "component_id BIGINT, ghsa_id VARCHAR, cve_id VARCHAR, match_rule VARCHAR, version_range VARCHAR, severity VARCHAR",
    [
        (1, "GHSA-AAAA", "CVE-2026-0001", PYPI, ">= 1.0a1, < 1.2", "MEDIUM"),
        (1, "GHSA-BBBB", None, PYPI, "< 2", "HIGH"),
        (2, "GHSA-AAAA", "CVE-2026-0001", PYPI, "= 1.2.0", "MEDIUM"),
        (2, "GHSA-BBBB", None, PYPI, "< 2", "HIGH"),
        (3, "GHSA-CCCC", "CVE-2026-0002", NPM, "<= 2.0.0", "CRITICAL"),
        (5, "GHSA-EEEE", None, PYPI, "~= 1.0", "LOW"),
        (12, "GHSA-AAAA", "CVE-2026-0001", PYPI, ">= 1.0a1, < 1.2", "MEDIUM"),
        (12, "GHSA-BBBB", None, PYPI, "< 2", "HIGH"),
        (15, "GHSA-HHHH", "CVE-2026-0009", PYPI, ">= 3, != 3.0", "NONE"),
    ],
))
def package_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages inside the ranges of advisories (JOIN-07, FN-23, FN-25, FN-26, FLT-07)."""
    found = matching.package_matches(fixture(spark, "fx_components"), fixture(spark, "fx_advisories"))
    return found.select("component_id", "ghsa_id", "cve_id", "match_rule", "version_range", "severity")


@query("application_matches", f"""WITH {values("fx_components", "fx_catalog")},
n AS (SELECT component_id, lower(regexp_replace(trim(name), '\\s+', ' ', 'g')) AS name, lower(regexp_replace(trim(vendor), '\\s+', ' ', 'g')) AS
  vendor FROM fx_components WHERE component_type = 'application'),
c AS (SELECT DISTINCT upper(trim(cve_id)) AS cve_id, lower(regexp_replace(trim(vendor), '\\s+', ' ', 'g')) AS vendor,
  lower(regexp_replace(trim(product), '\\s+', ' ', 'g')) AS name FROM fx_catalog)
SELECT component_id, cve_id, '{KEV}' AS match_rule, 'potential' AS applicability FROM n JOIN c USING (vendor, name)""")  # fmt: skip
def application_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications by exact vendor and product, once for each vulnerability (JOIN-09)."""
    found = matching.application_matches(fixture(spark, "fx_components"), fixture(spark, "fx_catalog"))
    return found.select("component_id", "cve_id", "match_rule", "applicability")


def _package_matches(spark: SparkSession) -> DataFrame:
    found = matching.package_matches(fixture(spark, "fx_components"), fixture(spark, "fx_advisories"))
    return cut(matching.resolved(found, fixture(spark, "fx_identifiers")), "matches")


@query("match_resolution", expected(
    "component_id BIGINT, ghsa_id VARCHAR, vulnerability_id BIGINT, state VARCHAR",
    [
        (1, "GHSA-AAAA", 101, "resolved"), (1, "GHSA-BBBB", 101, "resolved"), (2, "GHSA-AAAA", 101, "resolved"), (2, "GHSA-BBBB", 101, "resolved"),
        (3, "GHSA-CCCC", 102, "resolved"), (5, "GHSA-EEEE", None, "unresolved"), (12, "GHSA-AAAA", 101, "resolved"), (12, "GHSA-BBBB", 101, "resolved"),
        (15, "GHSA-HHHH", None, "conflict"),
    ],
))
def match_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches to canonical records: resolved, not actionable, or in conflict (JOIN-10)."""
    return _package_matches(spark).select("component_id", "ghsa_id", "vulnerability_id", "state")


@query("reconciled_packages", expected(
    "component_id BIGINT, vulnerability_id BIGINT, match_rule VARCHAR, priority VARCHAR, is_kev BOOLEAN, first_day INTEGER, action VARCHAR",
    [
        (1, 101, PYPI, None, False, 0, "insert"), (2, 101, PYPI, "LOW", False, -9, "update"), (2, 102, NPM, "LOW", False, -8, "delete"),
        (3, 102, NPM, None, False, 0, "insert"), (5, 104, PYPI, None, False, -7, "exempt"), (9, 102, KEV, "HIGH", True, -6, "keep"),
        (9, 103, KEV, "HIGH", True, -6, "keep"), (10, 103, "manual", "MEDIUM", False, -5, "keep"), (12, 101, PYPI, None, False, 0, "insert"),
        (14, 104, "manual", "LOW", False, -4, "keep"),
    ],
))
def reconciled_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a package reconciliation does to each exposure (REC-01, AGG-12, SNK-10,
    SNK-12)."""
    at = F.lit(T0).cast("timestamp_ntz")
    after = matching.reconciled(fixture(spark, "fx_exposures"), _package_matches(spark), [PYPI, NPM], at)
    return after.select("component_id", "vulnerability_id", "match_rule", "priority", "is_kev",
        F.date_diff("first_detected_at", at).alias("first_day"), "action")


@query("reconciled_applications", expected(
    "component_id BIGINT, vulnerability_id BIGINT, match_rule VARCHAR, applicability VARCHAR, is_kev BOOLEAN, action VARCHAR",
    [
        (2, 101, PYPI, "confirmed", False, "keep"), (2, 102, NPM, "confirmed", False, "keep"), (5, 104, PYPI, "confirmed", False, "keep"),
        (9, 102, KEV, "potential", True, "delete"), (9, 103, KEV, "potential", True, "update"), (10, 103, "manual", "confirmed", True, "mark"),
        (14, 101, KEV, "potential", True, "insert"), (14, 104, "manual", "confirmed", False, "keep"),
    ],
))
def reconciled_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's reconciliation: potential only; exposures of other rules are kept
    and marked (REC-02)."""
    found = matching.resolved(matching.application_matches(fixture(spark, "fx_components"), fixture(spark, "fx_catalog")), fixture(spark, "fx_identifiers"))
    after = matching.reconciled(fixture(spark, "fx_exposures"), found, [KEV], F.lit(T0).cast("timestamp_ntz"), kev=True)
    return after.select("component_id", "vulnerability_id", "match_rule", "applicability", "is_kev", "action")


@query("selected_scores", f"""WITH {values("fx_scores")}, r AS (SELECT *, row_number() OVER (PARTITION BY vulnerability_id ORDER BY
  CASE version WHEN '4.0' THEN 0 WHEN '3.1' THEN 1 WHEN '3.0' THEN 2 WHEN '3.x' THEN 3 ELSE 4 END, CASE source_role WHEN 'VENDOR' THEN 0 WHEN 'CNA'
    THEN 0 WHEN 'NVD' THEN 1 WHEN 'ADP' THEN 1 WHEN 'THIRD_PARTY' THEN 2 ELSE 3 END,
  CASE source_role WHEN 'CNA' THEN 1 ELSE 0 END, coalesce(modified_at, published_at) DESC NULLS LAST, source_name, coalesce(vector, '')) AS n FROM
    fx_scores)
SELECT vulnerability_id, version, base_score, source_name, CASE WHEN base_score = 0 THEN 'NONE' WHEN base_score < 4 THEN 'LOW' WHEN base_score < 7
  THEN 'MEDIUM' WHEN base_score < 9 THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM r WHERE n = 1""")  # fmt: skip
def selected_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score by its seven-part key, and its severity (AGG-09, REC-03)."""
    return matching.selected_scores(fixture(spark, "fx_scores"))


def _signals(spark: SparkSession) -> DataFrame:
    return matching.priority_signals(fixture(spark, "fx_forecasts"), fixture(spark, "fx_weaknesses"))


@query("exposure_signals", f"""WITH {values("fx_forecasts", "fx_weaknesses")}, f AS (SELECT *, row_number() OVER (PARTITION BY vulnerability_id ORDER BY percentile DESC, score DESC,
  score_date DESC, cve_id DESC) AS n FROM fx_forecasts),
w AS (SELECT vulnerability_id, string_agg(DISTINCT cwe_id, ',' ORDER BY cwe_id) AS cwe_ids FROM fx_weaknesses GROUP BY 1)
SELECT vulnerability_id, f.score AS epss_score, f.percentile AS epss_percentile, w.cwe_ids FROM (SELECT * FROM f WHERE n = 1) f FULL JOIN w USING
  (vulnerability_id)""")  # fmt: skip
def exposure_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest forecast by (percentile, score, date, identifier) and the weaknesses
    of each record (AGG-10, AGG-11)."""
    return _signals(spark).withColumn("cwe_ids", F.array_join("cwe_ids", ","))


def _processed(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    names = ("fx_components", "fx_exposures", "fx_advisories", "fx_catalog", "fx_identifiers", "fx_scores")
    return matching.processed(*[fixture(spark, n) for n in names], _signals(spark), F.lit(T0).cast("timestamp_ntz"))


@query("processed_exposures", expected(
    "component_id BIGINT, vulnerability_id BIGINT, applicability VARCHAR, severity VARCHAR, priority VARCHAR, is_kev BOOLEAN",
    [
        # 101: 9.8 by the CNA, forecast 0.5, top weaknesses; 102: 5.0, the fresher and first by name, forecast at 0.90; 103: 0.0
        (1, 101, "confirmed", "CRITICAL", "CRITICAL", False), (2, 101, "confirmed", "CRITICAL", "CRITICAL", False),
            (3, 102, "confirmed", "MEDIUM", "HIGH", False),
        (5, 104, "confirmed", None, "MEDIUM", False), (9, 103, "potential", "NONE", "CRITICAL", True), (10, 103, "confirmed", "NONE", "CRITICAL", True),
        (12, 101, "confirmed", "CRITICAL", "CRITICAL", False), (14, 101, "potential", "CRITICAL", "CRITICAL", True),
            (14, 104, "confirmed", None, "MEDIUM", False),
    ],
))
def processed_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposures after the machine pipeline: packages, applications, severity, priority
    (REC-03, REC-04, REC-05)."""
    return _processed(spark)[0].select("component_id", "vulnerability_id", "applicability", "severity", "priority", "is_kev")


@query("processed_transitions", expected(
    "component_id BIGINT, vulnerability_id BIGINT, known BOOLEAN, kev_before BOOLEAN, kev_now BOOLEAN, priority_before VARCHAR, priority_now VARCHAR",
    [
        (1, 101, False, None, False, None, "CRITICAL"), (2, 101, True, False, False, "LOW", "CRITICAL"), (3, 102, False, None, False, None, "HIGH"),
        (5, 104, True, False, False, None, "MEDIUM"), (9, 103, True, True, True, "HIGH", "CRITICAL"), (10, 103, True, False, True, "MEDIUM", "CRITICAL"),
        (12, 101, False, None, False, None, "CRITICAL"), (14, 101, False, None, True, None, "CRITICAL"), (14, 104, True, False, False, "LOW", "MEDIUM"),
    ],
))
def processed_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before and after the machine pipeline (JOIN-14, REC-05)."""
    return _processed(spark)[1].drop("applicability")


@query("processed_alerts", expected(
    "dedup_key VARCHAR, alert_type VARCHAR, machine_id BIGINT, organization_id BIGINT, recipient_id BIGINT",
    [
        (f"alert/v1:{kind}:{exposure}:recipient:{to}", kind, machine, tenant, to)
        for kind, exposure, machine, tenant, contacts in (
            ("new_confirmed_critical_exposure", "1-101", 1, 10, (1, 6)), ("priority_transition_to_critical", "2-101", 1, 10, (1, 6)),
            ("confirmed_exposure_entered_kev", "10-103", 3, 20, (4,)), ("priority_transition_to_critical", "10-103", 3, 20, (4,)),
            ("new_confirmed_critical_exposure", "12-101", 3, 20, (4,)),
        )
        for to in contacts
    ],
))
def processed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the transitions for the active contacts of each tenant (FN-32, FLT-14,
    JOIN-03, JOIN-15)."""
    owners = fixture(spark, "fx_components").select("component_id", "machine_id", "organization_id")
    return matching.alerts(_processed(spark)[1], owners, fixture(spark, "fx_contacts"))


@query("alert_states", expected(
    "dedup_key VARCHAR, status VARCHAR",
    [
        ("alert/v1:confirmed_exposure_entered_kev:10-103:recipient:4", "sent"), ("old", "failed"), ("done", "sent"),
        ("alert/v1:new_confirmed_critical_exposure:1-101:recipient:1", "pending"), ("alert/v1:new_confirmed_critical_exposure:1-101:recipient:6", "pending"),
        ("alert/v1:priority_transition_to_critical:2-101:recipient:1", "pending"), ("alert/v1:priority_transition_to_critical:2-101:recipient:6", "pending"),
        ("alert/v1:priority_transition_to_critical:10-103:recipient:4", "pending"), ("alert/v1:new_confirmed_critical_exposure:12-101:recipient:4", "pending"),
    ],
))
def alert_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert table after insert-ignore and deliveries (SNK-15)."""
    raised = cut(processed_alerts(spark, sf_dir), "alerts")
    return matching.alert_states(fixture(spark, "fx_alerts"), raised, fixture(spark, "fx_delivered"))
