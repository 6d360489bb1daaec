"""Small tables with the shapes of the engine's own, for queries whose rules the star
schema cannot exercise: identifiers, versions, ranges, states and clocks. The same rows
stand in the SQL, so a query and its SQL see the same input.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

T0 = dt.datetime(2026, 1, 1)


def day(n: float) -> dt.datetime:
    return T0 + dt.timedelta(days=n)


TABLES: dict[str, tuple[str, list[tuple]]] = {
    "fx_components": (
        "component_id long, machine_id long, organization_id long, component_type string, ecosystem string, name string, vendor string, version string",
        [
            (1, 1, 10, "package", "pypi", "Foo_Bar", None, "1.0rc1"),
            (2, 1, 10, "package", "pip", "foo-bar", None, "1.2.0"),
            (3, 1, 10, "package", "npm", "Left-Pad", None, "2.0.0-beta"),
            (4, 2, 10, "package", "PyPI", "foo.bar", None, "1!0.5"),
            (5, 2, 10, "package", "pypi", "other", None, "1.0.0.post1"),
            (6, 2, 10, "package", "maven", "foo-bar", None, "1.0"),
            (7, 2, 10, "package", "pypi", "foo-bar", None, None),
            (8, 2, 10, "package", "pypi", "foo-bar", None, "not a version"),
            (9, 1, 10, "application", None, "Widget  Server", " ACME Corp ", "9"),
            (10, 3, 20, "application", None, "widget server", "acme corp", None),
            (11, 3, 20, "application", None, "widget server", None, "9"),
            (12, 3, 20, "package", "pypi", "ｆｏｏ＿ｂａｒ", None, "1.1"),
            (13, 3, 20, "package", "npm", "left_pad", None, "1.0"),
            (14, 3, 20, "application", None, "gadget", "acme corp", "1"),
            (15, 3, 20, "package", "pypi", "third", None, "3.1"),
        ],
    ),
    "fx_advisories": (
        "ghsa_id string, cve_id string, ecosystem string, package_name string, version_range string, first_patched string, severity string",
        [
            ("GHSA-AAAA", "cve-2026-0001", "pip", "Foo_Bar", ">= 1.0a1, < 1.2", "1.2", "moderate"),
            ("GHSA-AAAA", "cve-2026-0001", "pip", "Foo_Bar", "= 1.2.0", "1.2.1", "moderate"),
            ("ghsa-bbbb", None, "pip", "foo-bar", "< 2", None, "HIGH"),
            ("GHSA-CCCC", "CVE-2026-0002", "npm", "left-pad", "<= 2.0.0", None, "critical"),
            ("GHSA-DDDD", None, "pip", "other", "> 1.0.0", None, "unknown"),
            ("GHSA-EEEE", None, "pip", "other", "~= 1.0", "2.0", "low"),
            ("GHSA-FFFF", None, "maven", "foo-bar", "< 2", None, "high"),
            ("GHSA-GGGG", None, "pip", "foo-bar", ">= 1.0,", None, "high"),
            ("GHSA-HHHH", "CVE-2026-0009", "pip", "third", ">= 3, != 3.0", None, "none"),
        ],
    ),
    "fx_catalog": (
        "cve_id string, vendor string, product string",
        [("CVE-2026-0003", "Acme Corp", "Widget Server"), (" cve-2026-0003", "ACME  corp", "widget server"), ("CVE-2026-0001", "acme corp", "Gadget"),
            ("CVE-2026-0007", "acme", "widget server")],
    ),
    "fx_identifiers": (
        "identifier string, vulnerability_id long, status string",
        [
            ("CVE-2026-0001", 101, "active"), ("GHSA-AAAA", 101, "active"), ("GHSA-BBBB", 101, "active"), ("CVE-2026-0002", 102, "provisional"),
            ("GHSA-CCCC", 102, "provisional"), ("CVE-2026-0003", 103, "active"), ("GHSA-EEEE", 104, "withdrawn"), ("GHSA-HHHH", 105, "active"),
                ("CVE-2026-0009", 106, "active"),
        ],
    ),
    "fx_exposures": (
        "component_id long, vulnerability_id long, match_rule string, applicability string, severity string, priority string, is_kev boolean, first_detected_at timestamp_ntz",
        [
            (2, 101, "github_advisory_pypi_exact_package_version_range_v1", "confirmed", "LOW", "LOW", False, day(-9)),
            (2, 102, "github_advisory_npm_exact_package_version_range_v1", "confirmed", "LOW", "LOW", False, day(-8)),
            (5, 104, "github_advisory_pypi_exact_package_version_range_v1", "confirmed", None, None, False, day(-7)),
            (9, 103, "cisa_kev_exact_vendor_product_v1", "potential", "HIGH", "HIGH", True, day(-6)),
            (9, 102, "cisa_kev_exact_vendor_product_v1", "potential", "HIGH", "HIGH", True, day(-6)),
            (10, 103, "manual", "confirmed", "LOW", "MEDIUM", False, day(-5)),
            (14, 104, "manual", "confirmed", None, "LOW", False, day(-4)),
        ],
    ),
    "fx_scores": (
        "vulnerability_id long, version string, base_score double, source_name string, source_role string, vector string, published_at timestamp_ntz, modified_at timestamp_ntz",
        [
            (101, "3.1", 5.0, "nvd", "NVD", "v1", day(1), None), (101, "3.1", 9.8, "cna", "CNA", "v2", day(1), day(2)),
                (101, "2.0", 10.0, "maker", "VENDOR", None, day(9), None),
            (102, "3.x", 8.0, "nvd", "NVD", None, None, None), (102, "3.x", 6.0, "nvd", "NVD", None, day(1), None),
                (102, "3.x", 5.0, "adp", "ADP", None, day(1), day(1)),
            (103, "4.0", 0.0, "maker", "VENDOR", "v", None, None), (103, "4.0", 0.0, "cna", "CNA", "v", day(5), None),
        ],
    ),
    "fx_forecasts": (
        "vulnerability_id long, cve_id string, score double, percentile double, score_date date",
        [(101, "CVE-2026-0001", 0.5, 0.89, dt.date(2026, 1, 2)), (101, "CVE-2026-0001", 0.01, 0.89, dt.date(2026, 1, 3)),
            (102, "CVE-2026-0002", 0.01, 0.90, dt.date(2026, 1, 1)), (104, "CVE-2026-0004", 0.039, 0.1, dt.date(2026, 1, 1))],
    ),
    "fx_weaknesses": (
        "vulnerability_id long, cwe_id string",
        [(101, "CWE-639"), (101, "CWE-79"), (101, "CWE-79"), (102, "CWE-287"), (104, "CWE-770"), (105, "CWE-120")],
    ),
    "fx_contacts": (
        "recipient_id long, organization_id long, role string, active boolean, created_at timestamp_ntz",
        [(1, 10, "security_responsible", True, day(3)), (2, 10, "security_responsible", False, day(1)), (3, 10, "viewer", True, day(1)),
            (4, 20, "security_responsible", True, day(2)), (5, 20, "security_responsible", None, day(2)), (6, 10, "security_responsible", True, day(1))],
    ),
    "fx_alerts": (
        "dedup_key string, status string",
        [("alert/v1:confirmed_exposure_entered_kev:10-103:recipient:4", "failed"), ("old", "pending"), ("done", "sent")],
    ),
    "fx_delivered": ("dedup_key string, ok boolean", [("alert/v1:confirmed_exposure_entered_kev:10-103:recipient:4", True), ("old", False), ("done", False)]),
    "fx_observations": (
        "record_key string, source string, identifiers array<string>, observed_at timestamp_ntz, last_observed_at timestamp_ntz, published_at timestamp_ntz, modified_at timestamp_ntz, record_id string, evidence_type string, rule string, confidence double, record_hash string, withdrawn boolean",
        [
            ("k1", "kev", ["CVE-2026-0100"], day(5), day(6), None, None, "r1", "catalog", "exact", 1.0, "h1", False),
            ("a1", "advisory", ["CVE-2026-0100", "GHSA-1111"], day(3), None, day(1), day(4), "r2", "advisory", "exact", 1.0, None, False),
            ("a1", "advisory", ["GHSA-1111"], day(4), day(7), day(2), day(3), "r3", "advisory", "exact", 0.9, "h3", False),
            ("a2", "advisory", ["GHSA-2222", "GHSA-1111"], day(2), day(7), None, None, "r4", "advisory", "exact", 0.8, None, False),
            ("a3", "advisory", ["GHSA-3333"], day(2), None, None, None, "r5", "advisory", "exact", 1.0, None, False),
            ("a4", "advisory", ["GHSA-4444"], day(2), None, None, None, "r6", "advisory", "exact", 1.0, None, True),
            ("e1", "epss", ["CVE-2026-0200"], day(8), None, None, None, "r7", "forecast", "exact", 1.0, None, False),
            ("a5", "advisory", ["CVE-2026-0200", "CVE-2026-0201"], day(8), None, None, None, "r8", "advisory", "exact", 1.0, None, False),
            ("a6", "advisory", ["CVE-2026-0300", "GHSA-6666"], day(1), None, None, None, "r9", "advisory", "exact", 1.0, None, False),
            ("k2", "kev", ["CVE-2026-0400"], day(1), None, None, None, "ra", "catalog", "exact", 1.0, None, False),
        ],
    ),
    "fx_stored_identifiers": (
        "identifier string, vulnerability_id long, is_primary boolean",
        [("CVE-2026-0201", 7, True), ("CVE-2026-0300", 8, True), ("GHSA-6666", 9, True), ("GHSA-3333", 10, True), ("CVE-2026-0400", 11, True)],
    ),
    "fx_stored_records": (
        "vulnerability_id long, status string, created_at timestamp_ntz, updated_at timestamp_ntz",
        [(7, "active", day(-20), day(9)), (8, "active", day(-20), day(0)), (9, "active", day(-20), day(0)), (10, "provisional", day(-20), day(1)),
            (11, "rejected", day(-20), day(1))],
    ),
    "fx_stored_evidence": ("record_key string, source string, vulnerability_id long", [("a2", "advisory", 12)]),
    "fx_web": (
        "source string, record_key string, url string, submitted_at timestamp_ntz, verified_at timestamp_ntz, normalized_at timestamp_ntz, last_observed_at timestamp_ntz, record_id string, threat string, active boolean",
        [
            ("phish", "p1", "HTTP://Example.com:80/a", day(1), day(2), day(3), day(4), "01", None, True),
            ("phish", "p1", "http://example.com/a", None, day(1.5), day(3), day(6), "02", None, False),
            ("malware", "m1", "http://example.com/a", None, None, day(2), day(6), "03", "malware_download", True),
            ("malware", "m2", "http://example.com/b?x=1", None, None, day(2), None, "04", "malware_download", None),
            ("malware", "m2", "http://example.com/b?x=2", None, None, day(3), None, "05", "malware_download", True),
            ("phish", "p3", "http://bücher.example/ä", day(5), None, day(6), None, "06", None, True),
            ("phish", "p4", "http://[2001:DB8:0:0::1]:8080/", day(5), None, day(6), None, "07", None, True),
            ("phish", "p5", "http://user@example.com/", day(5), None, day(6), None, "08", None, True),
            ("malware", "m6", "http://moved.example/new", None, None, day(2), None, "09", "t", True),
        ],
    ),
    "fx_web_stored": (
        "source string, record_key string, url string, indicator_id long, created_at timestamp_ntz, updated_at timestamp_ntz",
        [("phish", "p0", "http://example.com/a", 1, day(-3), day(99)), ("malware", "m6", "http://moved.example/old", 2, day(-3), day(-1))],
    ),
}


def fixture(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


_SQL_TYPES = {"long": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
    "array<string>": "VARCHAR[]"}


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(_literal, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def values(*names: str) -> str:
    """The tables as common table expressions for SQL."""
    out = []
    for name in names:
        schema, rows = TABLES[name]
        columns = [c.split() for c in schema.split(", ")]
        cast = ", ".join(f"CAST({c} AS {_SQL_TYPES[t]}) AS {c}" for c, t in columns)
        body = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
        out.append(f"{name} AS (SELECT {cast} FROM (VALUES {body}) AS v({', '.join(c for c, _ in columns)}))")
    return ", ".join(out)


def expected(columns: str, rows: list[tuple]) -> str:
    """SQL of rows that are known beforehand; `columns` as `name TYPE`."""
    named = [c.split() for c in columns.split(", ")]
    cast = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in named)
    body = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
    return f"SELECT {cast} FROM (VALUES {body}) AS v({', '.join(c for c, _ in named)})"
