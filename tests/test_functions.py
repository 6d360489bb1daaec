"""Boundary tables of the scalar functions and policies."""

import pytest
from pyspark.sql import functions as F

from vigilake.functions import policies, text, unicode, urls, versions


def one(spark, f, *values, types=None):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types or ["string"] * len(values), strict=True))
    return spark.createDataFrame([tuple(values)], schema).select(f(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "expected"), [(" cve-2024-1234 ", "CVE-2024-1234"), ("CVE-24-1234", None), ("CVE-2024-123", None), (None, None)])
def test_cve(spark, given, expected):
    assert one(spark, text.cve, given) == expected


@pytest.mark.parametrize(("given", "expected"), [("79", "CWE-79"), ("cwe-0079", "CWE-79"), ("CWE-0", None), ("NVD-CWE-noinfo", None), (None, None)])
def test_cwe(spark, given, expected):
    assert one(spark, text.cwe, given) == expected


def test_ghsa(spark):
    assert one(spark, text.ghsa, "ghsa-23cf-gh4v-56pq") == "GHSA-23CF-GH4V-56PQ"
    assert one(spark, lambda c: text.ghsa(c, storage=True), "GHSA-23CF-GH4V-56PQ") == "GHSA-23cf-gh4v-56pq"
    assert one(spark, text.ghsa, "GHSA-aaaa-bbbb") is None


def test_cwe_from_text(spark):
    assert one(spark, text.cwe_from_text, "see [CWE-0089], (CWE-79)") == "CWE-89"
    assert one(spark, text.cwe_from_text, "nothing here") is None


@pytest.mark.parametrize(("given", "expected"), [("Yes", True), (" n ", False), ("1", True), ("maybe", None), (None, None)])
def test_flag(spark, given, expected):
    assert one(spark, text.flag, given) is expected


@pytest.mark.parametrize(("given", "expected"), [("12", 12), ("0", None), ("-3", None), ("1.5", None), ("99999999999999999999", None)])
def test_positive_id(spark, given, expected):
    assert one(spark, text.positive_id, given) == expected


@pytest.mark.parametrize(("given", "expected"), [("2024-02-29", "2024-02-29"), ("2023-02-29", None), ("2024-2-9", None)])
def test_strict_date(spark, given, expected):
    got = one(spark, text.strict_date, given)
    assert (str(got) if got else None) == expected


def test_times(spark):
    iso = lambda s: one(spark, lambda c: text.iso_utc(c).cast("string"), s)
    assert iso("2024-01-02T03:04:05Z") == "2024-01-02 03:04:05" and iso("2024-01-02T03:04:05+02:00") == "2024-01-02 01:04:05" and iso("2024-01-02T03:04:05") is None
    feed = lambda s: one(spark, lambda c: text.feed_timestamp(c).cast("string"), s)
    assert feed("2024-01-02 03:04:05 UTC") == "2024-01-02 03:04:05" and feed("2 January") is None


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("HTTP://Example.COM", "http://example.com/"), ("https://example.com.:443/a?B#C", "https://example.com/a?B#C"),
            ("http://example.com:8080/", "http://example.com:8080/"),
        ("https://u:p@example.com/", None), ("ftp://example.com/", None), ("http://exa mple.com/", None), ("http://example.com:/", None),
            ("javascript:alert(1)", None), ("http://a\\b/", None), (None, None), ("http:///x", None),
    ],
)
def test_canonical_url(spark, given, expected):
    assert one(spark, urls.canonical, given) == expected


def test_url_parts(spark):
    assert one(spark, lambda c: urls.group_key(urls.host(c)), "http://a.b.example.co.uk/") == "example.co.uk"
    assert one(spark, lambda c: urls.group_key(urls.host(c)), "http://10.1.2.3/") == "10.1.2.3"
    hidden = one(spark, urls.projection, "https://e.org/0a1b2c3d-0000-1111-2222-333344445555/me@x.org/abcdefghijklmnopqrstuvwxyz/z?q=1&r=2#top")
    assert hidden == "https://e.org/<uuid>/<email>/<token>/z?q=<value>&r=<value>#<fragment>"
    assert one(spark, urls.entropy, "aabb") == 1.0 and one(spark, urls.entropy, "") == 0.0


@pytest.mark.parametrize(("version", "bounds", "expected"), [("1.2.3", ">= 1.0, < 2.0", True), ("2.0", "< 2.0.0", False), ("1.10", "> 1.9", True),
    ("v3", "= 3.0", True), ("1.0rc1", ">= 0.1", True), ("1.0rc1", ">= 1.0", False), ("junk", ">= 0", False), ("1.0", "nonsense", False),
        (None, "< 2", False), ("1.0", None, False), ("1.0", "!= 1.0", False)])
def test_version_range(spark, version, bounds, expected):
    assert one(spark, versions.in_range, version, bounds) is expected


@pytest.mark.parametrize(("score", "version", "expected"), [(0.0, "3.1", "NONE"), (3.9, "3.1", "LOW"), (4.0, "3.1", "MEDIUM"), (7.0, "4.0", "HIGH"),
    (9.0, "3.0", "CRITICAL"), (9.0, "2.0", "HIGH"), (None, "3.1", None), (5.0, "9", None)])
def test_severity(spark, score, version, expected):
    assert one(spark, policies.severity, score, version, types=["double", "string"]) == expected


@pytest.mark.parametrize(
    ("severity", "kev", "percentile", "score", "weaknesses", "expected"),
    [
        (None, False, None, None, None, "LOW"), ("NONE", False, 0.89, 0.039, [], "LOW"), ("LOW", False, 0.90, None, [], "MEDIUM"),
            ("HIGH", False, 0.1, 0.04, [], "CRITICAL"), ("HIGH", False, None, None, ["CWE-79"], "HIGH"),
        ("LOW", True, None, None, [], "CRITICAL"), ("LOW", False, 0.95, None, ["CWE-79"], "HIGH"), ("MEDIUM", None, None, None, ["CWE-1"], "MEDIUM"),
            ("CRITICAL", False, 0.99, None, ["CWE-79"], "CRITICAL"),
    ],
)
def test_priority(spark, severity, kev, percentile, score, weaknesses, expected):
    assert one(spark, policies.priority, severity, kev, percentile, score, weaknesses,
        types=["string", "boolean", "double", "double", "array<string>"]) == expected


def test_alerts(spark):
    said = lambda *v: one(spark, policies.alert_types, *v, types=["string", "boolean", "boolean", "boolean", "string", "string"])
    assert said("confirmed", False, None, False, None, "CRITICAL") == ["new_confirmed_critical_exposure"]
    assert said("potential", False, None, True, None, "CRITICAL") == []
    assert said("confirmed", True, False, True, "HIGH", "CRITICAL") == ["confirmed_exposure_entered_kev", "priority_transition_to_critical"]
    assert said("confirmed", True, True, True, "CRITICAL", "CRITICAL") == []


def test_redaction(spark):
    said = "Bearer abc.def password=hunter2 at https://user:pw@host/x "
    out = one(spark, text.log_summary, said + "a" * 2000)
    assert "hunter2" not in out and "host" not in out and "abc.def" not in out and len(out) == 1000
    out = one(spark, text.redacted, said + "Authorization: Token t0 auth_key: k1; cve-2024-1")
    assert out == "Bearer abc.def password=[REDACTED] at https://user:[REDACTED]@host/x Authorization: [REDACTED] auth_key: [REDACTED]; [CVE_REDACTED]"


def test_every_version_and_range(spark):
    """Against the packaging library, over forms of versions and all kinds of bounds."""
    packaging = pytest.importorskip("packaging")
    from packaging.specifiers import InvalidSpecifier, SpecifierSet
    from packaging.version import InvalidVersion, Version

    assert packaging
    known = ["1.0", "1.0.0", "1.0rc1", "1.0.dev3", "1.0a1.dev2", "1.0.post1", "1.0-1", "v1.2.3", "1!0.5", "2.0.0-beta", "1.0+abc", "1.0+ABC_1", "1.2",
        "1.10", "1.0.post1.dev2", "junk", "1.0.x", "", "2", "1.0c1", "1.2.0.0.0", " 1.2 "]
    ranges = [f"{o} {v}" for o in ("<", "<=", ">", ">=", "==", "!=", "~=", "=") for v in known if v.strip()] + ["== 1.*", "!=1.0.*", "==1.2.*",
        ">= 1.0, < 2", "> 1.0,", "== 1.0 , != 1.0.post1", "1.0", ">=1.0rc1, <1.0"]

    def want(v, r):
        parts = [" ".join(p.split()) for p in r.split(",")]
        parts = ["==" + p[1:].lstrip() if p.startswith("=") and not p.startswith("==") else p for p in parts]
        try:
            return all(parts) and SpecifierSet(",".join(parts)).contains(Version(v), prereleases=True)
        except (InvalidVersion, InvalidSpecifier):
            return False

    rows = spark.createDataFrame([(v, r) for v in known for r in ranges], "v string, r string")
    got = rows.select("v", "r", versions.in_range(F.col("v"), F.col("r")).alias("x")).collect()
    assert [(r["v"], r["r"], r["x"]) for r in got if r["x"] != want(r["v"], r["r"])] == []


def test_every_top_weakness(spark):
    """The whole list raises a priority by one level, others do not."""
    ids = policies.TOP_WEAKNESSES
    others = ("CWE-119", "CWE-190", "CWE-269", "CWE-287", "CWE-400", "CWE-798", "CWE-7", "CWE-1")
    rows = spark.createDataFrame([(i,) for i in (*ids, *others)], "id string")
    priority = policies.priority(F.lit("LOW"), F.lit(False), F.lit(None).cast("double"), F.lit(None).cast("double"), F.array("id"))
    raised = {r["id"] for r in rows.select("id", priority.alias("p")).collect() if r["p"] == "MEDIUM"}
    assert raised == set(ids) and len(ids) == 25


def test_small_forms(spark):
    assert one(spark, lambda c: text.catalog_id(c, "CAPEC"), "capec-0066") == "CAPEC-66" and one(spark, lambda c: text.catalog_id(c, "CWE"), "0") is None
    assert one(spark, text.cwe_from_text, "NVD-CWE-Other") is None and one(spark, text.cwe_from_text, "79") == "CWE-79"
    assert one(spark, lambda c: text.strict(c, 3), "abcd") == "too_long" and one(spark, lambda c: text.strict(c, 3), "  ") == "missing" and one(spark,
        lambda c: text.strict(c, 3), "abc") is None
    assert one(spark, policies.source_severity, "none") == "NONE" and one(spark, policies.source_severity, "unknown") is None
    assert one(spark, policies.verdict, "benign") == "benign" and one(spark, policies.verdict, "phishing") == "malicious" and one(spark,
        policies.verdict, None) is None
    assert one(spark, text.package_name, "Foo_Bar", "pip") == "foo-bar" and one(spark, text.ecosystem, " PIP ") == "pypi"
    assert [one(spark, unicode.network, x) for x in ("10.1.2.3/8", "2001:DB8::0:1", "1.2.3.4", "300.1.1.1", "x")] == ["10.0.0.0/8", "2001:db8::1",
        "1.2.3.4", None, None]


def test_package_names(spark):
    assert one(spark, text.package_name, " Foo__Bar.baz ", "PyPI") == "foo-bar-baz" and one(spark, text.package_name, "Foo_Bar", "npm") == "foo_bar"
    assert one(spark, policies.cvss_version, "CVSS:3.1/AV:N") == "3.1" and one(spark, policies.cvss_version, "cvss_v4") == "4.0" and one(spark,
        policies.cvss_version, "x") is None
