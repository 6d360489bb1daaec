"""The engine's own tables derived from the star schema, and the same in SQL.

orders = software components, part = advisories, identifiers and the known-exploited
catalog, lineitem = scores, forecasts and weaknesses, supplier = contacts. Names,
ecosystems, versions and ranges take the forms that feeds have: mixed case, odd white
space, all kinds of releases, several bounds, ids that belong to two records. The SQL
never reads a version as text: it compares the numbers that the text was made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.session import table

PYPI, NPM = "github_advisory_pypi_exact_package_version_range_v1", "github_advisory_npm_exact_package_version_range_v1"
KEV = "cisa_kev_exact_vendor_product_v1"
#: Suffixes of a version by kind of row, and where they put it: epoch, a further part,
#: order among versions of one release.
KINDS = (("", 0, 0, 3), ("rc1", 0, 0, 2), (".post1", 0, 0, 4), (".dev3", 0, 0, 0), ("a2", 0, 0, 1), (".0.0.0.0.0.0.0.0.0.0.7", 0, 7, 3), ("!", 1, 0, 3))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _package(key: Column) -> Column:
    """One package in fifty is the same, and so is very frequent."""
    return F.when(key % 50 == 0, 0).otherwise(key)


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key, order = table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_orderkey")
    application = F.col("o_orderpriority") == "5-LOW"
    name = F.when(application, _text("Widget  ", key)).otherwise(_text(F.when(order % 2 == 0, "Lib_").otherwise("lib-"), _package(key)))
    plain = _text(F.floor(F.col("o_totalprice") / 100_000), ".", F.dayofmonth("o_orderdate") % 10)
    kind = order % len(KINDS)
    version = plain
    for n, (suffix, _, _, _) in enumerate(KINDS):
        version = F.when(kind == n, _text("1!", plain) if suffix == "!" else _text(plain, suffix)).otherwise(version)
    ecosystem = F.when(F.col("o_orderstatus") == "F", "pip").when(F.col("o_orderstatus") == "O", " npm ").otherwise("Maven")
    return o.select(
        order.alias("component_id"), key.alias("machine_id"), (key % 7).alias("organization_id"),
        F.when(application, "application").otherwise("package").alias("component_type"), ecosystem.alias("ecosystem"), name.alias("name"),
        F.when(order % 9 != 0, _text(" ACME  ", key % 5, " Corp ")).alias("vendor"), F.when(order % 31 != 0, version).alias("version"),
    )


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two affected ranges of each part."""
    key, major, minor = F.col("p_partkey"), F.floor(F.col("p_size") / 10), F.col("p_size") % 10
    low, high = _text(major, ".", minor), _text(major + 1 + key % 3, ".", minor)
    first = (F.when(key % 5 == 0, _text(">= ", low, ", < ", high)).when(key % 5 == 1, _text("<= ", low)).when(key % 5 == 2, _text("> ", low))
        .when(key % 5 == 3, _text("= ", low, ".*")).otherwise(_text(">= ", low, ", != ", low)))
    second = _text("= ", key % 5, ".", key % 10, ".0")
    severity = F.get(F.array(*map(F.lit, ("low", "moderate", " HIGH", "critical"))), (F.col("p_size") % 4).cast("int"))
    return table(spark, sf_dir, "part").select(
        _text("ghsa-", key).alias("ghsa_id"), F.when(key % 3 != 0, _text(" cve-2024-", key + 10_000)).alias("cve_id"),
        F.when(key % 2 == 0, "PyPI").otherwise("npm").alias("ecosystem"), _text("LIB-", _package(key)).alias("package_name"),
        F.explode(F.array(first, second)).alias("version_range"), F.when(key % 4 == 0, high).alias("first_patched"), severity.alias("severity"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").where("p_size % 3 = 0").select(_text("CVE-2024-", key + 10_000).alias("cve_id"), _text("acme ", key % 5, " corp").alias("vendor"),
        _text("WIDGET ", key).alias("product"))


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's advisory, and its CVE where it has one; one in eleven advisories
    belongs to the record of the next part."""
    key, p = F.col("p_partkey"), table(spark, sf_dir, "part")
    status = F.when(key % 13 == 0, "withdrawn").when(key % 2 == 0, "active").otherwise("provisional").alias("status")
    cve = p.select(_text("CVE-2024-", key + 10_000).alias("identifier"), key.alias("vulnerability_id"), status)
    return cve.unionByName(p.select(_text("GHSA-", key).alias("identifier"), F.when(key % 11 == 0, key + 1).otherwise(key).alias("vulnerability_id"), status))


def stored_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("o_orderkey")
    rule = F.get(F.array(*map(F.lit, (PYPI, NPM, KEV, "manual"))), (order % 4).cast("int"))
    priority = F.when(order % 5 == 0, "LOW").when(order % 5 == 1, "MEDIUM").when(order % 5 == 2, "HIGH")
    return table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(
        order.alias("component_id"), F.col("o_custkey").alias("vulnerability_id"), rule.alias("match_rule"), F.when(order % 4 == 2, "potential").otherwise("confirmed").alias("applicability"),
        F.lit(None).cast("string").alias("severity"), priority.alias("priority"), (order % 4 == 2).alias("is_kev"), F.col("o_orderdate").cast("timestamp_ntz").alias("first_detected_at"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score that comes twice counts once: the best of a vulnerability is the same."""
    line, role = F.col("l_linenumber"), F.array(*map(F.lit, ("NVD", "CNA", "ADP", "VENDOR", "THIRD_PARTY")))
    version = F.get(F.array(*map(F.lit, ("3.1", "4.0", "3.0", "3.x", "2.0"))), (F.col("l_suppkey") % 5).cast("int"))
    price = F.round(F.col("l_extendedprice") * 100).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("vulnerability_id"), version.alias("version"), (F.col("l_quantity") / 5).alias("base_score"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), line.cast("string")).alias("source_name"), F.get(role, line % 5).alias("source_role"),
        F.when(line % 2 == 0, price.cast("string")).alias("vector"), F.when(line != 3, F.col("l_shipdate")).cast("timestamp_ntz").alias("published_at"),
        F.when(F.col("l_discount") > 0.05, F.col("l_shipdate")).cast("timestamp_ntz").alias("modified_at"),
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_suppkey % 4 = 0").select(
        F.col("l_partkey").alias("vulnerability_id"), _text("CVE-2024-", F.col("l_partkey") + 10_000).alias("cve_id"), (F.col("l_discount") / 2).alias("score"),
        (F.col("l_tax") * 12).alias("percentile"), F.col("l_shipdate").cast("date").alias("score_date"))


def weaknesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("vulnerability_id"), _text("CWE-", F.col("l_suppkey") * 2).alias("cwe_id"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.alias("recipient_id"), (key % 7).alias("organization_id"),
        F.when(key % 3 == 0, "viewer").otherwise("security_responsible").alias("role"), F.when(key % 5 != 0, key % 4 != 0).alias("active"),
        F.col("s_acctbal").alias("created_at"))


_KIND = " ".join(f"WHEN {n} THEN {{}}" for n in range(len(KINDS)))


def _kind(place: int) -> str:
    return "CASE o_orderkey % 7 " + _KIND.format(*[k[place] for k in KINDS]) + " END"


_VERSION = "CASE o_orderkey % 7 " + " ".join(f"WHEN {n} THEN " + ("'1!' || v" if k[0] == "!" else f"v || '{k[0]}'") for n, k in enumerate(KINDS)) + " END"
_PACKAGE = "CASE WHEN {k} % 50 = 0 THEN 0 ELSE {k} END"
#: The same tables in SQL; of a version and a range, the numbers that they are made of.
CTES = {
    "components": f"""components AS (SELECT o_orderkey AS component_id, o_custkey AS machine_id, o_custkey % 7 AS organization_id,
  o_orderpriority = '5-LOW' AS application, CASE o_orderstatus WHEN 'F' THEN 'pypi' WHEN 'O' THEN 'npm' END AS ecosystem,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'widget ' || o_custkey WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'F' THEN 'lib_' || ({_PACKAGE.format(k="o_custkey")})
    ELSE 'lib-' || ({_PACKAGE.format(k="o_custkey")}) END AS name,
  CASE WHEN o_orderkey % 9 <> 0 THEN 'acme ' || (o_custkey % 5) || ' corp' END AS vendor, CASE WHEN o_orderkey % 31 <> 0 THEN {_VERSION} END AS version,
  [{_kind(1)}, major, minor, {_kind(2)}] AS release, [{_kind(1)}, major, minor, {_kind(2)}, {_kind(3)}] AS placed
  FROM (SELECT *, CAST(floor(o_totalprice / 100000) AS INTEGER) AS major, day(o_orderdate) % 10 AS minor,
    CAST(floor(o_totalprice / 100000) AS INTEGER) || '.' || (day(o_orderdate) % 10) AS v FROM orders))""",
    "advisories": f"""parts AS (SELECT *, p_partkey AS k, CAST(p_size // 10 AS INTEGER) AS major, CAST(p_size % 10 AS INTEGER) AS minor, (p_size // 10) || '.' || (p_size % 10) AS low,
    (p_size // 10 + 1 + p_partkey % 3) || '.' || (p_size % 10) AS high FROM part),
ranges AS (SELECT k, k % 5 AS kind, major, minor, CASE k % 5 WHEN 0 THEN '>= ' || low || ', < ' || high WHEN 1 THEN '<= ' || low WHEN 2 THEN '> ' || low WHEN 3 THEN '= ' || low || '.*'
    ELSE '>= ' || low || ', != ' || low END AS version_range FROM parts
  UNION ALL SELECT k, 5, k % 5, k % 10, '= ' || (k % 5) || '.' || (k % 10) || '.0' FROM parts),
advisories AS (SELECT 'GHSA-' || k AS ghsa_id, CASE WHEN k % 3 <> 0 THEN 'CVE-2024-' || (k + 10000) END AS cve_id, CASE WHEN k % 2 = 0 THEN 'pypi' ELSE 'npm' END AS ecosystem,
  'lib-' || ({_PACKAGE.format(k="k")}) AS name, r.version_range, kind, r.major, r.minor, (p_size // 10 + 1 + k % 3) AS next_major,
  (['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[1 + p_size % 4] AS severity FROM ranges r JOIN parts p USING (k))""",
    "package_matches": f"""package_hits AS (SELECT c.component_id, a.ghsa_id, a.cve_id, CASE c.ecosystem WHEN 'pypi' THEN '{PYPI}' ELSE '{NPM}' END AS match_rule, 'confirmed' AS applicability,
  c.version AS match_version, a.version_range, a.severity, row_number() OVER (PARTITION BY c.component_id, a.ghsa_id ORDER BY coalesce(a.cve_id, ''), a.version_range) AS n
  FROM components c JOIN advisories a ON a.ecosystem = c.ecosystem AND a.name = c.name AND NOT c.application AND c.version IS NOT NULL AND CASE a.kind
    WHEN 0 THEN c.placed >= [0, a.major, a.minor, 0, 3] AND c.release < [0, a.next_major, a.minor, 0]
    WHEN 1 THEN c.placed <= [0, a.major, a.minor, 0, 3]
    WHEN 2 THEN c.release > [0, a.major, a.minor, 0]
    WHEN 3 THEN c.release[:3] = [0, a.major, a.minor]
    WHEN 4 THEN c.placed > [0, a.major, a.minor, 0, 3]
    ELSE c.placed = [0, a.major, a.minor, 0, 3] END),
package_matches AS (SELECT * EXCLUDE (n) FROM package_hits WHERE n = 1)""",
    "application_matches": f"""application_matches AS (SELECT component_id, 'CVE-2024-' || (p_partkey + 10000) AS cve_id, CAST(NULL AS VARCHAR) AS ghsa_id, '{KEV}' AS match_rule,
  'potential' AS applicability, CAST(NULL AS VARCHAR) AS severity FROM components JOIN part ON p_size % 3 = 0 AND application AND name = 'widget ' || p_partkey AND vendor = 'acme ' || (p_partkey % 5) || ' corp')""",
    "identifiers": """identifiers AS (SELECT 'CVE-2024-' || (p_partkey + 10000) AS identifier, p_partkey AS vulnerability_id,
    CASE WHEN p_partkey % 13 = 0 THEN 'withdrawn' WHEN p_partkey % 2 = 0 THEN 'active' ELSE 'provisional' END AS status FROM part
  UNION ALL SELECT 'GHSA-' || p_partkey, CASE WHEN p_partkey % 11 = 0 THEN p_partkey + 1 ELSE p_partkey END,
    CASE WHEN p_partkey % 13 = 0 THEN 'withdrawn' WHEN p_partkey % 2 = 0 THEN 'active' ELSE 'provisional' END FROM part)""",
    "stored": f"""stored AS (SELECT o_orderkey AS component_id, o_custkey AS vulnerability_id, (['{PYPI}', '{NPM}', '{KEV}', 'manual'])[1 + o_orderkey % 4] AS match_rule,
  CASE WHEN o_orderkey % 4 = 2 THEN 'potential' ELSE 'confirmed' END AS applicability, CASE o_orderkey % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' END AS priority,
  o_orderkey % 4 = 2 AS is_kev, CAST(o_orderdate AS TIMESTAMP) AS first_detected_at FROM orders WHERE o_orderkey % 3 = 0)""",
    "selected": """scores AS (SELECT DISTINCT l_partkey AS vulnerability_id, (['3.1', '4.0', '3.0', '3.x', '2.0'])[1 + l_suppkey % 5] AS version, l_quantity / 5 AS base_score,
  l_orderkey || '-' || l_linenumber AS source_name, (['NVD', 'CNA', 'ADP', 'VENDOR', 'THIRD_PARTY'])[1 + l_linenumber % 5] AS source_role,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) END AS vector, CASE WHEN l_linenumber <> 3 THEN l_shipdate END AS published_at,
  CASE WHEN l_discount > 0.05 THEN l_shipdate END AS modified_at FROM lineitem),
ordered_scores AS (SELECT *, row_number() OVER (PARTITION BY vulnerability_id ORDER BY CASE version WHEN '4.0' THEN 0 WHEN '3.1' THEN 1 WHEN '3.0' THEN 2 WHEN '3.x' THEN 3 ELSE 4 END,
  CASE source_role WHEN 'VENDOR' THEN 0 WHEN 'CNA' THEN 0 WHEN 'NVD' THEN 1 WHEN 'ADP' THEN 1 ELSE 2 END, CASE source_role WHEN 'CNA' THEN 1 ELSE 0 END,
  coalesce(modified_at, published_at) DESC NULLS LAST, source_name, coalesce(vector, '')) AS n FROM scores),
selected AS (SELECT vulnerability_id, version, base_score, source_name, CASE WHEN version = '2.0' THEN CASE WHEN base_score < 4 THEN 'LOW' WHEN base_score < 7 THEN 'MEDIUM' ELSE 'HIGH' END
  WHEN base_score = 0 THEN 'NONE' WHEN base_score < 4 THEN 'LOW' WHEN base_score < 7 THEN 'MEDIUM' WHEN base_score < 9 THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM ordered_scores WHERE n = 1)""",
    "signals": """forecasts AS (SELECT l_partkey AS vulnerability_id, l_discount / 2 AS score, l_tax * 12 AS percentile, CAST(l_shipdate AS DATE) AS score_date FROM lineitem WHERE l_suppkey % 4 = 0),
best_forecasts AS (SELECT vulnerability_id, max(percentile) AS epss_percentile, arg_max(score, (percentile, score)) AS epss_score FROM forecasts GROUP BY 1),
named_weaknesses AS (SELECT l_partkey AS vulnerability_id, string_agg(DISTINCT 'CWE-' || (l_suppkey * 2), ',' ORDER BY 'CWE-' || (l_suppkey * 2)) AS cwe_ids FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
signals AS (SELECT vulnerability_id, epss_score, epss_percentile, cwe_ids FROM best_forecasts FULL JOIN named_weaknesses USING (vulnerability_id))""",
    "contacts": """contacts AS (SELECT s_suppkey AS recipient_id, s_suppkey % 7 AS organization_id FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 4 <> 0)""",
}


def ctes(*names: str) -> str:
    return ",\n".join(CTES[n] for n in names)
