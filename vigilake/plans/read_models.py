"""Dashboard, list and detail read models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.functions.policies import named as level, rank
from vigilake.plans.base import COMPONENTS, EXPOSURES, MACHINES, RANK, components, exposures, machines, query, spread, tasks
from vigilake.session import table

OWNED = f"WITH {EXPOSURES}, {COMPONENTS}, {MACHINES}"


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposures with their component and machine (JOIN-01)."""
    return exposures(spark, sf_dir).join(components(spark, sf_dir), "component_id").join(machines(spark, sf_dir), "machine_id")


@query("dash_top_machines", f"""{OWNED}
SELECT machine_id, hostname, count(*) AS n_exposures, count(*) FILTER (priority = 'CRITICAL') AS n_critical, count(*) FILTER (is_kev) AS n_kev
FROM exposures JOIN components USING (component_id) JOIN machines USING (machine_id) WHERE applicability <> 'not_applicable'
GROUP BY machine_id, hostname ORDER BY n_critical DESC, n_exposures DESC, hostname, machine_id LIMIT 5""")  # fmt: skip
def dash_top_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five machines with most critical exposures (AGG-03, TOP-01). Exposures
    are summed by component before they meet machines, so little is shuffled."""
    lines = exposures(spark, sf_dir).where("applicability <> 'not_applicable'")
    per_component = lines.groupBy("component_id").agg(F.count("*").alias("n"), F.count_if(F.col("priority") == "CRITICAL").alias("c"),
        F.count_if("is_kev").alias("k"))
    per_machine = per_component.join(components(spark, sf_dir).select("component_id", "machine_id"), "component_id").groupBy("machine_id")
    sums = per_machine.agg(F.sum("n").alias("n_exposures"), F.sum("c").alias("n_critical"), F.sum("k").alias("n_kev"))
    named = sums.join(machines(spark, sf_dir).select("machine_id", "hostname"), "machine_id")
    return named.select("machine_id", "hostname", "n_exposures", "n_critical", "n_kev").orderBy(F.desc("n_critical"), F.desc("n_exposures"),
        "hostname", "machine_id").limit(5)


@query("dash_exposure_counts", f"""{OWNED}
SELECT organization_id, count(*) AS n_total, count(*) FILTER (priority = 'CRITICAL') AS n_critical, count(*) FILTER (priority = 'HIGH') AS n_high,
  count(*) FILTER (priority = 'MEDIUM') AS n_medium, count(*) FILTER (priority = 'LOW') AS n_low, count(*) FILTER (priority IS NULL) AS n_unranked,
  count(*) FILTER (applicability = 'confirmed') AS n_confirmed, count(*) FILTER (applicability = 'potential') AS n_potential,
  count(*) FILTER (is_kev) AS n_kev, count(*) FILTER (is_kev AND applicability = 'confirmed') AS n_kev_confirmed
FROM exposures JOIN components USING (component_id) JOIN machines USING (machine_id) GROUP BY organization_id""")  # fmt: skip
def dash_exposure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten filtered counts in one pass (AGG-01, JOIN-03)."""
    of = lambda c: F.col("priority") == c
    return owned(spark, sf_dir).groupBy("organization_id").agg(
        F.count("*").alias("n_total"), *[F.count_if(of(p)).alias(f"n_{p.lower()}") for p in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
            F.count_if(F.col("priority").isNull()).alias("n_unranked"),
        F.count_if(F.col("applicability") == "confirmed").alias("n_confirmed"), F.count_if(F.col("applicability") == "potential").alias("n_potential"),
        F.count_if("is_kev").alias("n_kev"), F.count_if(F.col("is_kev") & (F.col("applicability") == "confirmed")).alias("n_kev_confirmed"),
    )


@query("dash_alert_counts", "SELECT count(*) FILTER (event_type = 'view') AS n_pending, count(*) FILTER (event_type = 'error') AS n_failed FROM events")
def dash_alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending and failed alerts (AGG-02)."""
    return table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "view").alias("n_pending"),
        F.count_if(F.col("event_type") == "error").alias("n_failed"))


@query("dash_latest_alerts",
    "SELECT event_id, ts, event_type, user_id FROM events WHERE event_type IN ('error', 'view') ORDER BY ts DESC, event_id DESC LIMIT 5")
def dash_latest_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest five alerts, with a unique tie-break (TOP-01)."""
    alerts = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "view"))
    return alerts.select("event_id", "ts", "event_type", "user_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(5)


@query("dash_actions", f"""{OWNED}, m AS (
  SELECT organization_id, count(*) FILTER (priority = 'CRITICAL' AND applicability = 'confirmed') AS critical, count(*) FILTER (is_kev) AS kev,
    count(*) FILTER (priority IS NULL) AS unranked
  FROM exposures JOIN components USING (component_id) JOIN machines USING (machine_id) GROUP BY organization_id),
a AS (SELECT organization_id, 1 AS step, 'fix_critical' AS action, critical AS n FROM m UNION ALL SELECT organization_id, 2, 'review_kev', kev FROM m
  UNION ALL SELECT organization_id, 3, 'rank_exposures', unranked FROM m)
SELECT organization_id, step, action, n FROM a WHERE n > 0""")  # fmt: skip
def dash_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions derived from the metrics, as rows (AGG-29)."""
    m = owned(spark, sf_dir).groupBy("organization_id").agg(
        F.count_if((F.col("priority") == "CRITICAL") & (F.col("applicability") == "confirmed")).alias("critical"), F.count_if("is_kev").alias("kev"),
            F.count_if(F.col("priority").isNull()).alias("unranked"),
    )
    stacked = F.expr("stack(3, 1, 'fix_critical', critical, 2, 'review_kev', kev, 3, 'rank_exposures', unranked) AS (step, action, n)")
    return m.select("organization_id", stacked).where("n > 0")


@query("machine_list", f"""{OWNED}
SELECT m.organization_id, m.machine_id, m.hostname, count(DISTINCT c.component_id) AS n_components, count(DISTINCT (e.component_id, e.line)) FILTER
  (e.line IS NOT NULL) AS n_exposures,
  count(DISTINCT (e.component_id, e.line)) FILTER (e.priority = 'CRITICAL') AS n_critical
FROM machines m LEFT JOIN components c USING (machine_id) LEFT JOIN exposures e USING (component_id)
GROUP BY m.organization_id, m.machine_id, m.hostname""")  # fmt: skip
def machine_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines of every tenant with distinct counts (AGG-04, FLT-01); one tenant's are a
    filter on organization_id. A line is one exposure, so sums by component stand for
    distinct counts after the join."""
    mine = machines(spark, sf_dir)
    parts = components(spark, sf_dir).select("component_id", "machine_id").join(mine.select("machine_id"), "machine_id", "left_semi")
    sums = exposures(spark, sf_dir).groupBy("component_id").agg(F.count_distinct("line").alias("n"),
        F.count_distinct(F.when(F.col("priority") == "CRITICAL", F.col("line"))).alias("c"))
    per = parts.join(sums, "component_id", "left").groupBy("machine_id").agg(F.count_distinct("component_id").alias("p"), F.sum("n").alias("n"),
        F.sum("c").alias("c"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return mine.join(per, "machine_id", "left").select("organization_id", "machine_id", "hostname", zero("p", "n_components"),
        zero("n", "n_exposures"), zero("c", "n_critical"))


@query("software_list", f"""{OWNED}
SELECT component_type, ecosystem, os_name, count(DISTINCT machine_id) AS n_machines, count(DISTINCT component_id) AS n_components, count(DISTINCT
  vulnerability_id) AS n_vulnerabilities,
  count(*) FILTER (priority = 'CRITICAL') AS n_critical, max(seen_at) AS last_seen_at
FROM components JOIN machines USING (machine_id) LEFT JOIN exposures USING (component_id) GROUP BY component_type, ecosystem, os_name""")  # fmt: skip
def software_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped by nullable columns, with exposures of components that have any (AGG-05)."""
    by, lines, parts = ["component_type", "ecosystem", "os_name"], exposures(spark, sf_dir), components(spark, sf_dir)
    n, m = tasks(lines), tasks(parts)
    owned = spread(parts.select("component_id", "machine_id", "seen_at", "component_type", "ecosystem"), m, "machine_id").join(
        spread(machines(spark, sf_dir).select("machine_id", "os_name"), m, "machine_id"), "machine_id")
    named = spread(owned.select("component_id", *by), n, "component_id")
    lines = spread(lines.select("component_id", "vulnerability_id", (F.col("priority") == "CRITICAL").alias("critical")), n, "component_id")
    # Each distinct count is a plain count over rows that were summed before, and no row is copied for it. Rows are
    # spread by what they are summed by, so that the groups of a task are bounded too.
    machine = owned.groupBy(*by, "machine_id").agg(F.count("component_id").alias("n"), F.max("seen_at").alias("seen_at"))
    machine = machine.groupBy(*by).agg(F.count("*").alias("n_machines"), F.sum("n").alias("n_components"), F.max("seen_at").alias("last_seen_at"))
    found = spread(lines.join(named, "component_id").drop("component_id"), n, *by, "vulnerability_id")
    vulnerable = found.groupBy(*by, "vulnerability_id").agg(F.count_if("critical").alias("critical"))
    vulnerable = vulnerable.groupBy(*by).agg(F.count("vulnerability_id").alias("n_vulnerabilities"), F.sum("critical").alias("n_critical"))
    key = F.struct(*by)
    joined = machine.join(vulnerable.select(key.alias("of"), "n_vulnerabilities", "n_critical"), key.eqNullSafe(F.col("of")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(*by, "n_machines", "n_components", zero("n_vulnerabilities"), zero("n_critical"), "last_seen_at")


@query("vuln_summary", f"""WITH {EXPOSURES}, {COMPONENTS}
SELECT vulnerability_id, any_value(p_name) AS name, coalesce(arg_max(priority, {RANK}), NULL) AS priority, bool_or(is_kev) AS is_kev,
  count(*) FILTER (applicability = 'confirmed') AS n_confirmed, count(*) FILTER (applicability = 'potential') AS n_potential,
  count(DISTINCT machine_id) AS n_machines, count(DISTINCT component_id) AS n_components
FROM exposures JOIN components USING (component_id) LEFT JOIN part ON p_partkey = vulnerability_id GROUP BY vulnerability_id""")  # fmt: skip
def vuln_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vulnerability: highest priority, any KEV, counts by status, distinct
    machines and components (AGG-08, JOIN-02)."""
    lines = exposures(spark, sf_dir)
    n = tasks(lines)
    first = lambda order, *of: F.row_number().over(Window.partitionBy(*of).orderBy(order)) == 1
    lines = spread(lines.select("component_id", "vulnerability_id", rank(F.col("priority")).alias("r"), "is_kev", "applicability"), n, "component_id")
    owners = spread(components(spark, sf_dir).select("component_id", "machine_id"), n, "component_id")
    # One row of each component and vulnerability is marked, so that a sum counts components: no row is copied for
    # a distinct count, and what a task sorts and sums are the rows that were spread to it.
    rows = lines.withColumn("new", first("r", "component_id", "vulnerability_id")).join(owners.withColumn("own", first("machine_id", "component_id")), "component_id")
    rows = spread(rows.select("vulnerability_id", "machine_id", "r", "is_kev", "applicability", (F.col("new") & F.col("own")).alias("new")), n,
        "vulnerability_id", "machine_id")
    of_machine = rows.groupBy("vulnerability_id", "machine_id").agg(
        F.max("r").alias("r"), F.bool_or("is_kev").alias("is_kev"), F.count_if(F.col("applicability") == "confirmed").alias("c"),
        F.count_if(F.col("applicability") == "potential").alias("p"), F.count_if("new").alias("n"),
    )
    folded = of_machine.groupBy("vulnerability_id").agg(
        level(F.when(F.max("r") >= 0, F.max("r"))).alias("priority"), F.bool_or("is_kev").alias("is_kev"), F.sum("c").alias("n_confirmed"),
        F.sum("p").alias("n_potential"), F.count("machine_id").alias("n_machines"), F.sum("n").alias("n_components"),
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vulnerability_id"), F.col("p_name").alias("name"))
    return folded.join(part, "vulnerability_id", "left").select("vulnerability_id", "name", "priority", "is_kev", "n_confirmed", "n_potential",
        "n_machines", "n_components")


@query("vuln_page_by_rank", f"""WITH {EXPOSURES}, v AS (SELECT vulnerability_id, max({RANK}) AS priority_rank, bool_or(is_kev) AS is_kev FROM exposures WHERE applicability =
  'confirmed' GROUP BY vulnerability_id)
SELECT vulnerability_id, priority_rank, is_kev FROM v ORDER BY priority_rank DESC, is_kev DESC, vulnerability_id LIMIT 50""")  # fmt: skip
def vuln_page_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page in rank order (TOP-02)."""
    rows = exposures(spark,
        sf_dir).where("applicability = 'confirmed'").groupBy("vulnerability_id").agg(F.max(rank(F.col("priority"))).alias("priority_rank"),
            F.bool_or("is_kev").alias("is_kev"))
    return rows.orderBy(F.desc("priority_rank"), F.desc("is_kev"), "vulnerability_id").limit(50)


@query("machine_exposures_by_text", f"""{OWNED}, r AS (SELECT machine_id, component_id, line, vulnerability_id, priority, row_number() OVER (PARTITION BY machine_id ORDER BY priority DESC
  NULLS LAST, component_id, line, vulnerability_id) AS place
FROM exposures JOIN components USING (component_id)) SELECT * FROM r WHERE place <= 100""")  # fmt: skip
def machine_exposures_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every machine's first 100 exposures in the text order of priority (FLT-16), the
    page that its detail view shows."""
    rows = exposures(spark, sf_dir).join(components(spark, sf_dir).select("component_id", "machine_id"), "component_id")
    place = F.row_number().over(Window.partitionBy("machine_id").orderBy(F.col("priority").desc_nulls_last(), "component_id", "line", "vulnerability_id"))
    return rows.select("machine_id", "component_id", "line", "vulnerability_id", "priority", place.alias("place")).where("place <= 100")


@query("machine_detail", f"""{OWNED}
SELECT organization_id, machine_id, any_value(hostname) AS hostname, count(DISTINCT component_id) AS n_components, max(seen_at) AS last_seen_at,
  string_agg(DISTINCT lower(component_type) || '/' || coalesce(ecosystem, '') || '/' || component_id, ',' ORDER BY lower(component_type) || '/' ||
    coalesce(ecosystem, '') || '/' || component_id) AS components,
  string_agg(DISTINCT CAST(vulnerability_id AS VARCHAR), ',' ORDER BY CAST(vulnerability_id AS VARCHAR)) AS vulnerabilities
FROM exposures JOIN components USING (component_id) JOIN machines USING (machine_id) GROUP BY organization_id, machine_id""")  # fmt: skip
def machine_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested document per machine, its parts in (lower(name), version or '', id)
    order, given here as text so that SQL can be compared (TOP-04)."""
    rows = exposures(spark, sf_dir).join(components(spark, sf_dir), "component_id").join(machines(spark, sf_dir), "machine_id")
    part = F.struct(F.concat_ws("/", F.lower("component_type"), F.coalesce("ecosystem", F.lit("")), F.col("component_id").cast("string")).alias("label"))
    nested = rows.groupBy("organization_id", "machine_id").agg(
        F.first("hostname").alias("hostname"), F.count_distinct("component_id").alias("n_components"), F.max("seen_at").alias("last_seen_at"),
        F.array_sort(F.collect_set(part)).alias("components"), F.array_sort(F.collect_set(F.col("vulnerability_id").cast("string"))).alias("vulnerabilities"),
    )
    return nested.withColumns({"components": F.array_join(F.transform("components", lambda x: x["label"]), ","),
        "vulnerabilities": F.array_join("vulnerabilities", ",")})


@query("search_components", f"""WITH {COMPONENTS}, {MACHINES}
SELECT component_id, machine_id, component_type, ecosystem FROM components JOIN machines USING (machine_id)
WHERE component_type = 'O' AND contains(lower(concat_ws(' ', ecosystem, hostname, os_name)), 'urgent customer#00000001')""")  # fmt: skip
def search_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters and a case-insensitive substring over joined columns (FLT-10, FLT-15)."""
    rows = components(spark, sf_dir).where("component_type = 'O'").join(machines(spark, sf_dir), "machine_id")
    text = F.lower(F.concat_ws(" ", "ecosystem", "hostname", "os_name"))
    return rows.where(text.contains("urgent customer#00000001")).select("component_id", "machine_id", "component_type", "ecosystem")


@query("keyset_page", """SELECT o_orderdate AS seen_at, o_custkey AS machine_id, o_orderkey AS component_id FROM orders
WHERE (o_orderdate, o_custkey, o_orderkey) > (TIMESTAMP '1998-01-01 00:00:00', 100, 5000) ORDER BY o_orderdate, o_custkey, o_orderkey LIMIT 200""")  # fmt: skip
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page after a three-part key (TOP-03)."""
    c = components(spark, sf_dir).select("seen_at", "machine_id", "component_id")
    after = F.struct("seen_at", "machine_id", "component_id") > F.struct(F.lit("1998-01-01").cast("timestamp").alias("seen_at"),
        F.lit(100).cast("long").alias("machine_id"), F.lit(5000).cast("long").alias("component_id"))
    # The first part alone can be pushed to the scan.
    return c.where((F.col("seen_at") >= F.lit("1998-01-01").cast("timestamp")) & after).orderBy("seen_at", "machine_id", "component_id").limit(200)


@query("tenant_scope_check", f"""{OWNED}
SELECT e.component_id, e.line, e.vulnerability_id FROM exposures e WHERE NOT EXISTS (
  SELECT 1 FROM components c JOIN machines m USING (machine_id) WHERE c.component_id = e.component_id AND m.organization_id = e.vulnerability_id % 25)""")  # fmt: skip
def tenant_scope_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested exposures outside the tenant that asked (JOIN-19, SNK-12), joined on
    component and tenant; here every exposure is asked for, by a tenant of its own."""
    asked = exposures(spark, sf_dir).select("component_id", "line", "vulnerability_id", (F.col("vulnerability_id") % 25).cast("int").alias("organization_id"))
    mine = components(spark, sf_dir).join(machines(spark, sf_dir), "machine_id").select("component_id", "organization_id")
    return asked.join(mine, ["component_id", "organization_id"], "left_anti").select("component_id", "line", "vulnerability_id")


@query("canonical_metrics", f"""WITH {EXPOSURES}, v AS (SELECT p_partkey, starts_with(p_name, 'a') OR p_size > 20 AS has_cve, p_size > 30 AS primary_cve, p_size < 5 AS primary_other,
    coalesce(bool_or(e.is_kev), false) AS has_cwe, coalesce(bool_or(e.applicability = 'confirmed'), false) AS has_epss, count(DISTINCT e.source_id) AS
      sources
  FROM part LEFT JOIN exposures e ON e.vulnerability_id = p_partkey GROUP BY ALL)
SELECT count(*) AS n_total, count(*) FILTER (has_cve) AS n_cve, count(*) FILTER (NOT has_cve) AS n_without_cve, count(*) FILTER (primary_cve) AS
  n_primary_cve, count(*) FILTER (primary_other) AS n_primary_other,
  count(*) FILTER (has_cve AND has_cwe) AS n_cve_cwe, count(*) FILTER (has_cve AND NOT has_cwe) AS n_cve_no_cwe, count(*) FILTER (has_cve AND
    has_epss) AS n_cve_epss, count(*) FILTER (has_cve AND NOT has_epss) AS n_cve_no_epss,
  count(*) FILTER (has_cve AND (has_cwe OR has_epss)) AS n_cve_any, count(*) FILTER (has_cve AND NOT has_cwe AND NOT has_epss) AS n_cve_none, count(*)
    FILTER (has_cve AND sources > 1) AS n_multi_source, count(*) FILTER (has_cve AND sources <= 1) AS n_single_source FROM v""")  # fmt: skip
def canonical_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags per canonical record, then a total and twelve filtered counts (AGG-06,
    JOIN-18)."""
    e = exposures(spark, sf_dir).groupBy("vulnerability_id").agg(F.bool_or("is_kev").alias("kev"),
        F.bool_or(F.col("applicability") == "confirmed").alias("confirmed"), F.count_distinct("source_id").alias("sources"))
    v = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vulnerability_id"), "p_name", "p_size").join(e, "vulnerability_id", "left")
    said = lambda c: F.coalesce(c, F.lit(False))
    cve, cwe, epss = F.col("p_name").startswith("a") | (F.col("p_size") > 20), said(F.col("kev")), said(F.col("confirmed"))
    many = F.coalesce("sources", F.lit(0)) > 1
    counts = {
        "n_cve": cve, "n_without_cve": ~cve, "n_primary_cve": F.col("p_size") > 30, "n_primary_other": F.col("p_size") < 5, "n_cve_cwe": cve & cwe,
            "n_cve_no_cwe": cve & ~cwe,
        "n_cve_epss": cve & epss, "n_cve_no_epss": cve & ~epss, "n_cve_any": cve & (cwe | epss), "n_cve_none": cve & ~cwe & ~epss,
            "n_multi_source": cve & many, "n_single_source": cve & ~many,
    }
    return v.agg(F.count("*").alias("n_total"), *[F.count_if(c).alias(name) for name, c in counts.items()])


@query("set_status_histogram", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by status (AGG-07)."""
    return components(spark, sf_dir).groupBy(F.col("component_type").alias("status")).agg(F.count("*").alias("n"))
