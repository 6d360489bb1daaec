"""Matching, policies, reconciliation, merges and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.functions import policies
from vigilake.operators import merge, resolution
from vigilake.plans.base import COMPONENTS, EXPOSURES, MACHINES, components, exposures, machines, query, spread, tasks
from vigilake.session import table


#: Weaknesses dealt over exposures: those that raise a priority, and neighbours that do not.
DEALT = (*policies.TOP_WEAKNESSES, "CWE-1", "CWE-2", "CWE-23", "CWE-80", "CWE-119", "CWE-190", "CWE-269", "CWE-287", "CWE-400", "CWE-798", "CWE-1000",
    "CWE-7870")
#: The same in SQL.
RAISING = ", ".join(f"'{w}'" for w in policies.TOP_WEAKNESSES)


@query("priority_policy", f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'CRITICAL' ELSE
  (['NONE', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[1 + CASE WHEN w THEN greatest(once, least(once + 1, 3)) ELSE once END] END AS priority FROM (
  SELECT *, least(base + CASE WHEN pct >= 0.90 OR l_tax >= 0.04 THEN 1 ELSE 0 END, 4) AS once FROM (
    SELECT *, CASE WHEN l_quantity >= 45 THEN 4 WHEN l_quantity >= 30 THEN 3 WHEN l_quantity >= 15 THEN 2 ELSE 1 END AS base, l_discount * 10 AS pct,
      list_contains([{RAISING}], ([{", ".join(f"'{w}'" for w in DEALT)}])[1 + l_partkey % {len(DEALT)}]) AS w
        FROM lineitem))""")  # fmt: skip
def priority_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-31 over every exposure: severity from the quantity, the forecast from
    discount and tax, every weakness of the list and some others dealt over parts."""
    severity = F.when(F.col("l_quantity") >= 45, "CRITICAL").when(F.col("l_quantity") >= 30, "HIGH").when(F.col("l_quantity") >= 15,
        "MEDIUM").when(F.col("l_quantity") >= 5, "LOW")
    weak = F.array(F.get(F.array(*map(F.lit, DEALT)), (F.col("l_partkey") % len(DEALT)).cast("int")))
    kev = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")
    priority = policies.priority(severity, kev, F.col("l_discount") * 10, F.col("l_tax"), weak)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", priority.alias("priority"))


@query("severity_policy", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CASE WHEN s < 4 THEN 'LOW' WHEN s < 7 THEN 'MEDIUM' ELSE 'HIGH' END
  ELSE CASE WHEN s = 0 THEN 'NONE' WHEN s < 4 THEN 'LOW' WHEN s < 7 THEN 'MEDIUM' WHEN s < 9 THEN 'HIGH' ELSE 'CRITICAL' END END AS severity FROM
    (SELECT *, p_size / 5.0 AS s FROM part)""")  # fmt: skip
def severity_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-30 over every part."""
    version = F.when(F.col("p_size") % 2 == 0, "2.0").otherwise("3.1")
    return table(spark, sf_dir, "part").select("p_partkey", policies.severity(F.col("p_size") / 5.0, version).alias("severity"))


HALF = "1998-01-01"


#: Bits of what an exposure tells: its rank from -1, known-exploited or not, confirmed. What it was before a day has the same, `BEFORE` places on.
RANKS, KEV_SAID, KEV_DENIED, CONFIRMED, BEFORE = tuple(1 << n for n in range(6)), 1 << 6, 1 << 7, 1 << 8, 9


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure state per (machine, vulnerability), now and before a day (`*0`), in one
    grouped pass. Maxima of six ranks and flags are bits of one number, so that an
    exposure that is moved is two keys and a number."""
    e, kev = exposures(spark, sf_dir), F.col("is_kev")
    now = F.get(F.array(*map(F.lit, RANKS)), policies.rank(F.col("priority")) + 1)
    now = now + F.when(kev, KEV_SAID).when(~kev, KEV_DENIED).otherwise(0) + F.when(F.col("applicability") == "confirmed", CONFIRMED).otherwise(0)
    old = F.col("detected_at") < F.lit(HALF).cast("timestamp_ntz")
    told = now + F.when(old, F.shiftleft(now, BEFORE)).otherwise(0)
    e = e.select("component_id", "vulnerability_id", told.alias("told")).join(components(spark, sf_dir).select("component_id", "machine_id"), "component_id")
    bits = e.groupBy("machine_id", "vulnerability_id").agg(F.bit_or("told").alias("told"))

    def rank(shift: int):
        found = F.lit(None).cast("int")
        for n, bit in enumerate(RANKS):
            found = F.when(F.col("told").bitwiseAND(bit << shift) != 0, n - 1).otherwise(found)
        return found

    has = lambda bit, shift=0: F.col("told").bitwiseAND(bit << shift) != 0
    flag = lambda shift: F.when(has(KEV_SAID, shift), True).when(has(KEV_DENIED, shift), False)
    return bits.select("machine_id", "vulnerability_id", rank(0).alias("r"), flag(0).alias("kev"), has(CONFIRMED).alias("confirmed"), rank(BEFORE).alias("r0"), flag(BEFORE).alias("kev0"))


SNAPSHOTS = f"""WITH {EXPOSURES}, {COMPONENTS}, s AS (
  SELECT machine_id, vulnerability_id, detected_at < TIMESTAMP '{HALF}' AS old, is_kev, applicability = 'confirmed' AS conf, CASE priority WHEN 'LOW'
    THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE -1 END AS r
  FROM exposures JOIN components USING (component_id)),
x AS (SELECT machine_id, vulnerability_id, max(r) AS r, bool_or(is_kev) AS kev, bool_or(conf) AS confirmed, max(r) FILTER (old) AS r0, bool_or(is_kev)
  FILTER (old) AS kev0, bool_or(conf) FILTER (old) AS confirmed0
  FROM s GROUP BY machine_id, vulnerability_id)"""


@query("exposure_transitions",
    f"""{SNAPSHOTS} SELECT machine_id, vulnerability_id, r0 IS NOT NULL AS known, r0 AS rank_before, r AS rank_now FROM x WHERE r0 IS NULL OR r0 <> r OR kev0
  <> kev""")
def exposure_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New or changed exposures between two snapshots (JOIN-14)."""
    x = _snapshots(spark, sf_dir)
    moved = merge.changed(F.col("r0"), F.col("r")) | merge.changed(F.col("kev0"), F.col("kev"))
    return x.where(moved).select("machine_id", "vulnerability_id", F.col("r0").isNotNull().alias("known"), F.col("r0").alias("rank_before"),
        F.col("r").alias("rank_now"))


@query("alert_candidates", f"""{SNAPSHOTS}, t AS (
  SELECT machine_id, vulnerability_id, unnest(list_filter([CASE WHEN r0 IS NULL AND r = 4 THEN 'new_confirmed_critical_exposure' END, CASE WHEN r0 IS
    NOT NULL AND NOT kev0 AND kev THEN 'confirmed_exposure_entered_kev' END,
    CASE WHEN r0 IN (1, 2, 3) AND r = 4 THEN 'priority_transition_to_critical' END], lambda a: a IS NOT NULL)) AS alert_type FROM x WHERE confirmed)
SELECT machine_id, vulnerability_id, alert_type, 'alert/v1:' || alert_type || ':' || machine_id || '-' || vulnerability_id || ':recipient:' ||
  s_suppkey AS dedup_key
FROM t JOIN customer ON c_custkey = machine_id JOIN supplier ON s_nationkey = c_nationkey""")  # fmt: skip
def alert_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of every transition for each recipient of the machine's tenant
    (FN-32, JOIN-15, FLT-14)."""
    t = _snapshots(spark, sf_dir)
    level = lambda c: policies.named(F.when(F.col(c) >= 0, F.col(c)))
    found = policies.alert_types(F.when(F.col("confirmed"), "confirmed"), F.col("r0").isNotNull(), F.col("kev0"), F.col("kev"), level("r0"), level("r"))
    rows = t.select("machine_id", "vulnerability_id", F.explode(found).alias("alert_type")).join(machines(spark, sf_dir).select("machine_id",
        "organization_id"), "machine_id")
    return to_recipients(spread(rows, tasks(exposures(spark, sf_dir))), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("organization_id"),
        F.col("s_suppkey").alias("recipient_id")))


def in_lists(recipients: DataFrame, block: int) -> DataFrame:
    """(organization_id, told): an organization's recipients, as the ends of their keys, in
    lists of about `block`."""
    sizes = recipients.groupBy("organization_id").agg(F.ceil(F.count("*") / block).alias("blocks"))
    after = F.concat(F.lit(":recipient:"), F.col("recipient_id").cast("string")).alias("after")
    # Lists of structs, since lists of keys would leave null ones out.
    lists = recipients.join(sizes, "organization_id").groupBy("organization_id", F.pmod(F.xxhash64("recipient_id"), "blocks").alias("block")).agg(
        F.collect_list(F.struct(after)).alias("told"))
    return lists.select("organization_id", F.col("told.after").alias("told"))


def to_recipients(rows: DataFrame, recipients: DataFrame, block: int = 1_000, within: int = 1_000_000) -> DataFrame:
    """Each transition for each recipient of its organization. The rows are the product, so
    both parts of the key are put together before they meet, and recipients come in lists,
    which makes a row cheaper than a join does. Lists go to the transitions where the
    recipients are counted and within `within`: organizations are few, and a shuffle would
    leave each one's rows to one task."""
    before = F.concat(F.lit("alert/v1:"), "alert_type", F.lit(":"), F.col("machine_id").cast("string"), F.lit("-"), F.col("vulnerability_id").cast("string"))
    lists = in_lists(recipients, block)
    lists = F.broadcast(lists) if recipients.count() <= within else lists
    out = ["machine_id", "vulnerability_id", "alert_type"]
    met = rows.withColumn("before", before).join(lists, "organization_id").select(*out, "before", F.explode("told").alias("after"))
    return met.select(*out, F.concat("before", "after").alias("dedup_key"))


@query("diff_snapshots", f"""WITH a AS (SELECT o_custkey, max(o_orderkey) AS k, max(o_orderstatus) AS s FROM orders WHERE o_orderdate < TIMESTAMP '{HALF}' GROUP BY o_custkey),
b AS (SELECT o_custkey, max(o_orderkey) AS k, max(o_orderstatus) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY o_custkey)
SELECT o_custkey AS machine_id, CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'delete' WHEN a.k <> b.k OR a.s <> b.s THEN 'update' ELSE
  'unchanged' END AS action FROM a FULL JOIN b USING (o_custkey)""")  # fmt: skip
def diff_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-outer inventory diff (JOIN-08, SNK-19)."""
    c = components(spark, sf_dir)
    fold = lambda df: df.groupBy("machine_id").agg(F.max("component_id").alias("k"), F.max("component_type").alias("s"))
    old, new = fold(c.where(F.col("seen_at") < F.lit(HALF).cast("timestamp"))), fold(c.where(F.col("seen_at") >= F.lit("1996-01-01").cast("timestamp")))
    return merge.diff(old, new, ["machine_id"], ["k", "s"])


@query("latest_per_key",
    "SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each key; withdrawn ones go after picking (SET-03, FLT-02)."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return merge.newest(rows, ["user_id"], ["ts", "event_id"]).where("event_type <> 'error'")


@query("merge_observations", """WITH r AS (SELECT user_id, event_type, event_id, ts, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, CAST(event_id AS
  VARCHAR) DESC) AS n, min(ts) OVER (PARTITION BY user_id, event_type) AS first_at FROM events)
SELECT user_id, event_type, event_id, value, ts AS last_at, first_at FROM r WHERE n = 1""")  # fmt: skip
def merge_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored (even ids) and incoming (odd ids) observations merged (SNK-08, ER-10)."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.col("ts").alias("last_at"), F.col("ts").alias("first_at"))
    even = F.col("event_id") % 2 == 0
    return merge.merge_observations(rows.where(even), rows.where(~even), ["user_id", "event_type"], "first_at", "last_at", "event_id")


@query("merge_monotonic_scores", """WITH s AS (SELECT o_custkey AS id, max(o_orderdate) AS d, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderstatus = 'F'
  GROUP BY 1),
i AS (SELECT o_custkey AS id, max(o_orderdate) AS d, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderstatus <> 'F'
  GROUP BY 1)
SELECT coalesce(i.id, s.id) AS id, CASE WHEN s.id IS NULL OR i.d >= s.d THEN i.d ELSE s.d END AS d, CASE WHEN s.id IS NULL OR i.d >= s.d THEN i.v ELSE
  s.v END AS v FROM s FULL JOIN i USING (id)""")  # fmt: skip
def merge_monotonic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores replace stored ones only if they are not older (SNK-03, SNK-04)."""
    o = components(spark, sf_dir)
    latest = lambda df: df.groupBy(F.col("machine_id").alias("id")).agg(F.max("seen_at").alias("d"), F.max_by("price", F.struct("seen_at", "component_id")).alias("v"))
    return merge.merge_monotonic(latest(o.where("component_type = 'F'")), latest(o.where("component_type <> 'F'")), ["id"], "d")


@query("insert_ignore", """SELECT o_custkey AS source_id, count(*) AS n_new FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'F') i
WHERE NOT EXISTS (SELECT 1 FROM orders s WHERE s.o_orderstatus = 'F' AND s.o_custkey = i.o_custkey AND s.o_orderpriority = i.o_orderpriority) GROUP BY
  1""")  # fmt: skip
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New payload keys of a batch (SNK-01, SNK-02, SNK-18)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderpriority").alias("hash"), "o_orderstatus")
    new = merge.insert_ignore(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), ["source_id", "hash"])
    return new.groupBy("source_id").agg(F.count("*").alias("n_new"))


@query("batch_conflicts",
    "SELECT l_orderkey AS id, count(DISTINCT (l_returnflag, l_linestatus)) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1")
def batch_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that carry different values in one batch (SRC-05, SNK-16)."""
    return merge.conflicts(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id"), ["id"], ["l_returnflag", "l_linestatus"])


@query("conditional_updates",
    """SELECT o_orderkey AS id, CASE WHEN o_totalprice > 200000 THEN 'P' ELSE o_orderstatus END AS status, o_orderstatus IS DISTINCT FROM CASE WHEN
  o_totalprice > 200000 THEN 'P' ELSE o_orderstatus END AS changed FROM orders""")
def conditional_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk update that marks only what differs (SNK-11, FLT-06)."""
    new = F.when(F.col("price") > 200000, "P").otherwise(F.col("component_type"))
    return components(spark, sf_dir).select(F.col("component_id").alias("id"), new.alias("status"),
        merge.changed(F.col("component_type"), new).alias("changed"))


@query("semi_anti_sources", """SELECT s_suppkey AS source_id, (SELECT min(l_shipdate) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'A') AS first_observed FROM
  supplier
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'A' AND l_quantity >= 50) AND NOT EXISTS (SELECT 1 FROM lineitem
  WHERE l_suppkey = s_suppkey AND l_tax > 0.07 AND l_quantity <= 1)""")  # fmt: skip
def semi_anti_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXISTS, NOT EXISTS and a correlated minimum as one pre-aggregate (JOIN-04/05/06)."""
    a = F.col("l_returnflag") == "A"
    marks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("source_id")).agg(
        F.min(F.when(a, F.col("l_shipdate"))).alias("first_observed"), F.bool_or(a & (F.col("l_quantity") >= 50)).alias("has"),
            F.bool_or((F.col("l_tax") > 0.07) & (F.col("l_quantity") <= 1)).alias("bad"),
    )
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id")).join(marks.where("has AND NOT bad"),
        "source_id").select("source_id", "first_observed")


@query("version_range_join",
    """SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey AND l_quantity >= p_size - 5 AND l_quantity < p_size + 5""")
def version_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi join on the package, then the version inside its range (JOIN-07)."""
    lines, parts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), table(spark, sf_dir,
        "part").select("p_partkey", "p_size")
    inside = (F.col("l_quantity") >= F.col("p_size") - 5) & (F.col("l_quantity") < F.col("p_size") + 5)
    return lines.join(parts, (F.col("l_partkey") == F.col("p_partkey")) & inside).select("l_orderkey", "l_linenumber", "p_partkey")


@query("match_consolidation", f"""WITH {EXPOSURES}, r AS (SELECT component_id, vulnerability_id, source_id, priority, row_number() OVER (PARTITION BY component_id, vulnerability_id
  ORDER BY CASE priority WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE -1 END DESC, source_id, line) AS n FROM
  exposures)
SELECT component_id, vulnerability_id, source_id, priority FROM r WHERE n = 1""")  # fmt: skip
def match_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One match per pair: higher severity, then the smaller advisory (AGG-12)."""
    e = exposures(spark, sf_dir)
    best = F.min_by(F.struct("source_id", "priority"), F.struct((-policies.rank(F.col("priority"))).alias("r"), F.col("source_id"), F.col("line"))).alias("m")
    return e.groupBy("component_id", "vulnerability_id").agg(best).select("component_id", "vulnerability_id", "m.source_id", "m.priority")


@query("cvss_selection", """SELECT p_partkey, l_suppkey AS source_id, l_quantity AS score FROM (SELECT p_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY p_partkey
  ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_shipdate DESC, l_quantity DESC, l_suppkey, l_orderkey, l_linenumber) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0) WHERE n = 1""")  # fmt: skip
def cvss_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score of each vulnerability by a several-part key (AGG-09, AGG-10)."""
    order = F.struct(
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("a"),
            (-F.unix_micros(F.col("l_shipdate").cast("timestamp"))).alias("b"), (-F.col("l_quantity")).alias("c"), "l_suppkey", "l_orderkey", "l_linenumber",
    )
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 0").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min_by(F.struct("l_suppkey",
        "l_quantity"), order).alias("m"))
    return rows.join(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", "left_semi").select("p_partkey",
        F.col("m.l_suppkey").alias("source_id"), F.col("m.l_quantity").alias("score"))


@query("identifier_conflicts", """WITH i AS (SELECT c_name AS identifier, c_custkey AS canonical_id FROM customer UNION ALL SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9,
  '0'), o_custkey % 1000 FROM orders)
SELECT identifier, count(DISTINCT canonical_id) AS n_records, min(canonical_id) AS first_record FROM i GROUP BY identifier HAVING count(DISTINCT
  canonical_id) > 1""")  # fmt: skip
def identifier_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers that resolve to several canonical records (JOIN-10, ER-07)."""
    a = table(spark, sf_dir, "customer").select(F.col("c_name").alias("identifier"), F.col("c_custkey").alias("canonical_id"))
    b = table(spark, sf_dir, "orders").select(F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("identifier"),
        (F.col("o_custkey") % 1000).alias("canonical_id"))
    return a.unionByName(b).groupBy("identifier").agg(F.count_distinct("canonical_id").alias("n_records"),
        F.min("canonical_id").alias("first_record")).where("n_records > 1")


@query("components", """WITH RECURSIVE l AS (SELECT DISTINCT s_suppkey AS node, CAST(round(s_acctbal / 100) AS BIGINT) AS shared FROM supplier),
reach(a, b) AS (SELECT node, node FROM l UNION SELECT r.a, y.node FROM reach r JOIN l x ON x.node = r.b JOIN l y ON y.shared = x.shared)
SELECT a AS node, min(b) AS component FROM reach GROUP BY a""")  # fmt: skip
def components_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components over shared identifiers (ER-01)."""
    links = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.round(F.col("s_acctbal") / 100).cast("long").alias("shared"))
    return resolution.components(links)


@query("package_reconciliation", f"""WITH {EXPOSURES}, stored AS (SELECT DISTINCT component_id, vulnerability_id FROM exposures WHERE detected_at < TIMESTAMP '{HALF}'),
matched AS (SELECT DISTINCT component_id, vulnerability_id FROM exposures WHERE applicability <> 'not_applicable'), unresolved AS (SELECT DISTINCT
  component_id FROM exposures WHERE priority IS NULL)
SELECT action, count(*) AS n FROM (
  SELECT CASE WHEN s.component_id IS NULL THEN 'insert' WHEN m.component_id IS NOT NULL THEN 'update' WHEN component_id IN (SELECT component_id FROM
    unresolved) THEN 'exempt' ELSE 'delete' END AS action
  FROM stored s FULL JOIN matched m USING (component_id, vulnerability_id)) GROUP BY action""")  # fmt: skip
def package_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reconciliation inserts, updates, deletes as stale or exempts (REC-01,
    SNK-10, SNK-12), for all machines at once."""
    e, keys = exposures(spark, sf_dir), ["component_id", "vulnerability_id"]
    stored = e.where(F.col("detected_at") < F.lit(HALF).cast("timestamp")).select(*keys).distinct().withColumn("s", F.lit(True))
    matched = e.where("applicability <> 'not_applicable'").select(*keys).distinct().withColumn("m", F.lit(True))
    unresolved = e.where("priority IS NULL").select("component_id").distinct().withColumn("u", F.lit(True))
    joined = stored.join(matched, keys, "full").join(unresolved, "component_id", "left")
    action = F.when(F.col("s").isNull(), "insert").when(F.col("m").isNotNull(), "update").when(F.col("u").isNotNull(), "exempt").otherwise("delete")
    return joined.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("kev_reconciliation", f"""WITH {EXPOSURES}, {COMPONENTS}, kev AS (SELECT DISTINCT p_partkey FROM part WHERE p_size >= 48)
SELECT c.component_id, count(DISTINCT k.p_partkey) AS n_kev, bool_or(e.applicability = 'confirmed') AS owned_elsewhere FROM exposures e JOIN
  components c USING (component_id) JOIN kev k ON k.p_partkey = e.vulnerability_id
WHERE c.component_type = 'O' GROUP BY c.component_id""")  # fmt: skip
def kev_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposures of applications to cataloged vulnerabilities, once for each, and whether
    another rule owns one. The match by vendor and product is `application_matches`, the
    reconciliation `reconciled_applications`."""
    kev = table(spark, sf_dir, "part").where("p_size >= 48").select(F.col("p_partkey").alias("vulnerability_id")).distinct()
    apps = components(spark, sf_dir).where("component_type = 'O'").select("component_id")
    rows = exposures(spark, sf_dir).join(kev, "vulnerability_id").join(apps, "component_id")
    return rows.groupBy("component_id").agg(F.count_distinct("vulnerability_id").alias("n_kev"),
        F.bool_or(F.col("applicability") == "confirmed").alias("owned_elsewhere"))


@query("priority_signals", f"""WITH {EXPOSURES}, s AS (SELECT l_partkey AS vulnerability_id, max(l_discount) AS score FROM lineitem GROUP BY 1),
w AS (SELECT vulnerability_id, string_agg(DISTINCT applicability, ',' ORDER BY applicability) AS weaknesses FROM exposures GROUP BY 1)
SELECT p_partkey AS vulnerability_id, score, weaknesses FROM part LEFT JOIN s ON s.vulnerability_id = p_partkey LEFT JOIN w ON w.vulnerability_id =
  p_partkey""")  # fmt: skip
def priority_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best forecast and sorted weakness set of each vulnerability (JOIN-21, AGG-11)."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("vulnerability_id"), "l_discount",
        F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "N", "potential").otherwise("not_applicable").alias("a"))
    signals = rows.groupBy("vulnerability_id").agg(F.max("l_discount").alias("score"), F.array_join(F.array_sort(F.collect_set("a")), ",").alias("weaknesses"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vulnerability_id")).join(signals, "vulnerability_id", "left")


@query("catalog_missing",
    "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity >= 49 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)")
def catalog_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referenced ids that the catalog lacks (SET-05, REC-06)."""
    asked = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("id")).distinct()
    return asked.join(table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("id")), "id", "left_anti")


@query("explode_json_union",
    """SELECT DISTINCT token FROM (SELECT CAST(json_extract(props, '$.k') AS VARCHAR) AS token FROM events UNION ALL SELECT unnest(string_split(p_name, ' '))
  FROM part) WHERE token <> ''""")
def explode_json_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed JSON fields and unnested arrays, united and distinct (SET-01, FN-34, FN-35)."""
    a = table(spark, sf_dir, "events").select(F.from_json("props", "k INT").getField("k").cast("string").alias("token"))
    b = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("token"))
    return a.unionByName(b).where("token <> ''").distinct()


@query("set_overlap", """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'
  AND value > 50)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_both,
  (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n_any,
  (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS n_only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS
    n_only_b""")  # fmt: skip
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes, intersection, union and differences (SET-02, SET-04)."""
    e = table(spark, sf_dir, "events")
    marks = e.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("a"),
        F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 50)).alias("b"))
    n = lambda c, name: F.count_if(c).alias(name)
    a, b = F.col("a"), F.col("b")
    return marks.agg(n(a, "n_a"), n(b, "n_b"), n(a & b, "n_both"), n(a | b, "n_any"), n(a & ~b, "n_only_a"), n(b & ~a, "n_only_b"))


@query("run_shares", """WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, day, n, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS share, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS
  BIGINT) AS running FROM d""")  # fmt: skip
def run_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of total and running sum (WIN-02), over pre-aggregated days."""
    d = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type")
    running = F.sum("n").over(w.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return d.select("event_type", "day", "n", F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"), running.alias("running"))


@query("monthly_counts", "SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1, 2")
def monthly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly counts per label (AGG-26)."""
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("n"))


@query("lease_recovery",
    "SELECT event_id, CASE WHEN event_type <> 'click' THEN 'pending' WHEN value >= 20 THEN 'failed' ELSE 'pending' END AS status FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00'")
def lease_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale work goes back to pending, or fails after too many attempts (STR-04)."""
    stale = table(spark, sf_dir, "events").where(F.col("ts") < F.lit("2024-01-10").cast("timestamp"))
    return stale.select("event_id", F.when(F.col("event_type") != "click", "pending").when(F.col("value") >= 20, "failed").otherwise("pending").alias("status"))


@query("latest_run_scope",
    "SELECT event_id, value FROM events WHERE user_id = (SELECT user_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 1)")
def latest_run_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the latest completed run (FLT-12)."""
    e = table(spark, sf_dir, "events")
    run = e.where("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("user_id")
    return e.join(F.broadcast(run), "user_id", "left_semi").select("event_id", "value")


@query("tuple_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT p_partkey, CAST(p_size AS BIGINT) FROM part)")
def tuple_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-column IN list as a semi join (FLT-05, FLT-07)."""
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("l_suppkey"))
    return table(spark, sf_dir, "lineitem").join(keys, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber")
