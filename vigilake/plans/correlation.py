"""Observations to canonical records, enrichment, and the machine pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.functions import policies, urls
from vigilake.operators import merge, resolution
from vigilake.plans.base import COMPONENTS, EXPOSURES, MACHINES, components, exposures, machines, query
from vigilake.plans.url_dataset import CANON, canonical_pages
from vigilake.session import scratch_path, table

OBSERVED = """obs AS (
  SELECT 'kev:' || s_suppkey AS node, 'CVE-2024-' || lpad(CAST(s_suppkey % 40 AS VARCHAR), 4, '0') AS identifier, s_suppkey AS observed_at, true AS
    active FROM supplier
  UNION ALL SELECT 'adv:' || s_suppkey, 'GHSA-' || (s_suppkey % 30), s_suppkey + 1000, false FROM supplier
  UNION ALL SELECT 'adv:' || s_suppkey, 'CVE-2024-' || lpad(CAST(s_nationkey + 100 AS VARCHAR), 4, '0'), s_suppkey + 1000, false FROM supplier),
links AS (SELECT DISTINCT node, identifier AS shared FROM obs),
step0 AS (SELECT node, min(node) AS c FROM links GROUP BY node)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-exploited (active) and advisory (provisional) observations (ER-05)."""
    s = table(spark, sf_dir, "supplier")
    cve = lambda n: F.concat(F.lit("CVE-2024-"), F.lpad(n.cast("string"), 4, "0"))
    key = lambda source: F.concat(F.lit(source), F.col("s_suppkey").cast("string")).alias("node")
    kev = s.select(key("kev:"), cve(F.col("s_suppkey") % 40).alias("identifier"), F.col("s_suppkey").alias("observed_at"), F.lit(True).alias("active"))
    adv = s.select(key("adv:"), F.explode(F.array(F.concat(F.lit("GHSA-"), (F.col("s_suppkey") % 30).cast("string")),
        cve(F.col("s_nationkey") + 100))).alias("identifier"), (F.col("s_suppkey") + 1000).alias("observed_at"), F.lit(False).alias("active"))
    return kev.unionByName(adv)


@query("canonical_vulnerabilities", f"""WITH RECURSIVE {OBSERVED},
reach(a, b) AS (SELECT node, node FROM links UNION SELECT r.a, y.node FROM reach r JOIN links x ON x.node = r.b JOIN links y ON y.shared = x.shared),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)
SELECT component, coalesce(min(identifier) FILTER (starts_with(identifier, 'CVE-')), min(identifier)) AS primary_identifier, min(observed_at) AS
  created_at, max(observed_at) AS updated_at,
  bool_or(active) AS active, count(DISTINCT node) AS n_evidence FROM obs JOIN comp USING (node) GROUP BY component""")  # fmt: skip
def canonical_vulnerabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that share identifiers become one record (ER-01, ER-03, ER-08)."""
    obs = observations(spark, sf_dir)
    found = resolution.components(obs.select("node", F.col("identifier").alias("shared")))
    return resolution.aggregates(obs, found)


@query("identifier_owner_conflicts",
    """WITH o AS (SELECT l_orderkey AS component, l_suppkey % 3 AS owner FROM lineitem) SELECT component, count(DISTINCT owner) AS n_owners FROM o GROUP BY
  component HAVING count(DISTINCT owner) > 1""")
def identifier_owner_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that touch several stored records are reported, never merged (ER-02)."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("node"),
        F.col("l_orderkey").alias("component"), (F.col("l_suppkey") % 3).alias("owner"))
    return resolution.owner_conflicts(rows.select("node", "component").distinct(), rows.select("node", "owner").distinct())


@query("web_indicators", f"""WITH {CANON} SELECT sha256('https://' || host || path) AS value_hash, count(*) AS n_observations, min(page_id) AS first_record, max(page_id) AS
  last_record, count(DISTINCT query || fragment) AS n_variants
FROM c GROUP BY 1""")  # fmt: skip
def web_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL observations grouped by identity: no fuzzy merging (ER-07, ER-09, SNK-07)."""
    u = F.col("canonical_url")
    place = F.concat(F.lit("https://"), "host", urls.part(u, 3))
    return canonical_pages(spark, sf_dir).groupBy(urls.value_hash(place).alias("value_hash")).agg(
        F.count("*").alias("n_observations"), F.min("page_id").alias("first_record"), F.max("page_id").alias("last_record"),
            F.count_distinct(F.concat(urls.part(u, 4), urls.part(u, 5))).alias("n_variants"),
    )


@query("evidence_merge", """WITH e AS (SELECT l_orderkey AS id, l_suppkey AS record, l_shipdate AS last_at, l_quantity AS q, l_tax AS tax FROM lineitem)
SELECT id, arg_max(record, (last_at, q, tax, record)) AS record, min(last_at) AS first_at, max(last_at) AS last_at, count(*) AS n FROM e GROUP BY id""")  # fmt: skip
def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The freshest evidence by a several-field order, least and greatest times
    (ER-04, SNK-05, SNK-09): one pre-aggregated pass."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("record"),
        F.col("l_shipdate").alias("last_at"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("tax"))
    return e.groupBy("id").agg(F.max_by("record", F.struct("last_at", "q", "tax", "record")).alias("record"), F.min("last_at").alias("first_at"),
        F.max("last_at").alias("last_at"), F.count("*").alias("n"))


@query("forecast_enrichment", """SELECT p_partkey, s.score, s.at, CASE WHEN s.score IS NULL THEN 'missing' WHEN s.score >= 0.09 THEN 'elevated' ELSE 'known' END AS state
FROM part LEFT JOIN (SELECT l_partkey, arg_max(l_discount, (l_shipdate, l_orderkey, l_linenumber, l_discount)) AS score, max(l_shipdate) AS at FROM
  lineitem WHERE l_quantity >= 48 GROUP BY 1) s ON s.l_partkey = p_partkey""")  # fmt: skip
def forecast_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest score of each record, and those that have none (JOIN-11, JOIN-20)."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity >= 48").groupBy(F.col("l_partkey").alias("p_partkey"))
    latest = rows.agg(F.max_by("l_discount", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_discount")).alias("score"),
        F.max("l_shipdate").alias("at"))
    state = F.when(F.col("score").isNull(), "missing").when(F.col("score") >= 0.09, "elevated").otherwise("known")
    return table(spark, sf_dir, "part").select("p_partkey").join(latest, "p_partkey", "left").select("p_partkey", "score", "at", state.alias("state"))


@query("weakness_associations", """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part), e AS (SELECT p_partkey, unnest(words) AS word, generate_subscripts(words,
  1) AS pos FROM w),
k AS (SELECT p_partkey, word, min(pos) AS pos FROM e WHERE length(word) % 2 = 0 GROUP BY 1, 2) SELECT p_partkey, string_agg(word, ',' ORDER BY pos) AS
  official, count(*) AS n FROM k GROUP BY p_partkey""")  # fmt: skip
def weakness_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source tokens that the official catalog has, in order, without repeats
    (JOIN-12, JOIN-13, SET-06): array functions only, no shuffle."""
    kept = F.array_distinct(F.filter(F.split("p_name", " "), lambda w: F.length(w) % 2 == 0))
    rows = table(spark, sf_dir, "part").select("p_partkey", kept.alias("k")).where(F.size("k") > 0)
    return rows.select("p_partkey", F.array_join("k", ",").alias("official"), F.size("k").cast("long").alias("n"))


MACHINE_SQL = f"""WITH {EXPOSURES}, {COMPONENTS}, {MACHINES}, x AS (
  SELECT machine_id, organization_id, vulnerability_id, applicability, is_kev, CASE priority WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3
    WHEN 'CRITICAL' THEN 4 ELSE 1 END AS base FROM exposures JOIN components USING (component_id) JOIN machines USING (machine_id) WHERE applicability
    <> 'not_applicable'),
s AS (SELECT l_partkey AS vulnerability_id, max(l_discount) * 9 AS percentile, max(l_tax) / 2 AS score, bool_or(l_linenumber = 7) AS weak FROM
  lineitem GROUP BY 1),
o AS (SELECT x.*, weak, least(base + CASE WHEN percentile >= 0.9 OR score >= 0.04 THEN 1 ELSE 0 END, 4) AS once FROM x LEFT JOIN s USING
  (vulnerability_id)),
p AS (SELECT *, CASE WHEN is_kev AND applicability = 'confirmed' THEN 4 WHEN weak THEN greatest(once, least(once + 1, 3)) ELSE once END AS r FROM o)
SELECT machine_id, organization_id, count(*) AS n_exposures, count(*) FILTER (r = 4) AS n_critical, count(DISTINCT vulnerability_id) AS
  n_vulnerabilities, max(r) AS worst FROM p GROUP BY 1, 2"""


@query("machine_pipeline", MACHINE_SQL)
def machine_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority by the policy, with forecasts and weaknesses, and totals for every
    machine in one job (REC-04). Matching, severity, transitions and alerts of the whole
    pipeline are `processed_exposures`, `processed_transitions`, `processed_alerts`."""
    weak = F.when(F.bool_or(F.col("l_linenumber") == 7), F.array(F.lit("CWE-79"))).otherwise(F.array(F.lit("CWE-1")))
    signals = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("vulnerability_id")).agg(
        (F.max("l_discount") * 9).alias("percentile"), (F.max("l_tax") / 2).alias("score"), weak.alias("cwe_ids"),
    )
    x = exposures(spark, sf_dir).where("applicability <> 'not_applicable'").join(components(spark, sf_dir).select("component_id", "machine_id"), "component_id")
    x = x.join(machines(spark, sf_dir).select("machine_id", "organization_id"), "machine_id").join(signals, "vulnerability_id", "left")
    kev = F.col("is_kev") & (F.col("applicability") == "confirmed")
    r = policies.rank(policies.priority(F.col("priority"), kev, F.col("percentile"), F.col("score"), F.col("cwe_ids")))
    return x.withColumn("r", r).groupBy("machine_id", "organization_id").agg(
        F.count("*").alias("n_exposures"), F.count_if(F.col("r") == 4).alias("n_critical"),
            F.count_distinct("vulnerability_id").alias("n_vulnerabilities"), F.max("r").alias("worst"),
    )


@query("work_claim", """SELECT event_id, ts FROM events e WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'purchase' AND r.user_id =
  e.user_id AND r.ts >= e.ts) ORDER BY ts, event_id LIMIT 500""")
def work_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oldest pending payloads seen in a completed run (STR-03): the existence test is
    one maximum for each run key."""
    e = table(spark, sf_dir, "events")
    done = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("done_at"))
    rows = e.where("event_type = 'view'").join(done, "user_id").where("done_at >= ts")
    return rows.select("event_id", "ts").orderBy("ts", "event_id").limit(500)


@query("latest_inventories", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
s AS (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM r)
SELECT o_custkey AS machine_uid, o_orderkey AS inventory_id, CASE WHEN newest IS NULL OR o_orderdate > newest THEN 'accepted' WHEN o_orderdate =
  newest THEN 'timestamp_conflict' ELSE 'stale' END AS outcome FROM s""")  # fmt: skip
def latest_inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each inventory of a machine in order of arrival: accepted if it is
    newer than all before; of the same time with another id, or older, it is rejected
    (STR-07)."""
    o = table(spark, sf_dir, "orders")
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    newest, at = F.max("o_orderdate").over(before), F.col("o_orderdate")
    outcome = F.when(newest.isNull() | (at > newest), "accepted").when(at == newest, "timestamp_conflict").otherwise("stale")
    return o.select(F.col("o_custkey").alias("machine_uid"), F.col("o_orderkey").alias("inventory_id"), outcome.alias("outcome"))


@query("alert_status_updates",
    """SELECT event_id, CASE WHEN event_type IN ('view', 'error') AND value >= 40 THEN 'sent' WHEN event_type = 'view' AND value < 5 THEN 'failed' ELSE
  event_type END AS status FROM events""")
def alert_status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pending or failed -> sent, pending -> failed (SNK-15)."""
    t, v = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.when(t.isin("view", "error") & (v >= 40), "sent").when((t == "view") & (v < 5),
        "failed").otherwise(t).alias("status"))


@query("actionable_matches",
    """SELECT l_orderkey, l_linenumber, p_partkey IS NOT NULL AS resolved FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size >= 10 WHERE
  l_returnflag = 'A'""")
def actionable_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches split into resolved and unresolved (FLT-09, JOIN-02)."""
    part = table(spark, sf_dir, "part").where("p_size >= 10").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("hit"))
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").join(part, "l_partkey", "left")
    return rows.select("l_orderkey", "l_linenumber", F.col("hit").isNotNull().alias("resolved"))


@query("three_valued_filter", """WITH b AS (SELECT doc_id, lang = 'en' AS verified, CASE WHEN n_chars % 3 = 0 THEN NULL ELSE source <> 'src0' END AS online FROM documents)
SELECT doc_id, verified, online, coalesce(verified AND online, false) AS active FROM b WHERE (verified IS TRUE AND online IS TRUE) OR (verified IS
  NULL OR online IS NULL)""")  # fmt: skip
def three_valued_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IS TRUE of nullable flags (FLT-03): null is not true, and a row whose flag is
    unknown is not active."""
    verified, online = F.col("lang") == "en", F.when(F.col("n_chars") % 3 == 0, None).otherwise(F.col("source") != "src0")
    rows = table(spark, sf_dir, "documents").select("doc_id", verified.alias("verified"), online.alias("online"))
    true = F.col("verified").eqNullSafe(True) & F.col("online").eqNullSafe(True)
    unknown = F.col("verified").isNull() | F.col("online").isNull()
    return rows.withColumn("active", true).where(true | unknown)


@query("keep_first_rows", f"""WITH {CANON} SELECT group_key, path, min(page_id) AS page_id FROM c GROUP BY group_key, path""")
def keep_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key in a stable order (SET-07)."""
    rows = canonical_pages(spark, sf_dir).select("group_key", urls.part(F.col("canonical_url"), 3).alias("path"), "page_id")
    return merge.newest(rows, ["group_key", "path"], [(-F.col("page_id")).alias("o")])


@query("collated_page", """SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY lower(p_name), coalesce(p_retailprice, -1) DESC, p_partkey LIMIT 100""")
def collated_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page in case- and accent-insensitive order, nulls as -1 (TOP-05)."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    return rows.orderBy(F.collate("p_name", "fr_CI_AI"), F.coalesce("p_retailprice", F.lit(-1.0)).desc(), "p_partkey").limit(100)


@query("payload_hashes",
    """SELECT event_id, sha256('{"id":' || event_id || ',"type":"' || event_type || '","user":' || user_id || '}') AS payload_hash FROM events""")
def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash of canonical JSON: keys in order, compact (FN-15)."""
    body = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("user_id").alias("user")))
    return table(spark, sf_dir, "events").select("event_id", F.sha2(body, 256).alias("payload_hash"))


@query("csv_export", """SELECT page_id, url FROM pages WHERE url IS NOT NULL""")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as CSV and read back (SNK-20, SRC-11)."""
    path = scratch_path(spark, "csv")
    table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", "url").write.csv(path, header=True, escape='"')
    return spark.read.csv(path, header=True, schema="page_id long, url string", escape='"', multiLine=True)


@query("sample_preparation", f"""WITH {CANON} SELECT sha256(canonical_url) AS sample_id, group_key, CASE WHEN ends_with(host, '.com') THEN 'phishing' WHEN ends_with(host, '.net') THEN
  'malware' ELSE 'benign' END AS label,
  CAST(CASE WHEN ends_with(host, '.com') OR ends_with(host, '.net') THEN 1.0 ELSE 0.9 END AS DOUBLE) AS confidence, length(canonical_url) AS
    url_length FROM c""")  # fmt: skip
def sample_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity, group, label, confidence and a feature of each sample (DS-02)."""
    h, u = F.col("host"), F.col("canonical_url")
    label = F.when(h.endswith(".com"), "phishing").when(h.endswith(".net"), "malware").otherwise("benign")
    return canonical_pages(spark, sf_dir).select(urls.value_hash(u).alias("sample_id"), "group_key", label.alias("label"),
        F.when(label == "benign", 0.9).otherwise(1.0).alias("confidence"), F.length(u).cast("long").alias("url_length"))
