"""Vendor feeds as typed tables with a reject table.

Every reader takes a path that Spark reads and returns `Feed(valid, rejects)`.
Rows are never dropped silently: a reject has a reason and no payload, so that no
URL or secret gets into an error table. Schemas are declared, never inferred.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.functions import nested, policies, unicode, urls
from vigilake.functions import text as tx


@dataclass(frozen=True)
class Feed:
    valid: DataFrame
    rejects: DataFrame


def split(rows: DataFrame, key: str, reasons: dict[str, Column]) -> Feed:
    """Rows for which no reason holds, and (key, reason) of the others: the first
    reason in order (STR-05)."""
    reason = F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in reasons.items()])
    marked = rows.withColumn("_reason", reason)
    return Feed(marked.where("_reason IS NULL").drop("_reason"),
        marked.where("_reason IS NOT NULL").select(F.col(key).cast("string").alias("record_key"), F.col("_reason").alias("reason")))


def payload_id(source: str, record: Column, payload: Column) -> Column:
    """A stable id of a raw payload, the same on every replay."""
    return F.sha2(F.concat_ws("\x1f", F.lit(source), record, F.sha2(payload, 256)), 256)


def as_fields(columns: str) -> str:
    """`name type, ...` as the fields of a struct type."""
    return ", ".join(re.sub(r"^(\w+) ", r"\1: ", c) for c in re.split(r", (?=\w+ )", columns))


KEV_RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("cveID", "vendorProject", "product", "vulnerabilityName", "dateAdded",
    "shortDescription", "requiredAction", "dueDate", "knownRansomwareCampaignUse", "notes")] + [T.StructField("cwes", T.ArrayType(T.StringType()))])
KEV_FILE = T.StructType([T.StructField("catalogVersion", T.StringType()), T.StructField("dateReleased", T.StringType()),
    T.StructField("count", T.IntegerType()), T.StructField("vulnerabilities", T.ArrayType(KEV_RECORD))])


def kev(spark: SparkSession, path: str) -> Feed:
    """Known exploited vulnerabilities: a whole catalog in one object (SRC-02). A
    catalog whose declared count differs from its rows is rejected as a whole; of a
    repeated identifier all rows are rejected."""
    files = spark.read.schema(KEV_FILE).json(path, multiLine=True)
    complete = F.col("count") == F.size("vulnerabilities")
    rows = files.select("catalogVersion", complete.alias("complete"), F.explode("vulnerabilities").alias("v")).select("catalogVersion", "complete", "v.*")
    rows = rows.select(
        tx.cve(F.col("cveID")).alias("cve_id"), F.col("cveID").alias("raw_id"), tx.software_name(F.col("vendorProject")).alias("vendor"),
            tx.software_name(F.col("product")).alias("product"),
        tx.clean(F.col("vulnerabilityName"), 500).alias("name"), tx.strict_date(F.col("dateAdded")).alias("date_added"),
            tx.strict_date(F.col("dueDate")).alias("due_date"),
        (F.lower("knownRansomwareCampaignUse") == "known").alias("ransomware"), tx.cwe_list(F.col("cwes")).alias("weaknesses"), "complete",
            F.col("catalogVersion").alias("catalog_version"),
    )
    repeats = rows.groupBy("cve_id").agg((F.count("*") > 1).alias("repeated"))
    joined = rows.join(repeats, "cve_id", "left")
    return split(joined, "raw_id", {"incomplete_catalog": ~F.col("complete"), "bad_identifier": F.col("cve_id").isNull(),
        "repeated_identifier": F.col("repeated"), "bad_date_added": F.col("date_added").isNull()})


EPSS_FILE = T.StructType([T.StructField("status", T.StringType()),
    T.StructField("data", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("cve", "epss", "percentile", "date")])))])


def epss(spark: SparkSession, path: str) -> Feed:
    """Exploit forecasts; one identifier with different values in a batch is a
    conflict and all its rows are rejected (SRC-05)."""
    d = spark.read.schema(EPSS_FILE).json(path, multiLine=True).select(F.explode("data").alias("d")).select("d.*")
    rows = d.select(tx.cve(F.col("cve")).alias("cve_id"), F.col("cve").alias("raw_id"), tx.bounded(F.col("epss"), 0, 1).alias("score"),
        tx.bounded(F.col("percentile"), 0, 1).alias("percentile"), tx.strict_date(F.col("date")).alias("score_date")).distinct()
    clash = rows.groupBy("cve_id").agg((F.count("*") > 1).alias("conflict"))
    return split(rows.join(clash, "cve_id", "left"), "raw_id",
        {"bad_identifier": F.col("cve_id").isNull(), "conflicting_values": F.col("conflict"),
            "bad_score": F.col("score").isNull() | F.col("percentile").isNull(), "bad_date": F.col("score_date").isNull()})


PHISH = T.StructType([T.StructField(n, T.StringType()) for n in ("phish_id", "url", "submission_time", "verification_time", "verified", "online",
    "target")] + [T.StructField("details", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("ip_address", "cidr_block",
        "announcing_network", "rir", "country")])))])


def phishing(spark: SparkSession, path: str, limit: int | None = None) -> Feed:
    """Phishing snapshot, plain or .bz2 (SRC-06, ER-06). With a `limit` the rows are the
    first by identifier and `snapshot_complete` is false: what is missing from such a
    snapshot says nothing."""
    d = spark.read.schema(PHISH).json(path, multiLine=True)
    if limit is not None:
        d = d.orderBy(tx.positive_id(F.col("phish_id")).asc_nulls_last()).limit(limit)
    submitted, verified_at = tx.iso_utc(F.col("submission_time")), tx.iso_utc(F.col("verification_time"))
    rows = d.select(
        tx.positive_id(F.col("phish_id")).alias("phish_id"), F.col("phish_id").alias("raw_id"), unicode.canonical(F.col("url")).alias("canonical_url"),
        submitted.alias("submitted_at"), verified_at.alias("verified_at"), tx.flag(F.col("verified")).alias("verified"),
            tx.flag(F.col("online")).alias("online"),
        tx.clean(F.col("target"), 200).alias("target"), "details", F.lit(limit is None).alias("snapshot_complete"),
    )
    rows = rows.withColumn("observed_at", F.coalesce("submitted_at", "verified_at"))
    rows = rows.withColumns({"active": F.coalesce(F.col("verified") & F.col("online"), F.lit(False)), "label": F.lit("phishing")})
    early = F.coalesce(F.col("verified_at") < F.col("submitted_at"), F.lit(False))
    feed = split(rows, "raw_id", {"bad_identifier": F.col("phish_id").isNull(), "bad_url": F.col("canonical_url").isNull(),
        "verified_before_submission": early})
    return Feed(networked(feed.valid), feed.rejects)


def networked(rows: DataFrame) -> DataFrame:
    """`details` as `network`: canonical addresses and networks, country in upper and
    registry in lower case, each once, in order (FN-36). Details without a valid address
    and network are left out; the arrays are taken apart, so that only what needs it is
    read outside of Spark."""
    each = rows.select("phish_id", F.posexplode("details").alias("at", "d")).select(
        "phish_id", "at", unicode.network(F.col("d.ip_address")).alias("ip"), unicode.network(F.col("d.cidr_block")).alias("cidr"),
        F.lower(F.trim("d.rir")).alias("rir"), F.when(F.trim("d.country").rlike("^[A-Za-z]{2}$"), F.upper(F.trim("d.country"))).alias("country"),
    )
    known = each.where("ip IS NOT NULL OR cidr IS NOT NULL")
    one = F.struct("ip", "cidr", "rir", "country")
    listed = known.groupBy("phish_id").agg(F.array_sort(F.collect_list(F.struct("at", one.alias("x")))).alias("n"))  # of one record
    listed = listed.select(F.col("phish_id").alias("of"), F.array_distinct(F.transform("n", lambda x: x["x"])).alias("network"))
    joined = rows.drop("details").join(listed, F.col("phish_id") == F.col("of"), "left").drop("of")
    return joined.withColumn("network", F.coalesce("network", F.array().cast("array<struct<ip:string,cidr:string,rir:string,country:string>>")))


MALWARE = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "url", "url_status", "date_added", "threat",
    "reporter")] + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("blacklists", T.MapType(T.StringType(), T.StringType()))])
MALWARE_FILE = T.StructType([T.StructField("query_status", T.StringType()), T.StructField("urls", T.ArrayType(MALWARE))])


def _malware(rows: DataFrame) -> Feed:
    return split(rows, "raw_id", {"bad_identifier": F.col("malware_id").isNull(), "bad_url": F.col("canonical_url").isNull(),
        "bad_time": F.col("added_at").isNull()})


def malware_urls(spark: SparkSession, path: str) -> Feed:
    """Recent malware URLs of the service's JSON answer (SRC-07, FN-42..44)."""
    d = spark.read.schema(MALWARE_FILE).json(path, multiLine=True).select(F.explode("urls").alias("u")).select("u.*")
    return _malware(d.select(
        tx.positive_id(F.col("id")).alias("malware_id"), F.col("id").alias("raw_id"), unicode.canonical(F.col("url")).alias("canonical_url"),
            tx.clean(F.col("url_status"), 50).alias("status"), tx.feed_timestamp(F.col("date_added")).alias("added_at"),
        tx.clean(F.col("threat"), 100).alias("threat"), tx.tags(F.col("tags")).alias("tags"), tx.named_statuses(F.col("blacklists")).alias("blacklists"),
    ))


def malware_dump(spark: SparkSession, path: str) -> Feed:
    """The service's CSV dump: comment lines, optional header, rows of 8 or 9
    columns, tags split on commas (SRC-09, STR-09). Lines are parsed where they are
    read; nothing is gathered."""
    return malware_lines(spark.read.text(path))


def malware_lines(text: DataFrame) -> Feed:
    """The dump's lines (value), of a batch or of a file stream: a line stands for itself,
    so a dump of any size is read batch by batch (STR-09)."""
    head = F.lower("value").startswith("id,") | F.lower("value").startswith('"id"')
    lines = text.where((F.col("value") != "") & ~F.col("value").startswith("#") & ~head)
    nine = F.from_csv(F.col("value"), "a string, b string, c string, d string, e string, f string, g string, h string, i string", {"mode": "PERMISSIVE"})
    rows = lines.select(nine.alias("r"), F.col("value")).withColumn("long", F.col("r.i").isNotNull())
    pick = lambda with_nine, with_eight: F.when(F.col("long"), F.col(f"r.{with_nine}")).otherwise(F.col(f"r.{with_eight}"))
    return _malware(rows.select(
        tx.positive_id(F.col("r.a")).alias("malware_id"), F.col("r.a").alias("raw_id"), unicode.canonical(F.col("r.c")).alias("canonical_url"),
            tx.clean(F.col("r.d"), 50).alias("status"), tx.feed_timestamp(F.col("r.b")).alias("added_at"),
        tx.clean(pick("f", "e"), 100).alias("threat"), tx.tags(F.split(pick("g", "f"), ",")).alias("tags"),
            F.lit(None).cast("array<struct<name:string,status:string>>").alias("blacklists"),
    ))


CWE_FIELDS = "ID string, Name string, Description string, Abstraction string, Structure string, Status string, ExtendedDescription string, LikelihoodOfExploit string, MappingNotes struct<Usage:string,Rationale:string>"
RELATIONS = "RelatedWeaknesses array<struct<Nature:string,CweID:string>>, RelatedAttackPatterns array<string>, CommonConsequences array<struct<Scope:array<string>,Impact:array<string>>>, PotentialMitigations array<struct<Phase:array<string>,Description:string>>, DetectionMethods array<struct<Method:string,Description:string>>, ApplicablePlatforms array<struct<Type:string,Name:string>>, AlternateTerms array<string>"


def weaknesses(spark: SparkSession, path: str) -> Feed:
    """Weakness catalog with its relations; one id with different content is a conflict
    (SRC-10, SNK-13, FN-05)."""
    schema = f"Weaknesses array<struct<{as_fields(CWE_FIELDS + ', ' + RELATIONS)}>>"
    d = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("Weaknesses").alias("w")).select("w.*")
    related = F.filter(F.transform("RelatedWeaknesses", lambda x: F.struct(x["Nature"].alias("nature"), tx.catalog_id(x["CweID"],
        "CWE").alias("cwe_id"))), lambda x: x["cwe_id"].isNotNull())
    attacks = F.filter(F.transform("RelatedAttackPatterns", lambda x: tx.catalog_id(x, "CAPEC")), lambda x: x.isNotNull())
    # A term is a text or an object with one.
    terms = F.transform("AlternateTerms", lambda x: tx.clean(F.coalesce(F.get_json_object(x, "$.Term"), x), 500))
    rows = d.select(
        tx.catalog_id(F.col("ID"), "CWE").alias("cwe_id"), F.col("ID").alias("raw_id"), tx.clean(F.col("Name"), 500).alias("name"),
            tx.clean(F.col("Description"), 500_000).alias("description"),
        tx.clean(F.col("ExtendedDescription"), 500_000).alias("extended_description"), F.col("Abstraction").alias("abstraction"),
            F.col("Structure").alias("structure"), F.col("Status").alias("status"),
        F.col("LikelihoodOfExploit").alias("likelihood"), F.col("MappingNotes.Usage").alias("mapping_usage"),
            F.col("MappingNotes.Rationale").alias("mapping_rationale"),
        F.array_distinct(related).alias("related"), F.array_distinct(attacks).alias("attack_patterns"),
            F.col("CommonConsequences").alias("consequences"), F.col("PotentialMitigations").alias("mitigations"),
        F.col("DetectionMethods").alias("detection_methods"), F.col("ApplicablePlatforms").alias("platforms"),
            F.array_distinct(F.filter(terms, lambda x: x.isNotNull())).alias("terms"),
    ).distinct()
    clash = rows.groupBy("cwe_id").agg((F.count("*") > 1).alias("conflict"))
    return split(rows.join(clash, "cwe_id", "left"), "raw_id",
        {"bad_identifier": F.col("cwe_id").isNull(), "conflicting_content": F.col("conflict"), "no_name": F.col("name").isNull()})


ADVISORY = T.StructType([
    T.StructField("ghsa_id", T.StringType()), T.StructField("cve_id", T.StringType()), T.StructField("severity", T.StringType()),
        T.StructField("summary", T.StringType()), T.StructField("published_at", T.StringType()), T.StructField("updated_at", T.StringType()),
            T.StructField("withdrawn_at", T.StringType()),
    T.StructField("cvss_severities", T.StructType([T.StructField(n, T.StructType([T.StructField("score", T.DoubleType()),
        T.StructField("vector_string", T.StringType())])) for n in ("cvss_v3", "cvss_v4")])),
    T.StructField("cvss", T.StructType([T.StructField("score", T.DoubleType()), T.StructField("vector_string", T.StringType())])),
    T.StructField("cwes", T.ArrayType(T.StructType([T.StructField("cwe_id", T.StringType())]))),
    T.StructField("vulnerabilities", T.ArrayType(T.StructType([T.StructField("package", T.StructType([T.StructField("ecosystem", T.StringType()),
        T.StructField("name", T.StringType())])), T.StructField("vulnerable_version_range", T.StringType()),
            T.StructField("first_patched_version", T.StringType()), T.StructField("source_code_location", T.StringType())]))),
    T.StructField("source_code_location", T.StringType()),
])


def advisories(spark: SparkSession, path: str) -> Feed:
    """Package advisories: identifiers, scores and affected packages (SRC-03, SRC-04,
    FN-27..29, FN-33). A score of 0 without a vector is no score; version 4 comes
    before 3; the older single field counts only where there is no version 3."""
    d = spark.read.schema(ADVISORY).json(path, multiLine=True)

    def metric(c: str, *versions: str) -> Column:
        """A metric with the version that its vector states, else the first given; one
        of a version that does not belong there is none."""
        score, vector = F.col(f"{c}.score"), F.col(f"{c}.vector_string")
        version = F.coalesce(policies.cvss_version(vector), F.lit(versions[0]))
        told = ((score > 0) | vector.isNotNull()) & version.isin(*versions)
        return F.when(told, F.struct(version.alias("version"), score.alias("score"), vector.alias("vector")))

    v3 = F.coalesce(metric("cvss_severities.cvss_v3", "3.1", "3.0"), metric("cvss", "3.1", "3.0", "2.0", "4.0"))
    metrics = F.filter(F.array(metric("cvss_severities.cvss_v4", "4.0"), v3), lambda x: x.isNotNull())
    primary = F.coalesce(F.get(F.filter(metrics, lambda x: x["score"] > 0), F.lit(0)), F.get(metrics, F.lit(0)))
    # The advisory's own locations, then those of its packages, as one JSON value.
    listed = F.concat(F.array("source_code_location"), F.transform("vulnerabilities", lambda v: v["source_code_location"]))
    as_json = lambda x: F.when(x.rlike(r"^\s*[\[{]"), x).otherwise(F.to_json(F.array(x)))
    every_location = F.concat(F.lit("["), F.array_join(F.transform(F.array_compact(F.coalesce(listed, F.array("source_code_location"))), as_json),
        ","), F.lit("]"))
    packages = F.array_distinct(F.transform("vulnerabilities", lambda v: F.struct(
        F.coalesce(tx.ecosystem(v["package"]["ecosystem"]), F.lower(F.trim(v["package"]["ecosystem"]))).alias("ecosystem"),
            tx.package_name(v["package"]["name"], v["package"]["ecosystem"]).alias("package_name"),
                tx.clean(v["vulnerable_version_range"]).alias("version_range"), tx.clean(v["first_patched_version"]).alias("first_patched"),
    )))
    rows = d.select(
        tx.ghsa(F.col("ghsa_id")).alias("ghsa_id"), F.col("ghsa_id").alias("raw_id"), tx.cve(F.col("cve_id")).alias("cve_id"),
            F.upper(F.trim("severity")).alias("severity"), tx.clean(F.col("summary"), 1000).alias("summary"),
        tx.iso_utc(F.col("published_at")).alias("published_at"), tx.iso_utc(F.col("updated_at")).alias("updated_at"),
            tx.iso_utc(F.col("withdrawn_at")).alias("withdrawn_at"),
        metrics.alias("metrics"), primary.alias("primary_metric"), nested.locations(every_location).alias("source_locations"),
            tx.cwe_list(F.transform("cwes", lambda w: w["cwe_id"])).alias("weaknesses"),
                F.filter(packages, lambda p: p["package_name"].isNotNull()).alias("packages"),
    )
    return split(rows, "raw_id", {"bad_identifier": F.col("ghsa_id").isNull(), "no_update_time": F.col("updated_at").isNull()})


COMPONENT = "component_type string, name string, version string, vendor string, external_id string, ecosystem string, package_name string, scope string, detected_by string"
INVENTORY = f"schema_version string, inventory_id string, collected_at string, machine struct<machine_uid:string,hostname:string,os_name:string>, components array<struct<{COMPONENT.replace(' string', ':string').replace(', ', ',')}>>"


#: The keys of the inventory contract.
ROOT_KEYS = ("agent", "collected_at", "components", "inventory_id", "machine", "schema_version")
APPLICATION_KEYS = ("component_type", "detected_by", "external_id", "name", "vendor", "version")
PACKAGE_KEYS = ("component_type", "detected_by", "ecosystem", "package_name", "scope", "version")


def inventories(spark: SparkSession, path: str, exact: bool = True) -> Feed:
    """Machine inventories: one row for each component; applications need a name,
    packages an ecosystem and a package name (SRC-13). With `exact` an inventory must
    have the keys of the contract, no more and no less, and so must each component by
    its type."""
    d = spark.read.format("json").option("multiLine", True).option("singleVariantColumn", "v").load(path).select(F.to_json("v").alias("text"))
    each = F.when(F.col("text").startswith("["), F.from_json("text", "array<string>")).otherwise(F.array("text"))  # a file holds one or a list
    d = d.select(F.explode(each).alias("text"))
    kinds = "array<map<string,string>>"
    d = d.select(F.from_json("text", INVENTORY).alias("r"), F.array_sort(F.json_object_keys("text")).alias("root_keys"),
        F.from_json(F.get_json_object("text", "$.components"), kinds).alias("maps"))
    both = F.when(F.size("r.components") > 0, F.arrays_zip(F.col("r.components").alias("c"), F.transform("maps",
        lambda m: F.array_sort(F.map_keys(m))).alias("keys")))
    rows = d.select("r.schema_version", "r.inventory_id", tx.iso_utc(F.col("r.collected_at")).alias("collected_at"),
        F.col("r.machine.machine_uid").alias("machine_uid"), "root_keys", F.explode_outer(both).alias("x"))
    rows = rows.select("*", "x.c.*", F.col("x.keys").alias("own_keys")).drop("x")
    app, package = F.col("component_type") == "application", F.col("component_type") == "package"
    name = F.when(app, unicode.software_name(F.col("name"))).when(package, unicode.package_name(F.col("package_name"), F.col("ecosystem")))
    rows = rows.withColumns({"normalized_name": name, "ecosystem": F.coalesce(tx.ecosystem(F.col("ecosystem")), F.lower(F.trim("ecosystem")))})
    keys = lambda names: F.array(*map(F.lit, names))
    wrong_keys = {
        "wrong_keys": F.col("root_keys") != keys(ROOT_KEYS),
        "wrong_component_keys": (app & (F.col("own_keys") != keys(APPLICATION_KEYS))) | (package & (F.col("own_keys") != keys(PACKAGE_KEYS))),
    }
    feed = split(rows, "inventory_id", {
        "unknown_schema": F.lower("schema_version") != "inventory/v1", "bad_time": F.col("collected_at").isNull(), "no_machine": F.col("machine_uid").isNull(),
        "unknown_component_type": ~(app | package), "package_without_ecosystem": package & F.col("ecosystem").isNull(),
            **(wrong_keys if exact else {}), "no_name": F.col("normalized_name").isNull(),
    })
    return Feed(feed.valid.drop("root_keys", "own_keys"), feed.rejects)


CANDIDATE_COLUMNS = ("url", "registered_domain", "source_rank", "source_snapshot", "observed_at")


def benign_candidates(spark: SparkSession, path: str) -> Feed:
    """Candidate pages of a web crawl from CSV with a header (SRC-11, SRC-12). The header
    must hold the columns, in any order, and may hold more."""
    header = spark.read.csv(path, header=True).columns
    missing = [c for c in CANDIDATE_COLUMNS if c not in header]
    if missing:
        raise ValueError(f"columns missing from the header: {', '.join(missing)}")
    d = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in header)).select(*CANDIDATE_COLUMNS)
    rows = d.select(
        F.col("url").alias("raw_url"), unicode.canonical(F.col("url")).alias("canonical_url"), F.lower("registered_domain").alias("domain"),
        tx.positive_id(F.col("source_rank")).alias("rank"), "source_snapshot", tx.iso_utc(F.col("observed_at")).alias("observed_at"),
    )
    host = urls.host(F.col("canonical_url"))
    inside = (host == F.col("domain")) | host.endswith(F.concat(F.lit("."), "domain"))
    feed = split(rows, "source_snapshot", {"bad_url": F.col("canonical_url").isNull(), "bad_rank": F.col("rank").isNull(),
        "bad_time": F.col("observed_at").isNull(), "outside_domain": ~inside})
    return Feed(feed.valid.drop("raw_url"), feed.rejects)
