"""Observations of many feeds to canonical records: vulnerabilities by shared
identifiers, web indicators by URL identity. Conflicts are reported, never merged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions import unicode, urls
from vigilake.operators.resolution import components
from vigilake.session import cut

#: States of a record that takes no more observations.
TERMINAL = ("withdrawn", "rejected", "merged")


@dataclass(frozen=True)
class Canonical:
    """`records`, their `identifiers` and `evidence`, and the `conflicts` and `rejects`
    that came to none of them."""

    records: DataFrame
    identifiers: DataFrame
    evidence: DataFrame
    conflicts: DataFrame
    rejects: DataFrame


def is_cve(identifier: Column) -> Column:
    return identifier.startswith("CVE-")


def last_seen() -> Column:
    return F.coalesce("last_observed_at", "observed_at")


def merged_evidence(observations: DataFrame) -> DataFrame:
    """One piece of evidence for each (source, record_key): the freshest by seven fields
    gives record, type, rule and confidence, times are the least and greatest, and a
    missing hash is filled from an older piece (ER-04, SNK-05)."""
    long_ago = F.lit("0001-01-01").cast("timestamp_ntz")
    fresh = F.struct(
        last_seen().alias("a"), F.coalesce("modified_at", long_ago).alias("b"), "record_id", "evidence_type", "rule", "confidence",
        F.coalesce("record_hash", F.lit("")).alias("g"),
    )
    top = F.max_by(F.struct("record_id", "evidence_type", "rule", "confidence"), fresh)
    hashed = F.max_by("record_hash", F.when(F.col("record_hash").isNotNull(), fresh))
    return observations.groupBy("source", "record_key").agg(
        top.alias("top"), F.min("observed_at").alias("observed_at"), F.max(last_seen()).alias("last_observed_at"),
        F.min("published_at").alias("published_at"), F.max("modified_at").alias("modified_at"), hashed.alias("record_hash"),
    ).select("source", "record_key", "top.*", "observed_at", "last_observed_at", "published_at", "modified_at", "record_hash")


def correlated(observations: DataFrame, stored_identifiers: DataFrame, stored_records: DataFrame, stored_evidence: DataFrame) -> Canonical:
    """Vulnerabilities of a batch (ER-01 to ER-05, ER-08, SNK-05).

    `observations`: (record_id, source, record_key, identifiers, observed_at,
    last_observed_at, published_at, modified_at, evidence_type, rule, confidence,
    record_hash, withdrawn). Observations that share an identifier, a piece of evidence
    or a stored record become one; withdrawn ones are refused. A component that touches
    several stored records, or one in a terminal state, is a conflict. The primary
    identifier is the stored one if it is a CVE, else the smallest CVE, else the stored
    one, else the smallest. A catalog of known exploitation makes a record active.
    """
    rejects = observations.where("withdrawn").select("record_id", F.lit("withdrawn").alias("reason"))
    rows = cut(observations.where("NOT coalesce(withdrawn, false)").drop("withdrawn"), "observations")
    named = rows.select("record_id", F.explode("identifiers").alias("identifier"))
    tag = lambda kind, c: F.concat(F.lit(kind), c.cast("string")).alias("shared")
    held = named.join(stored_identifiers.select("identifier", "vulnerability_id"), "identifier")
    proved = rows.join(stored_evidence, ["source", "record_key"]).select("record_id", "vulnerability_id")
    owners = cut(held.select("record_id", "vulnerability_id").unionByName(proved).distinct(), "owners")
    links = (
        named.select("record_id", tag("id:", F.col("identifier")))
        .unionByName(rows.select("record_id", tag("evidence:", F.concat_ws(":", "source", "record_key"))))
        .unionByName(owners.select("record_id", tag("record:", F.col("vulnerability_id"))))
    )
    found = components(links.withColumnRenamed("record_id", "node")).withColumnRenamed("node", "record_id")
    found = cut(found, "components")

    touched = owners.join(found, "record_id").groupBy("component").agg(F.array_sort(F.collect_set("vulnerability_id")).alias("ids"))
    known = touched.withColumn("vulnerability_id", F.get("ids", F.lit(0))).join(stored_records, "vulnerability_id", "left")
    several, ended = F.size("ids") > 1, F.col("status").isin(*TERMINAL)
    known = cut(known.withColumn("reason", F.when(several, "several_records").when(ended, "terminal_record")), "known")
    conflicts = known.where("reason IS NOT NULL").select("component", F.array_join("ids", ",").alias("vulnerability_ids"), "reason")
    existing = known.where("reason IS NULL").select("component", "vulnerability_id", "status", "created_at", "updated_at")
    good = cut(rows.join(found, "record_id").join(conflicts.select("component"), "component", "left_anti"), "good")

    parts = merged_evidence(good)
    evidence = cut(parts.join(good.select("source", "record_key", "component").distinct(), ["source", "record_key"]), "evidence")
    times = evidence.groupBy("component").agg(F.min("observed_at").alias("first"), F.max("last_observed_at").alias("last"), F.count("*").alias("n_evidence"))
    active = good.groupBy("component").agg(F.bool_or(F.col("source") == "kev").alias("kev"))
    joined = times.join(active, "component").join(existing, "component", "left")
    status = F.when(F.col("kev") | F.coalesce(F.col("status") == "active", F.lit(False)), "active").otherwise("provisional")
    records = joined.select(
        "component", "vulnerability_id", F.coalesce("created_at", "first").alias("created_at"), F.greatest("last", "updated_at").alias("updated_at"),
        status.alias("status"), "n_evidence",
    )

    own = good.select("component", F.explode("identifiers").alias("identifier"))
    before = existing.select("component", "vulnerability_id").join(stored_identifiers, "vulnerability_id").select("component", "identifier", "is_primary")
    every = own.withColumn("is_primary", F.lit(False)).unionByName(before)
    # One row for each identifier (ownership is checked above), one of them primary.
    each = cut(every.groupBy("component", "identifier").agg(F.bool_or("is_primary").alias("was")), "identifiers")
    order = F.struct((~is_cve(F.col("identifier"))).alias("a"), (~F.col("was")).alias("b"), "identifier")
    primary = each.groupBy("component").agg(F.min_by("identifier", order).alias("primary"))
    identifiers = each.join(primary, "component").select("component", "identifier", (F.col("identifier") == F.col("primary")).alias("is_primary"))
    return Canonical(records, identifiers, evidence, conflicts, rejects)


def web_observations(rows: DataFrame) -> Canonical:
    """Web observations by URL identity, before they meet stored records (ER-06): rows
    (source, record_key, url, submitted_at, verified_at, normalized_at,
    last_observed_at, record_id, threat, active) get value_hash, observed_at (the first
    of the times that is known), label; refused URLs are rejects."""
    url = unicode.canonical(F.col("url"))
    observed = F.coalesce("submitted_at", "verified_at", "normalized_at")
    label = F.when(F.col("source") == "phish", "phishing").otherwise("malware_distribution")
    given = rows.select(
        "source", "record_key", "record_id", "active", label.alias("label"), url.alias("canonical_url"), observed.alias("observed_at"),
        F.greatest(F.coalesce("last_observed_at", observed), observed).alias("last_observed_at"),
    )
    given = cut(given.withColumn("value_hash", urls.value_hash(F.col("canonical_url"))), "web")
    rejects = given.where("canonical_url IS NULL").select("record_id", F.lit("bad_url").alias("reason"))
    empty = given.limit(0)
    return Canonical(given.where("canonical_url IS NOT NULL"), empty, empty, empty, rejects)


def web_correlated(rows: DataFrame, stored: DataFrame, now: Column) -> Canonical:
    """Web indicators of a batch (ER-06, ER-07, ER-09, ER-10, SNK-07).

    One indicator for each URL identity, no merging by host or address. A source record
    seen with two identities, or stored under another one, is a conflict. A new
    indicator is created now, whatever the observations say; a stored one keeps its
    creation and only its update time moves, never back. `stored`: (source, record_key,
    url, indicator_id, created_at, updated_at).
    """
    given = web_observations(rows)
    seen = given.records
    kept = stored.select("source", "record_key", urls.value_hash(unicode.canonical(F.col("url"))).alias("value_hash"), "indicator_id", "created_at",
        "updated_at")
    kept = cut(kept, "stored")
    keys = ["source", "record_key"]
    both = seen.select(*keys, "value_hash").unionByName(kept.select(*keys, "value_hash"))
    identities = both.groupBy(*keys).agg(F.count_distinct("value_hash").alias("n")).where("n > 1")
    moved = kept.select(*keys).withColumn("was_stored", F.lit(True))
    asked = identities.join(seen.select(*keys).distinct(), keys, "left_semi").join(moved.distinct(), keys, "left")
    reason = F.when(F.col("was_stored"), "moved_to_another_url").otherwise("two_identities")
    conflicts = cut(asked.select(*keys, reason.alias("reason")), "conflicts")
    good = seen.join(conflicts.select(*keys), keys, "left_anti")

    newest = F.struct("last_observed_at", "record_id")
    top = F.max_by(F.struct("record_id", "active", "label"), newest).alias("top")
    evidence = good.groupBy("value_hash", *keys).agg(top, F.min("observed_at").alias("observed_at"), F.max("last_observed_at").alias("last_observed_at"))
    evidence = evidence.select("value_hash", *keys, "top.*", "observed_at", "last_observed_at")
    records = good.groupBy("value_hash").agg(F.min("canonical_url").alias("canonical_url"), F.count_distinct(F.struct(*keys)).alias("n_observations"))
    old = kept.groupBy("value_hash").agg(F.min("indicator_id").alias("indicator_id"), F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"))
    joined = records.join(old, "value_hash", "left")
    created = F.coalesce("created_at", now)
    out = joined.select("value_hash", "canonical_url", "indicator_id", created.alias("created_at"),
        F.greatest(created, now, "updated_at").alias("updated_at"), "n_observations")
    return Canonical(out, evidence.limit(0), evidence, conflicts, given.rejects)


def accepted_forecasts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Forecasts after a batch (SNK-03, SNK-04): of one batch the latest for each record
    counts; it replaces the stored one if its date is newer, or the date is the same,
    the synchronization not older and a value differs. (vulnerability_id, cve_id, score,
    percentile, score_date, synchronized_at) -> the same with `replaced`."""
    order = F.struct("score_date", "synchronized_at", "cve_id", "score")
    columns = ["cve_id", "score", "percentile", "score_date", "synchronized_at"]
    latest = incoming.groupBy("vulnerability_id").agg(F.max_by(F.struct(*columns), order).alias("new"))
    both = stored.select("vulnerability_id", F.struct(*columns).alias("old")).join(latest, "vulnerability_id", "full")
    of = lambda side, *names: F.struct(*[F.col(f"{side}.{n}") for n in names])
    differs = ~of("new", "cve_id", "score", "percentile").eqNullSafe(of("old", "cve_id", "score", "percentile"))
    same_day = (F.col("new.score_date") == F.col("old.score_date")) & (F.col("new.synchronized_at") >= F.col("old.synchronized_at")) & differs
    take = F.col("old").isNull() | F.coalesce((F.col("new.score_date") > F.col("old.score_date")) | same_day, F.lit(False))
    chosen = F.when(take, F.col("new")).otherwise(F.col("old"))
    return both.select("vulnerability_id", chosen.alias("x"), take.alias("replaced")).select("vulnerability_id", "x.*", "replaced")


def merged_weaknesses(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Weakness associations after a batch (SNK-09): the more recent by
    coalesce(source_modified_at, last_observed_at) gives the source, incoming wins ties,
    times are the least and greatest known. (vulnerability_id, cwe_id, source,
    observed_at, last_observed_at, source_modified_at)."""
    keys = ["vulnerability_id", "cwe_id"]
    both = stored.withColumn("new", F.lit(0)).unionByName(incoming.withColumn("new", F.lit(1)))
    recent = F.struct(F.coalesce("source_modified_at", "last_observed_at").alias("a"), "new", "source")
    return both.groupBy(*keys).agg(
        F.max_by("source", recent).alias("source"), F.min("observed_at").alias("observed_at"),
        F.max("last_observed_at").alias("last_observed_at"), F.max("source_modified_at").alias("source_modified_at"),
    )
