"""Ingestion runs, work queue and weakness references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rules.base import query
from rules.fixtures import day, expected
from vigilake.functions import text
from vigilake.operators import dataset, merge
from vigilake.streaming import runs


@query("failed_run", expected(
    "batch INTEGER, status VARCHAR, records BIGINT, error VARCHAR, cursor VARCHAR, attempts INTEGER, complete BOOLEAN",
    [(0, "running", 1, None, "next", 1, False), (1, "failed", 0, "ValueError: no answer from [redacted-url] token=***", "next", 1, False)],
))
def failed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that fails on its second page: the run is failed, the cursor stays, the
    text is redacted (STR-01, SNK-14, FN-37)."""

    def source(cursor: str | None, state: dict) -> runs.Fetch:
        if cursor == "next":
            raise ValueError("no answer from https://host/x?y token=abc")
        rows = spark.createDataFrame([("1", "{}", day(1))], "record_id string, payload string, modified_at timestamp_ntz")
        return runs.Fetch(rows, "next")

    state, log = runs.ingest(spark, source, runs.State(), lambda rows, batch: None)
    end = [F.lit(state.cursor).alias("cursor"), F.lit(state.attempts).alias("attempts"), F.lit(state.complete).alias("complete")]
    return log.select("batch", "status", "records", "error", *end)


@query("stuck_cursor", expected("status VARCHAR, error VARCHAR", [("running", None), ("failed", "StuckCursor: cursor same again")]))
def stuck_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that gives the same cursor again ends the run (STR-06)."""
    rows = spark.createDataFrame([("1", "{}", day(1))], "record_id string, payload string, modified_at timestamp_ntz")
    return runs.ingest(spark, lambda cursor, state: runs.Fetch(rows, "same"), runs.State(), lambda rows, batch: None)[1].select("status", "error")


PAYLOADS = "payload_id long, status string, received_at timestamp_ntz, attempts int, leased_at timestamp_ntz"
QUEUE = [
    (1, "pending", day(3), 0, None), (2, "pending", day(1), 0, None), (3, "pending", day(0), 0, None), (4, "processed", day(0), 1, None),
    (5, "processing", day(2), 1, day(1)), (6, "processing", day(2), 3, day(1)), (7, "processing", day(2), 1, day(9)), (8, "pending", day(4), 0, None),
]


@query("claimed_work", expected("payload_id BIGINT, status VARCHAR, attempts INTEGER", [(2, "processing", 1), (1, "processing", 1)]))
def claimed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two oldest pending payloads that a completed run has seen (STR-03)."""
    sightings = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 11), (4, 10), (8, 10)], "payload_id long, run_id long")
    log = spark.createDataFrame([(10, "completed"), (11, "failed")], "run_id long, status string")
    found = runs.claimed(spark.createDataFrame(QUEUE, PAYLOADS), sightings, log, 2)
    return found.select("payload_id", "status", "attempts")


@query("recovered_work", expected(
    "payload_id BIGINT, status VARCHAR, leased BOOLEAN",
    [(1, "pending", False), (2, "pending", False), (3, "pending", False), (4, "processed", False), (5, "pending", False), (6, "failed", False),
        (7, "processing", True), (8, "pending", False)],
))
def recovered_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases that ran out: pending again, or failed after three attempts (STR-04)."""
    rows = runs.recovered(spark.createDataFrame(QUEUE, PAYLOADS), F.lit(day(5)).cast("timestamp_ntz"), 3)
    return rows.select("payload_id", "status", F.col("leased_at").isNotNull().alias("leased"))


@query("requested_forecasts", expected(
    "place BIGINT, cve_id VARCHAR, score DOUBLE, state VARCHAR", [(0, "CVE-2", 0.2, "found"), (1, "CVE-1", None, "conflict"), (3, "CVE-3", None, "missing")],
))
def requested_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in the order of the request; conflicts and missing ones are told (SRC-05)."""
    asked = spark.createDataFrame([(0, "CVE-2"), (1, "CVE-1"), (2, "CVE-2"), (3, "CVE-3")], "place long, cve_id string")
    answers = spark.createDataFrame([("CVE-1", 0.1), ("CVE-1", 0.3), ("CVE-2", 0.2), ("CVE-2", 0.2), ("CVE-9", 0.9)], "cve_id string, score double")
    return runs.requested(asked, answers)


@query("owned_weaknesses", expected(
    "vulnerability_id BIGINT, cwe_id VARCHAR, place INTEGER", [(1, "CWE-79", 0), (1, "CWE-20", 2), (2, "CWE-89", 1)],
))
def owned_weaknesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weaknesses of the records that own a source's evidence, by the official catalog,
    in order and once (JOIN-12, JOIN-13, SET-06)."""
    sources = spark.createDataFrame([("adv", "a", ["CWE-79", "CWE-999", "CWE-20", "CWE-79"]), ("adv", "b", ["CWE-999", "CWE-89"]),
        ("adv", "c", ["CWE-20"])], "source string, record_key string, cwe_ids array<string>")
    evidence = spark.createDataFrame([("adv", "a", 1), ("adv", "b", 2)], "source string, record_key string, vulnerability_id long")
    catalog = spark.createDataFrame([("CWE-79",), ("CWE-89",), ("CWE-20",)], "cwe_id string")
    return dataset.associated_weaknesses(sources, evidence, catalog)


def _normal() -> Column:
    return text.cwe(F.col("ref"))


@query("reference_states", expected(
    "id BIGINT, resolved BIGINT, placeholder BIGINT, invalid BIGINT, unresolved BIGINT, cwe_ids VARCHAR",
    [(1, 2, 1, 0, 0, "CWE-79"), (2, 1, 0, 1, 1, "CWE-20"), (3, 0, 0, 0, 0, "")],
))
def reference_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References against the local catalog: resolved, placeholder, invalid, unresolved
    (JOIN-20)."""
    references = spark.createDataFrame([(1, ["79", "cwe-0079", "NVD-CWE-noinfo"]), (2, ["CWE-20", "what", "CWE-1234"]), (3, None)],
        "id long, refs array<string>")
    catalog = spark.createDataFrame([("CWE-79",), ("CWE-20",)], "cwe_id string")
    return dataset.reference_states(references, catalog, text.CWE_PLACEHOLDERS, _normal())


@query("catalog_upsert", expected("cwe_id VARCHAR, name VARCHAR, version VARCHAR", [("CWE-1", "kept", "4.1"), ("CWE-2", "new", "4.2"), ("CWE-3",
    "added", "4.2"), ("CWE-4", "old", "4.1")]))
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weakness catalog after a batch; contradicting rows change nothing (SNK-13)."""
    kinds = "cwe_id string, name string, version string"
    stored = spark.createDataFrame([("CWE-1", "kept", "4.1"), ("CWE-2", "old", "4.1"), ("CWE-4", "old", "4.1")], kinds)
    batch = spark.createDataFrame([("CWE-2", "new", "4.2"), ("CWE-3", "added", "4.2"), ("CWE-3", "added", "4.2"), ("CWE-4", "a", "4.2"),
        ("CWE-4", "b", "4.2"), ("CWE-5", "a", "1"), ("CWE-5", "b", "1")], kinds)
    return merge.upsert(stored, batch, ["cwe_id"])
