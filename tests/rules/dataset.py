"""Registrable domains, snapshots and members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rules.base import query
from rules.fixtures import expected
from vigilake.operators import dataset


@query("registrable_domains", expected(
    "host VARCHAR, group_key VARCHAR",
    [
        ("a.b.example.com", "example.com"), ("example.com", "example.com"), ("com", "com"), ("x.y.co.uk", "y.co.uk"), ("co.uk", "co.uk"),
            ("a.b.c.ck", "b.c.ck"), ("b.c.ck", "b.c.ck"),
        ("www.ck", "www.ck"), ("a.www.ck", "www.ck"), ("me.github.io", "me.github.io"), ("deep.me.github.io", "me.github.io"),
            ("localhost", "localhost"), ("10.0.0.1", "10.0.0.1"), ("[2001:db8::1]", "[2001:db8::1]"),
    ],
))
def registrable_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrable domains by a public suffix list with wildcards, exceptions and private
    rules (FN-16). The list is a parameter: any table of its lines."""
    rules = spark.createDataFrame([(r,) for r in ("// comment", "com", "uk", "co.uk", "*.ck", "!www.ck", "io", "github.io", "")], "rule string")
    hosts = "a.b.example.com example.com com x.y.co.uk co.uk a.b.c.ck b.c.ck www.ck a.www.ck me.github.io deep.me.github.io localhost 10.0.0.1 [2001:db8::1]".split()
    return dataset.registrable_domains(spark.createDataFrame([(h,) for h in hosts], "host string"), rules)


SNAPSHOT = "name string, version string, feature_set_version string, targets string"


@query("ensured_snapshots", expected("name VARCHAR, version VARCHAR, status VARCHAR", [("urls", "1", "frozen"), ("urls", "2", "draft")]))
def ensured_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot is made once; asked for again it must be the same (SNK-17)."""
    stored = spark.createDataFrame([("urls", "1", "v1", "{}", "frozen")], SNAPSHOT + ", status string")
    fields = ["feature_set_version", "targets"]
    same, new = (spark.createDataFrame([("urls", v, "v1", "{}")], SNAPSHOT) for v in ("1", "2"))
    return dataset.ensure_snapshot(dataset.ensure_snapshot(stored, same, fields), new, fields).select("name", "version", "status")


def _persisted(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    samples = spark.createDataFrame([("a", "benign"), ("b", "phishing")], "sample_id string, label string")
    members = spark.createDataFrame([("s1", "a", "train")], "snapshot string, sample_id string, split string")
    rows = [("s1", "a", "train", "benign"), ("s1", "b", "test", "malware"), ("s1", "c", "train", "benign"), ("s1", "c", "train", "benign"),
        ("s1", "d", "train", "benign"), ("s1", "d", "test", "benign"), ("s1", "e", "train", "benign"), ("s1", "e", "train", "malware")]
    batch = spark.createDataFrame(rows, "snapshot string, sample_id string, split string, label string")
    return dataset.persisted_batch(samples, members, batch)


@query("persisted_members", expected("sample_id VARCHAR, label VARCHAR, split VARCHAR", [("a", "benign", "train"), ("b", "phishing", None), ("c",
    "benign", "train")]))
def persisted_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and members after a batch: new ones once, known ones unchanged (SNK-16)."""
    samples, members, _ = _persisted(spark)
    return dataset.one_to_one(samples, members.select("sample_id", "split"), ["sample_id"], "left")


@query("member_conflicts", expected("sample_id VARCHAR, reason VARCHAR", [("b", "label_conflict"), ("d", "member_conflict"), ("e", "label_conflict")]))
def member_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose label or split is contradicted (SNK-16)."""
    return _persisted(spark)[2]
