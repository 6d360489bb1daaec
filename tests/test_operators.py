"""Merges, resolution, feeds, streams and every registered query."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from vigilake.operators import merge, order, resolution
from vigilake.plans.registry import FLAGSHIP, ORACLES, QUERIES
from vigilake.sources import feeds
from vigilake.streaming import ingest

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert got.count() >= 0
        return
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    expected = sorted((tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in want.fetchall()), key=repr)
    found = sorted((tuple(plain(v) for v in r) for r in rows(got)), key=repr)
    assert found == expected


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES


def test_merge_replay(spark):
    """merge(merge(T, B), B) == merge(T, B), and older rows change nothing."""
    stored = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "id int, clock int, v string")
    batch = spark.createDataFrame([(1, 4, "old"), (2, 5, "same time"), (3, 1, "new")], "id int, clock int, v string")
    once = merge.merge_monotonic(stored, batch, ["id"], "clock")
    assert rows(once) == rows(merge.merge_monotonic(once, batch, ["id"], "clock"))
    assert {r["id"]: r["v"] for r in once.collect()} == {1: "a", 2: "same time", 3: "new"}


def test_diff(spark):
    old = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id int, v string")
    new = spark.createDataFrame([(1, "x"), (2, "y"), (4, "w")], "id int, v string")
    assert {r["id"]: r["action"] for r in merge.diff(old, new, ["id"], ["v"]).collect()} == {1: "unchanged", 2: "update", 3: "delete", 4: "insert"}


def test_conflicts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "id int, v string")
    assert [r["id"] for r in merge.conflicts(df, ["id"], ["v"]).collect()] == [2]


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    pairs = [(n, f"s{rng.randrange(60)}") for n in range(80) for _ in range(rng.randrange(1, 3))] + [(n, f"chain{n // 2}") for n in range(200,
        230)] + [(n + 1, f"chain{n // 2}") for n in range(200, 230)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for n, s in pairs:
        a, b = root(n), root(s)
        parent[a] = b
    least = {}
    for n, _ in pairs:
        least[root(n)] = min(least.get(root(n), n), n)
    rng.shuffle(pairs)  # the order of rows does not matter
    found = resolution.components(spark.createDataFrame(pairs, "node long, shared string")).collect()
    assert {r["node"]: r["component"] for r in found} == {n: least[root(n)] for n, _ in pairs}


def test_aggregates_and_owner_conflicts(spark):
    obs = spark.createDataFrame([("k1", "CVE-2024-0002", 3, False), ("k2", "GHSA-X", 1, True), ("k2", "CVE-2024-0001", 1, True)],
        "node string, identifier string, observed_at int, active boolean")
    found = spark.createDataFrame([("k1", "k1"), ("k2", "k1")], "node string, component string")
    a = resolution.aggregates(obs, found).first()
    assert (a["primary_identifier"], a["created_at"], a["updated_at"], a["active"], a["n_evidence"]) == ("CVE-2024-0001", 1, 3, True, 2)
    owners = spark.createDataFrame([("k1", 10), ("k2", 11)], "node string, owner int")
    assert resolution.owner_conflicts(found, owners).first()["n_owners"] == 2


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def reasons(feed):
    return sorted(r["reason"] for r in feed.rejects.collect())


def test_kev_feed(spark, tmp_path):
    ok = {"cveID": "cve-2024-0001", "vendorProject": " Acme  Inc ", "product": "Thing", "dateAdded": "2024-01-02", "dueDate": "bad",
        "knownRansomwareCampaignUse": "Known", "cwes": ["CWE-079", "x"]}
    bad = [dict(ok, cveID="nope"), dict(ok, cveID="CVE-2024-0002", dateAdded="2024-1-2"), dict(ok, cveID="CVE-2024-0003"), dict(ok, cveID="CVE-2024-0003")]
    feed = feeds.kev(spark, put(tmp_path / "kev.json", {"catalogVersion": "1", "count": 5, "vulnerabilities": [ok, *bad]}))
    (r,) = feed.valid.collect()
    assert (r["cve_id"], r["vendor"], r["ransomware"], r["weaknesses"], r["due_date"]) == ("CVE-2024-0001", "acme inc", True, ["CWE-79"], None)
    assert reasons(feed) == ["bad_date_added", "bad_identifier", "repeated_identifier", "repeated_identifier"]
    assert reasons(feeds.kev(spark, put(tmp_path / "short.json", {"count": 2, "vulnerabilities": [ok]}))) == ["incomplete_catalog"]


def test_epss_feed(spark, tmp_path):
    d = [{"cve": "CVE-2024-0001", "epss": "0.5", "percentile": "0.9", "date": "2024-01-01"}] * 2 + [{"cve": "CVE-2024-0002", "epss": "1.5",
        "percentile": "0.9", "date": "2024-01-01"}]
    d += [{"cve": "CVE-2024-0003", "epss": e, "percentile": "0.9", "date": "2024-01-01"} for e in ("0.1", "0.2")]
    feed = feeds.epss(spark, put(tmp_path / "epss.json", {"status": "OK", "data": d}))
    assert [r["cve_id"] for r in feed.valid.collect()] == ["CVE-2024-0001"]
    assert reasons(feed) == ["bad_score", "conflicting_values", "conflicting_values"]


def test_phishing_feed(spark, tmp_path):
    ok = {"phish_id": "7", "url": "http://Bad.example/", "submission_time": "2024-01-01T00:00:00+00:00",
        "verification_time": "2024-01-02T00:00:00+00:00", "verified": "yes", "online": "no",
            "details": [{"ip_address": "1.2.3.4", "rir": "RIPE", "country": "de"}]}
    feed = feeds.phishing(spark, put(tmp_path / "p.json", [ok, dict(ok, phish_id="0"), dict(ok, phish_id="8", url="mailto:x"), dict(ok, phish_id="9",
        verification_time="2023-01-01T00:00:00Z")]))
    (r,) = feed.valid.collect()
    assert (r["canonical_url"], r["active"], r["network"][0]["rir"], r["network"][0]["country"]) == ("http://bad.example/", False, "ripe", "DE")
    assert reasons(feed) == ["bad_identifier", "bad_url", "verified_before_submission"]


def test_malware_feeds(spark, tmp_path):
    u = {"id": "5", "url": "http://m.example/x", "url_status": "online", "date_added": "2024-01-01 10:00:00 UTC", "tags": [" a ", "a", None, "b"],
        "blacklists": {"z": "listed", "b": "not"}}
    feed = feeds.malware_urls(spark, put(tmp_path / "m.json", {"query_status": "ok", "urls": [u, dict(u, id="x"), dict(u, date_added="?")]}))
    (r,) = feed.valid.collect()
    assert r["tags"] == ["a", "b"] and [b["name"] for b in r["blacklists"]] == ["b", "z"]
    assert reasons(feed) == ["bad_identifier", "bad_time"]
    dump = '# comment\n"id","dateadded","url","url_status","last_online","threat","tags","urlhaus_link","reporter"\n"1","2024-01-01 10:00:00","http://a.example/","online","","malware","x,y","l","r"\n"2","2024-01-01 10:00:00","http://b.example/","offline","malware","z","l","r"\n'
    got = {r["malware_id"]: (r["threat"], r["tags"]) for r in feeds.malware_dump(spark, put(tmp_path / "d.csv", dump)).valid.collect()}
    assert got == {1: ("malware", ["x", "y"]), 2: ("malware", ["z"])}


def test_advisories(spark, tmp_path):
    a = {"ghsa_id": "GHSA-23cf-gh4v-56pq", "cve_id": "CVE-2024-0001", "severity": "moderate", "updated_at": "2024-01-01T00:00:00Z",
        "cvss_severities": {"cvss_v3": {"score": 0.0, "vector_string": None}, "cvss_v4": {"score": 8.1, "vector_string": "CVSS:4.0/x"}},
            "cvss": {"score": 5.0, "vector_string": "CVSS:3.1/x"}, "cwes": [{"cwe_id": "CWE-79"}]}
    a["vulnerabilities"] = [{"package": {"ecosystem": "pip", "name": "A_b"}, "vulnerable_version_range": "< 2"}] * 2
    feed = feeds.advisories(spark, put(tmp_path / "a.json", [a, dict(a, ghsa_id="x"), dict(a, updated_at=None)]))
    (r,) = feed.valid.collect()
    assert r["primary_metric"]["version"] == "4.0" and len(r["metrics"]) == 2 and len(r["packages"]) == 1
    assert reasons(feed) == ["bad_identifier", "no_update_time"]


def test_inventory_and_benign(spark, tmp_path):
    inv = {"schema_version": "inventory/v1", "inventory_id": "i1", "collected_at": "2024-01-01T00:00:00Z", "machine": {"machine_uid": "m1"},
        "components": [{"component_type": "application", "name": " My  App "},
            {"component_type": "package", "ecosystem": "pypi", "package_name": "A.B"}, {"component_type": "package", "package_name": "x"},
                {"component_type": "driver"}]}
    feed = feeds.inventories(spark, put(tmp_path / "i.json", [inv]), exact=False)
    assert sorted(r["normalized_name"] for r in feed.valid.collect()) == ["a-b", "my app"]
    assert reasons(feed) == ["package_without_ecosystem", "unknown_component_type"]
    csv = "url,registered_domain,source_rank,source_snapshot,observed_at\nhttps://www.a.org/x,a.org,3,s,2024-01-01T00:00:00Z\nhttps://b.org/,a.org,3,s,2024-01-01T00:00:00Z\nhttps://a.org/,a.org,0,s,2024-01-01T00:00:00Z\n"
    feed = feeds.benign_candidates(spark, put(tmp_path / "b.csv", csv))
    assert [r["canonical_url"] for r in feed.valid.collect()] == ["https://www.a.org/x"] and reasons(feed) == ["bad_rank", "outside_domain"]


def test_weaknesses(spark, tmp_path):
    w = [{"ID": "79", "Name": "XSS", "Description": "d"}, {"ID": "79", "Name": "XSS", "Description": "d"}, {"ID": "80", "Name": "a"},
        {"ID": "80", "Name": "b"}, {"ID": "x", "Name": "n"}]
    feed = feeds.weaknesses(spark, put(tmp_path / "w.json", {"Weaknesses": w}))
    assert [r["cwe_id"] for r in feed.valid.collect()] == ["CWE-79"] and reasons(feed) == ["bad_identifier", "conflicting_content", "conflicting_content"]


def test_stream_lands_each_payload_once(spark, tmp_path):
    data = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), (None, "3")], "record_id string, payload string")
    data.repartition(2).write.parquet(str(tmp_path / "in"))
    out = f"file://{tmp_path}/out"
    stream = lambda: spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.drain(stream(), out, "s")
    data.limit(1).union(spark.createDataFrame([("c", "9")], data.schema)).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.drain(stream(), out, "s")
    stored = spark.read.parquet(f"{out}/raw")
    assert sorted(r["payload"] for r in stored.collect()) == ["1", "2", "9"] and stored.select("id").distinct().count() == 3
    assert spark.read.parquet(f"{out}/rejects").count() == 1


def test_components_of_a_long_chain(spark):
    """1,000 nodes that share values only with their neighbours, and a hub of 500."""
    chain = [(i, f"s{j}") for i in range(1000) for j in (i, i + 1)]
    hub = [(5000 + i, "hub") for i in range(500)] + [(9000, None), (9001, "alone")]
    got = {r["node"]: r["component"] for r in resolution.components(spark.createDataFrame(chain + hub, "node long, shared string")).collect()}
    assert all(got[i] == 0 for i in range(1000)) and all(got[5000 + i] == 5000 for i in range(500)) and got[9001] == 9001 and 9000 not in got


def test_quantiles_by_ranges(spark):
    """Exact, over many ranges, with a hot key, ties, a null key and null values."""
    rng = random.Random(2)
    rows = [("hot", float(rng.randrange(50))) for _ in range(3000)] + [("one", 5.0), ("two", 1.0), ("two", 2.0), (None, 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r["k"]: tuple(r)[1:] for r in order.quantiles(df, "k", "x", {"q0": 0.0, "q5": 0.5, "q9": 0.9, "q1": 1.0}).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {r["k"]: (r["n"], *r["q"]) for r in df.where("x is not null").groupBy("k").agg(F.count("*").alias("n"),
        F.percentile("x", [0.0, 0.5, 0.9, 1.0]).alias("q")).collect()}
    assert got == want and got["two"] == (2, 1.0, 1.5, pytest.approx(1.9), 2.0)


def test_inventory_keys_are_exact(spark, tmp_path):
    app = {"component_type": "application", "name": "A", "version": None, "vendor": None, "external_id": None, "detected_by": "x"}
    package = {"component_type": "package", "ecosystem": "pip", "package_name": "Foo_Bar", "version": "1", "scope": "user", "detected_by": "x"}
    inv = {"schema_version": "Inventory/V1", "inventory_id": "i1", "collected_at": "2026-01-01T00:00:00Z", "agent": {"name": "a", "version": "1"},
        "machine": {"machine_uid": "m1"}, "components": [app, package, dict(app, extra=1), {k: v for k, v in package.items() if k != "scope"}]}
    feed = feeds.inventories(spark, put(tmp_path / "i.json", [inv, dict(inv, more=1), {k: v for k, v in inv.items() if k != "agent"}]))
    assert sorted((r["normalized_name"], r["ecosystem"]) for r in feed.valid.collect()) == [("a", None), ("foo-bar", "pypi")]
    assert reasons(feed) == ["wrong_component_keys"] * 2 + ["wrong_keys"] * 8


def test_feeds_of_odd_shapes(spark, tmp_path):
    """Network details, partial snapshots, CVSS versions of vectors, nested locations,
    relations of weaknesses, headers."""
    details = [{"ip_address": "2001:DB8::0:1", "cidr_block": "10.1.2.3/8", "rir": " RIPE ", "country": "de"}] * 2 + [{"ip_address": "999.1.1.1",
        "country": "xx"}, {"ip_address": "1.2.3.4", "country": "Germany"}]
    phish = [{"phish_id": str(i), "url": "http://bücher.example/", "submission_time": "2026-01-01T00:00:00Z", "details": details} for i in (3, 1, 2)]
    feed = feeds.phishing(spark, put(tmp_path / "p.json", phish), limit=2)
    got = {r["phish_id"]: r for r in feed.valid.collect()}
    assert set(got) == {1, 2} and not got[1]["snapshot_complete"] and got[1]["canonical_url"] == "http://xn--bcher-kva.example/"
    assert [tuple(n) for n in got[1]["network"]] == [("2001:db8::1", "10.0.0.0/8", "ripe", "DE"), ("1.2.3.4", None, None, None)]

    a = {"ghsa_id": "GHSA-23cf-gh4v-56pq", "updated_at": "2026-01-01T00:00:00Z", "cvss": {"score": 5.0, "vector_string": "CVSS:3.0/x"},
        "source_code_location": {"url": "u1", "location": ["l1", {"path": "p1"}]}}
    a["vulnerabilities"] = [{"package": {"ecosystem": "pip", "name": "A_b"}, "source_code_location": "u2"},
        {"package": {"ecosystem": "pip", "name": "C"}, "source_code_location": ["u1", "  "]}]
    (r,) = feeds.advisories(spark, put(tmp_path / "a.json", [a])).valid.collect()
    assert r["primary_metric"]["version"] == "3.0" and r["source_locations"] == ["u1", "l1", "p1",
        "u2"] and [p["ecosystem"] for p in r["packages"]] == ["pypi", "pypi"]

    w = {"ID": "079", "Name": "n", "RelatedWeaknesses": [{"Nature": "ChildOf", "CweID": "0074"}, {"Nature": "x", "CweID": "?"}],
        "RelatedAttackPatterns": ["063", "CAPEC-63"], "AlternateTerms": ["XSS", {"Term": "HTML injection"}], "MappingNotes": {"Usage": "Allowed"}}
    (r,) = feeds.weaknesses(spark, put(tmp_path / "w.json", {"Weaknesses": [w, w]})).valid.collect()
    assert (r["cwe_id"], r["related"][0]["cwe_id"], len(r["related"]), r["attack_patterns"], r["terms"], r["mapping_usage"]) == ("CWE-79", "CWE-74",
        1, ["CAPEC-63"], ["XSS", "HTML injection"], "Allowed")

    more = "more,observed_at,source_snapshot,source_rank,registered_domain,url\n1,2026-01-01T00:00:00Z,s,3,a.org,https://www.a.org/x\n"
    assert feeds.benign_candidates(spark, put(tmp_path / "b.csv", more)).valid.first()["rank"] == 3
    with pytest.raises(ValueError, match="observed_at"):
        feeds.benign_candidates(spark, put(tmp_path / "c.csv", "url,registered_domain,source_rank,source_snapshot\n"))


def test_ingestion_by_small_pages(spark, tmp_path):
    """Pages of two over ties of time: every record once, then the overlap again."""
    from rules.fixtures import day
    from vigilake.sources import pages
    from vigilake.streaming import runs

    def source(rows, name):
        pages.lay_out(rows, ["modified_at", "record_id"], 2, f"file://{tmp_path}/{name}")
        return runs.pages(f"file://{tmp_path}/{name}")

    records = spark.createDataFrame([(str(i), "{}", day(i // 3)) for i in range(7)], "record_id string, payload string, modified_at timestamp_ntz")
    got = []
    store = lambda rows, batch: got.append([r["record_id"] for r in rows.orderBy("modified_at", "record_id").collect()])
    state, log = runs.ingest(spark, source(records, "all"), runs.State(), store)
    assert got == [["0", "1"], ["2", "3"], ["4", "5"], ["6"]] and state == runs.State(None, day(2), None, 0, True)
    assert [r["status"] for r in log.orderBy("batch").collect()] == ["running"] * 3 + ["completed"]
    got.clear()
    asked = records.where(F.col("modified_at") >= F.lit(runs.since(state)).cast("timestamp_ntz"))
    state, _ = runs.ingest(spark, source(asked, "since"), state, store)
    assert got == [["6"]] and state.high_water_mark == day(2)
    state, log = runs.ingest(spark, runs.pages(f"file://{tmp_path}/all"), runs.State(), store, max_batches=2)
    assert [r["status"] for r in log.orderBy("batch").collect()] == ["running", "incomplete"]
    assert not state.complete and state.cursor is not None and state.high_water_mark is None and state.candidate_mark == day(1)
