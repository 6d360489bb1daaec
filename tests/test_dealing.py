"""Rows dealt out by their number: alerts by recipient, read models summed by key."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from vigilake.plans import base, exposure_rules, registry

SF = "/root/testdata/sf0.001"


def test_recipients_in_lists_are_what_the_join_gives(spark):
    rows = spark.createDataFrame([(m, v, t, m % 3) for m in range(20) for v, t in ((1, "a"), (2, None), (None, "b"))],
        "machine_id long, vulnerability_id long, alert_type string, organization_id int")
    recipients = spark.createDataFrame([(0, n) for n in range(50)] + [(1, 7), (1, 7), (1, None), (9, 1), (None, 2)], "organization_id int, recipient_id long")
    want = rows.join(recipients, "organization_id").select("machine_id", "vulnerability_id", "alert_type",
        F.expr("'alert/v1:' || alert_type || ':' || machine_id || '-' || vulnerability_id || ':recipient:' || recipient_id AS dedup_key"))
    for block, within in ((1_000, 1_000), (8, 1_000), (8, 0)):
        got = exposure_rules.to_recipients(rows, recipients, block, within)
        assert got.count() == want.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_no_list_holds_an_organization(spark):
    lists = exposure_rules.in_lists(spark.range(5_000).select(F.lit(1).alias("organization_id"), F.col("id").alias("recipient_id")), 100)
    sizes = [r["n"] for r in lists.select(F.size("told").alias("n")).collect()]
    assert sum(sizes) == 5_000 and len(sizes) == 50 and max(sizes) < 200


def test_alerts_are_dealt_over_all_tasks_and_no_join_copies_rows(spark):
    """With recipients too many for Spark to broadcast by itself, each organization was one task's."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = registry.QUERIES["alert_candidates"](spark, SF)
        per = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        plan = got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(per) == spark.sparkContext.defaultParallelism and "strategy=broadcast" in plan and "explode(told" in plan


def odd_tables(spark, path):
    """Null keys, an order twice with two customers, lines twice, keys that fit nothing."""
    t = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    at = dt.datetime(1997, 5, 1)
    t("customer", [(1, "a", 3, "X"), (2, "b", 3, None), (3, "c", 4, "X")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string")
    t("orders", [(10, 1, "F", "1-URGENT", at, 1.0), (10, 2, "F", "1-URGENT", at, 1.0), (11, 2, "O", "4-NOT SPECIFIED", at, 1.0), (12, None, "O", None, at, 1.0),
        (None, 1, "F", "1-URGENT", at, 1.0), (13, 3, None, None, at, 1.0), (14, 1, "F", "1-URGENT", at, 1.0)],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp_ntz, o_totalprice double")
    line = lambda o, p, q, s="F", r="A", n=1: (o, n, p, 1, q, s, r, at)
    t("lineitem", [line(10, 100, 50.0), line(10, 100, 1.0, "O", "N", 2), line(10, 101, None), line(11, 100, 20.0, "O", "N"), line(11, None, 46.0), line(12, 100, 48.0),
        line(99, 100, 48.0), line(None, 100, 48.0), line(14, 101, 2.0, None, None), line(14, 101, 2.0, None, None)],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_linestatus string, l_returnflag string, l_shipdate timestamp_ntz")
    t("part", [(100, "p")], "p_partkey long, p_name string")


def by_sql(path, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    want = con.execute(registry.ORACLES[name])
    return [d[0] for d in want.description], sorted(want.fetchall(), key=repr)


def test_vuln_summary_of_odd_tables_is_its_sql(spark, tmp_path):
    odd_tables(spark, str(tmp_path))
    names, want = by_sql(tmp_path, "vuln_summary")
    assert sorted((tuple(r) for r in registry.QUERIES["vuln_summary"](spark, str(tmp_path)).select(*names).collect()), key=repr) == want


def test_software_list_of_odd_tables_is_its_sql(spark, tmp_path):
    odd_tables(spark, str(tmp_path))
    names, want = by_sql(tmp_path, "software_list")
    assert sorted((tuple(r) for r in registry.QUERIES["software_list"](spark, str(tmp_path)).select(*names).collect()), key=repr) == want


def no_more_in_a_task(spark, name):
    """The query's first shuffles follow the number of rows, even where the session's are few."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sides = [line for line in plan.split("\n") if "Exchange hashpartitioning(component_id" in line]
    return sides, [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "vulnerability_id" in line and "REPARTITION_BY_NUM" in line], plan


def test_vuln_summary_copies_no_rows_and_bounds_its_tasks(spark):
    sides, summed, plan = no_more_in_a_task(spark, "vuln_summary")
    assert "Expand" not in plan and len(sides) == 2 and all(", 4), REPARTITION_BY_NUM" in s for s in sides) and len(summed) == 1


def test_software_list_bounds_its_tasks(spark):
    sides, summed, plan = no_more_in_a_task(spark, "software_list")
    assert "Expand" not in plan and len(sides) == 2 and all(", 4), REPARTITION_BY_NUM" in s for s in sides) and len(summed) == 1


def test_tasks_follow_the_rows(spark):
    assert base.tasks(spark.range(10)) == spark.sparkContext.defaultParallelism and base.tasks(spark.range(101), 10) == 11
