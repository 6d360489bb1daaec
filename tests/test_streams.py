"""The paged data source and streams with keyed state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigilake.sources import pages
from vigilake.streaming import keyed, runs

T0 = dt.datetime(2026, 1, 1)


def records(spark, ids):
    rows = [(str(i), f'{{"n": {i}}}', T0 + dt.timedelta(minutes=i), i) for i in ids]
    return spark.createDataFrame(rows, "record_id string, payload string, modified_at timestamp_ntz, n long")


def drained(spark, path, root):
    out = pages.stream_pages(spark, path).writeStream.format("parquet").option("checkpointLocation", f"{root}/mark").trigger(availableNow=True).start(f"{root}/out")
    out.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def test_pages_are_read_once_and_in_order(spark, tmp_path):
    path, root = f"file://{tmp_path}/pages", f"file://{tmp_path}/run"
    upto = pages.lay_out(records(spark, range(25)), ["modified_at", "n"], 10, path)
    assert upto == 3
    batch = {(r["page"], r["place"], r["record_id"]) for r in pages.read_pages(spark, path).collect()}
    assert batch == {(i // 10, i, str(i)) for i in range(25)}
    assert pages.read_pages(spark, path).rdd.getNumPartitions() == 3  # a task for each page
    assert drained(spark, path, root).count() == 25
    assert drained(spark, path, root).count() == 25  # nothing new: nothing read
    first = spark.read.parquet(f"{root}/out").select(F.min("page"), F.max("page")).first()
    assert tuple(first) == (0, 2)
    (tmp_path / "pages" / "page=0").rename(tmp_path / "gone")  # what is read is never opened again
    (tmp_path / "pages" / "page=0").mkdir()
    pages.lay_out(records(spark, range(25, 40)), ["modified_at", "n"], 10, path, upto)
    found = drained(spark, path, root)
    assert sorted(int(r["record_id"]) for r in found.collect()) == list(range(40))
    assert found.groupBy("record_id").count().where("count > 1").isEmpty()


def test_missing_pages_wait(spark, tmp_path):
    path, root = f"file://{tmp_path}/pages", f"file://{tmp_path}/run"
    assert pages.pages_of(path) == [] and pages.read_pages(spark, path).collect() == []
    pages.lay_out(records(spark, range(5)), ["n"], 2, path, 0)
    (tmp_path / "pages" / "page=1").rename(tmp_path / "late")
    assert {r["page"] for r in drained(spark, path, root).collect()} == {0}
    (tmp_path / "late").rename(tmp_path / "pages" / "page=1")
    assert sorted(r["place"] for r in drained(spark, path, root).collect()) == list(range(5))


def test_runs_have_no_silent_end(spark, tmp_path):
    path = f"file://{tmp_path}/pages"
    n = 1_005  # more batches than any fixed number of old
    spark.range(n).select(F.col("id").alias("page"), F.col("id").alias("place"), F.col("id").cast("string").alias("record_id"), F.lit("{}").alias("payload"),
        F.lit(T0).cast("timestamp_ntz").alias("modified_at")).repartition(4).write.partitionBy("page").parquet(path)
    source, one = runs.pages(path), records(spark, [1]).drop("n")
    numbers = pages.pages_of(path)
    assert numbers == list(range(n))

    def fast(cursor, state):  # the cursor of each page, with one small page in place of its rows
        at = int(cursor or 0)
        return runs.Fetch(one, str(at + 1) if at + 1 < 40 else None)

    state, log = runs.ingest(spark, fast, runs.State(), lambda rows, batch: None, max_batches=5)
    assert not state.complete and state.cursor == "5" and [r["status"] for r in log.orderBy("batch").collect()] == ["running"] * 4 + ["incomplete"]
    state, log = runs.ingest(spark, fast, state, lambda rows, batch: None)
    assert state.complete and log.count() == 35
    got = source("1004", {})
    assert got.next_cursor is None and [r["record_id"] for r in got.records.collect()] == ["1004"] and source("3", {}).next_cursor == "4"


def fed(spark, rows, schema, decide, tmp_path, batches):
    """Batches of rows one after another through one stream."""
    for n, batch in enumerate(batches):
        spark.createDataFrame([rows[i] for i in batch], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = decide(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        run = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/mark").start(f"{tmp_path}/out")
        run.processAllAvailable()
        run.stop()
    return spark.read.parquet(f"{tmp_path}/out")


def test_inventories_out_of_order(spark, tmp_path):
    at = lambda h: T0 + dt.timedelta(hours=h)
    rows = [(1, 0, 10, at(5)), (1, 1, 10, at(5)), (1, 2, 11, at(4)), (1, 3, 12, at(5)), (2, 4, 10, at(1)), (1, 5, 13, at(6)), (1, 6, 10, at(5)), (2, 7, 9, at(1)), (2, 8, 10, at(9))]
    found = fed(spark, rows, "machine_uid long, place long, inventory_id long, collected_at timestamp", keyed.inventories, tmp_path, [[4, 3, 0, 2, 1], [8, 5, 7, 6]])
    assert {r["place"]: r["outcome"] for r in found.collect()} == {0: "accepted", 1: "repeated", 2: "stale", 3: "timestamp_conflict", 4: "accepted", 5: "accepted", 6: "stale",
        7: "timestamp_conflict", 8: "repeated"}


@pytest.mark.parametrize("attempts", [1, 3])
def test_leases_run_out_by_timer(spark, tmp_path, attempts):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [(1, at(0), "submit"), (1, at(1), "claim"), (2, at(0), "submit"), (2, at(2), "claim"), (2, at(9), "renew"), (3, at(1), "claim"), (4, at(1), "submit"), (4, at(2), "claim"),
        (4, at(3), "finish"), (4, at(4), "submit"), (9, at(14), "submit"), (9, at(40), "submit")]
    decide = lambda s: keyed.leased_work(s.withWatermark("at", "0 seconds"), 600, attempts)
    found = fed(spark, rows, "work_id long, at timestamp, message string", decide, tmp_path, [list(range(10)), [10], [11]])
    by = {}
    for r in found.orderBy("work_id", "version").collect():
        by.setdefault(r["work_id"], []).append(r["status"])
    over = "failed" if attempts == 1 else "pending"
    assert by[1] == ["pending", "processing", over]  # at minute 11, told by the watermark of minute 14
    assert by[2] == ["pending", "processing", over]  # renewed until minute 19, told by that of minute 40
    assert by[4] == ["pending", "processing", "done", "pending"] and by[9] == ["pending"] and 3 not in by


def folded(rows):
    """Outcomes by place, row by row."""
    at, out = {}, {}
    for machine, place, inventory, seen in sorted(rows, key=lambda r: r[1]):
        current, newest = at.get(machine, (None, None))
        seen = dt.datetime.min if seen is None else seen
        if inventory is not None and inventory == current:
            out[place] = "repeated"
        elif newest is not None and seen <= newest:
            out[place] = "stale" if seen < newest else "timestamp_conflict"
        else:
            out[place], at[machine] = "accepted", (inventory, seen)
    return out


def test_machines_share_a_key_and_nothing_else(spark, tmp_path, monkeypatch):
    """Few calls of Python for many machines; numbers beyond 2 ** 53, missing ones and an id that comes again later and is no newer for that."""
    calls, many = f"{tmp_path}/calls", 2**60
    rows = [(m, 0, many + m % 3, T0 + dt.timedelta(hours=m * 7 % 5)) for m in list(range(200)) * 3] + [(None, 0, 5, T0), (None, 0, 5, T0), (1, 0, None, T0), (1, 0, None, None), (-1, 0, 3, None)]
    rows += [(300, 0, 1, T0), (300, 0, 1, T0 + dt.timedelta(hours=9)), (300, 0, 2, T0 + dt.timedelta(hours=3)), (many + 1, 0, many + 1, T0), (many, 0, many + 1, T0)]
    rows = [(m, place, i, seen) for place, (m, _, i, seen) in enumerate(rows)]
    order = keyed.inventories

    def decide(stream):
        apply = type(stream.groupBy()).applyInPandasWithState

        def counted(grouped, func, *more):
            def call(key, batches, state):
                with open(calls, "a") as f:
                    f.write("x")
                yield from func(key, batches, state)

            return apply(grouped, call, *more)

        with monkeypatch.context() as m:
            m.setattr(type(stream.groupBy()), "applyInPandasWithState", counted)
            return order(stream, 4)

    halves = [list(range(len(rows)))[::2], list(range(len(rows)))[1::2]]
    arrived = [(m, n, i, seen) for n, (m, _, i, seen) in enumerate(rows[k] for half in halves for k in half)]
    batches = [list(range(len(halves[0]))), list(range(len(halves[0]), len(rows)))]
    got = fed(spark, arrived, "machine_uid long, place long, inventory_id long, collected_at timestamp", decide, tmp_path, batches).collect()
    assert {r["place"]: r["outcome"] for r in got} == folded(arrived) and len(got) == len(arrived)
    assert {(r["machine_uid"], r["place"], r["inventory_id"]) for r in got} == {(m, place, i) for m, place, i, _ in arrived}
    assert len(open(calls).read()) <= 2 * 5
