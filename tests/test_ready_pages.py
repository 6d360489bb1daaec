"""Pages that lie ready are taken as one, and what came since a mark is one answer."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigilake.plans import ingestion
from vigilake.sources import pages
from vigilake.streaming import runs

T0 = dt.datetime(2026, 1, 1)


def laid_out(spark, path, n, size):
    rows = spark.range(n).select("id", F.col("id").cast("string").alias("record_id"), F.lit("{}").alias("payload"),
        (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("modified_at"))
    pages.lay_out(rows, ["id"], size, path)


def test_one_write_for_all_pages_and_a_row_of_the_log_for_each(spark, tmp_path):
    path, got = f"file://{tmp_path}/pages", []
    laid_out(spark, path, 25, 4)
    store = lambda rows, batch: got.append((batch, rows.count(), rows.columns))
    one = runs.ingest(spark, runs.pages(path), runs.State(), lambda rows, batch: None)
    state, log = runs.ingest(spark, runs.pages(path, ahead=True), runs.State(), store)
    assert got == [(0, 25, ["record_id", "payload", "modified_at"])] and state == one[0]
    assert sorted(map(tuple, log.collect())) == sorted(map(tuple, one[1].collect())) and log.count() == 7
    (tmp_path / "pages" / "page=3").rename(tmp_path / "gone")  # what is after a missing page is not ready
    state, log = runs.ingest(spark, runs.pages(path, ahead=True), runs.State(), store)
    assert got[-1][:2] == (0, 12) and log.count() == 3

    def broken(rows, batch):
        raise ValueError("disk full")

    state, log = runs.ingest(spark, runs.pages(path, ahead=True), runs.State(), broken)
    assert state == runs.State(attempts=1) and [r["status"] for r in log.collect()] == ["failed"]


def test_what_came_since_the_mark_is_one_answer(spark, tmp_path):
    n = 2 * ingestion.PAGE + 10
    spark.range(n).select(F.col("id").alias("event_id"), F.lit(T0).cast("timestamp_ntz").alias("ts"), F.lit("{}").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    log = ingestion.ingestion_runs(spark, str(tmp_path)).orderBy("run_id", "batch").collect()
    assert [tuple(r) for r in log] == [(1, 0, ingestion.PAGE, "running"), (1, 1, ingestion.PAGE, "running"), (1, 2, 10, "completed"), (2, 0, n, "completed")]


@pytest.mark.parametrize("n", [3, pages.TASKS * 3 + 5])
def test_a_task_of_a_stream_reads_a_run_of_pages(n):
    parts = pages.PageStreamReader("/nowhere").partitions({"page": 2}, {"page": 2 + n})
    assert [i for p in parts for i in range(p.number, p.upto)] == list(range(2, 2 + n)) and len(parts) <= 2 * pages.TASKS
