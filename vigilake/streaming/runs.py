"""Ingestion runs: batches of a source behind a cursor, with the state that the next
run starts from.

A connector answers `fetch(cursor, state) -> Fetch`. Runs, raw payloads and sync state
are tables; each function gives the rows that a run adds or the new state.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions.text import log_summary
from vigilake.session import cut
from vigilake.sources.pages import pages_of

#: How far behind its high-water mark a source is asked again.
OVERLAP = dt.timedelta(minutes=5)
RUN = "run_id long, batch int, cursor string, next_cursor string, status string, records long, error string"
STATE = "source string, cursor string, high_water_mark timestamp_ntz, candidate_mark timestamp_ntz, attempts int, complete boolean"


@dataclass(frozen=True)
class Fetch:
    """One answer of a connector: records (record_id, payload, modified_at), where to go
    on, and what the source says of itself (SRC-01)."""

    records: DataFrame
    next_cursor: str | None = None
    metadata: dict[str, object] = field(default_factory=dict)
    connector_version: str = "1"


@dataclass(frozen=True)
class Run:
    """Answers of a connector that lie ready, taken as one: those with the cursors from
    `first` and before `upto`, each of which goes on with the next. `records` also have
    `page`, the cursor; `next_cursor` is where the last answer goes on."""

    records: DataFrame
    first: int
    upto: int
    next_cursor: str | None = None


#: A connector may also have `ahead(cursor, state) -> Run | None`: what lies ready.
Connector = Callable[[str | None, dict], Fetch]


@dataclass(frozen=True)
class State:
    """Where a source stands (SNK-14): the cursor of an unfinished cycle, the mark up to
    which everything is known, and the mark that becomes it when the cycle ends."""

    cursor: str | None = None
    high_water_mark: dt.datetime | None = None
    candidate_mark: dt.datetime | None = None
    attempts: int = 0
    complete: bool = False


class StuckCursor(RuntimeError):
    """A source gave the same cursor again (STR-06)."""


def is_complete(fetch: Fetch) -> bool:
    """snapshot_complete, else pagination_complete, else no next cursor (STR-10)."""
    for name in ("snapshot_complete", "pagination_complete"):
        if isinstance(fetch.metadata.get(name), bool):
            return bool(fetch.metadata[name])
    return fetch.next_cursor is None


def since(state: State, overlap: dt.timedelta = OVERLAP) -> dt.datetime | None:
    """What a source is asked for: everything modified since the mark, less an overlap;
    what comes twice is dropped by its content (SRC-04, STR-02)."""
    return None if state.high_water_mark is None else state.high_water_mark - overlap


def advanced(state: State, fetch: Fetch, latest: dt.datetime | None) -> State:
    """The state after a batch. The greatest modification time seen becomes the mark only
    when the cycle of pages has ended (SRC-04)."""
    known = [m for m in (state.candidate_mark, latest) if m is not None]
    candidate = max(known) if known else None
    if not is_complete(fetch):
        return State(fetch.next_cursor, state.high_water_mark, candidate, 0, False)
    marks = [m for m in (state.high_water_mark, candidate) if m is not None]
    return State(None, max(marks) if marks else None, None, 0, True)


def ingest(
    spark: SparkSession, connector: Connector, state: State, store: Callable[[DataFrame, int], None], run_id: int = 1, max_batches: int | None = None
) -> tuple[State, DataFrame]:
    """Drain a source (STR-01, STR-06): fetch, store, advance, until it is complete. A
    run that is to stop after `max_batches` says so: its last batch is `incomplete`, and
    the state goes on from there. A batch that fails ends the run as failed and leaves
    the state of the batch before it, with one more attempt; nothing is fetched inside a
    write. What a connector has lying ready (`ahead`) is taken as one: one write, whose
    failure leaves the state before it, and still a row of the log for each answer.
    Returns the state and the log of the run."""
    log: list[tuple] = []
    taken, batch, ahead = [], 0, getattr(connector, "ahead", None) if max_batches is None else None
    while True:
        if max_batches is not None and batch >= max_batches:
            if log:
                log[-1] = (*log[-1][:4], "incomplete", *log[-1][5:])
            break
        cursor = state.cursor
        asked = {"since": since(state), "candidate_mark": state.candidate_mark}
        try:
            run = ahead(cursor, asked) if ahead else None
            if run is not None:
                state, rows = _taken(run, state, store, run_id, batch)
                taken.append(rows)
                batch += run.upto - run.first
                if state.complete:
                    break
                continue
            fetch = connector(cursor, asked)
            if fetch.next_cursor is not None and fetch.next_cursor == cursor:
                raise StuckCursor(f"cursor {cursor} again")
            store(fetch.records, batch)
            seen = fetch.records.agg(F.count("*").alias("n"), F.max("modified_at").alias("latest")).first()
            state = advanced(state, fetch, seen["latest"])
            log.append((run_id, batch, cursor, fetch.next_cursor, "completed" if state.complete else "running", seen["n"], None))
        except Exception as error:  # the run's own record of it; the text is redacted below
            log.append((run_id, batch, cursor, None, "failed", 0, f"{type(error).__name__}: {error}"))
            state = State(state.cursor, state.high_water_mark, state.candidate_mark, state.attempts + 1, False)
            break
        batch += 1
        if state.complete:
            break
    rows = reduce(DataFrame.unionByName, taken, spark.createDataFrame(log, RUN))
    return state, rows.withColumn("error", log_summary(F.col("error")))


def _taken(run: Run, state: State, store: Callable[[DataFrame, int], None], run_id: int, batch: int) -> tuple[State, DataFrame]:
    """The state after the answers of `run`, and their log: one write and one count for
    all, however many there are, with a row for each."""
    store(run.records.drop("page"), batch)
    seen = run.records.groupBy("page").agg(F.count("*").alias("records"), F.max("modified_at").alias("latest"))
    spark = run.records.sparkSession
    seen = cut(spark.range(run.first, run.upto).withColumnRenamed("id", "page").join(seen, "page", "left"), "log")
    end = advanced(state, Fetch(run.records, run.next_cursor), seen.agg(F.max("latest")).first()[0])
    page, last = F.col("page"), F.col("page") == run.upto - 1
    cursor = F.when(page == run.first, F.lit(state.cursor)).otherwise(page.cast("string"))
    onward = F.when(last, F.lit(run.next_cursor)).otherwise((page + 1).cast("string"))
    return end, seen.select(
        F.lit(run_id).cast("long").alias("run_id"), (page - run.first + batch).cast("int").alias("batch"), cursor.alias("cursor"), onward.alias("next_cursor"),
        F.when(last & F.lit(end.complete), "completed").otherwise("running").alias("status"), F.coalesce("records", F.lit(0)).cast("long").alias("records"), F.lit(None).cast("string").alias("error"),
    )


def backfill(spark: SparkSession, ids: DataFrame, fetch: Callable[[DataFrame], DataFrame], known: DataFrame, skip_canonical: bool = False) -> DataFrame:
    """Forecasts for the identifiers that have none (STR-11): the missing ones only, each
    once; `skip_canonical` also asks for those that only canonical records lack.
    Answers that were not asked for are dropped, missing answers are told."""
    stored = known if skip_canonical else known.where("canonical")
    asked = ids.select("cve_id").distinct().join(stored.select("cve_id"), "cve_id", "left_anti")
    found = fetch(asked).dropDuplicates(["cve_id"])
    return asked.join(found, "cve_id", "left").withColumn("state", F.when(F.col("score").isNull(), "missing").otherwise("found"))


def requested(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers in the order of the request (SRC-05): (place, cve_id) and (cve_id, score) ->
    each requested identifier once at its first place; `state` is found, missing, or
    conflict where a batch holds different values."""
    first = asked.groupBy("cve_id").agg(F.min("place").alias("place"))
    told = answers.groupBy("cve_id").agg(F.count_distinct("score").alias("n"), F.min("score").alias("score"))
    joined = first.join(told, "cve_id", "left")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "conflict").otherwise("found")
    return joined.select("place", "cve_id", F.when(state == "found", F.col("score")).alias("score"), state.alias("state"))


def claimed(payloads: DataFrame, sightings: DataFrame, runs: DataFrame, most: int) -> DataFrame:
    """Work for one worker (STR-03): the oldest pending payloads that a completed run has
    seen; they come back as `processing` with one more attempt."""
    done = sightings.join(runs.where("status = 'completed'").select("run_id"), "run_id", "left_semi").select("payload_id").distinct()
    ready = payloads.where("status = 'pending'").join(done, "payload_id", "left_semi")
    taken = ready.orderBy("received_at", "payload_id").limit(most)
    return taken.withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1})


def recovered(payloads: DataFrame, leased_before: Column, max_attempts: int) -> DataFrame:
    """Payloads after a sweep (STR-04): work whose lease has run out is pending again, or
    failed once it has had its attempts; all else stays."""
    stale = (F.col("status") == "processing") & (F.col("leased_at") < leased_before)
    again = F.when(F.col("attempts") >= max_attempts, "failed").otherwise("pending")
    return payloads.withColumns({"status": F.when(stale, again).otherwise(F.col("status")), "leased_at": F.when(~stale, F.col("leased_at"))})


def pages(path: str, ahead: bool = False) -> Connector:
    """A paged source over a folder of pages as `sources.pages.lay_out` leaves it; the
    cursor is the number of the page to read next (SRC-03, SRC-04). A fetch reads its
    page only. With `ahead` all pages up to the first that is missing are taken as one."""
    kinds = "place long, record_id string, payload string, modified_at timestamp_ntz"

    def fetch(cursor: str | None, state: dict) -> Fetch:
        numbers = pages_of(path)
        at = 0 if cursor is None else int(cursor)
        spark = SparkSession.getActiveSession()
        if at not in numbers:
            return Fetch(spark.createDataFrame([], "record_id string, payload string, modified_at timestamp_ntz"), None, {"pagination_complete": True})
        page = spark.read.schema(kinds).parquet(f"{path}/page={at}").drop("place")
        more = at + 1 in numbers
        return Fetch(page, str(at + 1) if more else None, {"pagination_complete": not more})

    def ready(cursor: str | None, state: dict) -> Run | None:
        first = 0 if cursor is None else int(cursor)
        numbers = [n for n in pages_of(path) if n >= first]
        upto = next((n for n, at in enumerate(numbers, first) if n != at), first + len(numbers))
        if upto == first:
            return None
        rows = SparkSession.getActiveSession().read.schema(f"{kinds}, page long").parquet(path).where(F.col("page").between(first, upto - 1))
        return Run(rows.drop("place"), first, upto)

    if ahead:
        fetch.ahead = ready
    return fetch
