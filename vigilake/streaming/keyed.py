"""Decisions that need what a key did before: state by key, with timers in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigilake.session import ship

def _in_order(batches: Iterator[pd.DataFrame], first: str, *more: str) -> list[tuple]:
    """A key's rows of one micro-batch, ordered by a column that all have."""
    return sorted((row for batch in batches for row in zip(*[batch[c].tolist() for c in (first, *more)], strict=True)), key=lambda row: row[0])


INVENTORY = "machine_uid long, place long, inventory_id long, outcome string"
#: Buckets of machines. They belong to the state: a checkpoint keeps its number.
BUCKETS = 4_096
CURRENT = "machines array<long>, current array<long>, newest array<long>"
#: Stands for a missing time, which is before all others.
NEVER = -(2**63) // 1_000


def inventories(stream: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """What becomes of each inventory of a machine in order of arrival (STR-07).

    `stream`: (machine_uid, place, inventory_id, collected_at), place the order of
    arrival. The id that is current comes again: `repeated`, nothing changes. Collected
    before the current one: `stale`. At the same time under another id:
    `timestamp_conflict`. Else `accepted`, and it is current from then on. The state of
    a machine is one id and one time.

    A call of Python costs milliseconds, a row less than a thousandth of that, so the
    machines of a bucket are one key: its state has a place for each. Those without a
    number are a bucket of their own, so that numbers stay integers in Python.
    """
    ship(stream.sparkSession)
    bucket = F.coalesce(F.when(F.col("machine_uid").isNotNull(), F.pmod(F.xxhash64("machine_uid"), F.lit(buckets))), F.lit(-1)).alias("bucket")
    given = stream.select(bucket, F.coalesce("machine_uid", F.lit(-1)).alias("machine"), "place", F.coalesce("inventory_id", F.lit(-1)).alias("inventory"),
        F.col("inventory_id").isNull().alias("missing"), F.coalesce(F.unix_micros("collected_at"), F.lit(NEVER)).alias("at"))

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*[state.get[0], zip(*state.get[1:], strict=True)], strict=True)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["machine", "place"], kind="stable", ignore_index=True)
        outcomes, machine, current, newest = [], None, None, None
        for of, inventory, missing, at in zip(*[rows[c].tolist() for c in ("machine", "inventory", "missing", "at")], strict=True):
            if of != machine:
                known[machine] = current, newest
                machine, (current, newest) = of, known.get(of, (None, None))
            if not missing and inventory == current:
                outcome = "repeated"
            elif newest is not None and at <= newest:
                outcome = "stale" if at < newest else "timestamp_conflict"
            else:
                outcome, current, newest = "accepted", None if missing else inventory, at
            outcomes.append(outcome)
        known[machine] = current, newest
        known.pop(None, None)
        state.update((list(known), [c for c, _ in known.values()], [n for _, n in known.values()]))
        number = rows["machine"].astype("Int64")
        yield pd.DataFrame({"machine_uid": number if key[0] >= 0 else number.where(rows["machine"] != -1), "place": rows["place"],
            "inventory_id": rows["inventory"].astype("Int64").mask(rows["missing"]), "outcome": outcomes})

    return given.groupBy("bucket").applyInPandasWithState(decide, INVENTORY, CURRENT, "append", GroupStateTimeout.NoTimeout)


WORK = "work_id long, version long, status string, attempts int, at timestamp"


def leased_work(stream: DataFrame, lease_seconds: int, max_attempts: int) -> DataFrame:
    """The states of work items under leases (STR-03, STR-04): one row for each change.

    `stream`: (work_id, at, message) with a watermark on `at`. `submit` makes an item
    pending if it is new or over; `claim` makes a pending one processing, with one more
    attempt and a lease; `renew` extends the lease; `release` gives it back and `finish`
    ends it. A lease that has run out gives it back too, by a timer when the watermark
    passes its end, whether or not the item is heard of again. An item given back is
    pending, or failed once it has had its attempts.
    """
    ship(stream.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, until, version = state.get if state.exists else ("new", 0, 0, 0)
        out = []

        def change(to: str, at: int) -> None:
            nonlocal status, version
            status, version = to, version + 1
            out.append((key[0], version, to, attempts, pd.Timestamp(at, unit="ms")))

        def give_back(at: int) -> None:
            change("failed" if attempts >= max_attempts else "pending", at)

        if state.hasTimedOut:
            if status == "processing":
                give_back(until)
        else:
            for at, message in _in_order(batches, "at", "message"):
                at = at.value // 1_000_000
                if status == "processing" and until < at:
                    give_back(until)
                if message == "submit" and status in ("new", "done", "failed"):
                    attempts = 0
                    change("pending", at)
                elif message == "claim" and status == "pending":
                    attempts, until = attempts + 1, at + lease_seconds * 1_000
                    change("processing", at)
                elif message == "renew" and status == "processing":
                    until = at + lease_seconds * 1_000
                elif message == "release" and status == "processing":
                    give_back(at)
                elif message == "finish" and status == "processing":
                    change("done", at)
        state.update((status, attempts, until, version))
        if status == "processing":
            # A lease that ended before the watermark is given back as soon as Spark may fire.
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["work_id", "version", "status", "attempts", "at"])

    return stream.groupBy("work_id").applyInPandasWithState(step, WORK, "status string, attempts int, until long, version long", "append", GroupStateTimeout.EventTimeTimeout)
