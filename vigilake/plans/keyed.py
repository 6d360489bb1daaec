"""Streams with state by key, and the work queue, over the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.plans.base import query
from vigilake.session import scratch_path, table
from vigilake.sources import pages
from vigilake.streaming import keyed, runs

#: Records of a page.
PAGE = 5_000


def _fed(records: DataFrame, order: str, name: str, halves: tuple[str, str], decide) -> DataFrame:
    """Records (payload JSON, modified_at, `order`) laid out as pages and drained in two
    runs of one checkpoint: the second begins with what the first has left as state."""
    spark, root, first = records.sparkSession, scratch_path(records.sparkSession, name), 0
    for half in halves:
        first = pages.lay_out(records.where(half), [order], PAGE, f"{root}/pages", first)
        rows = decide(pages.stream_pages(spark, f"{root}/pages"))
        run = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/mark").start(f"{root}/out")
        try:
            run.processAllAvailable()  # with the batch without rows in which timers fire
        finally:
            run.stop()
    return spark.read.parquet(f"{root}/out")


ARRIVED = """o AS (SELECT o_custkey AS machine_uid, o_orderkey * 2 AS arrival, o_orderkey AS inventory_id, o_orderdate AS seen FROM orders),
s AS (SELECT *, max(seen) OVER (PARTITION BY machine_uid ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM o),
d AS (SELECT *, CASE WHEN newest IS NULL OR seen > newest THEN 'accepted' WHEN seen = newest THEN 'timestamp_conflict' ELSE 'stale' END AS outcome FROM s)"""


@query("streamed_inventories", f"""WITH {ARRIVED} SELECT machine_uid, inventory_id, false AS again, outcome FROM d
UNION ALL SELECT machine_uid, inventory_id, true, CASE WHEN outcome = 'accepted' THEN 'repeated' ELSE outcome END FROM d WHERE inventory_id % 10 = 0""")  # fmt: skip
def streamed_inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventories of machines as a stream in order of arrival, one in ten delivered twice
    (STR-07): the same outcomes as `latest_inventories`, from keyed state."""
    o = table(spark, sf_dir, "orders")
    twice = F.explode(F.when(F.col("o_orderkey") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")
    body = F.to_json(F.struct(F.col("o_custkey").alias("machine_uid"), "again"))
    rows = o.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("modified_at"), twice)
    rows = rows.select((F.col("o_orderkey") * 2 + F.col("again")).alias("arrival"), F.col("o_orderkey").cast("string").alias("record_id"), body.alias("payload"), "modified_at")
    middle = (o.agg(F.max("o_orderkey")).first()[0] or 0)

    def decide(stream: DataFrame) -> DataFrame:
        told = F.from_json("payload", "machine_uid long, again int")
        given = stream.select(told.alias("t"), ((F.col("record_id").cast("long") * 2) + told["again"]).alias("place"), F.col("record_id").cast("long").alias("inventory_id"),
            F.col("modified_at").cast("timestamp").alias("collected_at"))
        return keyed.inventories(given.select("t.machine_uid", "place", "inventory_id", "collected_at"))

    found = _fed(rows, "arrival", "inventories", (f"arrival <= {middle}", f"arrival > {middle}"), decide)
    return found.select("machine_uid", "inventory_id", (F.col("place") % 2 == 1).alias("again"), "outcome")


LEASE, ATTEMPTS = 6 * 3_600, 2
MESSAGES = {"signup": "submit", "click": "claim", "view": "renew", "error": "release", "purchase": "finish"}
LEASED = f"""e AS (SELECT user_id, CAST(epoch_ms(ts) AS BIGINT) AS seen, event_type AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
mark AS (SELECT max(seen) AS mark FROM e),
s(user_id, n, status, attempts, until, version) AS (
  SELECT user_id, CAST(0 AS BIGINT), 'new', 0, CAST(0 AS BIGINT), 0 FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, n + 1,
    CASE WHEN m = 'signup' AND status IN ('new', 'done', 'failed') THEN 'pending' WHEN m = 'click' AND status = 'pending' THEN 'processing'
      WHEN m = 'error' AND status = 'processing' THEN CASE WHEN attempts >= {ATTEMPTS} THEN 'failed' ELSE 'pending' END WHEN m = 'purchase' AND status = 'processing' THEN 'done' ELSE status END,
    CASE WHEN m = 'signup' AND status IN ('new', 'done', 'failed') THEN 0 WHEN m = 'click' AND status = 'pending' THEN attempts + 1 ELSE attempts END,
    CASE WHEN (m = 'click' AND status = 'pending') OR (m = 'view' AND status = 'processing') THEN seen + {LEASE * 1000} ELSE until END,
    version + CASE WHEN (m = 'signup' AND status IN ('new', 'done', 'failed')) OR (m = 'click' AND status = 'pending') OR (m IN ('error', 'purchase') AND status = 'processing') THEN 1 ELSE 0 END
  FROM (SELECT s.user_id, s.n, e.seen, e.m, s.attempts, s.until, CASE WHEN s.status = 'processing' AND s.until < e.seen THEN CASE WHEN s.attempts >= {ATTEMPTS} THEN 'failed' ELSE 'pending' END
    ELSE s.status END AS status, s.version + CASE WHEN s.status = 'processing' AND s.until < e.seen THEN 1 ELSE 0 END AS version FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))"""


@query("leased_work", f"""WITH RECURSIVE {LEASED}, z AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1)
SELECT user_id AS work_id, CASE WHEN status = 'processing' AND until < mark THEN CASE WHEN attempts >= {ATTEMPTS} THEN 'failed' ELSE 'pending' END ELSE status END AS status, attempts,
  CAST(version + CASE WHEN status = 'processing' AND until < mark THEN 1 ELSE 0 END AS BIGINT) AS version FROM z, mark WHERE version > 0""")  # fmt: skip
def leased_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user's work stands after a stream of messages, with leases that run out
    by timers of event time (STR-03, STR-04)."""
    e = table(spark, sf_dir, "events")
    body = F.to_json(F.struct("user_id", "event_type"))
    rows = e.select(F.col("ts").cast("timestamp_ntz").alias("modified_at"), F.col("event_id").cast("string").alias("record_id"), body.alias("payload"), "event_id",
        F.concat(F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("event_id").cast("string"), 19, "0")).alias("place_"))
    middle = F.lit(dt.datetime(2024, 1, 16)).cast("timestamp_ntz")
    rows = rows.withColumn("early", F.col("modified_at") < middle)

    def decide(stream: DataFrame) -> DataFrame:
        told = F.from_json("payload", "user_id long, event_type string")
        message = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])[told["event_type"]]
        given = stream.select(told["user_id"].alias("work_id"), F.col("modified_at").cast("timestamp").alias("at"), message.alias("message"))
        return keyed.leased_work(given.withWatermark("at", "0 seconds"), LEASE, ATTEMPTS)

    found = _fed(rows, "place_", "work", ("early", "NOT early"), decide)
    last = F.max_by(F.struct("status", "attempts"), "version").alias("x")
    return found.groupBy("work_id").agg(last, F.max("version").alias("version")).select("work_id", "x.status", "x.attempts", "version")


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored payloads of a queue."""
    k = F.col("event_id")
    status = F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "error", "processing").otherwise("processed")
    return table(spark, sf_dir, "events").select(k.alias("payload_id"), status.alias("status"), F.col("ts").cast("timestamp_ntz").alias("received_at"), (k % 4).cast("int").alias("attempts"),
        F.when(F.col("event_type") == "error", F.col("ts").cast("timestamp_ntz") + F.make_dt_interval((k % 10).cast("int"))).alias("leased_at"))


CLAIM = 1_000


@query("claimed_work", f"""SELECT event_id AS payload_id, 'processing' AS status, CAST(event_id % 4 + 1 AS INTEGER) AS attempts FROM events
WHERE event_type = 'click' AND user_id % 3 <> 0 AND event_id % 2 = 0 ORDER BY ts, event_id LIMIT {CLAIM}""")  # fmt: skip
def claimed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest pending payloads that a completed run has seen, as many as one worker
    takes (STR-03)."""
    e = table(spark, sf_dir, "events")
    sightings = e.where("event_id % 2 = 0").select(F.col("event_id").alias("payload_id"), F.col("user_id").alias("run_id"))
    log = e.select(F.col("user_id").alias("run_id"), F.when(F.col("user_id") % 3 == 0, "failed").otherwise("completed").alias("status")).distinct()
    return runs.claimed(_payloads(spark, sf_dir), sightings, log, CLAIM).select("payload_id", "status", "attempts")


@query("recovered_work", """SELECT event_id AS payload_id, CASE event_type WHEN 'click' THEN 'pending' WHEN 'error' THEN CASE
  WHEN ts + to_days(CAST(event_id % 10 AS INTEGER)) >= TIMESTAMP '2024-01-20' THEN 'processing' WHEN event_id % 4 >= 3 THEN 'failed' ELSE 'pending' END ELSE 'processed' END AS status,
  event_type = 'error' AND ts + to_days(CAST(event_id % 10 AS INTEGER)) >= TIMESTAMP '2024-01-20' AS leased FROM events""")  # fmt: skip
def recovered_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases that ran out: pending again, or failed after three attempts (STR-04)."""
    rows = runs.recovered(_payloads(spark, sf_dir), F.lit(dt.datetime(2024, 1, 20)).cast("timestamp_ntz"), 3)
    return rows.select("payload_id", "status", F.col("leased_at").isNotNull().alias("leased"))


@query("requested_forecasts", """WITH a AS (SELECT min(l_orderkey * 10 + l_linenumber) AS place, l_partkey AS k FROM lineitem WHERE l_quantity >= 48 GROUP BY l_partkey),
p AS (SELECT p_partkey AS k, p_size / 100 AS score, CASE WHEN p_partkey % 6 = 0 THEN p_size / 100 + 0.5 END AS other FROM part WHERE p_partkey % 4 <> 0)
SELECT place, 'CVE-' || a.k AS cve_id, CASE WHEN other IS NULL THEN score END AS score, CASE WHEN p.k IS NULL THEN 'missing' WHEN other IS NOT NULL THEN 'conflict' ELSE 'found' END AS state
FROM a LEFT JOIN p USING (k)""")  # fmt: skip
def requested_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in the order of the request; conflicts and missing ones are told (SRC-05)."""
    cve = lambda c: F.concat(F.lit("CVE-"), F.col(c).cast("string")).alias("cve_id")
    asked = table(spark, sf_dir, "lineitem").where("l_quantity >= 48").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), cve("l_partkey"))
    score = F.col("p_size") / 100
    answers = F.when(F.col("p_partkey") % 6 == 0, F.array(score, score + 0.5)).otherwise(F.array(score, score))
    told = table(spark, sf_dir, "part").where("p_partkey % 4 <> 0").select(cve("p_partkey"), F.explode(answers).alias("score"))
    return runs.requested(asked, told)
