"""Landing raw payloads from a file stream, once each.

The checkpoint holds the cursor; every micro-batch is deduplicated by content hash
against what is stored, so a batch that runs again adds nothing. Bad records go to
a reject table and the stream goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators.merge import insert_ignore
from vigilake.sources.feeds import payload_id

KEYS = ["source", "record_id", "payload_hash"]
#: Folders that stored keys are dealt over by hash.
KEY_SHARDS = 64


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def land(batch: DataFrame, batch_id: int, table_path: str, source: str) -> None:
    """One micro-batch of (record_id, payload) into the raw table at `table_path`
    (a folder for each batch, so a repeated batch replaces its own rows). Keys are kept
    apart, by hash, so that a batch meets stored keys and never stored payloads."""
    spark = batch.sparkSession
    rows = batch.select(F.lit(source).alias("source"), "record_id", F.sha2("payload", 256).alias("payload_hash"), "payload",
        payload_id(source, F.col("record_id"), F.col("payload")).alias("id"))
    good = rows.where(F.col("record_id").isNotNull() & F.col("payload").isNotNull())
    shard = F.pmod(F.xxhash64(*KEYS), F.lit(KEY_SHARDS)).cast("int")
    new = good.dropDuplicates(KEYS).withColumn("shard", shard).persist()
    if exists(spark, f"{table_path}/keys"):
        # Only the shards of keys that the batch touches are read, and keys only.
        touched = [r["shard"] for r in new.select("shard").distinct().collect()]  # KEY_SHARDS at most
        stored = spark.read.parquet(f"{table_path}/keys").where((F.col("batch") != batch_id) & F.col("shard").isin(touched))
        left = insert_ignore(stored.select(*KEYS), new, KEYS)
    else:
        left = new
    left.drop("shard").write.mode("overwrite").parquet(f"{table_path}/raw/batch={batch_id}")
    left = spark.read.parquet(f"{table_path}/raw/batch={batch_id}")
    left.select(*KEYS, shard.alias("shard")).write.mode("overwrite").partitionBy("shard").parquet(f"{table_path}/keys/batch={batch_id}")
    new.unpersist()
    bad = batch.where(F.col("record_id").isNull() | F.col("payload").isNull()).select(F.lit(source).alias("source"),
        F.lit("no_record_id_or_payload").alias("reason"))
    bad.write.mode("overwrite").parquet(f"{table_path}/rejects/batch={batch_id}")


def drain(stream: DataFrame, table_path: str, source: str, each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a (record_id, payload) stream until its input is used up (STR-01, STR-02,
    STR-06); `each` may process the batch further."""

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        land(batch, batch_id, table_path, source)
        if each:
            each(batch, batch_id)
        batch.unpersist()

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{table_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
