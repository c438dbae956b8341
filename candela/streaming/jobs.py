"""Structured Streaming jobs; each ends with the same rows as its batch form."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from candela.operators import audit
from candela.operators.metrics import BOUNDS


def read_landing(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files landed under a path, as a stream with an explicit schema."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


class BatchSink:
    """Rows written by micro-batches, each visible as a whole or not at all.

    A batch has a folder of its own under its token, which names the stream's
    checkpoint and the batch, so a replay overwrites what the failed run left.
    The receipt is one row in one file and comes last; readers join receipts,
    so rows without one don't exist for them. A batch that has its receipt is
    not written again.
    """

    def __init__(self, spark: SparkSession, out: str, schema: str, checkpoint: str):
        self.spark, self.out, self.schema = spark, out, schema
        self.stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
        spark.createDataFrame([], "committed_at timestamp, batch string").write.partitionBy("batch").mode("ignore").parquet(f"{out}/receipts")
        for name in ("rows", "heads"):
            spark.createDataFrame([], f"{schema}, batch string").limit(0).write.mode("ignore").parquet(f"{out}/{name}/batch=none")

    def token(self, batch_id: int) -> str:
        return f"{self.stream}-{batch_id:012d}"

    def receipts(self) -> DataFrame:
        return self.spark.read.schema("committed_at timestamp, batch string").parquet(f"{self.out}/receipts").select("batch")

    def written(self, name: str = "rows", besides: str = "") -> DataFrame:
        """Rows of batches that have their receipt, but one."""
        rows = self.spark.read.schema(f"{self.schema}, batch string").parquet(f"{self.out}/{name}").where(F.col("batch") != besides)
        return rows.join(self.receipts(), "batch")

    def done(self, batch_id: int) -> bool:
        return not self.receipts().where(F.col("batch") == self.token(batch_id)).isEmpty()

    def write(self, rows: DataFrame, batch_id: int, name: str = "rows") -> DataFrame:
        """Write a part of a batch over what a failed run left of it, and read it back."""
        path = f"{self.out}/{name}/batch={self.token(batch_id)}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def commit(self, batch_id: int) -> None:
        self.spark.range(1).select(F.current_timestamp().alias("committed_at")).coalesce(1).write.mode("overwrite").parquet(f"{self.out}/receipts/batch={self.token(batch_id)}")


def committed(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """What a sink's readers see: the rows of batches with a receipt."""
    receipts = spark.read.schema("committed_at timestamp, batch string").parquet(f"{out}/receipts").select("batch")
    return spark.read.schema(f"{schema}, batch string").parquet(f"{out}/rows").join(receipts, "batch").drop("batch")


ENVELOPES = "digest string, batch_id long, payload string"


def ingest_envelopes(envelopes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """ST1: envelopes (batch_id, payload), each payload digest once, whatever is replayed after which failure.

    Read them with committed(spark, out, ENVELOPES).
    """
    sink = BatchSink(envelopes.sparkSession, out, ENVELOPES, checkpoint)

    def one_batch(rows: DataFrame, number: int) -> None:
        if sink.done(number):
            return
        marked = rows.withColumn("digest", F.sha2("payload", 256))
        first = marked.groupBy("digest").agg(F.min_by(F.struct("batch_id", "payload"), "batch_id").alias("r")).select("digest", "r.*")
        sink.write(first.join(sink.written(besides=sink.token(number)).select("digest"), "digest", "left_anti"), number)
        sink.commit(number)

    return envelopes.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_versions(versions: DataFrame, out: str, checkpoint: str, cluster_id: str) -> StreamingQuery:
    """ST2/ST3: versions appended with one transaction per micro-batch and its receipt last.

    Readers join receipts (operators.temporal.with_commit_times), so a batch
    that is half written stays invisible, and facts may be as late as they
    like: there is no watermark on valid time. Reruns of a batch overwrite its
    own folder.
    """

    def one_batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        rows.withColumn("cluster_id", F.lit(cluster_id)).write.mode("overwrite").parquet(f"{out}/versions/txn_id={batch_id}")
        receipt = spark.range(1).select(F.lit(cluster_id).alias("cluster_id"), F.current_timestamp().alias("committed_at"))
        receipt.write.mode("overwrite").parquet(f"{out}/receipts/txn_id={batch_id}")

    return versions.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_observations(rows: DataFrame, keys: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """ST4: one row per key, the keys seen being the stream's state."""
    once = rows.select(*keys).dropDuplicates(keys)
    return once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def metric_rollup(requests: DataFrame, out: str, checkpoint: str, every: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """ST5: requests (ts, route, status, latency) counted per window and route; each batch rewrites the windows it changed."""
    buckets: list[Column] = [F.count_if(F.col("latency") <= b).alias(f"le_{k}") for k, b in enumerate(BOUNDS)]
    rolled = (
        requests.withWatermark("ts", late)
        .groupBy(F.window("ts", every), "route")
        .agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"), *buckets)
        .select(F.col("window.start").alias("window_start"), "route", "requests", "errors", *[f"le_{k}" for k in range(len(BOUNDS))])
    )

    def one_batch(rows: DataFrame, batch_id: int) -> None:
        rows.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    return rolled.writeStream.foreachBatch(one_batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_windows(spark: SparkSession, out: str) -> DataFrame:
    """The last state of each window that metric_rollup wrote."""
    rows = spark.read.parquet(out).drop("part")
    rest = [c for c in rows.columns if c not in ("window_start", "route")]
    return rows.groupBy("window_start", "route").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("window_start", "route", "r.*").drop("batch")


def sealed_schema(events: DataFrame, chain: str, order: str) -> str:
    """The columns of sealed events: the chain's key, of any type, the order and both hashes."""
    return ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in (chain, order)) + ", previous_hash string, event_hash string"


def seal_events(events: DataFrame, chain: str, order: str, payload: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """ST6: each micro-batch's events sealed after the last hash of their chain, exactly once.

    The state is the head of each chain, a row in the folder of the batch that
    last changed it. A batch's events are joined to their heads and stream
    through sorted partitions with one hash held, so no chain is a frame, and a
    key may have any type. An event that comes in a later batch is sealed after
    those before it. Read the events with committed(spark, out, sealed_schema(...)).
    """
    sink = BatchSink(events.sparkSession, out, sealed_schema(events, chain, order), checkpoint)

    def one_batch(rows: DataFrame, number: int) -> None:
        if sink.done(number):
            return
        kept = rows.select(chain, order, *[c for c in payload if c not in (chain, order)])
        heads = sink.written("heads", besides=sink.token(number)).groupBy(chain).agg(F.max_by("event_hash", "batch").alias("event_hash"))
        own = sink.write(audit.seal(kept, chain, order, payload, heads).select(chain, order, "previous_hash", "event_hash"), number)
        # The last of a chain is the one that no other follows.
        followed = own.select(F.col(chain).alias("c"), F.col("previous_hash").alias("h"))
        ends = own.join(followed, F.col(chain).eqNullSafe(F.col("c")) & (F.col("event_hash") == F.col("h")), "left_anti")
        sink.write(ends, number, "heads")
        sink.commit(number)

    return events.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
