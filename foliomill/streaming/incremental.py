"""Incremental work: file streams with watermarks, latest-state tables, and resumable appends."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.plans.runtime import cut, ensure_checkpoint_dir

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder, so that every executor can write there."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a file stream, its time as event time."""
    path = f"{sf_dir}/events.parquet"
    local = path.removeprefix("file://")
    source = path if os.path.isdir(local) else sf_dir
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet" if source == path else "events.parquet")
    return stream.parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there and return what its sink holds in the end.

    Append mode writes Parquet files with exactly-once commits; update and complete modes overwrite a batch's snapshot."""
    spark = stream.sparkSession
    out, marks = _folder(spark, "stream"), _folder(spark, "marks")
    writer = stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def window_counts(spark: SparkSession, sf_dir: str, late: str = "1 day") -> DataFrame:
    """Tumbling hours with a watermark; complete mode, so hours the watermark has not passed are there, too."""
    events = event_stream(spark, sf_dir).withWatermark("ts", late)
    counts = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return drained(counts.select(F.col("window.start").alias("hour"), "event_type", "n", "total"), "complete").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event, kept as state and updated as files arrive."""
    state = event_stream(spark, sf_dir).groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e"))
    return drained(state.select("user_id", "e.event_id", "e.event_type"), "complete")


def sample_ticks(spark: SparkSession, sf_dir: str, every: str = "3 seconds", late: str = "1 day") -> DataFrame:
    """Samples of each tick of ``every``, as a telemetry loop takes them: count, mean and greatest value."""
    events = event_stream(spark, sf_dir).withWatermark("ts", late)
    ticks = events.groupBy(F.window("ts", every)).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))
    return drained(ticks.select(F.col("window.start").alias("tick"), "n", "mean", "most"), "complete").withColumn("tick", F.col("tick").cast("timestamp_ntz"))


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as error:  # the table is not there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def append_new(batch: DataFrame, path: str, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Append the rows whose key is neither in the table at ``path`` nor earlier in the batch, by ``order`` (all columns, if none is given);
    returns what was written."""
    others = [c for c in batch.columns if c not in keys]
    ordered = F.struct(*(order or others or keys))
    fresh = batch.groupBy(*keys).agg(F.min_by(F.struct(*others), ordered).alias("row")).select(*keys, "row.*").select(*batch.columns) if others else batch.distinct()
    old = _existing(batch.sparkSession, path)
    if old is not None:
        fresh = fresh.join(old.select(*keys).distinct(), keys, "left_anti")
    fresh = cut(fresh)
    fresh.write.mode("append").parquet(path)
    return fresh


def absent(batch: DataFrame, keys: list[Column], order: list[str], old: DataFrame | None = None, old_keys: list[Column] | None = None) -> DataFrame:
    """The rows of ``batch`` of which no key is taken: not in ``old``, and not by a row kept before it by ``order``, which must tell rows apart.
    Null keys are none.

    A row that is left out takes no keys.  So rows are settled in rounds: a row that is first in all its keys is kept, rows that share a key
    with a kept one are left out, and what is left is looked at again; each round settles the first row of every connected group at least."""
    rows = batch.withColumn("keys_of", F.array_compact(F.array_distinct(F.array(*keys)))).withColumn("order_of", F.struct(*order))
    if old is not None:
        taken = old.select(F.explode(F.array(*(old_keys or keys))).alias("key")).filter("key is not null").distinct()
        hit = rows.select("order_of", F.explode("keys_of").alias("key")).join(taken, "key", "left_semi").select("order_of").distinct()
        rows = rows.join(hit, "order_of", "left_anti")
    rows = cut(rows)
    kept = cut(rows.filter(F.size("keys_of") == 0))
    left = rows.filter(F.size("keys_of") > 0)
    while not left.isEmpty():
        each = left.select("order_of", F.explode("keys_of").alias("key"))
        first = each.groupBy("key").agg(F.min("order_of").alias("first"))
        whole = each.join(first, "key").groupBy("order_of").agg(F.bool_and(F.col("order_of") == F.col("first")).alias("whole"))
        now = cut(left.join(whole.filter("whole").select("order_of"), "order_of", "left_semi").select(*rows.columns))
        gone = each.join(now.select(F.explode("keys_of").alias("key")), "key", "left_semi").select("order_of").distinct()
        kept = kept.unionByName(now)
        left = cut(left.join(gone, "order_of", "left_anti").select(*rows.columns))
    return kept.select(*batch.columns)


def append_absent(batch: DataFrame, path: str, keys: list[Column], order: list[str]) -> DataFrame:
    """Append the rows of which no key, of several, is in the table at ``path`` or taken by an earlier row of the batch; returns what was written."""
    fresh = cut(absent(batch, keys, order, _existing(batch.sparkSession, path)))
    fresh.write.mode("append").parquet(path)
    return fresh
