"""Structured Streaming: event windows, incremental upserts into a store, and per-key state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corpusflow.session import shared_folder


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A Parquet path as a stream of its files."""
    schema = spark.read.parquet(path).schema
    # A glob, as the file source takes folders and globs but no single file.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*")


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(event_type, start, n_events, value) in tumbling windows of event time, late events up to ``late`` included."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("value")).select("event_type", F.col("window.start").alias("start"), "n_events", "value")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n_events) of runs of a user's events less than ``gap`` apart."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id").withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n_events")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")


def run_to_end(writer: DataStreamWriter, checkpoint: str) -> None:
    """Start a stream over what is there, wait until it has ended, and raise what ended it otherwise."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def complete_result(stream: DataFrame) -> DataFrame:
    """The final result of an aggregating stream, written to the shared folder by its last batch and read from there."""
    spark = stream.sparkSession
    folder = shared_folder(spark, f"stream-{uuid.uuid4().hex}")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    run_to_end(stream.writeStream.outputMode("complete").foreachBatch(keep), f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder of the shared file system; none where it doesn't exist."""
    jvm, target = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(target) if f.isDirectory()] if jvm is not None and system.exists(target) else []


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _versions(spark: SparkSession, store: str) -> dict[int, list[int]]:
    """The batches that wrote each bucket of a store, the latest last; as many entries as there are buckets."""
    return {int(b.partition("=")[2]): sorted(int(v.partition("=")[2]) for v in _folders(spark, f"{store}/{b}")) for b in _folders(spark, store)}


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The rows of a store that ``upsert_stream`` keeps: the latest version of each bucket."""
    return spark.read.parquet(*[f"{store}/bucket={b}/version={v[-1]}" for b, v in sorted(_versions(spark, store).items()) if v])


def upsert_stream(stream: DataFrame, store: str, checkpoint: str, key: str = "id", sequence: str = "created_at", buckets: int = 16) -> None:
    """Keep a Parquet store at the latest row of each key, batch after batch; of equal times the greatest row stands.

    The store is cut into buckets by the key's hash. A batch merges and writes anew only the buckets that it has rows of,
    as a version named by the batch, so a batch that is run again after a failure writes the same version again. A bucket's
    last two versions are kept.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        columns = batch.columns
        batch = batch.where(F.col(key).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        # No more than there are buckets.
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]
        known = _versions(spark, store)
        before = {b: [v for v in known.get(b, []) if v < number] for b in touched}
        paths = [f"{store}/bucket={b}/version={v[-1]}" for b, v in before.items() if v]
        rows = batch.select(*columns)
        if paths:
            rows = rows.unionByName(spark.read.parquet(*paths).select(*columns))
        rest = [c for c in columns if c not in (key, sequence)]
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(sequence, *rest)).alias("r")).select("r.*")
        placed = latest.withColumns({"bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"), "version": F.lit(number)})
        placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(store)
        for bucket, old in before.items():
            for version in old[:-1]:
                _remove(spark, f"{store}/bucket={bucket}/version={version}")
        batch.unpersist()

    run_to_end(stream.writeStream.foreachBatch(merge), checkpoint)


def appended(stream: DataFrame) -> DataFrame:
    """What a stream without a final result appends, batch after batch, written to the shared folder and read from there."""
    spark = stream.sparkSession
    folder = shared_folder(spark, f"stream-{uuid.uuid4().hex}")
    run_to_end(stream.writeStream.outputMode("append").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/part={n}")), f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").drop("part")


def sliding_windows(events: DataFrame, size: str = "2 hours", slide: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(event_type, start, n_events, value) in windows of event time that start every ``slide`` and overlap."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("value")).select("event_type", F.col("window.start").alias("start"), "n_events", "value")


def first_of_each(stream: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key; the keys met are forgotten once the watermark is ``late`` past them."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def joined_within(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, within: str) -> DataFrame:
    """Rows of both streams with equal keys of which the right one comes at most ``within`` after the left one; what can't meet any more is forgotten."""
    a, b = left.withWatermark(left_time, within), right.withWatermark(right_time, within)
    met = (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"interval {within}"))
    return a.join(b.withColumnsRenamed({k: f"_{k}" for k in on}), reduce(Column.__and__, (F.col(k) == F.col(f"_{k}") for k in on), met)).drop(*(f"_{k}" for k in on))


def running_totals(events: DataFrame, limit: float) -> DataFrame:
    """(user_id, n_events, spent, over): state of each user over a stream of events, updated with every batch.

    ``over`` is whether what was spent exceeds the limit. The state is a count and a sum, kept by Spark; it has no
    time limit, as totals never end.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        n, spent = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, spent = n + len(batch), spent + float(batch["value"].fillna(0).sum())
        state.update((n, spent))
        yield pd.DataFrame({"user_id": [key[0]], "n_events": [n], "spent": [round(spent, 4)], "over": [spent > limit]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n_events long, spent double, over boolean", "n long, spent double", "update", "NoTimeout")
