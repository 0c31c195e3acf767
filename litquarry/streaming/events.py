"""Structured Streaming over append-only logs: latest states, event-time windows with late data, resumable batches."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from litquarry.session import ensure_checkpoint_dir

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_log(spark: SparkSession, path: str, schema: str = EVENTS, time: str = "ts") -> DataFrame:
    """The log as a stream; event time becomes a zoned timestamp, which watermarks need."""
    folder, _, name = path.rstrip("/").rpartition("/")
    # A single file is read as a glob of its folder: the file source wants a folder.
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if os.path.isfile(path) else spark.readStream.schema(schema).parquet(path)
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def latest_states(log: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Latest state per key as an unbounded aggregation; write it in update or complete mode."""
    return log.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state), F.count("*").alias("entries"))


def tumbling(log: DataFrame, by: str, time: str = "ts", length: str = "1 day", late: str = "2 hours") -> DataFrame:
    w = log.withWatermark(time, late).groupBy(F.window(time, length), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return w.select(F.col("window.start").alias("start"), by, "n", "value")


def sessions(log: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    w = log.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def drain(stream: DataFrame, table: str, mode: str) -> DataFrame:
    """Runs all available input into tables of the shared folder and returns what is there: the last one in complete mode, else all."""
    folder = f"{ensure_checkpoint_dir(stream.sparkSession)}/{table}-{uuid.uuid4().hex}"
    last: list[str] = []

    def keep(rows: DataFrame, epoch: int) -> None:
        path = f"{folder}/epoch={epoch}"
        rows.write.mode("overwrite").parquet(path)
        last[:] = [path] if mode == "complete" else [*last, path]

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(*last) if last else spark.createDataFrame([], stream.schema)


def process_once(items: DataFrame, done_path: str, key: list[str], work, checkpoint: str) -> StreamingQuery:
    """Items of a stream that are not yet done under the same identity are worked on and recorded; a restart skips what is recorded."""

    def batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        try:
            done = spark.read.parquet(done_path).select(*key).distinct()
            todo = rows.join(done, key, "left_anti")
        except Exception as e:  # no record yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            todo = rows
        work(todo.dropDuplicates(key)).withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(done_path)

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
