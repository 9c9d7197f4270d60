"""Streams over folders of Parquet files: new rows, sessions, and tables kept at the latest row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.sources.files import merge_table


def new_files(spark: SparkSession, path: str, like: DataFrame, files_a_batch: int = 1000) -> DataFrame:
    """A stream of the rows of files that appear in a folder; what was read is in the sink's checkpoint."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def event_time(rows: DataFrame, at: str) -> DataFrame:
    """Watermarks take timestamps with a zone."""
    return rows.withColumn(at, F.col(at).cast("timestamp"))


def latest_by_key(rows: DataFrame, key: str, at: str, late: str = "7 days") -> DataFrame:
    """The first row of each key within the lateness that is waited for; redeliveries in that time are left out."""
    return event_time(rows, at).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def session_counts(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions with their number of events, given out once the watermark has passed them."""
    w = F.session_window(ts, gap)
    return event_time(events, ts).withWatermark(ts, late).groupBy(user, w.alias("w")).agg(F.count("*").alias("events")).select(user, F.col("w.start").alias("started"), F.col("w.end").alias("ends"), "events")


def upsert_stream(rows: DataFrame, table: str, key: str, at: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table at the latest row of each key, a batch at a time, and ends when all there is is read.

    A batch that is run again after a failure, at whatever step, gives the same table.
    """
    return rows.writeStream.foreachBatch(lambda batch, _: merge_table(batch, table, key, at)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
