"""Incremental readings: late hourly data into daily aggregates, overlapping snapshots into one row per key."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from weekwatch.operators.weather import keep_last
from weekwatch.session import checkpoint_dir
from weekwatch.sources.tables import delete_path, path_exists


EPOCH = "batch_number"


def daily_readings(readings: DataFrame, delay: str = "2 days", ts: str = "ts") -> DataFrame:
    """Tumbling day per station with the count of valid hours; a day closes when the watermark passes it."""
    return (
        readings.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day"), "station")
        .agg(F.sum("rain").alias("rain_mm"), F.count("rain").alias("valid_hours"))
        .select("station", F.col("window.start").cast("date").alias("day"), "rain_mm", "valid_hours")
    )


def sliding_readings(readings: DataFrame, days: int = 28, slide: str = "7 days", delay: str = "2 days", ts: str = "ts") -> DataFrame:
    """Trailing sums as sliding windows that end on Saturdays (1970-01-04 was a Sunday)."""
    return (
        readings.withWatermark(ts, delay)
        .groupBy(F.window(ts, f"{days} days", slide, "3 days"), "station")
        .agg(F.sum("rain").alias("rain_mm"), F.count("rain").alias("valid_hours"))
        .select("station", F.date_sub(F.col("window.end").cast("date"), 1).alias("last_day"), "rain_mm", "valid_hours")
    )


def first_of_key(readings: DataFrame, keys: Sequence[str], delay: str = "2 days", ts: str = "ts") -> DataFrame:
    """Overlapping snapshots, first row of a key wins while the watermark remembers it."""
    return readings.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def merge_latest(readings: DataFrame, table: str, keys: Sequence[str], order: Sequence[str], partition: str, checkpoint: str) -> StreamingQuery:
    """Last row of a key wins: each batch is merged into the touched partitions of a table.

    Partitions are replaced whole from (old rows of those partitions + batch), so a batch that
    runs twice gives the same table.
    """
    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        if path_exists(spark, table):
            old = spark.read.schema(batch.schema).parquet(table)
            touched = batch.select(partition).distinct()
            merged = old.join(touched, partition, "left_semi").unionByName(batch)
        else:
            merged = batch
        out = keep_last(merged, list(keys), list(order)).select(*batch.columns)
        # written aside first: the target is also an input
        aside = f"{table}__batch_{epoch}"
        out.write.mode("overwrite").parquet(aside)
        spark.read.schema(batch.schema).parquet(aside).repartition(partition).write.partitionBy(partition).mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).parquet(table)
        delete_path(spark, aside)

    return readings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(df: DataFrame, table: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; restarting continues from the checkpoint."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def upsert_available(df: DataFrame, table: str, checkpoint: str) -> None:
    """Processes what is there in update mode: every batch writes the rows it changed under its own number.

    Windows that the watermark has not closed are written as they stand, so nothing waits for later
    events; a batch that runs twice replaces its own folder.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/{EPOCH}={epoch}")

    q = df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def newest_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last written row of each key of an upserted table."""
    others = [c for c in df.columns if c not in (*keys, EPOCH)]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), EPOCH).alias("_r")).select(*keys, "_r.*")


def run_to_table(spark: SparkSession, df: DataFrame, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Runs a stream into a fresh folder of the shared checkpoint directory and reads it back.

    With `keys` the table holds the newest row of each key, open windows included; without, rows are appended.
    """
    base = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not keys:
        run_available(df, f"{base}/table", f"{base}/checkpoint")
        return spark.read.schema(df.schema).parquet(f"{base}/table")
    upsert_available(df, f"{base}/table", f"{base}/checkpoint")
    written = spark.read.schema(StructType([*df.schema.fields, StructField(EPOCH, LongType())])).parquet(f"{base}/table")
    return newest_rows(written, keys).select(*df.columns)


def merge_to_table(spark: SparkSession, df: DataFrame, name: str, keys: Sequence[str], order: Sequence[str], partition: str) -> DataFrame:
    """Merges what is there into a fresh table of the shared checkpoint directory, last row of a key, and reads it back."""
    base = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    merge_latest(df, f"{base}/table", keys, order, partition, f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/table")
