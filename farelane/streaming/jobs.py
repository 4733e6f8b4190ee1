"""Micro-batch counterparts: the batch operators over streams, run until what is there is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(stream: DataFrame, ts: str, keys: list[str], width: str = "15 minutes", late: str = "62 days") -> DataFrame:
    """Counts by key and event-time window; rows later than `late` behind the newest are dropped from state."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def sessions(stream: DataFrame, ts: str, keys: list[str], gap: str = "120 seconds", late: str = "1 hour") -> DataFrame:
    """Activity sessions by key that end after `gap` without a row."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def once_per_event(stream: DataFrame, ts: str, key: str, late: str = "62 days") -> DataFrame:
    """The first row of each key within the watermark; rows whose key is null or 0 (none) all pass."""
    none = F.col(key).isNull() | (F.col(key).cast("string") == "0")
    own = F.when(none, F.expr("uuid()")).otherwise(F.col(key).cast("string"))
    return stream.withColumn("_key", own).withWatermark(ts, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def split_late(stream: DataFrame, event: str, delivery: str, months: int = 2) -> tuple[DataFrame, DataFrame]:
    """(in time, too late): rows whose event is at most `months` before their delivery, and the others for accounting."""
    fine = F.add_months(F.to_date(event), months) >= F.trunc(F.to_date(delivery), "month")
    return stream.where(fine), stream.where(~fine)


def drain(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run batch(df, id) on all that is there, then stop. The batch should replace partitions, so that a repeat is harmless."""
    return stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_days(path: str, day: str) -> Callable[[DataFrame, int], None]:
    """A batch function that writes each batch to partitions of its own id and days; a repeated batch overwrites just them."""

    def run(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", day).parquet(path)

    return run
