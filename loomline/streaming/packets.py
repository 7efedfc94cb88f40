"""Packets and usage from a stream of events, with the batch library's own expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.packets import newest
from loomline.sources.shared import fresh_path


def event_stream(spark: SparkSession, folder: str, schema: str, glob: str | None = None, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(folder)


def running_packets(events: DataFrame, key: str, order: list[str], content: str, kind: str, late: str = "1 day", time: str = "ts") -> DataFrame:
    """Newest content, event count and kinds of each key, kept up to date; state is one row per key."""
    kinds = F.array_join(F.array_sort(F.collect_set(kind)), ",")
    return events.withWatermark(time, late).groupBy(key).agg(newest(F.col(content), order).alias("latest_content"), F.count(F.lit(1)).alias("n_events"), kinds.alias("event_types"))


def usage_windows(events: DataFrame, kind: str, value: str, width: str = "1 day", late: str = "1 day", time: str = "ts") -> DataFrame:
    """Events and their sum per window and kind; a window's state is dropped once the watermark passes it."""
    out = events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), kind, "n", "total")


def once_seen(events: DataFrame, keys: list[str], late: str = "1 day", time: str = "ts") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that a stream gives for the input there is now, as a table in the shared folder."""
    spark = stream.sparkSession
    path, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    if mode == "append":
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).option("path", path).format("parquet").trigger(availableNow=True).start()
    else:  # the last batch holds the whole result; writing a batch again overwrites it
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
