"""Metrics of an event stream: windowed means with late events, for Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(events: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """(start, key, n, mean) over tumbling windows; events later than `late` are left out."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width), key)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), key, "n", "mean")


def run_to_folder(result: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs a streaming aggregate over all that its source holds now and leaves its whole result, as Parquet, in the folder.

    A batch that is tried again overwrites what it left before.
    """
    from pyspark.errors import StreamingQueryException

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    query = result.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise StreamingQueryException(str(query.exception()))
