"""The incremental append as a stream: each micro-batch of new files goes through the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.maintenance import new_rows
from tessera.sources.store import exists


def append_stream(rows: DataFrame, path: str, checkpoint: str, key: str, prepare: Callable[[DataFrame], DataFrame] = lambda x: x) -> StreamingQuery:
    """Appends rows whose key isn't in the table at ``path`` yet; what is there at the start is done, then it ends.

    A batch that is tried again after a failure finds its rows in place and adds none twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = prepare(batch).dropDuplicates([key])
        if exists(spark, path):
            new = new_rows(new, spark.read.parquet(path), key)
        new.write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event time window; rows later than ``late`` behind the newest are dropped in a stream."""
    from pyspark.sql import functions as F

    marked = events.withWatermark(time, late) if events.isStreaming else events
    span = F.window(F.col(time), width)
    return marked.groupBy(span.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
