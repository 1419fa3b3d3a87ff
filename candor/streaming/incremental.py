"""Resumption by key, and row-local operators on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def not_done(df: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't in the log of what was processed.

    By key, not by count: rows that were processed but dropped are in the log too, so they aren't made again.
    """
    return df.join(log.select(*keys).dropna().distinct(), keys, "left_anti")


def resume(df: DataFrame, path: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Do ``work`` on the rows that the table at ``path`` lacks, append them, and return the table."""
    spark = df.sparkSession
    try:
        df = not_done(df, spark.read.parquet(path), keys)
    except Exception as e:  # noqa: BLE001 - the first run finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
    work(df).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def append_batches(stream: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], keys: list[str]) -> StreamingQuery:
    """Process what is available and stop. A batch that is repeated after a failure replaces itself: one folder per batch."""

    def batch(df: DataFrame, number: int) -> None:
        work(df.dropDuplicates(keys)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unseen(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once, with state bounded by a watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_rate(df: DataFrame, time: str, hit, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes", by: list[str] | None = None) -> DataFrame:  # noqa: ANN001
    """Rows and share of hits per window of event time; the same plan runs on a table and, with a watermark, on a stream."""
    d = df.withWatermark(time, delay) if df.isStreaming else df
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return d.groupBy(w.alias("w"), *(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("rate")).select(F.col("w.start").alias("window_start"), *(by or []), "n", "rate")
