"""Incremental facts: only contents that were not seen before are worked on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_seen(stream: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each key of a stream; with a time column, keys are forgotten once they are older than the watermark."""
    if time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def parse_new(stream: DataFrame, cache: str, parse: Callable[[DataFrame], DataFrame], checkpoint: str, progress: str | None = None):
    """Start a query that parses each batch's unseen keys into the Parquet cache (key, ...), once each.

    A batch is written below its own number, so a batch that is run again replaces itself instead of adding rows.
    The returned query has counters in ``lastProgress``; with a folder for ``progress`` they are a table too, which outlives the query:
    a row per batch, see ``read_progress``.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        fresh = rows.dropDuplicates(["key"])
        try:
            seen = spark.read.parquet(cache).where(F.col("batch") < number).select("key")
            fresh = fresh.join(seen, "key", "left_anti")
        except Exception as e:  # noqa: BLE001  the first batch finds no cache
            if "PATH_NOT_FOUND" not in str(e):
                raise
        parse(fresh).write.mode("overwrite").parquet(f"{cache}/batch={number}")
        if progress is not None:
            done = spark.read.parquet(f"{cache}/batch={number}").count()
            total = rows.agg(F.count("*").alias("rows"), F.count_distinct(F.struct("key")).alias("keys"))
            total.withColumn("parsed", F.lit(done).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{progress}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    """batch, rows, keys, parsed, known, and so far: keys that are done and rows in total. Known keys were parsed by an earlier batch.

    One row per batch, so the running sums are over a table that is far smaller than what the batches read.
    """
    so_far = W.orderBy("batch").rowsBetween(W.unboundedPreceding, 0)
    held = spark.read.parquet(folder).select(F.col("batch").cast("long").alias("batch"), "rows", "keys", "parsed", (F.col("keys") - F.col("parsed")).alias("known"))
    return held.withColumns({"done": F.sum("parsed").over(so_far), "total": F.sum("rows").over(so_far)})
