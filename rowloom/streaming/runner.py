"""Tables that grow: each batch of new files through the same operators, with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowloom.sources import writers


def stream_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 16) -> DataFrame:
    """New files of a folder; ``files_per_batch`` bounds what one batch takes."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def run_batches(stream: DataFrame, transform: Callable[..., DataFrame | None], out: str, checkpoint: str, extra: list[str] | None = None) -> StreamingQuery:
    """``transform`` every batch and write it as a partition ``batch=N``: a batch that runs again replaces itself.

    A transform of two arguments gets the batch's number too; one that returns None leaves the batch out.  ``extra`` are
    other folders that get the same rows, read back from the first.
    """
    numbered = transform.__code__.co_argcount > 1 if hasattr(transform, "__code__") else False

    def each(batch: DataFrame, number: int) -> None:
        rows = transform(batch, number) if numbered else transform(batch)
        if rows is None:
            return
        first = f"{out}/batch={number}"
        rows.write.mode("overwrite").parquet(first)
        for path in extra or []:
            batch.sparkSession.read.schema(rows.schema).parquet(first).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def export(spark: SparkSession, out: str, path: str) -> DataFrame:
    """All batches as one file of the suffix's format."""
    return writers.write(spark.read.parquet(out).drop("batch"), path)


def totals(spark: SparkSession, out: str, cost: str | None = None) -> DataFrame:
    """Rows of each batch, and the sum of a cost column."""
    return spark.read.parquet(out).groupBy("batch").agg(F.count("*").alias("rows"), *([F.sum(cost).alias("cost")] if cost else []))


def windowed(events: DataFrame, time: str, size: str = "1 day", late: str = "1 hour", by: list[str] | None = None) -> DataFrame:
    """Counts by event-time window; rows later than the watermark are dropped when streaming."""
    w = F.window(time, size)
    return events.withWatermark(time, late).groupBy(w, *(by or [])).agg(F.count("*").alias("rows")).select(F.col("window.start").alias("window_start"), *(by or []), "rows")
