"""Durable progress: a log of responses, what is left to do, and how far the rows are complete."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.operators.merge import latest


def pending(df: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """The rows that no finished one stands for."""
    return df.join(done.select(on).distinct(), on, "left_anti")


def watermark(done: DataFrame, index: str) -> DataFrame:
    """One row: the largest w with 0..w all complete (-1 if 0 is missing), rows complete, and rows beyond w.

    Without a gap an index equals its rank.  Ranks are those within blocks of indices, shifted by the blocks
    before; duplicates count once.
    """
    span = 100_000
    once = done.select(F.col(index).cast("long").alias("i")).where("i is not null").distinct().withColumn("b", F.floor(F.col("i") / span))
    sizes = once.groupBy("b").agg(F.count("*").alias("n"))
    base = sizes.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("i")) - 1).join(base, "b").withColumn("r", F.col("r") + F.col("base"))
    got = ranked.agg(F.coalesce(F.max(F.when(F.col("i") == F.col("r"), F.col("i"))), F.lit(-1)).alias("watermark"), F.count("*").alias("completed"))
    return got.withColumn("beyond", F.col("completed") - F.col("watermark") - 1)


class ResponseLog:
    """Parquet files of responses (session, row_index, version, ...), one write a wave; a later version wins."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("session").parquet(self.path)

    def spent(self, session: str) -> Decimal:
        """The cost of everything that was appended, replaced rows included."""
        try:
            return self.spark.read.parquet(self.path).where(F.col("session") == session).agg(F.sum("cost")).first()[0] or Decimal(0)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return Decimal(0)

    def read(self, session: str, schema: str) -> DataFrame:
        try:
            log = self.spark.read.parquet(self.path).where(F.col("session") == session)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            log = self.spark.createDataFrame([], schema)
        return latest(log, ["session", "row_index"], "version")


def throughput(done: DataFrame, index: str, began: str, ended: str) -> DataFrame:
    """One row: rows that are complete without a gap, and how many a second from the first start to the last end."""
    spans = done.agg(F.min(F.col(began).cast("timestamp")).alias("a"), F.max(F.col(ended).cast("timestamp")).alias("b"))
    seconds = F.unix_micros("b") / 1e6 - F.unix_micros("a") / 1e6
    both = watermark(done, index).crossJoin(spans)
    return both.select((F.col("watermark") + 1).alias("processed"), F.when(seconds > 0, F.round((F.col("watermark") + 1) / seconds, 6)).alias("rows_per_second"))
