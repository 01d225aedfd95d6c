"""Results back to rows: replace, append, update and lookups by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_results(df: DataFrame, results: DataFrame, on: str, how: str = "replace") -> DataFrame:
    """Left join of results by row.

    ``replace`` takes the result's cell wherever the row has a result, NULL or not, and adds new columns;
    ``append`` refuses columns that exist; ``update`` takes only cells that are not NULL.  Rows without a result
    stay as they are.  Results are one a row.
    """
    new = [c for c in results.columns if c != on]
    if how == "append" and (both := [c for c in new if c in df.columns]):
        raise ValueError(f"columns exist already: {both}")
    if how not in ("replace", "append", "update"):
        raise ValueError(f"unknown merge {how!r}")
    right = results.select(F.col(f"`{on}`"), *[F.col(f"`{c}`").alias(f"__r_{c}") for c in new], F.lit(True).alias("__hit"))
    joined = df.join(right, on, "left")

    def cell(c: str):
        if c not in new:
            return F.col(f"`{c}`")
        r = F.col(f"`__r_{c}`")
        if c not in df.columns:
            return r.alias(c)
        return (F.coalesce(r, F.col(f"`{c}`")) if how == "update" else F.when(F.col("__hit"), r).otherwise(F.col(f"`{c}`"))).alias(c)

    return joined.select(*[cell(c) for c in [*df.columns, *[c for c in new if c not in df.columns]]])


def lookup(df: DataFrame, other: DataFrame, on: str, order: str) -> DataFrame:
    """Left join in which the last of the other side's rows with a key, by ``order``, counts and NULL matches NULL.

    Columns of the same name are the other side's where it has the key.
    """
    cols = [c for c in other.columns if c != on]
    last = other.groupBy(F.col(f"`{on}`").alias("__k")).agg(F.max_by(F.struct(*[F.col(f"`{c}`").alias(f"__r_{c}") for c in cols]), order).alias("__r"), F.lit(True).alias("__hit"))
    joined = df.join(last, F.col(f"`{on}`").eqNullSafe(F.col("__k")), "left")
    keep = [F.when(F.col("__hit"), F.col(f"__r.`__r_{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns]
    return joined.select(*keep, *[F.col(f"__r.`__r_{c}`").alias(c) for c in cols if c not in df.columns])


def latest(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """Of rows with equal keys the one of the highest version: the read side of an upsert log."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("__r"))
    return best.select(*[F.col(c) if c in key else F.col(f"__r.{c}") for c in df.columns])
