"""Row identity and the operators on whole rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom import store

INDEX = "_row_index"
#: Rows that one window partition numbers.
BUCKET_ROWS = 1_000_000


def with_row_index(df: DataFrame, key: str, name: str = INDEX) -> DataFrame:
    """Number the rows from 0 in the order of the column ``key``; of equal keys, by a hash of the row.

    Rows that tie even so are alike in all that can be hashed, so whichever is first, the same numbers meet the same
    values.  A table of more than ``BUCKET_ROWS`` rows is sorted into ranges and written once to the shared folder; each
    range is numbered by itself and shifted by the rows of those before, so no task holds the table.
    """
    hashable = [F.col(f"`{f.name}`") for f in df.schema.fields if not _has(f.dataType, (T.MapType, T.VariantType))]
    order = [F.col(f"`{key}`"), F.xxhash64(*hashable)]
    n = df.count()
    if n <= BUCKET_ROWS:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    ranged = df.repartitionByRange(math.ceil(n / BUCKET_ROWS), *order).sortWithinPartitions(*order)
    # the number holds the range above 33 bits and the place in it below
    kept = store.written(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = kept.groupBy(part.alias("__part")).count()  # one row a range
    base = sizes.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.withColumn("__part", part).join(F.broadcast(base), "__part").withColumn(name, (F.col("__base") + inside).cast("long")).drop("__at", "__part", "__base")


def _has(kind: T.DataType, of: tuple) -> bool:
    if isinstance(kind, of):
        return True
    if isinstance(kind, T.ArrayType):
        return _has(kind.elementType, of)
    return isinstance(kind, T.StructType) and any(_has(f.dataType, of) for f in kind.fields)


def at(df: DataFrame, i: int, name: str = INDEX) -> dict[str, Any]:
    """The row of an index, -1 being the last; an IndexError if there is none."""
    if i < 0:
        i += (df.agg(F.max(name)).first()[0] or 0) + 1
    found = df.where(F.col(name) == i).drop(name).first()
    if found is None:
        raise IndexError(i)
    return found.asDict()


def span(df: DataFrame, a: int, b: int, name: str = INDEX) -> DataFrame:
    """The rows from index a up to but without b."""
    return df.where((F.col(name) >= a) & (F.col(name) < b))


def to_records(df: DataFrame) -> Iterator[dict[str, Any]]:
    """The rows as dicts, a partition at a time."""
    return (r.asDict(recursive=True) for r in df.toLocalIterator())


def select(df: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns that exist."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing input columns: {missing}; there are {df.columns}")
    return df


def filter_rows(df: DataFrame, by: Column | str | Callable[[dict], bool]) -> DataFrame:
    """Rows by an expression, SQL text, or a Python predicate over row dicts.

    The predicate is the slow way: Arrow brings batches of rows, but Python sees them one by one.
    """
    if not callable(by) or isinstance(by, Column):
        return df.where(by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[bool(by(r)) for r in frame.to_dict("records")]]

    return df.mapInPandas(run, df.schema)


def map_rows(df: DataFrame, func: Callable[[dict], dict], schema: str) -> DataFrame:
    """Each row through a Python function, one by one; the schema is that of what it returns.  Prefer expressions."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([func(r) for r in frame.to_dict("records")])

    return df.mapInPandas(run, schema)


def where_equal(df: DataFrame, filters: dict[str, Any]) -> DataFrame:
    """All of ``column == value``; NULL equals NULL only, and a column that does not exist lets every row pass."""
    tests = [F.col(f"`{c}`").eqNullSafe(F.lit(v)) for c, v in filters.items() if c in df.columns]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def sort(df: DataFrame, key: str, descending: bool = False, tie: str | None = None) -> DataFrame:
    """NULLs last when rising, first when falling; ``tie`` makes the order total."""
    c = F.col(f"`{key}`")
    return df.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last(), *([tie] if tie else []))


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def tail(df: DataFrame, n: int, order: str) -> DataFrame:
    """The last n rows, in rising order."""
    return df.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows whose keys have the smallest hashes: uniform, and the same on every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def top_k(df: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The k rows of the highest score for each value of ``by``, with their ``rank``; ties by the smaller ``tie``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie)))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of both; columns of one side are NULL in the other's rows."""
    return a.unionByName(b, allowMissingColumns=True)


def profile(df: DataFrame) -> DataFrame:
    """One row a column: type, rows, NULLs and about how many distinct values (HyperLogLog, 5 %), in one pass."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    sums = df.agg(F.count("*").alias("rows"), *[F.count_if(c.isNull()).alias(f"n{i}") for i, c in enumerate(cols)], *[F.approx_count_distinct(c.cast("string")).alias(f"d{i}") for i, c in enumerate(cols)])
    items = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("rows"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct")) for i, (c, t) in enumerate(df.dtypes)]
    return sums.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: NULLs, others and distinct values of a column, and its sum: of numbers, or of true values."""
    c, kind = F.col(f"`{column}`"), df.schema[column].dataType
    total = F.count_if(c) if isinstance(kind, T.BooleanType) else F.sum(c) if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
    return df.agg(F.count_if(c.isNull()).alias("isna"), F.count(c).alias("notna"), F.count_distinct(c).alias("nunique"), total.alias("sum"))
