"""What became of the rows: reports, lost cells, second attempts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom import store
from rowloom.operators.merge import merge_results

SKIPPED = "[SKIPPED]"


def is_blank(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.coalesce((text == "") | (text == SKIPPED), F.lit(False))


def is_valid(c: Column) -> Column:
    return c.isNotNull() & ~is_blank(c)


def quality_report(df: DataFrame, outputs: list[str], expected_rows: int | None = None) -> DataFrame:
    """One row: valid rows (with at least one valid output), NULL and empty cells, rate, grade and issues."""
    cells = [F.col(f"`{c}`") for c in outputs]

    def times(test: Callable[[Column], Column]) -> Column:
        return reduce(lambda a, b: a + b, [F.count_if(test(c)) for c in cells])

    sums = df.agg(
        F.count("*").alias("total_rows"),
        F.count_if(reduce(lambda a, b: a | b, [is_valid(c) for c in cells])).alias("valid_rows"),
        times(lambda c: c.isNull()).alias("null_cells"),
        times(is_blank).alias("empty_cells"),
    )
    rows, all_cells = F.col("total_rows"), F.col("total_rows") * len(outputs)
    rate = F.when(rows > 0, 100.0 * F.col("valid_rows") / rows).otherwise(0.0)
    grade = F.when(rate >= 95, "excellent").when(rate >= 80, "good").when(rate >= 50, "poor").otherwise("critical")
    issues = [
        F.when(rate < 70, "low success rate"),
        F.when(F.col("null_cells") > 0.3 * all_cells, "many nulls"),
        F.when(F.col("empty_cells") > 0.1 * all_cells, "many empty"),
        F.when(rows != expected_rows, "row count differs") if expected_rows is not None else F.lit(None).cast("string"),
    ]
    return sums.select("*", F.round(rate, 4).alias("success_rate"), grade.alias("quality"), (rate >= 70).alias("acceptable"), F.concat_ws("; ", *issues).alias("issues"))


def blank_lost(df: DataFrame, errors: DataFrame, on: str, outputs: list[str]) -> DataFrame:
    """NULL in place of blanks and placeholders, only in rows that have an error."""
    hit = df.join(errors.select(on).distinct().withColumn("__lost", F.lit(True)), on, "left")
    lost = [F.when(F.col("__lost") & (is_blank(F.col(c)) | (F.trim(F.col(c).cast("string")) == "null")), None).otherwise(F.col(c)).alias(c) if c in outputs else F.col(c) for c in df.columns]
    return hit.select(*lost)


def failed_rows(df: DataFrame, outputs: list[str]) -> DataFrame:
    """The rows in which no output is valid."""
    return df.where(reduce(lambda a, b: a & b, [~is_valid(F.col(c)) for c in outputs]))


def retry_failed(df: DataFrame, outputs: list[str], on: str, again: Callable[[DataFrame, int], DataFrame], passes: int = 3) -> DataFrame:
    """Run ``again(failed rows, pass)`` up to ``passes`` times and merge what it returns (on, outputs).

    Each pass sees only rows that are still lost.  Its answers are written to the shared folder before anything reads
    them, so no pass is computed, or paid for, again by the next.
    """
    for i in range(1, passes + 1):
        lost = failed_rows(df, outputs)
        if lost.isEmpty():
            break
        df = merge_results(df, store.written(again(lost, i).select(on, *outputs)), on)
    return df


def guard(df: DataFrame, outputs: list[str], errors: int = 0, tokens: int = 0) -> DataFrame:
    """Fail a run of which nothing came: no valid row although rows were given, with errors or without a token."""
    got = quality_report(df, outputs).first()
    if got["total_rows"] and not got["valid_rows"] and (errors or not tokens):
        raise RuntimeError(f"no valid output in {got['total_rows']} rows ({errors} errors, {tokens} tokens)")
    return df


def apply_policy(df: DataFrame, outputs: list[str], error: str, policy: str, default: str | None = None) -> DataFrame:
    """What a row with an error becomes: ``skip`` NULLs, ``use_default`` a value, ``fail`` the end of the job."""
    bad = F.col(error).isNotNull()
    if policy == "fail":
        return df.withColumns({c: F.when(bad, F.raise_error(F.concat(F.lit("row failed: "), F.col(error)))).otherwise(F.col(c)) for c in outputs})
    if policy not in ("skip", "use_default"):
        raise ValueError(f"unknown policy {policy!r}")
    return df.withColumns({c: F.when(bad, F.lit(default if policy == "use_default" else None).cast("string")).otherwise(F.col(c)) for c in outputs})


def deployments(calls: DataFrame, column: str) -> DataFrame:
    """Calls of each deployment and their share in %."""
    counts = calls.groupBy(column).agg(F.count("*").alias("calls"))
    total = counts.agg(F.sum("calls").alias("__all"))
    return counts.crossJoin(F.broadcast(total)).select(column, "calls", F.round(100.0 * F.col("calls") / F.col("__all"), 4).alias("pct"))
