"""Cost, budgets and context windows in exact decimals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(38,10)"
#: Context windows in tokens by the beginning of a model's name; the longest that fits counts.
CONTEXT = {"tiny": 1024, "small": 8192, "medium": 32768, "large": 131072}
FALLBACK_CONTEXT = 4096


def call_cost(tokens_in: Column, tokens_out: Column, price_in: str, price_out: str) -> Column:
    """Tokens by thousands times the prices of a thousand."""
    return ((tokens_in * F.lit(Decimal(price_in)) + tokens_out * F.lit(Decimal(price_out))) / F.lit(Decimal(1000))).cast(MONEY)


def rollup(calls: DataFrame, stage: str = "stage", cost: str = "cost", tokens_in: str = "tokens_in", tokens_out: str = "tokens_out") -> DataFrame:
    """Cost and tokens for each stage and, under a NULL stage, for all."""
    return calls.rollup(stage).agg(F.sum(cost).cast(MONEY).alias("cost"), F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"), F.count("*").alias("calls"))


def estimate(df: DataFrame, prompt: Column, order: str, price_in: str, price_out: str, sample: int = 10) -> DataFrame:
    """One row: the cost of all rows, from the first ``sample``; a reply has half the tokens of its prompt."""
    from rowloom.functions.text import token_estimate

    few = df.orderBy(order).limit(sample).select(token_estimate(prompt).alias("t")).agg(F.count("*").alias("sampled"), F.sum("t").alias("t"))
    total = df.agg(F.count("*").alias("rows"))
    tin = F.col("t") * F.col("rows") / F.col("sampled")
    scaled = few.crossJoin(total).select("rows", "sampled", F.floor(tin).cast("long").alias("tokens_in"), F.floor(tin / 2).cast("long").alias("tokens_out"))
    return scaled.withColumn("cost", call_cost(F.col("tokens_in"), F.col("tokens_out"), price_in, price_out))


def running_cost(calls: DataFrame, order: str, cost: str = "cost", span: int = 10_000) -> DataFrame:
    """``spent``: the cost of all rows up to each one.  Blocks of ``span`` values of the integer ``order`` are summed
    apart and shifted by the sums of the blocks before, so no task sees all rows."""
    block = F.floor(F.col(order) / span)
    inside = Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = calls.withColumn("__block", block).withColumn("__in", F.sum(cost).over(inside))
    sums = rows.groupBy("__block").agg(F.sum(cost).alias("__sum"))
    before = sums.select(F.col("__block"), F.coalesce(F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(MONEY)).alias("__before"))
    return rows.join(before, "__block").withColumn("spent", (F.col("__in") + F.col("__before")).cast(MONEY)).drop("__block", "__in", "__before")


def budget(calls: DataFrame, order: str, most: str, cost: str = "cost") -> DataFrame:
    """``spent`` and ``budget_state``: ok, warn_75, warn_90, or stop where the sum is beyond the budget."""
    top = Decimal(most)
    state = F.when(F.col("spent") > F.lit(top), "stop").when(F.col("spent") >= F.lit(top * 9 / 10), "warn_90").when(F.col("spent") >= F.lit(top * 3 / 4), "warn_75").otherwise("ok")
    return running_cost(calls, order, cost).withColumn("budget_state", state)


def can_afford(spent: Decimal, next_cost: Decimal, most: Decimal) -> bool:
    return spent + next_cost <= most


def remaining(spent: Decimal, most: Decimal) -> Decimal:
    return max(Decimal(0), most - spent)


def context_limit(model: str) -> int:
    fits = [k for k in CONTEXT if model.lower().startswith(k)]
    return CONTEXT[max(fits, key=len)] if fits else FALLBACK_CONTEXT


def fits_context(tokens: Column, batch: int, model: str, margin: float = 0.8) -> Column:
    return tokens * batch <= int(context_limit(model) * margin)


def suggested_batch(tokens: Column, model: str, margin: float = 0.8, most: int = 500) -> Column:
    """How many prompts of so many tokens fit the safe part of the window; NULL for a prompt without tokens."""
    return F.when(tokens > 0, F.least(F.lit(most), F.floor(F.lit(int(context_limit(model) * margin)) / tokens))).cast("int")
