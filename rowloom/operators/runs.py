"""Runs as tables: routing of calls, legal states, events and what they add up to."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom import store

#: What may follow a state; a run starts as ``created``.
TRANSITIONS: dict[str, tuple[str, ...]] = {
    "created": ("submitted", "running", "cancelled"),
    "submitted": ("running", "failed", "cancelled"),
    "running": ("paused", "completed", "failed", "cancelled"),
    "paused": ("running", "cancelled"),
    "completed": (),
    "failed": (),
    "cancelled": (),
}


STRATEGIES = ("simple-shuffle", "weighted", "round-robin", "least-busy", "latency-based-routing", "cost-based-routing", "usage-based-routing")


def route(key: Column, deployments: dict[str, int]) -> Column:
    """The deployment of each row: by weight, through a hash of its key, so a retry goes the same way."""
    total = sum(deployments.values())
    if total <= 0:
        raise ValueError("no deployment has a weight above 0")
    at = F.pmod(F.crc32(key.cast("string")), F.lit(total))
    out, end = F.lit(None).cast("string"), total
    for name, weight in reversed(deployments.items()):
        out = F.when(at < end, name).otherwise(out)
        end -= weight
    return out


def shares(strategy: str, deployments: dict[str, dict[str, float]], parts: int = 1000) -> dict[str, int]:
    """Weights for ``route`` by a strategy's name, out of ``parts``, from what is known of each deployment: ``weight``,
    ``busy`` calls, ``latency`` in seconds, ``cost`` of a thousand tokens, ``used`` and ``limit`` tokens a minute.

    Work is split for a whole stage ahead, so "least" means "in inverse proportion to": a deployment that is twice as
    busy, slow or dear gets half.  ``cost-based-routing`` sends all to the cheapest, the first of equals.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {STRATEGIES}")
    if not deployments:
        raise ValueError("no deployments")

    def value(d: dict[str, float], name: str, default: float) -> float:
        return float(d.get(name, default))

    if strategy == "cost-based-routing":
        best = min(deployments, key=lambda n: value(deployments[n], "cost", 0.0))
        raw = {n: float(n == best) for n in deployments}
    else:
        of = {
            "simple-shuffle": lambda d: 1.0,
            "round-robin": lambda d: 1.0,
            "weighted": lambda d: value(d, "weight", 1.0),
            "least-busy": lambda d: 1 / (1 + value(d, "busy", 0.0)),
            "latency-based-routing": lambda d: 1 / max(value(d, "latency", 1.0), 1e-6),
            "usage-based-routing": lambda d: max(0.0, value(d, "limit", 1.0) - value(d, "used", 0.0)),
        }[strategy]
        raw = {n: of(d) for n, d in deployments.items()}
    total = sum(raw.values())
    if total <= 0:
        raise ValueError(f"no deployment has room by {strategy}")
    exact = {n: parts * v / total for n, v in raw.items()}
    out = {n: int(v) for n, v in exact.items()}
    for n in sorted(exact, key=lambda n: (out[n] - exact[n], n))[: parts - sum(out.values())]:
        out[n] += 1
    return out


def assign(df: DataFrame, key: str, strategy: str, deployments: dict[str, dict[str, float]]) -> DataFrame:
    """``deployment`` by a strategy.  Round robin takes turns by the number ``key``, the others go by its hash."""
    if strategy == "round-robin":
        names = F.array(*map(F.lit, deployments))
        return df.withColumn("deployment", F.try_element_at(names, (F.pmod(F.col(key), F.lit(len(deployments))) + 1).cast("int")))
    return df.withColumn("deployment", route(F.col(key), shares(strategy, deployments)))


def labels(calls: DataFrame, deployment: str, order: str, names: list[str]) -> DataFrame:
    """(deployment, label): unseen deployments take the configured names by first appearance, then their own."""
    seen = calls.groupBy(deployment).agg(F.min(order).alias("__first"))
    rank = F.row_number().over(Window.orderBy("__first", deployment))
    return seen.select(deployment, F.coalesce(F.try_element_at(F.array(*map(F.lit, names)).cast("array<string>"), rank), F.col(deployment)).alias("label"))


def run_states(events: DataFrame, run: str, state: str, seq: str) -> DataFrame:
    """(run, state, changes, illegal): the latest state of each run, and how many of its steps no rule allows."""
    legal = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    before = F.coalesce(F.lag(state).over(Window.partitionBy(run).orderBy(seq)), F.lit("created"))
    ok = F.coalesce(F.array_contains(F.try_element_at(legal, before), F.col(state)), F.lit(False)) | (before == F.col(state))
    return events.withColumn("__bad", ~ok).groupBy(run).agg(F.max_by(state, seq).alias("state"), F.count("*").alias("changes"), F.count_if(F.col("__bad")).alias("illegal"))


def metrics(events: DataFrame, kind: str, by: list[str], value: str) -> DataFrame:
    """Requests, errors and the sum and median of a value, from an event table.

    Values are counted by (group, value) first, so no task holds all values of a large group; the median is where half
    of the counts are reached, halfway between two values if it falls there, as linear interpolation has it.
    """
    c = F.col(value)
    counts = events.groupBy(*by, c.alias("__v")).agg(F.count("*").alias("__n"), F.count_if(F.col(kind) == "error").alias("__e"), F.sum(c).alias("__s"))
    w = Window.partitionBy(*by)
    known = F.col("__v").isNotNull()
    n = F.when(known, F.col("__n")).otherwise(0)
    ranked = counts.withColumns({"__upto": F.sum(n).over(w.orderBy(F.col("__v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum(n).over(w)})
    # the 0-based positions (all - 1) / 2, rounded down and up
    low, high = F.floor((F.col("__all") - 1) / 2), F.ceil((F.col("__all") - 1) / 2)
    at = lambda p: F.max(F.when(known & (F.col("__upto") - F.col("__n") <= p) & (p < F.col("__upto")), F.col("__v")))
    return ranked.groupBy(*by).agg(F.sum("__n").alias("requests"), F.sum("__e").alias("errors"), F.round(F.sum("__s"), 4).alias("total"), F.round((at(low) + at(high)) / 2, 6).alias("median"))


#: Columns of the event table that runs append to.
EVENT = "run string, seq long, at timestamp, kind string, stage string, rows long, tokens_in long, tokens_out long, cost decimal(38,10), detail string"


class Registry:
    """Runs in a folder: an event for each change of state, and no change that the rules forbid.

    An event is one small Parquet file named by run and number.  The number's file is created, not replaced, so of two
    writers that take the same step one fails.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _steps(self, run: str) -> list[str]:
        fs, p = store.filesystem(self.spark, f"{self.path}/{run}")
        if not fs.exists(p):
            return []
        found = sorted((s.getPath().getName() for s in fs.listStatus(p)), key=lambda n: int(n.partition(".")[0]))
        return [n.partition(".")[2] for n in found]

    def state(self, run: str) -> str:
        """The run's state; ``created`` before its first event."""
        return (self._steps(run) or ["created"])[-1]

    def move(self, run: str, state: str) -> str:
        steps = self._steps(run)
        now = steps[-1] if steps else "created"
        if state == now:
            return state
        if state not in TRANSITIONS.get(now, ()):
            raise ValueError(f"run {run} is {now}; it cannot become {state}")
        fs, p = store.filesystem(self.spark, f"{self.path}/{run}/{len(steps)}.{state}")
        # another writer may have taken this step under another name
        fs.create(p, False).close()
        if len([n for n in self._numbers(run) if n == len(steps)]) > 1:
            fs.delete(p, False)
            raise ValueError(f"run {run} was moved by another writer")
        return state

    def _numbers(self, run: str) -> list[int]:
        fs, p = store.filesystem(self.spark, f"{self.path}/{run}")
        return [int(s.getPath().getName().partition(".")[0]) for s in fs.listStatus(p)]

    def runs(self) -> dict[str, str]:
        return {r: self.state(r) for r in store.folders(self.spark, self.path)}


def sessions(spark: SparkSession, log: str) -> list[str]:
    """The sessions of a response log."""
    return sorted(n.partition("=")[2] for n in store.folders(spark, log) if n.startswith("session="))


def clean(spark: SparkSession, log: str, days: float = 7) -> list[str]:
    """Delete sessions that were not written to for so many days; returns their names."""
    old = [n for n, at in store.folders(spark, log).items() if n.startswith("session=") and at < time.time() - 86400 * days]
    for n in old:
        store.delete(spark, f"{log}/{n}")
    return sorted(n.partition("=")[2] for n in old)
