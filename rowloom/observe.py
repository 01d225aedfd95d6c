"""Events of runs: to observers as they happen, to a table that outlives the run."""

from __future__ import annotations

import logging
import time
from collections import Counter
from collections.abc import Callable
from datetime import UTC, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rowloom.operators.runs import EVENT

Event = dict[str, Any]
Observer = Callable[[Event], None]
_log = logging.getLogger("rowloom")


class Dispatcher:
    """Hands each event to every observer; one that fails is logged and does not disturb the others or the run."""

    def __init__(self, run: str, observers: list[Observer]):
        self.run, self.observers, self.seq = run, observers, 0

    def __call__(self, kind: str, **fields: Any) -> None:
        event = {"run": self.run, "seq": self.seq, "at": datetime.now(UTC).replace(tzinfo=None), "kind": kind, "stage": None, "rows": None, "tokens_in": None, "tokens_out": None, "cost": None, "detail": None, **fields}
        self.seq += 1
        for observer in self.observers:
            try:
                observer(event)
            except Exception:
                _log.exception("observer %r failed", observer)


def log_events(event: Event) -> None:
    """Each event is a line of the log."""
    _log.info("%s %s", event["kind"], {k: v for k, v in event.items() if v is not None and k not in ("kind", "at")})


class EventTable:
    """Events as rows of a table; ``flush`` appends those seen so far, ``end`` and ``error`` flush by themselves."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.held = spark, path, []

    def __call__(self, event: Event) -> None:
        self.held.append(event)
        if event["kind"] in ("end", "error"):
            self.flush()

    def flush(self) -> None:
        if self.held:
            names = [f.split()[0] for f in EVENT.split(", ")]
            rows, self.held = [tuple(e.get(n) for n in names) for e in self.held], []
            self.spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(EVENT).parquet(self.path)


class CostObserver:
    """The cost of all runs seen."""

    def __init__(self) -> None:
        self.total = Decimal(0)

    def __call__(self, event: Event) -> None:
        if event["kind"] == "end" and event["cost"] is not None:
            self.total += event["cost"]


class Progress:
    """Waves done, and since when."""

    def __init__(self, show: Callable[[str], None] = print):
        self.show, self.began, self.waves = show, time.monotonic(), 0

    def __call__(self, event: Event) -> None:
        self.waves += event["kind"] == "wave"
        self.show(f"{event['kind']}: {self.waves} waves in {time.monotonic() - self.began:.1f} s")


class Metrics:
    """Counters by kind of event, in the text format that Prometheus reads."""

    def __init__(self) -> None:
        self.count, self.cost = Counter(), Decimal(0)

    def __call__(self, event: Event) -> None:
        self.count[event["kind"]] += 1
        self.cost += event["cost"] or 0

    def text(self) -> str:
        lines = ["# TYPE rowloom_events_total counter", *(f'rowloom_events_total{{kind="{k}"}} {n}' for k, n in sorted(self.count.items()))]
        return "\n".join([*lines, "# TYPE rowloom_cost_total counter", f"rowloom_cost_total {self.cost}", ""])


def tracing(tracer: Any) -> Observer:
    """A span a run for anything with OpenTelemetry's ``start_span``; other events become events of the span."""
    spans: dict[str, Any] = {}

    def observe(event: Event) -> None:
        run = event["run"]
        if event["kind"] == "start":
            spans[run] = tracer.start_span("rowloom")
        elif run in spans:
            spans[run].add_event(event["kind"], {k: str(v) for k, v in event.items() if v is not None})
            if event["kind"] in ("end", "error"):
                spans.pop(run).end()

    return observe


#: Observers by name, for settings files and the command line.
OBSERVERS: dict[str, Callable[[], Observer]] = {"log": lambda: log_events, "cost": CostObserver, "progress": Progress, "metrics": Metrics}
