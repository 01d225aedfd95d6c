"""Columns that depend on columns: a graph of steps run in topological order, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Transform = Callable[[DataFrame], DataFrame]


@dataclass
class Composer:
    """Steps that each add a column; a step sees the columns of those it depends on."""

    steps: dict[str, tuple[Transform, tuple[str, ...]]] = field(default_factory=dict)

    def add_column(self, name: str, transform: Transform, depends_on: list[str] | None = None) -> Composer:
        if name in self.steps:
            raise ValueError(f"column {name} is defined twice")
        self.steps[name] = (transform, tuple(depends_on or ()))
        return self

    def order(self) -> list[str]:
        """A topological order; of steps that are ready the one added first."""
        for name, (_, needs) in self.steps.items():
            if missing := [n for n in needs if n not in self.steps]:
                raise ValueError(f"{name} depends on unknown columns {missing}")
        done: list[str] = []
        while len(done) < len(self.steps):
            ready = [n for n, (_, needs) in self.steps.items() if n not in done and all(d in done for d in needs)]
            if not ready:
                raise ValueError(f"circular dependency among {sorted(set(self.steps) - set(done))}")
            done.append(ready[0])
        return done

    def execute(self, df: DataFrame) -> DataFrame:
        for name in self.order():
            df = self.steps[name][0](df)
        return df
