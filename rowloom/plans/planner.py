"""From a goal in words to settings: a model drafts them, the table and the rules correct them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rowloom.api import Pipeline, from_config
from rowloom.functions.prompt import placeholders
from rowloom.sources import readers

SAMPLE_ROWS, SAMPLE_CHARS = 50, 200
_RULES = "Draft a prompt for every row of this table. Reply with one JSON object: template (with {column} placeholders), output_columns (a list of names) and parser (raw or json)."


@dataclass
class Plan:
    """A drafted and checked pipeline; nothing has run yet."""

    spark: SparkSession
    settings: dict[str, Any]
    notes: list[str]

    def preview_yaml(self) -> str:
        import yaml

        return yaml.safe_dump({k: v for k, v in self.settings.items()}, sort_keys=False, allow_unicode=True)

    def build(self, model=None, client=None) -> Pipeline:
        return from_config(self.spark, self.settings, model, client)

    def estimated_cost(self, price_in: str = "0", price_out: str = "0") -> DataFrame:
        from rowloom.functions.cost import estimate
        from rowloom.operators.rows import INDEX
        from pyspark.sql import functions as F

        p = self.build(lambda c: c)
        return estimate(p.prompts(p.rows()), F.col("prompt"), INDEX, price_in, price_out)


def sample(df: DataFrame) -> list[dict[str, Any]]:
    """Up to 50 rows, long texts cut: what the drafting model may see."""
    return [{k: v[:SAMPLE_CHARS] if isinstance(v, str) else v for k, v in r.asDict().items()} for r in df.limit(SAMPLE_ROWS).collect()]


def plan(spark: SparkSession, source: str, goal: str, draft: Callable[[str], str], key: str | None = None) -> Plan:
    """The plan for a goal.  ``draft`` is any model: prompt to reply.

    A placeholder without a column is an error.  Several outputs are parsed as JSON whatever the draft says, and
    outputs that repeat a column of the table are noted, as they replace it.
    """
    df = readers.read(spark, source)
    shown = json.dumps(sample(df), default=str, ensure_ascii=False)
    reply = draft(f"{_RULES}\n\nGoal: {goal}\nColumns: {', '.join(df.columns)}\nRows: {shown}")
    start, end = reply.find("{"), reply.rfind("}")
    try:
        got = json.loads(reply[start : end + 1])
        template, outs, parser = got["template"], list(got["output_columns"]), got.get("parser", "raw")
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"the draft is no settings: {reply[:200]!r}") from e
    inputs = placeholders(template)
    if missing := [c for c in inputs if c not in df.columns]:
        raise ValueError(f"the draft asks for columns {missing}; there are {df.columns}")
    if not inputs or not outs:
        raise ValueError("the draft has no inputs or no outputs")
    notes = [f"{c} is replaced" for c in outs if c in df.columns]
    if len(outs) > 1 and parser == "raw":
        parser = "json"
        notes.append("several outputs: parsed as JSON")
    return Plan(spark, {"dataset": {"path": source, "input_columns": inputs, "output_columns": outs, "key": key}, "prompt": {"template": template}, "parser": parser}, notes)
