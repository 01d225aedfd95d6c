"""Pipelines from little: what can be inferred is."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from rowloom.api import Pipeline, PipelineBuilder
from rowloom.functions.prompt import placeholders
from rowloom.sources import provider, readers

#: Calls at a time of each task, by the provider.
THREADS = {"local": 2, "hosted": 16}


def waves_for(rows: int) -> int:
    """Waves of a log: one for small tables, else one for about 100 000 rows, so that little is lost with a run."""
    return max(1, min(1000, rows // 100_000))


def pack_for(rows: int) -> int:
    """Rows of one call: 10 for up to a hundred rows, then 50, 100 and 500 by tens."""
    return 10 if rows <= 100 else 50 if rows <= 1_000 else 100 if rows <= 10_000 else 500


def guess_provider(model: str) -> str:
    """The provider of a model's name: that of a preset of this name or this model, or what stands before a slash."""
    for name, spec in provider.PRESETS.items():
        if model in (name, spec.model):
            return spec.provider
    return model.partition("/")[0] if "/" in model else "hosted"


def create(spark: SparkSession, data: Any, template: str, outputs: list[str] | None = None, model: Any = None, client: Any = None, name: str = "small", key: str | None = None, budget: str | None = None, pack: bool = False) -> Pipeline:
    """A pipeline over a path, frame or rows.

    The inputs are the template's placeholders, the output is ``output`` unless named, the parser JSON for several
    outputs.  ``model`` is a column model, ``client`` makes a remote one, of which ``name`` gives prices and calls at a
    time.  ``pack`` puts several rows in a call, as many as ``pack_for`` says.
    """
    inputs = placeholders(template)
    if not inputs:
        raise ValueError("the template has no placeholders")
    df = readers.read(spark, data)
    if missing := [c for c in inputs if c not in df.columns]:
        raise ValueError(f"the template asks for {missing}; there are {df.columns}")
    outs = outputs or ["output"]
    b = PipelineBuilder(spark).from_source(df, inputs, outs, key).with_prompt(template).with_parser("json" if len(outs) > 1 else "raw")
    n = df.count()
    if pack:
        b = b.with_batch_size(pack_for(n))
    if client is not None:
        spec = provider.PRESETS.get(name)
        if spec:
            b = b.with_prices(spec.price_in, spec.price_out)
        b = b.with_client(client, threads=THREADS.get(guess_provider(name), 8))
    else:
        b = b.with_column_model(model)
    if budget:
        from rowloom.store import new_path

        b = b.with_log(new_path(spark, "responses"), waves=max(10, waves_for(n))).with_budget(budget)
    return b.build()


class DatasetProcessor:
    """The three questions that a table is usually asked."""

    def __init__(self, spark: SparkSession, data: Any, template: str, outputs: list[str], **options: Any):
        self.pipeline = create(spark, data, template, outputs, **options)

    def run(self):
        return self.pipeline.execute()

    def run_sample(self, n: int = 10):
        return self.pipeline.sample(n)

    def estimate(self):
        return self.pipeline.estimate()
