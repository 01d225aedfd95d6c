"""The pipeline as tools for agents and as tasks for schedulers."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import Any, TextIO

from pyspark.sql import SparkSession

from rowloom.api import Pipeline, from_config
from rowloom.operators import runs


class Tools:
    """estimate, run, status and collect, over plain values; each run writes its result into ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, model=None, client=None):
        self.spark, self.folder, self.model, self.client = spark, folder.rstrip("/"), model, client
        self.registry = runs.Registry(spark, f"{self.folder}/state")

    def _pipeline(self, settings: dict[str, Any]) -> Pipeline:
        return from_config(self.spark, settings, self.model, self.client)

    def estimate(self, settings: dict[str, Any]) -> dict[str, Any]:
        return {k: str(v) for k, v in self._pipeline(settings).estimate().first().asDict().items()}

    def run(self, settings: dict[str, Any]) -> dict[str, Any]:
        p = self._pipeline(settings)
        self.registry.move(p.run, "running")
        try:
            p.execute().write.mode("overwrite").parquet(f"{self.folder}/result-{p.run}")
        except Exception:
            self.registry.move(p.run, "failed")
            raise
        self.registry.move(p.run, "completed")
        return {"run": p.run}

    def status(self, run: str) -> dict[str, Any]:
        return {"run": run, "state": self.registry.state(run)}

    def collect(self, run: str, rows: int = 100) -> dict[str, Any]:
        """The first rows of a result and how many there are; the whole lies in the folder."""
        df = self.spark.read.parquet(f"{self.folder}/result-{run}")
        return {"rows": df.count(), "first": [json.loads(x) for x in df.limit(rows).toJSON().collect()], "path": f"{self.folder}/result-{run}"}

    def names(self) -> list[str]:
        return ["estimate", "run", "status", "collect"]

    def call(self, request: dict[str, Any]) -> dict[str, Any] | None:
        """Answer one request of the Model Context Protocol (JSON-RPC); notifications get none."""
        if "id" not in request:
            return None
        answer: dict[str, Any] = {"jsonrpc": "2.0", "id": request["id"]}
        try:
            method, params = request["method"], request.get("params", {})
            if method == "initialize":
                answer["result"] = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "rowloom", "version": "1"}}
            elif method == "tools/list":
                answer["result"] = {"tools": [{"name": n, "description": getattr(self, n).__doc__ or n, "inputSchema": {"type": "object"}} for n in self.names()]}
            elif method == "tools/call" and params.get("name") in self.names():
                got = getattr(self, params["name"])(**params.get("arguments", {}))
                answer["result"] = {"content": [{"type": "text", "text": json.dumps(got, default=str)}]}
            else:
                answer["error"] = {"code": -32601, "message": f"no method {method} {params.get('name', '')}".strip()}
        except Exception as e:
            answer["error"] = {"code": -32000, "message": str(e)[:500]}
        return answer

    def serve(self, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
        """Requests a line, answers a line, until the input ends."""
        for line in lines:
            if line.strip() and (answer := self.call(json.loads(line))) is not None:
                print(json.dumps(answer), file=out, flush=True)


def task(spark_of: Callable[[], SparkSession], settings: dict[str, Any], **models: Any) -> Callable[..., str]:
    """A callable that runs the settings and returns the path of the result: for any scheduler's Python task."""

    def run(*_: Any, **__: Any) -> str:
        p = from_config(spark_of(), settings, **models)
        if p.s.out is None:
            raise ValueError("the settings name no output")
        p.execute()
        return p.s.out

    return run


def airflow_operator(task_id: str, spark_of: Callable[[], SparkSession], settings: dict[str, Any], **models: Any):
    """An operator of Airflow, if it is installed."""
    from airflow.operators.python import PythonOperator

    return PythonOperator(task_id=task_id, python_callable=task(spark_of, settings, **models))


def prefect_task(spark_of: Callable[[], SparkSession], settings: dict[str, Any], **models: Any):
    """A task of Prefect, if it is installed."""
    from prefect import task as prefect

    return prefect(task(spark_of, settings, **models))
