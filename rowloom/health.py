"""Whether a pipeline could run just now."""

from __future__ import annotations

from typing import Any

from rowloom import store
from rowloom.api import Pipeline


def check(pipeline: Pipeline) -> dict[str, Any]:
    """``healthy``, and for each part ok or what is wrong: the source, the prompt, the model and the log's folder."""

    def source() -> None:
        if pipeline.rows().isEmpty():
            raise ValueError("the source has no rows")

    def model() -> None:
        s = pipeline.s
        if s.model is None:
            raise ValueError("no model")
        if s.remote and not hasattr(pipeline._make(next(iter(s.router[1])) if s.router else None)(), "invoke"):
            raise ValueError("the client has no invoke")

    def log() -> None:
        if pipeline.s.log:
            fs, p = store.filesystem(pipeline.spark, pipeline.s.log)
            if not fs.exists(p) and not fs.mkdirs(p):
                raise ValueError(f"cannot make {pipeline.s.log}")

    parts: dict[str, str] = {}
    for name, test in (("source", source), ("prompt", pipeline.validate), ("model", model), ("log", log)):
        try:
            test()
            parts[name] = "ok"
        except Exception as e:
            parts[name] = f"{type(e).__name__}: {str(e)[:200]}"
    return {"healthy": all(v == "ok" for v in parts.values()), "parts": parts}


def readiness(pipeline: Pipeline) -> dict[str, Any]:
    """``ready`` and the parts that are not."""
    got = check(pipeline)
    return {"ready": got["healthy"], "missing": [k for k, v in got["parts"].items() if v != "ok"]}
