"""Models by name, and providers that take whole batches of requests."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rowloom import store
from rowloom.operators.invoke import Client, invoke


@dataclass(frozen=True)
class Spec:
    """A model: its name, its provider, prices of a thousand tokens, and its window in tokens."""

    model: str
    provider: str
    price_in: str = "0"
    price_out: str = "0"
    window: int = 4096
    #: Ways of asking for structured replies, best first.
    modes: tuple[str, ...] = ("prompt",)


#: Named defaults; ``register`` adds others.
PRESETS: dict[str, Spec] = {
    "echo": Spec("echo", "local"),
    "tiny": Spec("tiny-v1", "local", window=1024),
    "small": Spec("small-v1", "hosted", "0.00015", "0.0006", 8192, ("schema", "tools", "json", "prompt")),
    "medium": Spec("medium-v1", "hosted", "0.001", "0.004", 32768, ("schema", "json", "prompt")),
    "large": Spec("large-v1", "hosted", "0.005", "0.02", 131072, ("tools", "json", "prompt")),
}


def register(name: str, spec: Spec) -> None:
    if name in PRESETS:
        raise ValueError(f"preset {name!r} exists already")
    PRESETS[name] = spec


def negotiate(spec: Spec, ask: Callable[[str], str]) -> tuple[str, str]:
    """(mode, reply) of the first of the model's modes that it does not reject; other errors are the caller's."""
    rejected = []
    for mode in spec.modes:
        try:
            return mode, ask(mode)
        except Exception as e:
            if not any(x in str(e).lower() for x in ("unsupported", "not supported", "invalid mode", "response_format", "tool_choice")):
                raise
            rejected.append(f"{mode}: {e}")
    raise RuntimeError(f"{spec.model} rejects all modes: {rejected}")


@dataclass(frozen=True)
class Batch:
    """What to keep of a run that was handed in: its own id, the provider's, and its folder."""

    run: str
    id: str
    folder: str


class BatchProvider(Protocol):
    model: str

    def submit(self, requests: str, replies: str) -> str:
        """Hand in a folder of request lines; its id."""

    def poll(self, batch: str) -> str:
        """submitted, running, completed or failed"""


class LiveProvider:
    """Any client as a provider of batches: requests are answered at once, on the executors, reply lines beside them."""

    def __init__(self, spark: SparkSession, make: Callable[[], Client], model: str = "live", **options):
        self.spark, self.make, self.model, self.options = spark, make, model, options

    def submit(self, requests: str, replies: str) -> str:
        lines = self.spark.read.text(requests)
        content = F.get_json_object("value", "$.body.messages[0].content")
        last = F.coalesce(F.get_json_object("value", "$.body.messages[1].content"), content)
        asked = lines.select(F.get_json_object("value", "$.custom_id").alias("custom_id"), last.alias("prompt"))
        done = invoke(asked, "prompt", self.make, ["custom_id"], **self.options)
        message = F.struct(F.array(F.struct(F.struct(F.col("reply").alias("content")).alias("message"))).alias("choices"))
        body = F.struct(F.when(F.col("error").isNull(), message).alias("body"))
        line = F.to_json(F.struct("custom_id", body.alias("response"), F.when(F.col("error").isNotNull(), F.struct(F.col("error").alias("message"))).alias("error")))
        done.select(line.alias("value")).write.mode("overwrite").text(replies)
        return f"{uuid.uuid4().hex}:{replies}"

    def poll(self, batch: str) -> str:
        fs, p = store.filesystem(self.spark, f"{batch.partition(':')[2]}/_SUCCESS")
        return "completed" if fs.exists(p) else "running"
