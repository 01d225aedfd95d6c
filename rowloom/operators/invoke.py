"""Calling a model for every row: column models that Catalyst sees, remote ones in Arrow batches."""

from __future__ import annotations

import itertools
import re
import threading
import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass
from datetime import UTC, datetime
from decimal import Decimal
from email.utils import parsedate_to_datetime
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.parsing import ERROR_KINDS, RETRYABLE

ColumnModel = Callable[[Column], Column]
"""A deterministic reply as an expression over the prompt."""

CALL_FIELDS = "reply string, tokens_in long, tokens_out long, latency_ms double, error string, error_kind string, attempts int"


class Client(Protocol):
    """What a remote model offers; ``make`` functions build one in each task.

    Only ``invoke`` is needed.  ``start`` and ``stop`` run once a task if a client has them, and
    ``structured(prompt, schema)`` is asked instead of ``invoke`` if a schema is given.
    """

    def invoke(self, prompt: str) -> tuple[str, int, int]:
        """(reply, tokens in, tokens out)"""


class BaseClient:
    """Defaults for a client: words times 1.3 as tokens, and prices of a thousand tokens."""

    price_in, price_out = "0", "0"

    def start(self) -> None: ...

    def stop(self) -> None: ...

    def invoke(self, prompt: str) -> tuple[str, int, int]:
        raise NotImplementedError

    def structured(self, prompt: str, schema: str) -> tuple[str, int, int]:
        """A reply that is a JSON object of the DDL ``schema``; by default the schema is told in the prompt."""
        return self.invoke(f"{prompt}\n\nReply with one JSON object of the fields: {schema}")

    def batch(self, prompts: list[str]) -> list[tuple[str, int, int]]:
        return [self.invoke(p) for p in prompts]

    def estimate_tokens(self, text: str) -> int:
        return len(text.split()) * 13 // 10

    def cost(self, tokens_in: int, tokens_out: int) -> Decimal:
        return (tokens_in * Decimal(self.price_in) + tokens_out * Decimal(self.price_out)) / 1000


class EchoClient(BaseClient):
    """The prompt comes back: for tests and dry runs."""

    def invoke(self, prompt: str) -> tuple[str, int, int]:
        return prompt, len(prompt.split()), len(prompt.split())


def classify(message: str) -> str:
    low = message.lower()
    return next((kind for kind, parts in ERROR_KINDS if any(p in low for p in parts)), "other")


_SPAN = re.compile(r"(?:(\d+(?:\.\d+)?)m(?!s))?(?:(\d+(?:\.\d+)?)s)?")


def retry_after(headers: Mapping[str, str], now: datetime | None = None, most: float = 300.0) -> float | None:
    """Seconds that a server asks to wait, from 0 to ``most``: milliseconds, seconds or a date, an ISO time, 6m0s."""
    low = {k.lower(): v.strip() for k, v in headers.items()}
    now = now or datetime.now(UTC)

    def number(v: str) -> float | None:
        try:
            return float(v)
        except ValueError:
            return None

    def until(when: datetime) -> float:
        return ((when if when.tzinfo else when.replace(tzinfo=UTC)) - now).total_seconds()

    def read(name: str, v: str) -> float | None:
        try:
            if name.endswith("-ms"):
                n = number(v)
                return None if n is None else n / 1000
            if name == "retry-after":
                n = number(v)
                return until(parsedate_to_datetime(v)) if n is None else n
            if (m := _SPAN.fullmatch(v)) and (m[1] or m[2]):
                return 60 * float(m[1] or 0) + float(m[2] or 0)
            return until(datetime.fromisoformat(v))
        except (TypeError, ValueError):
            return None

    resets = sorted(k for k in low if "ratelimit" in k and "reset" in k)
    for name in ("retry-after-ms", "retry-after", *resets):
        if name in low and (s := read(name, low[name])) is not None:
            return min(max(s, 0.0), most)
    return None


@dataclass
class Bucket:
    """A token bucket: ``rpm`` calls a minute, ``burst`` at once; a penalty blocks it until its end."""

    rpm: float
    burst: float = 1.0
    clock: Callable[[], float] = time.monotonic

    def __post_init__(self) -> None:
        self.tokens, self.at, self.blocked = self.burst, self.clock(), 0.0

    def wait(self) -> float:
        """Take a token and return the seconds until it is there."""
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rpm / 60)
        self.at = now
        self.tokens -= 1
        return max(0.0, -self.tokens * 60 / self.rpm, self.blocked - now)

    def penalise(self, seconds: float) -> None:
        self.blocked = max(self.blocked, self.clock() + seconds)


@dataclass
class Concurrency:
    """A limit that follows latency: it shrinks as calls slow down or are refused, and grows while they do not."""

    limit: float = 8.0
    least: float = 1.0
    most: float = 64.0
    base: float = 0.0

    def record(self, latency: float, refused: bool = False, saturated: bool = True) -> float:
        self.base = latency if not self.base else 0.8 * self.base + 0.2 * latency
        if refused:
            self.limit *= 0.9
        elif saturated:
            slope = max(0.5, min(1.0, 2 * self.base / max(latency, 1e-9)))
            self.limit = 0.8 * self.limit + 0.2 * (self.limit * slope + self.limit**0.5)
        self.limit = min(self.most, max(self.least, self.limit))
        return self.limit


class Gate:
    """Lets as many calls through at a time as a ``Concurrency`` allows just now."""

    def __init__(self, limit: Concurrency):
        self.limit, self.active, self.waiting, self.free = limit, 0, 0, threading.Condition(threading.Lock())

    def __enter__(self) -> Gate:
        with self.free:
            while self.active >= max(1, int(self.limit.limit)):
                self.waiting += 1
                self.free.wait()
                self.waiting -= 1
            self.active += 1
        return self

    def __exit__(self, *_: object) -> None:
        with self.free:
            self.active -= 1
            if self.waiting:
                self.free.notify_all()

    def record(self, latency: float, refused: bool) -> None:
        with self.free:
            self.limit.record(latency, refused, self.active >= int(self.limit.limit))
            if self.waiting:
                self.free.notify_all()


def _headers(error: Exception) -> Mapping[str, str]:
    """The headers of the response that an error came with."""
    return getattr(error, "headers", None) or getattr(getattr(error, "response", None), "headers", None) or {}


def with_column_model(df: DataFrame, prompt: str, model: ColumnModel, reply: str = "reply") -> DataFrame:
    return df.withColumn(reply, model(F.col(prompt)))


def invoke(df: DataFrame, prompt: str, make: Callable[[], Client], keep: list[str], threads: int = 8, retries: int = 3, pause: float = 1.0, rpm: float | None = None, adaptive: bool = True, stop_on: tuple[str, ...] = ("auth",), schema: str | None = None) -> DataFrame:
    """``keep`` columns and ``CALL_FIELDS`` of a call for every row; up to ``threads`` calls at a time in each task.

    Retryable errors are tried again after ``pause`` seconds, doubling to a minute, or after what the server's headers
    ask for, which holds for all calls of the task.  Other errors end in the row's ``error``.  After one of a kind in
    ``stop_on`` a task sends nothing more: its other rows have the error ``not sent``.

    ``rpm`` is the limit of the whole job; the tasks that can run at once share it.  With ``adaptive`` the calls at a
    time follow their latency and refusals.  A NULL prompt is not sent.  Tasks may run twice, so write the result to a
    ``ResponseLog`` before anything else reads it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    fields = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [CALL_FIELDS])
    share = rpm / max(1, df.sparkSession.sparkContext.defaultParallelism) if rpm else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, bucket = make(), Bucket(share, max(1.0, share / 60)) if share else Bucket(float("inf"))
        lock, gate, fatal = threading.Lock(), Gate(Concurrency(float(threads), most=float(threads))), []

        def wait(seconds: float | None = None) -> None:
            with lock:
                if seconds is not None:
                    bucket.penalise(seconds)
                rest = bucket.wait() if share else max(0.0, bucket.blocked - bucket.clock())
            if rest > 0:
                time.sleep(rest)

        def call(text: str | None) -> tuple:
            if text is None:
                return None, 0, 0, 0.0, None, None, 0
            began, error, kind, attempt = time.perf_counter(), None, None, 0
            for attempt in range(1, retries + 2):
                if fatal:
                    return None, 0, 0, 0.0, f"not sent: {fatal[0]}", "stopped", attempt - 1
                with gate if adaptive else nullcontext():
                    if share or bucket.blocked:
                        wait()
                    at = time.perf_counter()
                    try:
                        out, tin, tout = client.structured(text, schema) if schema else client.invoke(text)
                        gate.record(time.perf_counter() - at, False)
                        return out, tin, tout, 1000 * (time.perf_counter() - began), None, None, attempt
                    except Exception as e:
                        error, kind, asked = str(e), classify(str(e)), retry_after(_headers(e))
                        gate.record(time.perf_counter() - at, kind == "rate_limit")
                if kind in stop_on:
                    fatal.append(error)
                if kind not in RETRYABLE or attempt > retries:
                    break
                if asked is not None:
                    wait(asked)
                else:
                    time.sleep(min(60.0, pause * 2 ** (attempt - 1)))
            return None, 0, 0, 1000 * (time.perf_counter() - began), error, kind, attempt

        def call_all(pool: ThreadPoolExecutor, prompts: list[str | None]) -> list[tuple]:
            """Each thread takes the next prompt as it is free: one task a thread, not one a row."""
            rows, turn = [()] * len(prompts), itertools.count()

            def work() -> None:
                while (at := next(turn)) < len(prompts):
                    rows[at] = call(prompts[at])

            for done in [pool.submit(work) for _ in range(min(threads, len(prompts)))]:
                done.result()
            return rows

        getattr(client, "start", lambda: None)()
        try:
            with ThreadPoolExecutor(threads) as pool:
                for frame in frames:
                    rows = call_all(pool, [None if pd.isna(p) else p for p in frame[prompt]])
                    yield pd.concat([frame[keep].reset_index(drop=True), pd.DataFrame(rows, columns=[c.split()[0] for c in CALL_FIELDS.split(", ")])], axis=1)
        finally:
            getattr(client, "stop", lambda: None)()

    return df.mapInPandas(run, fields)
