"""Command line: inspect, validate, estimate and run; resume, and list what there is; hand in and collect batches."""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from rowloom.api import Pipeline, from_config
from rowloom.operators import runs
from rowloom.operators.rows import profile
from rowloom.sources import provider
from rowloom.sources.config import load
from rowloom.sources.readers import read


def thing(name: str) -> Any:
    """``package.module:attribute``."""
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"{name!r} is not module:attribute")
    return getattr(importlib.import_module(module), attribute)


def _pipeline(spark: SparkSession, args: argparse.Namespace, needs_model: bool = True) -> Pipeline:
    settings = load(args.settings)
    given: dict[str, Any] = settings.get("model", {})
    client, model = args.client or given.get("client"), args.model or given.get("column_model")
    if not client and not model:
        if needs_model:
            raise SystemExit("name a model: --client module:factory or --model module:function, or under model in the settings")
        model = "rowloom.cli:same"
    for k in ("session", "log"):
        if getattr(args, k, None):
            settings.setdefault("processing", {})[k] = getattr(args, k)
    if getattr(args, "output", None):
        settings.setdefault("output", {})["path"] = args.output
    return from_config(spark, settings, thing(model) if model and not client else None, thing(client) if client else None)


def same(prompt):
    """The model of commands that need none: the prompt."""
    return prompt


def _process(spark: SparkSession, args: argparse.Namespace) -> None:
    p = _pipeline(spark, args)
    if p.s.out is None:
        raise SystemExit("name an output: --output, or output.path in the settings")
    p.execute()
    print(f"wrote {p.s.out}; spent {p.spent()}")


def _resume(spark: SparkSession, args: argparse.Namespace) -> None:
    p = _pipeline(spark, args)
    if args.session not in runs.sessions(spark, p.s.log):
        raise SystemExit(f"no session {args.session!r} in {p.s.log}")
    _process(spark, args)


def _estimate(spark: SparkSession, args: argparse.Namespace) -> None:
    _pipeline(spark, args, False).estimate().show(truncate=False)


def _validate(spark: SparkSession, args: argparse.Namespace) -> None:
    _pipeline(spark, args, False).validate()
    print("valid")


def _inspect(spark: SparkSession, args: argparse.Namespace) -> None:
    df = read(spark, args.path)
    profile(df).show(1000, truncate=False)
    df.show(args.rows)


def _sessions(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.clean is not None:
        print("deleted:", *runs.clean(spark, args.path, args.clean))
    for s in runs.sessions(spark, args.path):
        print(s)


def _providers(spark: SparkSession, args: argparse.Namespace) -> None:
    for name, s in provider.PRESETS.items():
        print(f"{name}: {s.model} of {s.provider}, {s.price_in} / {s.price_out} for 1000 tokens, window {s.window}")


def _backend(spark: SparkSession, args: argparse.Namespace) -> provider.BatchProvider:
    return provider.LiveProvider(spark, thing(args.client)) if not args.provider else thing(args.provider)(spark)


def _submit(spark: SparkSession, args: argparse.Namespace) -> None:
    b = _pipeline(spark, args).submit(_backend(spark, args), args.folder)
    print(json.dumps({"run": b.run, "id": b.id, "folder": b.folder}))


def _batch(args: argparse.Namespace) -> provider.Batch:
    return provider.Batch(**json.loads(args.batch))


def _status(spark: SparkSession, args: argparse.Namespace) -> None:
    b = _batch(args)
    print(_backend(spark, args).poll(b.id), runs.Registry(spark, f"{b.folder}/state").state(b.run))


def _collect(spark: SparkSession, args: argparse.Namespace) -> None:
    from rowloom.sources.writers import write

    write(_pipeline(spark, args).collect(_batch(args), _backend(spark, args)), args.output)
    print(f"wrote {args.output}")


_SETTINGS = (("settings", {}), ("--client", {}), ("--model", {}))
COMMANDS: dict[str, tuple[str, Callable[[SparkSession, argparse.Namespace], None], tuple]] = {
    "process": ("run a settings file", _process, (*_SETTINGS, ("--output", {}), ("--log", {}), ("--session", {}))),
    "estimate": ("what a run would cost", _estimate, _SETTINGS),
    "resume": ("go on with a session of a log", _resume, (*_SETTINGS, ("--output", {}), ("--log", {}), ("--session", {"required": True}))),
    "validate": ("check a settings file", _validate, _SETTINGS),
    "list-checkpoints": ("sessions of a log", _sessions, (("path", {}), ("--clean", {"type": float, "metavar": "DAYS", "default": None}))),
    "inspect": ("profile a table", _inspect, (("path", {}), ("--rows", {"type": int, "default": 5}))),
    "list-providers": ("models by name", _providers, ()),
    "submit": ("hand in a batch", _submit, (*_SETTINGS, ("--provider", {}), ("--folder", {"required": True}))),
    "status": ("how far a batch is", _status, (("batch", {}), ("--client", {}), ("--provider", {}))),
    "collect": ("the result of a batch", _collect, (*_SETTINGS, ("--provider", {}), ("--batch", {"required": True}), ("--output", {"required": True}))),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rowloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (what, _, arguments) in COMMANDS.items():
        sub = commands.add_parser(name, help=what)
        for flag, options in arguments:
            sub.add_argument(flag, **options)
    args = parser.parse_args(argv)
    COMMANDS[args.command][1](SparkSession.builder.appName("rowloom").getOrCreate(), args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
