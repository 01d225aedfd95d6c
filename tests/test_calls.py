"""How calls are handed to threads, without a session."""

from __future__ import annotations

from types import SimpleNamespace

import pandas as pd

from rowloom.operators import invoke


def test_a_batch_is_one_task_a_thread(monkeypatch):
    submitted = []

    class Pool(invoke.ThreadPoolExecutor):
        def submit(self, *a, **k):
            submitted.append(a)
            return super().submit(*a, **k)

    monkeypatch.setattr(invoke, "ThreadPoolExecutor", Pool)
    field = SimpleNamespace(name="i", dataType=SimpleNamespace(simpleString=lambda: "long"))
    df = SimpleNamespace(schema=[field], mapInPandas=lambda run, fields: run)
    run = invoke.invoke(df, "prompt", invoke.EchoClient, ["i"], threads=4)
    frame = pd.DataFrame({"i": range(500), "prompt": [None if i == 7 else f"p {i}" for i in range(500)]})
    got = pd.concat(run(iter([frame, frame])))
    assert [None if pd.isna(r) else r for r in got["reply"]] == frame["prompt"].tolist() * 2
    assert len(submitted) <= 8
