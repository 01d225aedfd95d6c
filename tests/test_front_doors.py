"""The pipeline's own ways of failing, going on, streaming and being asked from outside."""

from __future__ import annotations

import io
import json
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowloom import api, health, observe, quick, store, tools
from rowloom.functions import parsing
from rowloom.operators import batches, grounding, invoke, quality, resume, retrieval, rows, runs
from rowloom.plans import planner
from rowloom.sources import provider, readers, writers


class Upper(invoke.BaseClient):
    def invoke(self, prompt):
        return prompt.upper(), 1, 1


class Refused(invoke.BaseClient):
    def invoke(self, prompt):
        if prompt.endswith("3"):
            raise RuntimeError("401 unauthorized")
        return prompt, 1, 1


class Blank(invoke.BaseClient):
    def invoke(self, prompt):
        return " ", 0, 0


def builder(spark, n=8, **options):
    df = spark.createDataFrame([(i, f"w{i}") for i in range(n)], "i long, w string")
    return api.PipelineBuilder(spark).from_source(df, ["w"], ["out"], "i").with_prompt("say {w}")


def test_remote_runs_are_logged_and_resume(spark, tmp_path):
    events = observe.EventTable(spark, f"file://{tmp_path}/events")
    b = builder(spark).with_log(f"file://{tmp_path}/log", "s", waves=2).with_observer(events).with_observer(lambda e: 1 / 0)
    with pytest.raises(RuntimeError, match="unauthorized"):
        b.with_client(Refused, threads=2).build().execute()
    done = b.with_client(Upper).build()
    assert [r["out"] for r in done.execute().orderBy("i").collect() if r["out"].isupper()]
    assert done.errors().count() == 0 and done.spent() == 0
    kinds = [r["kind"] for r in events.read().collect()]
    assert kinds.count("start") == 2 and "error" in kinds and "end" in kinds
    assert runs.sessions(spark, f"file://{tmp_path}/log") == ["s"]
    # without a log of its own a remote pipeline still has one, so that no action calls the model twice
    p = builder(spark).with_client(Upper).build()
    assert p.s.log and p.execute().count() == 8
    assert runs.clean(spark, f"file://{tmp_path}/log", -1) == ["s"] and runs.sessions(spark, f"file://{tmp_path}/log") == []


def test_guard_and_policies(spark):
    with pytest.raises(RuntimeError, match="no valid output"):
        builder(spark).with_client(Blank).build().execute()
    assert builder(spark).with_client(Blank).with_guard(False).build().execute().count() == 8
    with pytest.raises(ValueError):
        builder(spark).with_column_model(lambda p: p).with_error_policy("hope").build().validate()
    with pytest.raises(ValueError):
        builder(spark).build()
    with pytest.raises(ValueError):
        builder(spark).with_column_model(lambda p: p).with_confidence_scoring().build()


def test_rows_without_a_key_keep_their_replies(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "w string")
    p = api.PipelineBuilder(spark).from_dataframe(df, ["w"], ["out"]).with_prompt("{w}!").with_column_model(lambda c: F.upper(c)).build()
    assert sorted((r["w"] or "", r["out"]) for r in p.execute().collect()) == [("", "NONE!"), ("a", "A!"), ("a", "A!"), ("b", "B!")]
    assert api.enrich(df.toPandas(), "{w}?", ["o"], client=Upper, spark=spark)["o"].tolist().count("A?") == 2
    with pytest.raises(ValueError):
        api.enrich(df, "{w}", ["o"])


def test_router_system_and_structured_output(spark):
    class Where(invoke.BaseClient):
        def __init__(self, system, deployment):
            self.at = f"{system}@{deployment}"

        def invoke(self, prompt):
            return json.dumps({"out": self.at, "n": 3}), 1, 1

    b = builder(spark).with_system_prompt("sys").with_router("round-robin", {"x": {}, "y": {}}).with_client(Where).with_structured_output("out string, n int")
    assert [r["out"] for r in b.build().execute().orderBy("i").collect()] == ["sys@x", "sys@y"] * 4
    assert runs.shares("least-busy", {"a": {"busy": 0}, "b": {"busy": 1}}) == {"a": 667, "b": 333}
    assert runs.shares("cost-based-routing", {"a": {"cost": 2}, "b": {"cost": 1}}) == {"a": 0, "b": 1000}
    assert runs.shares("usage-based-routing", {"a": {"limit": 10, "used": 10}, "b": {"limit": 10}}) == {"a": 0, "b": 1000}
    for s in runs.STRATEGIES:
        assert sum(runs.shares(s, {"a": {}, "b": {"latency": 3}}).values()) == 1000
    with pytest.raises(ValueError):
        runs.shares("best", {"a": {}})


def test_rate_control(spark):
    class Limited(invoke.BaseClient):
        def __init__(self):
            self.calls = 0

        def invoke(self, prompt):
            self.calls += 1
            if self.calls == 1:
                e = RuntimeError("429 too many")
                e.headers = {"retry-after-ms": "400"}
                raise e
            return prompt, 1, 1

    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, p string").coalesce(1)
    began = time.monotonic()
    got = invoke.invoke(df, "p", Limited, ["i"], threads=1, pause=0.0).collect()
    assert {r["reply"] for r in got} == {"a", "b"} and time.monotonic() - began >= 0.4
    gate = invoke.Gate(invoke.Concurrency(4.0, most=4.0))
    for _ in range(30):
        with gate:
            gate.record(1.0, True)
    assert gate.limit.limit < 4.0
    stopped = invoke.invoke(spark.createDataFrame([(i, f"x{i}") for i in range(3, 6)], "i int, p string").coalesce(1), "p", Refused, ["i"], threads=1, pause=0.0).collect()
    assert [r["error_kind"] for r in sorted(stopped)] == ["auth", "stopped", "stopped"]


def test_registry_refuses_illegal_moves(spark, tmp_path):
    r = runs.Registry(spark, f"file://{tmp_path}/state")
    assert r.state("a") == "created"
    for s in ("running", "paused", "running", "completed"):
        r.move("a", s)
    assert r.runs() == {"a": "completed"} and r.move("a", "completed") == "completed"
    with pytest.raises(ValueError):
        r.move("a", "running")


def test_streams(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    for k in range(3):
        spark.createDataFrame([(k, "bad" if k == 1 else f"w{k}")], "i long, w string").coalesce(1).write.mode("append").parquet(src)
    b = api.PipelineBuilder(spark).from_source(src, ["w"], ["out"], "i").with_prompt("{w}").with_error_policy("fail")
    p = b.with_column_model(lambda c: F.upper(c)).build()
    p.execute_stream(f"file://{tmp_path}/out", f"file://{tmp_path}/cp", 1).awaitTermination()
    assert sorted(r["out"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["BAD", "W0", "W2"]
    assert sum(part.count() for part in p.stream_results(2)) == 3
    assert p.execute_async().result().count() == 3
    with pytest.raises(ValueError):
        p.execute_stream("x", "y", on_error="shrug")


def test_knowledge_claims_and_verification(spark):
    chunks = spark.createDataFrame([("c1", "the river floods in spring"), ("c2", "cats sleep all day")], "chunk_id string, text string")
    claims = spark.createDataFrame([("k1", "river floods are common", "atlas"), ("k2", "cats purr", None)], "claim string, text string, source string")
    df = spark.createDataFrame([(1, "river floods"), (2, "nothing here")], "i long, w string")
    b = api.PipelineBuilder(spark).from_source(df, ["w"], ["out"], "i").with_prompt("{w}").with_column_model(lambda p: p)
    got = [r["out"] for r in b.with_knowledge_base(chunks, 1).with_evidence_priming(claims, 1, 0.05, source="source").build().execute().orderBy("i").collect()]
    assert got[0].startswith("the river floods in spring\n\nriver floods\n\n[0.") and got[0].endswith("river floods are common (atlas)") and got[1] == "nothing here"
    v = b.with_grounding(threshold=0.9, action="skip").with_confidence_scoring().with_contradiction_detection().build().execute()
    assert {r["i"]: (r["out"], r["_grounding_score"], r["_contradiction"]) for r in v.collect()} == {1: ("river floods", 1.0, False), 2: ("nothing here", 1.0, False)}
    again = retrieval.search(chunks, spark.createDataFrame([(1, "river cats")], "query_id int, query string"), 2, score=lambda d: F.length("text"))
    assert [r["chunk_id"] for r in again.orderBy("rank").collect()] == ["c1", "c2"]
    hybrid = retrieval.search(chunks, spark.createDataFrame([(1, "river")], "query_id int, query string"), 1, method="hybrid", embed=retrieval.hash_embedder(16))
    assert hybrid.first()["chunk_id"] == "c1"
    up = retrieval.cross_encoder(lambda pairs: [len(t) for _, t in pairs])
    assert retrieval.search(chunks, spark.createDataFrame([(1, "river cats")], "query_id int, query string"), 1, score=up).first()["chunk_id"] == "c1"
    model = lambda p: F.when(p.contains("river"), "stream\nflood")
    q = spark.createDataFrame([(1, "river"), (2, "x")], "query_id int, query string")
    assert sorted(tuple(r) for r in retrieval.with_variants(q, "query_id", "query", retrieval.by_model(model, "rewrite")).collect()) == [(1, "flood"), (1, "river"), (1, "stream"), (2, "x")]


def test_contradiction_flags(spark):
    df = spark.createDataFrame([("k", "1", 1), ("k", "2", 2), ("k", "9", 3), ("k", "x", 4), ("k", None, 5), ("j", "9", 6)], "k string, v string, o int")
    flags = lambda tol: [r["_contradiction"] for r in grounding.flag_contradictions(df, "k", "v", "o", tol).orderBy("o").collect()]
    assert flags(None) == [False, True, True, True, False, False]
    assert flags(2.0) == [False, False, True, True, False, False]
    tied = spark.createDataFrame([("k", "a", 1), ("k", "b", 1)], "k string, v string, o int")
    assert grounding.contradictions(tied, "k", "v", "o").count() == 1


def test_structured_packs(spark):
    assert batches.with_row_ids("a string") == "items array<struct<id:int,a:string>>"
    assert batches.with_row_ids("id int, a string") == "items array<struct<id:int,a:string>>"
    df = spark.createDataFrame([('{"x":1}', 7), ('{"id":3}', 7), ("{}", 7), (None, 7), ("[1]", 7), ("t", 7)], "r string, i int")
    got = [r[0] for r in df.select(batches.result_text(F.col("r"), F.col("i"))).collect()]
    assert got == ['{"id":7,"x":1}', '{"id":3}', '{"id":7}', "", "[1]", "t"]


def test_parsers_of_schemas(spark):
    df = spark.createDataFrame([('{"a": 1, "b": ["x"]}',), ('{"a": "one"}',), ("no",), (None,)], "t string")
    got = parsing.outputs(F.col("t"), ["a", "b"], "schema", schema="a int, b array<string>")
    assert [tuple(r) for r in df.select(*got.values()).collect()] == [("1", '["x"]'), (None, None), (None, None), (None, None)]
    errors = [r[0] for r in df.select(parsing.schema_error(F.col("t"), "a int, b array<string>", ["b"])).collect()]
    assert errors[:3] == [None, "missing b", "no json"]
    with pytest.raises(Exception, match="does not fit"):
        df.select(*parsing.outputs(F.col("t"), ["a"], "strict_schema", schema="a int").values()).collect()
    with pytest.raises(Exception, match="no JSON"):
        df.select(*parsing.outputs(F.col("t"), ["a"], "strict_json").values()).collect()
    with pytest.raises(ValueError):
        parsing.outputs(F.col("t"), ["zz"], "schema", schema="a int")


def test_provider_batches(spark, tmp_path):
    b = builder(spark).with_client(Upper)
    to = provider.LiveProvider(spark, Upper)
    batch = b.build().submit(to, f"file://{tmp_path}/batch")
    assert to.poll(batch.id) == "completed"
    done = b.build().collect(batch, to)
    assert [r["out"] for r in done.orderBy("i").collect()] == [f"SAY W{i}" for i in range(8)]
    assert runs.Registry(spark, f"{batch.folder}/state").state(batch.run) == "completed"
    spec = provider.PRESETS["small"]

    def ask(mode):
        if mode != "json":
            raise RuntimeError(f"{mode} is not supported")
        return "ok"

    assert provider.negotiate(spec, ask) == ("json", "ok")
    with pytest.raises(RuntimeError, match="rejects"):
        provider.negotiate(provider.Spec("m", "p", modes=("tools",)), ask)
    with pytest.raises(ValueError):
        provider.register("small", spec)


def test_quick_health_and_plan(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "i int, w string").write.parquet(f"{tmp_path}/t.parquet")
    path = f"{tmp_path}/t.parquet"
    p = quick.create(spark, path, "say {w}", model=lambda c: c)
    assert sorted(r["output"] for r in p.execute().collect()) == ["say a", "say b"]
    assert quick.create(spark, path, "{w}", ["a", "b"], model=lambda c: c).s.parser == "json"
    assert [quick.pack_for(n) for n in (100, 1_000, 10_000, 10_001)] == [10, 50, 100, 500]
    assert quick.guess_provider("small-v1") == "hosted" and quick.guess_provider("acme/x") == "acme"
    with pytest.raises(ValueError):
        quick.create(spark, path, "{zz}", model=lambda c: c)
    d = quick.DatasetProcessor(spark, path, "{w}", ["o"], model=lambda c: c)
    assert d.run_sample(1).count() == 1 and d.estimate().first()["rows"] == 2 and d.run().count() == 2
    assert health.check(p)["healthy"] and health.readiness(p) == {"ready": True, "missing": []}
    broken = api.PipelineBuilder(spark).from_source(f"{tmp_path}/none.parquet", ["w"], ["o"], "i").with_prompt("{w}").with_client(object).build()
    assert set(health.readiness(broken)["missing"]) == {"source", "prompt", "model"}
    plan = planner.plan(spark, path, "label", lambda _: 'Here: {"template": "Label {w}", "output_columns": ["x", "w"]}', "i")
    assert plan.settings["parser"] == "json" and plan.notes == ["w is replaced", "several outputs: parsed as JSON"]
    assert "template: Label {w}" in plan.preview_yaml() and plan.estimated_cost().first()["rows"] == 2
    assert plan.build(lambda c: F.lit('{"x": 1, "w": 2}')).execute().count() == 2
    for bad in ("no", '{"template": "{zz}", "output_columns": ["x"]}', '{"template": "t", "output_columns": ["x"]}'):
        with pytest.raises(ValueError):
            planner.plan(spark, path, "label", lambda _, b=bad: b)


def test_tools_and_command_line(spark, tmp_path, capsys):
    from rowloom import cli

    spark.createDataFrame([(1, "a"), (2, "b")], "i int, w string").write.parquet(f"{tmp_path}/t.parquet")
    settings = {"dataset": {"path": f"{tmp_path}/t.parquet", "input_columns": ["w"], "output_columns": ["out"], "key": "i"}, "prompt": {"template": "say {w}"}}
    t = tools.Tools(spark, f"file://{tmp_path}/runs", model=lambda c: F.upper(c))
    asked = [{"id": 1, "method": "tools/list"}, {"method": "note"}, {"id": 2, "method": "tools/call", "params": {"name": "run", "arguments": {"settings": settings}}}, {"id": 3, "method": "nothing"}]
    out = io.StringIO()
    t.serve(io.StringIO("\n".join(map(json.dumps, asked))), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["name"] for x in got[0]["result"]["tools"]] == t.names() and "error" in got[2]
    run = json.loads(got[1]["result"]["content"][0]["text"])["run"]
    assert t.status(run)["state"] == "completed" and t.collect(run)["rows"] == 2 and t.estimate(settings)["rows"] == "2"
    (tmp_path / "s.json").write_text(json.dumps({**settings, "output": {"path": f"{tmp_path}/out.parquet"}, "processing": {"log": f"file://{tmp_path}/log", "session": "s"}}))
    path = f"{tmp_path}/s.json"
    cli.main(["validate", path])
    cli.main(["estimate", path])
    cli.main(["process", path, "--client", "rowloom.operators.invoke:EchoClient"])
    cli.main(["resume", path, "--client", "rowloom.operators.invoke:EchoClient", "--session", "s"])
    assert spark.read.parquet(f"{tmp_path}/out.parquet").count() == 2
    cli.main(["list-checkpoints", f"file://{tmp_path}/log"])
    cli.main(["list-providers"])
    cli.main(["inspect", f"{tmp_path}/t.parquet"])
    capsys.readouterr()
    cli.main(["submit", path, "--client", "rowloom.operators.invoke:EchoClient", "--folder", f"file://{tmp_path}/b"])
    batch = capsys.readouterr().out.strip().splitlines()[-1]
    cli.main(["status", batch, "--client", "rowloom.operators.invoke:EchoClient"])
    cli.main(["collect", path, "--client", "rowloom.operators.invoke:EchoClient", "--batch", batch, "--output", f"{tmp_path}/c.parquet"])
    assert spark.read.parquet(f"{tmp_path}/c.parquet").count() == 2
    with pytest.raises(SystemExit):
        cli.main(["process", path])
    assert tools.task(lambda: spark, {**settings, "output": {"path": f"{tmp_path}/task.parquet"}}, model=lambda c: c)() == f"{tmp_path}/task.parquet"


def test_observers():
    cost, metrics, shown = observe.CostObserver(), observe.Metrics(), []
    tell = observe.Dispatcher("r", [cost, metrics, observe.Progress(shown.append), lambda e: 1 / 0])
    tell("start")
    tell("end", cost=Decimal("1.5"))
    assert cost.total == Decimal("1.5") and 'kind="end"} 1' in metrics.text() and "1.5" in metrics.text() and len(shown) == 2


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string").coalesce(1)
    writers.write(df, f"{tmp_path}/a.json", array=True)
    text = "".join(p.read_text() for p in (tmp_path / "a.json").glob("part-*"))
    assert json.loads(text) == [{"i": 1, "s": "a"}, {"i": 2}]
    writers.write_all(df, [f"{tmp_path}/x.csv", f"{tmp_path}/x.parquet"])
    assert spark.read.parquet(f"{tmp_path}/x.parquet").count() == 2
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.txt").write_text("hello")
    (tmp_path / "docs/b.pdf").write_bytes(b"one|two")
    (tmp_path / "docs/c.png").write_bytes(b"scan")
    got = readers.documents(spark, f"{tmp_path}/docs", pdf=lambda b: b.decode().split("|"), ocr=lambda b: [b.decode()]).collect()
    assert sorted((r["source"].rpartition("/")[2], r["page"], r["text"]) for r in got) == [("a.txt", 0, "hello"), ("b.pdf", 0, "one"), ("b.pdf", 1, "two"), ("c.png", 0, "scan")]
    numbered = rows.with_row_index(spark.range(25), "id")
    assert [c.count() for c in readers.chunks(numbered, 10)] == [10, 10, 5]
    assert rows.at(numbered, -1) == {"id": 24} and len(list(rows.to_records(numbered))) == 25
    with pytest.raises(IndexError):
        rows.at(numbered, 99)
    assert store.folders(spark, f"file://{tmp_path}/nowhere") == {}


def test_retry_asks_lost_rows_again(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(6)], "i int, o string")
    asked = []

    def again(lost, n):
        asked.append((n, lost.count()))
        return lost.withColumn("o", F.when(F.col("i") == n, "y"))

    got = quality.retry_failed(df, ["o"], "i", again, 2)
    assert asked == [(1, 3), (2, 2)] and got.where("o is null").count() == 2
    spans = spark.createDataFrame([(0, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:04")], "i int, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert tuple(resume.throughput(spans, "i", "t", "t").first()) == (2, 0.5)
