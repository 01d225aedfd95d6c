"""Edges of the operators on small tables."""

from __future__ import annotations

from datetime import UTC, datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom import api
from rowloom.functions import cost, parsing, prompt, similarity, text
from rowloom.operators import batches, compose, grounding, invoke, merge, quality, resume, retrieval, rows
from rowloom.sources import config, readers, writers
from rowloom.streaming import runner


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "t string").select(build(F.col("t")).alias("o")).first()["o"]


def test_render_types_and_nulls(spark):
    df = spark.createDataFrame([(1, 2.5, True, None), (2, 1e7, False, "x")], "i int, d double, b boolean, s string")
    got = [r[0] for r in df.orderBy("i").select(prompt.render(df, "{i}|{d}|{b}|{s}|{{ i }}|{d:.2f}")).collect()]
    assert got == ["1|2.5|True|None|1|2.50", "2|10000000.0|False|x|2|10000000.00"]
    with pytest.raises(ValueError):
        prompt.render(df, "{absent}")


def test_cleaning(spark):
    assert one(spark, "  A\tb® “c”\n", text.clean) == "A b c"
    assert one(spark, "a | " + "b" * 20, lambda c: text.truncate(c, 20)) == "a | " + "b" * 13 + "..."
    assert one(spark, "abcdefghijklmno|pqrstu", lambda c: text.truncate(c, 20)) == "abcdefghijklmno..."
    assert one(spark, "mail a.b@c.org or 123-45-6789", text.redact) == "mail [REDACTED] or [REDACTED]"
    assert one(spark, "é", text.nfc) == "é"
    assert one(spark, " User: hi ", text.strip_role) == "hi"
    assert one(spark, "(Hello) x été!", text.tokenize) == ["hello"]
    assert one(spark, "One. Two! Three", text.sentences) == ["One.", "Two!", "Three"]
    assert one(spark, None, text.token_estimate) == 0


@pytest.mark.parametrize(("reply", "want"), [('{"a": "x"}', "x"), ('```json\n{"output": 3}\n```', "3"), ('{"z": "first"}', "first"), ("42", "42"), ("plain", "plain"), ("```json\n{bad\n```", None), (None, None)])
def test_json_one_output(spark, reply, want):
    assert one(spark, reply, lambda c: parsing.json_fields(c, ["a"])["a"]) == want


def test_json_nested_and_regex(spark):
    got = parsing.json_fields(F.col("t"), ["a", "b"])
    row = spark.createDataFrame([('{"items":[{"id":1,"result":{"a":"p","b":2}}]}',)], "t string").select(*[c.alias(n) for n, c in got.items()]).first()
    assert tuple(row) == ("p", "2")
    assert one(spark, "k=;", lambda c: parsing.regex_field(c, "k=(.*);")) == ""
    assert one(spark, "none", lambda c: parsing.regex_field(c, "k=(.*);")) is None
    with pytest.raises(ValueError):
        parsing.regex_fields(F.col("t"), {}, ["a"])
    assert one(spark, "x", lambda c: parsing.schema_error(c, "a int", ["a"])) == "no json"


def test_unpack_aligns_and_reports(spark):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "i long, v string")
    calls = batches.pack(df, 3, "i", 100, "v")
    replies = {0: '[{"id": 3, "result": "c"}, {"id": 1, "result": {"x": 1}}, {"id": 9, "result": "z"}]', 3: "oops"}
    calls = calls.withColumn("reply", F.when(F.col("first") == 0, replies[0]).otherwise(replies[3]))
    got = [tuple(r) for r in batches.unpack(calls, "reply", "i").orderBy("i").collect()]
    assert got == [(0, '{"x":1}', None), (1, "null", "missing id"), (2, "c", None), (3, "null", "unreadable reply"), (4, "null", "unreadable reply")]


def test_packs_stay_in_blocks(spark):
    df = spark.range(100).select(F.col("id").alias("i"), F.lit("x").alias("v"))
    assert sorted(r["n"] for r in batches.pack(df, 30, "i", 100, "v").collect()) == [10, 30, 30, 30]


def test_row_index_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(rows, "BUCKET_ROWS", 50)
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k")).repartition(5)
    assert [r["_row_index"] for r in rows.with_row_index(df, "k").orderBy("k").collect()] == list(range(500))


def test_row_operators(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i int, s string")
    assert [r["i"] for r in rows.sort(df, "s").collect()] == [1, 3, 2]
    assert [r["i"] for r in rows.sort(df, "s", True).collect()] == [2, 3, 1]
    assert [r["i"] for r in rows.where_equal(df, {"s": None, "absent": 4}).collect()] == [2]
    assert rows.filter_rows(df, lambda r: r["i"] > 1).count() == 2
    assert rows.map_rows(df, lambda r: {"j": r["i"] * 2}, "j int").agg(F.sum("j")).first()[0] == 12
    assert rows.sample(df, 2, "i", 1).collect() == rows.sample(df, 2, "i", 1).collect()
    with pytest.raises(ValueError):
        rows.require(df, ["zz"])


def test_merges(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "i int, s string")
    res = spark.createDataFrame([(1, None, 5), (2, "z", 6)], "i int, s string, n int")
    pick = lambda how: [tuple(r) for r in merge.merge_results(df, res, "i", how).orderBy("i").collect()]
    assert pick("replace") == [(1, None, 5), (2, "z", 6), (3, "c", None)]
    assert pick("update") == [(1, "a", 5), (2, "z", 6), (3, "c", None)]
    with pytest.raises(ValueError):
        pick("append")
    left = spark.createDataFrame([(None,), (1,)], "k int")
    right = spark.createDataFrame([(None, "n", 1), (1, "old", 1), (1, "new", 2)], "k int, v string, o int")
    assert {r["k"]: r["v"] for r in merge.lookup(left, right, "k", "o").collect()} == {None: "n", 1: "new"}


def test_quality_and_policy(spark):
    df = spark.createDataFrame([("x",), (None,), (" ",), ("[SKIPPED]",), ("y",)], "o string")
    got = quality.quality_report(df, ["o"]).first()
    assert (got["valid_rows"], got["null_cells"], got["empty_cells"], got["success_rate"], got["quality"], got["acceptable"]) == (2, 1, 2, 40.0, "critical", False)
    with pytest.raises(RuntimeError):
        quality.guard(df.where("o is null"), ["o"], errors=1)
    bad = spark.createDataFrame([("x", None), ("y", "boom")], "o string, e string")
    assert [r["o"] for r in quality.apply_policy(bad, ["o"], "e", "skip").collect()] == ["x", None]
    with pytest.raises(Exception, match="boom"):
        quality.apply_policy(bad, ["o"], "e", "fail").collect()


def test_cost_and_budget(spark):
    calls = spark.createDataFrame([(i, Decimal("0.01")) for i in range(10)], f"i long, cost {cost.MONEY}")
    states = [r["budget_state"] for r in cost.budget(calls, "i", "0.05").orderBy("i").collect()]
    assert states == ["ok", "ok", "ok", "warn_75", "warn_90", "stop", "stop", "stop", "stop", "stop"]
    assert cost.running_cost(calls, "i", span=3).orderBy("i").collect()[-1]["spent"] == Decimal("0.1")
    assert cost.can_afford(Decimal(1), Decimal(1), Decimal(2))
    assert cost.context_limit("unheard-of") == cost.FALLBACK_CONTEXT


def test_watermark(spark):
    for done, want in (([0, 1, 2, 4], (2, 4, 1)), ([1, 2], (-1, 2, 2)), ([], (-1, 0, 0)), ([0, 0, 1], (1, 2, 0))):
        df = spark.createDataFrame([(i,) for i in done], "i long")
        assert tuple(resume.watermark(df, "i").first()) == want


def test_similarity(spark):
    df = spark.createDataFrame([(1, "cat dog", "cat dog"), (2, "cat", "dog"), (3, "", ""), (4, "cat", ""), (5, None, "cat")], "i int, a string, b string")
    got = {r["i"]: round(r["similarity"], 6) for r in similarity.tfidf_pairs(df, "i", "a", "b").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.0, 5: 0.0}


@pytest.mark.parametrize(("a", "b", "tolerance", "want"), [("1", "1", None, False), ("1", "2", None, True), ("1", "2", 1.0, False), ("1", "2.5", 1.0, True), ("x", "y", 5.0, True)])
def test_contradicts(spark, a, b, tolerance, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(grounding.contradicts(F.col("a"), F.col("b"), tolerance)).first()[0] is want


def test_confidence(spark):
    df = spark.createDataFrame([(0.5, 2)], "g double, s int")
    assert df.select(grounding.confidence(F.col("g"), F.col("s"))).first()[0] == pytest.approx(0.47)


def test_chunks(spark):
    df = spark.createDataFrame([(1, "One two. Three four. Five six seven eight."), (2, ""), (3, None)], "i int, t string")
    got = [(r["i"], r["chunk"], r["text"], r["n_tokens"]) for r in retrieval.fixed_chunks(df, "i", "t", 4).orderBy("i", "chunk").collect()]
    assert got == [(1, 0, "One two. Three four.", 4), (1, 1, "Five six seven eight.", 4)]
    assert retrieval.semantic_chunks(df, "i", "t", 4).where("i = 1").count() >= 2


def test_composer_order():
    c = compose.Composer()
    c.add_column("b", lambda x: x, ["a"]).add_column("a", lambda x: x)
    assert c.order() == ["a", "b"]
    with pytest.raises(ValueError):
        compose.Composer().add_column("a", lambda x: x, ["b"]).add_column("b", lambda x: x, ["a"]).order()
    with pytest.raises(ValueError):
        compose.Composer().add_column("a", lambda x: x, ["zz"]).order()


def test_retry_after():
    now = datetime(2024, 1, 1, tzinfo=UTC)
    assert invoke.retry_after({"Retry-After": "7"}) == 7
    assert invoke.retry_after({"retry-after-ms": "1500", "retry-after": "9"}) == 1.5
    assert invoke.retry_after({"x-ratelimit-reset-requests": "6m0s"}) == 300
    assert invoke.retry_after({"x-ratelimit-reset-tokens": "1m2.5s"}) == 62.5
    assert invoke.retry_after({"some-ratelimit-reset": "2024-01-01T00:00:30Z"}, now) == 30
    assert invoke.retry_after({"retry-after": "soon"}) is None


def test_remote_calls(spark):
    class Flaky:
        def __init__(self):
            self.calls = 0

        def invoke(self, text):
            self.calls += 1
            if "bad" in text:
                raise RuntimeError("invalid api key")
            if self.calls % 2:
                raise RuntimeError("timeout")
            return text.upper(), 1, 1

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "i int, p string").coalesce(1)
    got = {r["i"]: (r["reply"], r["error_kind"]) for r in invoke.invoke(df, "p", Flaky, ["i"], threads=1, pause=0.0).collect()}
    assert got == {1: ("A", None), 2: (None, "auth"), 3: (None, None)}


def test_pipeline_with_log_resumes(spark, tmp_path):
    df = spark.createDataFrame([(i, f"w{i}") for i in range(6)], "i long, w string")
    b = api.PipelineBuilder(spark).from_source(df, ["w"], ["out"], "i").with_prompt("say {w}").with_column_model(lambda p: F.upper(p)).with_log(f"file://{tmp_path}/log", waves=2)
    want = [f"SAY W{i}" for i in range(6)]
    assert [r["out"] for r in b.build().execute().orderBy("i").collect()] == want
    files = sorted(p.name for p in (tmp_path / "log").rglob("*.parquet"))
    again = b.with_column_model(lambda p: F.lit("never asked")).build().execute()
    assert [r["out"] for r in again.orderBy("i").collect()] == want
    assert set(files) <= {p.name for p in (tmp_path / "log").rglob("*.parquet")}


def test_packed_pipeline(spark):
    df = spark.createDataFrame([(i, f"w{i}") for i in range(7)], "i long, w string")

    def model(p):
        items = F.from_json(F.regexp_extract(p, r"(\[\{.*\])", 1), "array<struct<id:int,input:string>>")
        return F.to_json(F.transform(items, lambda x: F.struct(x["id"], F.upper(x["input"]).alias("result"))))

    p = api.PipelineBuilder(spark).from_source(df, ["w"], ["out"], "i").with_prompt("{w}").with_batch_size(3).with_column_model(model).build()
    assert [r["out"] for r in p.execute().orderBy("i").collect()] == [f"W{i}" for i in range(7)]
    assert p.estimate().first()["rows"] == 7
    assert p.sample(2).count() == 2


def test_files_and_config(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, 'a "q", b\nc'), (2, None)], "i int, s string")
    for suffix in ("csv", "parquet", "json"):
        path = f"{tmp_path}/t.{suffix}"
        writers.write(df, path)
        back = spark.read.json(path) if suffix == "json" else readers.read(spark, path)
        assert back.count() == 2
    assert readers.read(spark, [{"a": 1}], ["a", "zz"]).columns == ["a"]
    with pytest.raises(ValueError):
        readers.read(spark, "x.unknown")
    (tmp_path / "c.yaml").write_text("data:\n  source: {type: csv, path: '${FOLDER}/x.csv'}\n")
    with pytest.raises(ValueError):
        config.load(f"{tmp_path}/c.yaml")
    monkeypatch.setenv("FOLDER", "/d")
    assert config.load(f"{tmp_path}/c.yaml")["dataset"]["path"] == "/d/x.csv"


def test_stream_equals_batch(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(src)
    stream = runner.stream_files(spark, src, "id long", files_per_batch=1)
    runner.run_batches(stream, lambda b: b.withColumn("x", F.col("id") * 2), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").agg(F.sum("x")).first()[0] == 870
    assert runner.totals(spark, f"file://{tmp_path}/out").count() == 3


def test_routes_labels_and_judges(spark, tmp_path):
    from rowloom.operators import runs

    got = {r["d"]: r["n"] for r in spark.range(4000).groupBy(runs.route(F.col("id"), {"a": 3, "b": 1, "c": 0}).alias("d")).agg(F.count("*").alias("n")).collect()}
    assert set(got) == {"a", "b"} and 2.5 < got["a"] / got["b"] < 3.5
    with pytest.raises(ValueError):
        runs.route(F.col("id"), {})
    q = spark.createDataFrame([(1, "x"), (2, "y")], "query_id int, query string")
    many = retrieval.with_variants(q, "query_id", "query", lambda c: F.when(c == "x", F.array(F.lit("x"), F.lit("z"))))
    assert sorted(tuple(r) for r in many.collect()) == [(1, "x"), (1, "z"), (2, "y")]
    got = retrieval.rag_scores(F.col("t"))
    row = spark.createDataFrame([('```json\n{"faithfulness": 2, "relevancy": 0.5, "context_precision": "high"}\n```',)], "t string").select(*[c.alias(n) for n, c in got.items()]).first()
    assert tuple(row) == (1.0, 0.5, None)
    (tmp_path / "session=a").mkdir()
    assert runs.sessions(spark, str(tmp_path)) == ["a"] and runs.clean(spark, str(tmp_path), -1) == ["a"] and runs.sessions(spark, str(tmp_path)) == []


def test_every_vector_is_a_query(spark):
    from rowloom.plans.catalogue import dense_cosine_topk

    sf = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    m = np.array(e["embedding"].tolist(), float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = {}
    for r in dense_cosine_topk(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(e["vec_id"])
    ids = e["vec_id"].to_numpy()
    for i, s in zip(ids.tolist(), np.round(m @ m.T, 6)):
        best = np.lexsort((ids, -s))[:10]
        assert [x[:2] for x in sorted(got[i])] == list(zip(range(1, 11), ids[best].tolist()))
    # ties, NULL, empty, zero and shorter vectors, in blocks smaller than k
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.5]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0]), (8, [1.0, 0.0]), (9, [0.3, 0.7])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    for k in (1, 3, 20):
        assert sorted(map(tuple, retrieval.dense_blocks(v, q, k, block=2).collect())) == sorted(map(tuple, retrieval.dense(v, q, k).collect()))
    assert retrieval.dense_blocks(v.limit(0), q, 3).count() == 0


def test_upsert_of_a_union_whose_parts_adaptive_plans_read_apart(spark, tmp_path):
    """The size of the tables matters: one side of each join is small enough to be broadcast only once it is read."""
    from rowloom.plans.catalogue import chunk_upsert

    sf = "/root/testdata/check_s"
    chunk_upsert(spark, sf).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.where("lang = 'old'").isEmpty()


@pytest.mark.parametrize("search", [retrieval.bm25, retrieval.overlap])
def test_searches_join_nothing(spark, search):
    """Words meet chunks in the tasks that read these: no join, so no row for each word or pair."""
    chunks = spark.createDataFrame([(i, f"red Blue-{i} the, (green) É{i}É") for i in range(40)] + [(40, None), (41, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "the red"), (1, "blue-7 the"), (2, "nothing"), (3, None)], "query_id long, query string")
    found = search(chunks, queries, 3)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in found.orderBy("rank").collect()] == [(1, 7, 1), (1, 0, 2), (1, 1, 3)]


def test_searches_take_several_passes_and_any_ids(spark, monkeypatch):
    from rowloom.operators import ranking

    chunks = spark.createDataFrame([(f"c{i}", "same text " + "word " * (i % 3)) for i in range(30)], "doc_id string, text string").repartition(3)
    queries = spark.createDataFrame([((q, "v"), "word text") for q in range(5)], "query_id struct<a:long,b:string>, query string")

    def run():
        return [sorted((r["query_id"]["a"], r["doc_id"], r["rank"], r["score"]) for r in f(chunks, queries, 4).collect()) for f in (retrieval.bm25, retrieval.overlap)]

    whole = run()
    assert [x[1] for x in whole[0] if x[0] == 0] == ["c11", "c14", "c17", "c2"]
    monkeypatch.setattr(ranking, "PASS_WORDS", 4)
    monkeypatch.setattr(ranking, "BLOCK_ROWS", 2)
    assert run() == whole
    assert retrieval.bm25(chunks, queries.limit(0), 4).count() == 0


def test_claims_join_nothing(spark):
    claims = spark.createDataFrame([(i, "a fox and the dog " * (i + 1)) for i in range(9)] + [(9, None)], "claim long, text string")
    found = grounding.search_claims(claims, spark.createDataFrame([(1, "the fox"), (2, "cat")], "query_id long, query string"), 2)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["query_id"], r["claim"], r["rank"]) for r in found.collect()] == [(1, 0, 1), (1, 1, 2)]


def test_semantic_chunks_take_few_texts_at_a_time(spark):
    """Arrow batches are cut before their sentences become strings; texts beyond a cut come out like those before it."""
    n = 2 * getattr(retrieval, "SEMANTIC_ROWS", 64) + 3
    df = spark.range(0, n, 1, 1).select(F.concat(F.lit("k"), "id").alias("k"), F.when(F.col("id") % 5 > 0, "A cat. A dog. Zzz!").alias("text"))
    got = retrieval.semantic_chunks(df, "k", "text", 2)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["n"] for r in got.groupBy("k").agg(F.count("*").alias("n"), F.max("chunk")).collect()) == [got.where("k = 'k1'").count()] * (n - len(range(0, n, 5)))
