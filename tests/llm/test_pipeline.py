"""The pipeline stage by stage against plain versions, and the one operator that SQL expresses whole."""

from __future__ import annotations

import glob

import duckdb

import corpus_pipeline
from rowloom.llm import mixing, quality
from rowloom.llm.queries import ORACLE, QUERIES

from plain import plain_pairs

SF = "/root/testdata/sf0.001"


def test_sql_twins(spark):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM read_parquet('{f}')")
    for name, sql in ORACLE.items():
        want = con.sql(sql)
        df = QUERIES[name](spark, SF)
        cols = sorted(want.columns)
        assert cols == sorted(df.columns)
        assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()), name


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, SF)
    assert good.columns == docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    rows = {r["doc_id"]: r for r in good.collect()}
    assert set(rows) == {i for i, s in scores.items() if s >= model.threshold}

    once = stages["exact dedup"](spark, good, SF)
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i]["text"], i)
    ids = {r["doc_id"] for r in once.collect()}
    assert ids == set(first.values()) and once.columns == docs.columns

    far = stages["n-gram jaccard join"](spark, once, SF)
    parent = {i: i for i in ids}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a, b, _, _ in plain_pairs([(i, rows[i]["text"]) for i in ids], 3, 0.5):
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    left = {r["doc_id"] for r in far.collect()}
    assert left == {find(i) for i in ids} and far.columns == docs.columns

    mixed = stages["mixing sources"](spark, far, SF)
    copies = {r["doc_id"]: r["copies"] for r in mixing.balance(far, floor=1.0).collect()}
    times = {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times == copies and set(times) == left and mixed.columns == docs.columns

    bins = stages["best-fit packing"](spark, mixed, SF).collect()
    assert sum(r["used"] for r in bins) == sum(len(rows[i]["text"].split()) * n for i, n in times.items())
    assert sorted((r["used"], r["doc_ids"]) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r["used"], r["doc_ids"]) for r in bins)


def test_stages_edges(spark, tmp_path):
    """NULLs, empties, repeats, clashing names, maps and empty tables through every stage."""
    rows = [(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, "a b c d", "en", None, 7), (3, None, None, "t", 7), (None, "x", "de", "t", 7), (4, "", "en", "s", 7), (5, " ", "en", "u", 7), (6, "word " * 30_000, "en", "u", 7)]
    docs = spark.createDataFrame([(i, t, g, s, k, k, k, k, k, {"m": k}, k) for i, t, g, s, k in rows], "doc_id long, text string, lang string, source string, n_copies int, __score int, __n int, __gone int, c0 int, m map<string,int>, `a.b` int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    last = "best-fit packing"
    want = {"quality classifier": [1, 1, 2, None, 4, 5, 6], "exact dedup": [1, 3, None, 4, 5, 6], "n-gram jaccard join": [1, 1, 3, None, 4, 5, 6], "mixing sources": [1, 1, 2, 3, None, 4, 5, 6]}
    for name, stage in stages.items():
        got, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0 and none.schema == got.schema
        if name == last:
            assert sum(r["used"] for r in got.collect()) == 3 * 4 + 1 + 30_000
            continue
        assert got.columns == docs.columns and got.where("n_copies <> 7 or __score <> 7 or __n <> 7 or c0 <> 7 or m['m'] <> 7 or `a.b` <> 7").count() == 0, name
        ids = [r["doc_id"] for r in got.collect()]
        assert sorted(map(str, set(ids) if name == "mixing sources" else ids)) == sorted(map(str, set(want[name]) if name == "mixing sources" else want[name])), name
