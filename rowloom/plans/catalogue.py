"""The queries of the catalogue: one for each operator, over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.api import PipelineBuilder, enrich
from rowloom.catalog import query, table
from rowloom.functions import cost, parsing, prompt, similarity, text
from rowloom.operators import batches, grounding, merge, quality, resume, retrieval, rows, runs
from rowloom.operators.compose import Composer
from rowloom.operators.invoke import BaseClient, EchoClient
from rowloom.sources import jsonl, provider
from rowloom.store import new_path
from rowloom.streaming.runner import windowed

# Pieces of SQL that several queries share.
_WORDS = "list_filter(string_split_regex(coalesce({0}, ''), '\\s+'), lambda x: x <> '')"
_TOKENS = "list_filter(list_transform(string_split_regex({0}, '\\s+'), lambda x: lower(regexp_replace(x, '^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$', '', 'g'))), lambda x: length(x) > 1)"
_BAND = "CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END"


def _words(c: str) -> str:
    return _WORDS.format(c)


def _tokens(c: str) -> str:
    return _TOKENS.format(c)


def _band(reply: F.Column) -> F.Column:
    """A model of the prompt ``... size <n> ...``: the band of the size."""
    n = F.regexp_extract(reply, r"size (\d+)", 1).cast("long")
    return F.when(n < 500, "short").when(n < 5000, "medium").otherwise("long")


# ---------------------------------------------------------------- prompts
@query("enrich_doc_band", f"SELECT doc_id, lang, n_chars, concat({_BAND}, '/', lang) AS band FROM documents")
def enrich_doc_band(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return enrich(docs, "A text in {lang} of size {n_chars}.", ["band"], lambda p: F.concat(F.lit("assistant: "), _band(p), F.lit("/"), F.regexp_extract(p, r"in (\w+)", 1)), "doc_id")


@query("prompt_render_orders", "SELECT o_orderkey, concat('Order ', o_orderkey, ' of ', strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), ' has status ', o_orderstatus, ' and priority ', o_orderpriority) AS prompt FROM orders")
def prompt_render_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", prompt.render(o, "Order {o_orderkey} of {o_orderdate} has status {o_orderstatus} and priority {{ o_orderpriority }}").alias("prompt"))


@query("prompt_fewshot_system", "SELECT conv_id, turn, 'You sort messages.' AS system, concat('Example 1', chr(10), 'Input: hello', chr(10), 'Output: greeting', chr(10), chr(10), 'Message of ', role, ': ', text) AS prompt FROM conversations")
def prompt_fewshot_system(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.lit("You sort messages.").alias("system"), prompt.render(c, "Message of {role}: {text}", [("hello", "greeting")]).alias("prompt"))


# ---------------------------------------------------------------- packing and parsing
@query("pack_mega_prompts", f"""
    WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, CAST(floor(len({_words('text')}) * 13 / 10) AS BIGINT) AS t FROM documents)
    SELECT p // 100 AS block, (p % 100) // 30 AS slot, min(p) AS first, CAST(count(*) AS INTEGER) AS n, list(doc_id ORDER BY p) AS doc_ids, CAST(200 + 25 * count(*) + sum(t) AS BIGINT) AS tokens FROM r GROUP BY ALL
""")
def pack_mega_prompts(spark: SparkSession, d: str) -> DataFrame:
    docs = rows.with_row_index(table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("t")), "doc_id")
    packed = batches.pack(docs, 30, rows.INDEX, batches.BLOCK, "doc_id", "t")
    return packed.select("block", "slot", "first", "n", F.col("items.doc_id").alias("doc_ids"), batches.pack_tokens(F.col("items.t")).alias("tokens"))


def _packed_events(spark: SparkSession, d: str) -> DataFrame:
    e = rows.with_row_index(table(spark, d, "events").select("event_id", "event_type"), "event_id")
    return batches.pack(e, 20, rows.INDEX, batches.BLOCK, "event_type")


@query("unpack_roundtrip", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS _row_index, concat('type ', event_type) AS result, CAST(NULL AS VARCHAR) AS failure FROM events")
def unpack_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    reply = F.to_json(F.reverse(F.transform("items", lambda x, i: F.struct((i + 1).alias("id"), F.concat(F.lit("type "), x["event_type"]).alias("result")))))
    return batches.unpack(_packed_events(spark, d).withColumn("reply", reply), "reply", rows.INDEX)


@query("unpack_partial_failure", """
    WITH r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS p, event_type FROM events), k AS (SELECT *, (p % 100) % 20 + 1 AS id, (p // 20) % 11 = 0 AS broken FROM r)
    SELECT p AS _row_index, CASE WHEN broken OR id % 7 = 0 THEN 'null' ELSE event_type END AS result, CASE WHEN broken THEN 'unreadable reply' WHEN id % 7 = 0 THEN 'missing id' END AS failure FROM k
""")
def unpack_partial_failure(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter(F.transform("items", lambda x, i: F.struct((i + 1).alias("id"), x["event_type"].alias("result"))), lambda x: x["id"] % 7 != 0)
    reply = F.when(F.floor(F.col("first") / 20) % 11 == 0, "I cannot answer.").otherwise(F.concat(F.lit("Here:\n```json\n"), F.to_json(F.struct(kept.alias("items"))), F.lit("\n```")))
    return batches.unpack(_packed_events(spark, d).withColumn("reply", reply), "reply", rows.INDEX)


@query("parse_json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def parse_json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", parsing.json_fields(F.col("props"), ["k"])["k"].alias("k"))


@query("parse_json_fenced", "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN NULL ELSE role END AS who, CASE WHEN turn % 3 = 2 THEN NULL ELSE CAST(turn AS VARCHAR) END AS at FROM conversations")
def parse_json_fenced(spark: SparkSession, d: str) -> DataFrame:
    doc = F.to_json(F.struct(F.col("role").alias("who"), F.col("turn").alias("at")))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), doc, F.lit("\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit('{"result": '), doc, F.lit("}"))).otherwise("```json\n{broken\n```")
    got = parsing.json_fields(reply, ["who", "at"])
    return table(spark, d, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in got.items()])


@query("parse_regex_fields", r"SELECT page_id, CASE WHEN regexp_matches(html, '<html lang=\"[a-z]+\"') THEN regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) END AS lang, CASE WHEN regexp_matches(html, '<!-- [a-z]+ [0-9]+ -->') THEN regexp_extract(html, '<!-- [a-z]+ [0-9]+ -->') END AS note, CASE WHEN regexp_matches(html, 'no such text') THEN '' END AS none FROM pages")
def parse_regex_fields(spark: SparkSession, d: str) -> DataFrame:
    got = parsing.regex_fields(F.col("html"), {"lang": '<html lang="([a-z]+)"', "note": "<!-- [a-z]+ [0-9]+ -->", "none": "no such text"}, ["lang", "note", "none"])
    return table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in got.items()])


@query("parse_raw_prefix", r"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^\s+|\s+$', '', 'g'), '^\s+|\s+$', '', 'g') AS output FROM conversations")
def parse_raw_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", parsing.raw(F.concat(F.lit(" "), F.col("role"), F.lit(": "), F.col("text"))).alias("output"))


@query("parse_schema_struct", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN json_extract(props, '$.k') IS NULL THEN 'missing k' END AS error FROM events")
def parse_schema_struct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", parsing.schema_struct(F.col("props"), "k long")["k"].alias("k"), parsing.schema_error(F.col("props"), "k long", ["k"]).alias("error"))


# ---------------------------------------------------------------- rows
@query("dataset_filter_nullsafe", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IS NOT DISTINCT FROM 'BUILDING' AND c_nationkey IS NOT DISTINCT FROM 7")
def dataset_filter_nullsafe(spark: SparkSession, d: str) -> DataFrame:
    return rows.where_equal(table(spark, d, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": 7, "absent": 1}).select("c_custkey", "c_name")


@query("sort_nulls_last_topn", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS FIRST, p_partkey LIMIT 25")
def sort_nulls_last_topn(spark: SparkSession, d: str) -> DataFrame:
    return rows.sort(table(spark, d, "part"), "p_retailprice", True, "p_partkey").select("p_partkey", "p_retailprice").limit(25)


@query("tail_rows", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey DESC LIMIT 10")
def tail_rows(spark: SparkSession, d: str) -> DataFrame:
    return rows.tail(table(spark, d, "part"), 10, "p_partkey").select("p_partkey", "p_name")


@query("reservoir_sample_det", "SELECT doc_id FROM documents ORDER BY md5(concat('7:', doc_id)), doc_id LIMIT 50")
def reservoir_sample_det(spark: SparkSession, d: str) -> DataFrame:
    return rows.sample(table(spark, d, "documents"), 50, "doc_id", 7).select("doc_id")


@query("select_existing", "SELECT s_suppkey, s_name FROM supplier")
def select_existing(spark: SparkSession, d: str) -> DataFrame:
    return rows.select(table(spark, d, "supplier"), ["s_suppkey", "nothing", "s_name"])


@query("profile_columns", """
    SELECT 'o_orderkey' AS "column", 'bigint' AS type, count(*) AS rows, count(*) - count(o_orderkey) AS nulls FROM orders
    UNION ALL SELECT 'o_orderstatus', 'string', count(*), count(*) - count(o_orderstatus) FROM orders
    UNION ALL SELECT 'o_totalprice', 'double', count(*), count(*) - count(o_totalprice) FROM orders
""")
def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    return rows.profile(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")).drop("distinct")


@query("column_stats", "SELECT count(*) - count(o_shippriority) AS isna, count(o_shippriority) AS notna, count(DISTINCT o_shippriority) AS nunique, CAST(sum(o_shippriority) AS BIGINT) AS sum FROM (SELECT CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 50 END AS o_shippriority FROM orders)")
def column_stats(spark: SparkSession, d: str) -> DataFrame:
    return rows.column_stats(table(spark, d, "orders").select(F.expr("CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 50 END").alias("o_shippriority")), "o_shippriority")


@query("filter_expression", "SELECT p_partkey, p_size FROM part WHERE p_size > 25 AND p_name IS NOT NULL")
def filter_expression(spark: SparkSession, d: str) -> DataFrame:
    return rows.filter_rows(table(spark, d, "part"), "p_size > 25 AND p_name IS NOT NULL").select("p_partkey", "p_size")


@query("filter_callable", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 1000")
def filter_callable(spark: SparkSession, d: str) -> DataFrame:
    return rows.filter_rows(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), lambda r: r["s_acctbal"] > 1000)


@query("map_callable", "SELECT s_suppkey, upper(s_name) AS name FROM supplier")
def map_callable(spark: SparkSession, d: str) -> DataFrame:
    return rows.map_rows(table(spark, d, "supplier").select("s_suppkey", "s_name"), lambda r: {"s_suppkey": r["s_suppkey"], "name": r["s_name"].upper()}, "s_suppkey long, name string")


@query("row_index_span", "SELECT _row_index, p_partkey FROM (SELECT row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS _row_index, p_partkey FROM part) WHERE _row_index >= 100 AND _row_index < 150")
def row_index_span(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.struct("p_retailprice", "p_partkey").alias("key"))
    return rows.span(rows.with_row_index(p, "key"), 100, 150).select("_row_index", "p_partkey")


# ---------------------------------------------------------------- merges
@query("merge_replace", "SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN quality = 1 THEN 'ok' END ELSE d.source END AS source, toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def merge_replace(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "ok").alias("source"), "toxic")
    return merge.merge_results(table(spark, d, "documents").select("doc_id", "source"), got, "doc_id")


@query("merge_update", "SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'ok' END, d.source) AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def merge_update(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "ok").alias("source"))
    return merge.merge_results(table(spark, d, "documents").select("doc_id", "source"), got, "doc_id", "update")


@query("merge_append", "SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
def merge_append(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_results(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "append")


@query("merge_on_last_wins", "SELECT c_custkey, (SELECT arg_max(o_totalprice, o_orderkey) FROM (SELECT CASE WHEN o_custkey % 10 > 0 THEN o_custkey END AS k, o_totalprice, o_orderkey FROM orders) WHERE k IS NOT DISTINCT FROM c.k) AS o_totalprice FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 > 0 THEN c_custkey END AS k FROM customer) c")
def merge_on_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Keys repeat on the right, and every tenth key is NULL on both sides."""
    o = table(spark, d, "orders").select(F.expr("CASE WHEN o_custkey % 10 > 0 THEN o_custkey END").alias("k"), "o_orderkey", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 10 > 0 THEN c_custkey END").alias("k"))
    return merge.lookup(c, o, "k", "o_orderkey").select("c_custkey", "o_totalprice")


@query("concat_union_columns", "SELECT c_custkey, c_name AS name, NULL AS s_suppkey FROM customer UNION ALL SELECT NULL, s_name, s_suppkey FROM supplier")
def concat_union_columns(spark: SparkSession, d: str) -> DataFrame:
    return rows.concat(table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name")), table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name")))


# ---------------------------------------------------------------- resume
@query("resume_anti_join", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return resume.pending(e, e.where("event_type = 'click'"), "event_id").select("event_id")


@query("watermark_contiguous", """
    WITH i AS (SELECT DISTINCT event_id AS i FROM events WHERE NOT (event_type = 'error' AND user_id = 50)), r AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS r FROM i), w AS (SELECT coalesce(max(i) FILTER (i = r), -1) AS watermark, count(*) AS completed FROM r)
    SELECT watermark, completed, completed - watermark - 1 AS beyond FROM w
""")
def watermark_contiguous(spark: SparkSession, d: str) -> DataFrame:
    return resume.watermark(table(spark, d, "events").where("NOT (event_type = 'error' AND user_id = 50)"), "event_id")


_LOGGED = "WITH e AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events)"


@query("response_log_latest", f"{_LOGGED} SELECT i AS row_index, CASE WHEN i % 3 = 0 THEN concat('again ', event_type) ELSE event_type END AS reply FROM e")
def response_log_latest(spark: SparkSession, d: str) -> DataFrame:
    """All rows are answered, every third one again: the later version counts, and another session does not."""
    e = rows.with_row_index(table(spark, d, "events").select("event_id", "event_type"), "event_id")
    log = resume.ResponseLog(spark, new_path(spark, "responses"))

    def add(df: DataFrame, session: str, version: int, reply: F.Column) -> None:
        log.append(df.select(F.lit(session).alias("session"), F.col(rows.INDEX).alias("row_index"), F.lit(version).cast("long").alias("version"), reply.alias("reply")))

    add(e, "mine", 1, F.col("event_type"))
    add(e, "other", 9, F.lit("not mine"))
    add(e.where(F.col(rows.INDEX) % 3 == 0), "mine", 2, F.concat(F.lit("again "), F.col("event_type")))
    return log.read("mine", "session string, row_index long, version long, reply string").select("row_index", "reply")


class _Refused(BaseClient):
    """Answers with the prompt in capitals; for some prompts its key is refused, until it is a good one."""

    def __init__(self, good: bool):
        self.good = good

    def invoke(self, prompt_: str) -> tuple[str, int, int]:
        if not self.good and int(prompt_.rpartition(" ")[2]) % 11 == 3:
            raise RuntimeError("401 unauthorized")
        return prompt_.upper(), 1, 1


def _client(good: bool):
    return lambda: _Refused(good)


@query("crash_resume", "SELECT event_id, upper(concat(event_type, ' ', event_id)) AS out FROM events")
def crash_resume(spark: SparkSession, d: str) -> DataFrame:
    """A run that is refused in its first wave, and a second one that asks only for what the first did not get."""
    e = table(spark, d, "events").select("event_id", "event_type")
    b = PipelineBuilder(spark).from_source(e, ["event_type", "event_id"], ["out"], "event_id").with_prompt("{event_type} {event_id}").with_log(new_path(spark, "responses"), "s", waves=4)
    try:
        b.with_client(_client(False), threads=4).build().execute()
        raise AssertionError("the first run was to be stopped")
    except RuntimeError:
        pass
    return b.with_client(_client(True), threads=4).build().execute().select("event_id", "out")


class _Odd(BaseClient):
    """Answers nothing but blanks to prompts of odd numbers until they are asked again."""

    def __init__(self) -> None:
        self.seen: set[str] = set()

    def invoke(self, prompt_: str) -> tuple[str, int, int]:
        n = int(prompt_.rpartition(" ")[2])
        if n % 5 == 0:
            raise RuntimeError("the model is gone: does not exist")
        return (" " if n % 3 == 0 else f"n{n}"), 2, 1


@query("retry_in_pipeline", "SELECT o_orderkey, CASE WHEN o_orderkey % 15 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('n', o_orderkey) END AS out FROM orders")
def retry_in_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Rows that stay lost are asked three times in all; errors become NULL, blanks stay blank."""
    o = table(spark, d, "orders").select("o_orderkey")
    b = PipelineBuilder(spark).from_source(o, ["o_orderkey"], ["out"], "o_orderkey").with_prompt("order {o_orderkey}").with_client(_Odd, threads=4, retries=0)
    return b.with_error_policy("retry").build().execute()


# ---------------------------------------------------------------- quality and errors
@query("quality_report", """
    WITH x AS (SELECT CASE WHEN l.doc_id IS NULL THEN NULL WHEN quality = 1 THEN 'good' ELSE ' ' END AS a, CASE WHEN toxic = 1 THEN 'toxic' WHEN toxic = 0 THEN '[SKIPPED]' END AS b FROM documents d LEFT JOIN labels l USING (doc_id)),
    s AS (SELECT count(*) AS total_rows, count(*) FILTER ((a IS NOT NULL AND trim(a) <> '') OR b = 'toxic') AS valid_rows, count(*) FILTER (a IS NULL) + count(*) FILTER (b IS NULL) AS null_cells, count(*) FILTER (trim(a) = '') + count(*) FILTER (b = '[SKIPPED]') AS empty_cells FROM x),
    r AS (SELECT *, 100.0 * valid_rows / total_rows AS rate FROM s)
    SELECT total_rows, valid_rows, null_cells, empty_cells, CAST(round(rate, 4) AS DOUBLE) AS success_rate, CASE WHEN rate >= 95 THEN 'excellent' WHEN rate >= 80 THEN 'good' WHEN rate >= 50 THEN 'poor' ELSE 'critical' END AS quality, rate >= 70 AS acceptable,
        concat_ws('; ', CASE WHEN rate < 70 THEN 'low success rate' END, CASE WHEN null_cells > 0.6 * total_rows THEN 'many nulls' END, CASE WHEN empty_cells > 0.2 * total_rows THEN 'many empty' END) AS issues FROM r
""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise(" ").alias("a"), F.when(F.col("toxic") == 1, "toxic").otherwise(quality.SKIPPED).alias("b"))
    return quality.quality_report(table(spark, d, "documents").select("doc_id").join(got, "doc_id", "left"), ["a", "b"])


@query("lost_cells_blanked", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 2 THEN 'null' ELSE event_type END AS out FROM events")
def lost_cells_blanked(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "null").otherwise(F.col("event_type")).alias("out"))
    return quality.blank_lost(e, e.where("event_id % 4 = 0"), "event_id", ["out"])


@query("auto_retry_pass", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type WHEN event_id % 2 = 0 THEN 'second' WHEN event_id % 5 = 0 THEN 'third' END AS out FROM events")
def auto_retry_pass(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("out"))

    def again(lost: DataFrame, n: int) -> DataFrame:
        return lost.withColumn("out", F.when(F.col("event_id") % (2 if n == 1 else 5) == 0, "second" if n == 1 else "third"))

    return quality.retry_failed(e, ["out"], "event_id", again, passes=2)


_MESSAGES = ["Connection timeout", "insufficient_quota: add credits", "429 Too Many Requests", "Invalid API key", "model does not exist", "something else"]


@query("error_classify", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'network' WHEN 1 THEN 'quota' WHEN 2 THEN 'rate_limit' WHEN 3 THEN 'auth' WHEN 4 THEN 'model' WHEN 5 THEN 'other' END AS kind FROM events")
def error_classify(spark: SparkSession, d: str) -> DataFrame:
    message = F.when(F.col("event_id") % 7 < 6, F.try_element_at(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % 7 + 1).cast("int")))
    return table(spark, d, "events").select("event_id", parsing.error_kind(message).alias("kind"))


@query("error_policy_default", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'unknown' ELSE event_type END AS out FROM events")
def error_policy_default(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("out"), F.when(F.col("event_id") % 10 == 0, "bad").alias("error"))
    return quality.apply_policy(e, ["out"], "error", "use_default", "unknown").drop("error")


# ---------------------------------------------------------------- cost
_TOK = f"CAST(floor(len({_words('text')}) * 13 / 10) AS BIGINT)"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("stage"), text.token_estimate(F.col("text")).alias("tokens_in"))
    docs = docs.withColumn("tokens_out", F.floor(F.col("tokens_in") / 2).cast("long"))
    return docs.withColumn("cost", cost.call_cost(F.col("tokens_in"), F.col("tokens_out"), "0.00015", "0.0006"))


_CALLS = f"c AS (SELECT *, CAST((tokens_in * 0.00015 + tokens_out * 0.0006) / 1000 AS DECIMAL(38, 10)) AS cost FROM (SELECT *, tokens_in // 2 AS tokens_out FROM (SELECT doc_id, source AS stage, {_TOK} AS tokens_in FROM documents)))"


@query("cost_rollup", f"WITH {_CALLS} SELECT stage, CAST(sum(cost) AS DECIMAL(38, 10)) AS cost, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, count(*) AS calls FROM c GROUP BY ROLLUP (stage)")
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    return cost.rollup(_calls(spark, d))


@query("cost_estimate_sample", f"""
    WITH s AS (SELECT count(*) AS sampled, sum(t) AS t FROM (SELECT {_TOK} AS t FROM documents ORDER BY doc_id LIMIT 10)), n AS (SELECT count(*) AS rows FROM documents),
    x AS (SELECT rows, sampled, CAST(floor(t * rows / sampled) AS BIGINT) AS tokens_in, CAST(floor(t * rows / sampled / 2) AS BIGINT) AS tokens_out FROM s, n)
    SELECT *, CAST((tokens_in * 0.00015 + tokens_out * 0.0006) / 1000 AS DECIMAL(38, 10)) AS cost FROM x
""")
def cost_estimate_sample(spark: SparkSession, d: str) -> DataFrame:
    return cost.estimate(table(spark, d, "documents"), F.col("text"), "doc_id", "0.00015", "0.0006")


@query("budget_cutoff", f"""
    WITH {_CALLS}, r AS (SELECT doc_id, cost, sum(cost) OVER (ORDER BY doc_id) AS spent FROM c)
    SELECT doc_id, cost, CAST(spent AS DECIMAL(38, 10)) AS spent, CASE WHEN spent > 0.05 THEN 'stop' WHEN spent >= 0.045 THEN 'warn_90' WHEN spent >= 0.0375 THEN 'warn_75' ELSE 'ok' END AS budget_state FROM r
""")
def budget_cutoff(spark: SparkSession, d: str) -> DataFrame:
    return cost.budget(_calls(spark, d), "doc_id", "0.05").select("doc_id", "cost", "spent", "budget_state")


@query("deployment_distribution", "SELECT event_type, count(*) AS calls, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS pct FROM events GROUP BY event_type")
def deployment_distribution(spark: SparkSession, d: str) -> DataFrame:
    return quality.deployments(table(spark, d, "events"), "event_type")


@query("context_window_fit", f"SELECT doc_id, {_TOK} AS tokens, {_TOK} * 10 <= 6553 AS fits, CASE WHEN {_TOK} > 0 THEN CAST(least(500, 6553 // {_TOK}) AS INTEGER) END AS suggested FROM documents")
def context_window_fit(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))
    return docs.select("*", cost.fits_context(F.col("tokens"), 10, "small-v1").alias("fits"), cost.suggested_batch(F.col("tokens"), "small-v1").alias("suggested"))


# ---------------------------------------------------------------- text
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\p{C}', ' ', 'g'), '[®™©℗℠]', '', 'g'), '[^\p{L}\p{N}_\s,\-/.()&]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("clean_text", f"SELECT doc_id, {_CLEAN} AS text FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("text"))


def _last_sql(part: str) -> str:
    return f"CASE WHEN strpos(reverse(h), '{part[::-1]}') = 0 THEN -1 ELSE length(h) - strpos(reverse(h), '{part[::-1]}') - {len(part) - 1} END"


_TRUNCATED = "CASE WHEN length(t) <= 200 THEN t ELSE concat(trim(substr(t, 1, CASE " + " ".join(f"WHEN ({_last_sql(p)}) > 140 THEN {_last_sql(p)}" for p in ("|", ";", " - ", "  ", " ")) + " ELSE 197 END)), '...') END"


@query("truncate_text", f"SELECT doc_id, {_TRUNCATED} AS text FROM (SELECT doc_id, {_CLEAN} AS t, substr({_CLEAN}, 1, 197) AS h FROM documents)")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.truncate(text.clean(F.col("text")), 200).alias("text"))


@query("preprocess_stats", f"""
    WITH x AS (SELECT text, {_TRUNCATED} AS a FROM (SELECT text, {_CLEAN} AS t, substr({_CLEAN}, 1, 197) AS h FROM documents)),
    s AS (SELECT count(*) AS rows_processed, count(*) - count(text) AS null_count, CAST(sum(length(text)) AS BIGINT) AS chars_before, CAST(sum(length(a)) AS BIGINT) AS chars_after, count(*) FILTER (length(text) > 200) AS truncated_count FROM x)
    SELECT *, CAST(round(100.0 * (chars_before - chars_after) / chars_before, 4) AS DOUBLE) AS reduction_pct FROM s
""")
def preprocess_stats(spark: SparkSession, d: str) -> DataFrame:
    return text.preprocess_stats(table(spark, d, "documents"), "text", 200)


#: Written apart from the expressions of the engine.
_HIDDEN = [
    "\\b[0-9A-Za-z_.%+-]+@[0-9A-Za-z_-]+(?:\\.[0-9A-Za-z_-]+)*\\.[A-Za-z][A-Za-z]+\\b",
    "\\b[0-9][0-9][0-9]-[0-9][0-9]-[0-9]{4}\\b",
    "\\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\\b",
    "\\b[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}\\b",
    "\\+[0-9]{1,3}[-.\\s]?\\(?[0-9]{1,4}\\)?[-.\\s]?[0-9]{1,4}[-.\\s]?[0-9]{1,9}",
    "(?i)\\b(?:api_key|api-key|apikey|secret|token)[\\s:=]+['\"]?[0-9a-z_-]{16,}['\"]?\\b",
    "\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b",
]


def _redact_sql(c: str) -> str:
    for rx in _HIDDEN:
        quoted = rx.replace("'", "''")
        c = f"regexp_replace({c}, '{quoted}', '[REDACTED]', 'g')"
    return c


@query("redact_pii", f"SELECT doc_id, {_redact_sql('text')} AS text FROM documents")
def redact_pii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.redact(F.col("text")).alias("text"))


@query("nfc_normalise", "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def nfc_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.nfc(F.col("text")).alias("text"))


# ---------------------------------------------------------------- retrieval
@query("token_frequency", f"""
    WITH t AS (SELECT item_id, {_tokens('text')} AS w FROM benchmark), u AS (SELECT item_id, len(w) AS size, unnest(w) AS term FROM t)
    SELECT item_id, term, count(*) AS n, round(count(*) / any_value(size), 6) AS tf FROM u GROUP BY item_id, term
""")
def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    return similarity.term_frequency(table(spark, d, "benchmark"), "item_id", "text").withColumn("tf", F.round("tf", 6))


def _pairs_sql(source: str, key: str) -> str:
    return f"""
        w AS (SELECT {key}, 1 AS l, unnest({_tokens('a')}) AS t FROM {source} UNION ALL SELECT {key}, 0, unnest({_tokens('b')}) FROM {source}),
        n AS (SELECT {key}, t, sum(l) AS x, sum(1 - l) AS y FROM w GROUP BY ALL),
        q AS (SELECT {key}, sum(x * y) AS dot, sum(x * x * CASE WHEN y > 0 THEN 1 ELSE {(1 + math.log(2)) ** 2} END) AS xx, sum(y * y * CASE WHEN x > 0 THEN 1 ELSE {(1 + math.log(2)) ** 2} END) AS yy FROM n GROUP BY {key}),
        sim AS (SELECT {key}, CASE WHEN q.dot IS NULL THEN 1.0 WHEN xx = 0 OR yy = 0 THEN 0.0 ELSE dot / sqrt(xx * yy) END AS similarity FROM (SELECT DISTINCT {key} FROM {source}) LEFT JOIN q USING ({key}))"""


_QA = "p AS (SELECT u.conv_id * 1000 + u.turn AS id, u.text AS b, v.text AS a FROM conversations u JOIN conversations v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1 AND u.role = 'user' AND v.role = 'assistant')"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    u = c.where("role = 'user'").select("conv_id", F.col("turn").alias("at"), F.col("text").alias("question"))
    v = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("at"), F.col("text").alias("answer"))
    return u.join(v, ["conv_id", "at"]).select((F.col("conv_id") * 1000 + F.col("at")).alias("id"), "question", "answer")


@query("tfidf_pair", f"WITH {_QA}, {_pairs_sql('p', 'id')} SELECT id, round(similarity, 6) AS similarity FROM sim")
def tfidf_pair(spark: SparkSession, d: str) -> DataFrame:
    return similarity.tfidf_pairs(_answers(spark, d), "id", "answer", "question").withColumn("similarity", F.round("similarity", 6))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_Q = f"q AS (SELECT DISTINCT item_id AS query_id, unnest({_tokens('text')}) AS word FROM benchmark)"
_RANKED = "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {1}) AS INTEGER) AS rank FROM {0}) WHERE rank <= {2}"


@query("overlap_search_topk", f"WITH {_Q}, s AS (SELECT query_id, doc_id, count(*) AS score FROM q JOIN documents ON contains(lower(text), word) GROUP BY ALL) {_RANKED.format('s', 'doc_id', 5)}")
def overlap_search_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.overlap(table(spark, d, "documents"), _queries(spark, d), 5)


_BM25 = f"""
    {_Q}, d AS (SELECT doc_id, {_tokens("coalesce(text, '')")} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS average FROM d),
    tf AS (SELECT doc_id, size, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM q) GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
    s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / average))), 6) AS score FROM q JOIN tf USING (word) JOIN df USING (word), st GROUP BY ALL)"""


@query("bm25_topk", f"WITH {_BM25} {_RANKED.format('s', 'doc_id', 10)}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(table(spark, d, "documents"), _queries(spark, d), 10)


@query("dense_cosine_topk", f"""
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT b.vec_id AS query_id, a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b)
    {_RANKED.format('s', 'vec_id', 10)}
""")
def dense_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return retrieval.dense_blocks(e, e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 10)


#: An embedding that SQL can express too: how often each letter occurs.
_LETTER_SQL = "list_transform(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' '), lambda x: (length(lower(coalesce({0}, ''))) - length(replace(lower(coalesce({0}, '')), x, '')))::DOUBLE)"


def _letters(text_: F.Column) -> F.Column:
    """One look at each text; lower case is Spark's, as in the SQL."""
    return F.pandas_udf(retrieval.letter_counts, "array<double>")(F.lower(F.coalesce(text_, F.lit(""))))


@query("rrf_hybrid", f"""
    WITH {_BM25}, l AS ({_RANKED.format('s', 'doc_id', 20)}),
    e AS (SELECT doc_id, {_LETTER_SQL.format('text')} AS e FROM documents), qe AS (SELECT item_id AS query_id, {_LETTER_SQL.format('text')} AS e FROM benchmark),
    v0 AS (SELECT query_id, doc_id, round(CASE WHEN list_sum(e.e) = 0 OR list_sum(qe.e) = 0 THEN 0 ELSE list_cosine_similarity(e.e, qe.e) END, 6) AS score FROM e, qe), v AS ({_RANKED.format('v0', 'doc_id', 20)}),
    f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM l UNION ALL SELECT query_id, doc_id, rank FROM v) GROUP BY ALL)
    {_RANKED.format('f', 'doc_id', 10)}
""")
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    docs, q = table(spark, d, "documents"), _queries(spark, d)
    vectors = retrieval.dense_blocks(docs.select("doc_id", _letters(F.col("text")).alias("e")), q.select("query_id", _letters(F.col("query")).alias("e")), 20, "doc_id", "e", "query_id", "e")
    return retrieval.hybrid(retrieval.bm25(docs, q, 20), vectors, 10, "query_id", "doc_id")


@query("kb_context_augment", f"""
    WITH {_BM25}, h AS ({_RANKED.format('s', 'doc_id', 3)})
    SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS _kb_context, count(*) AS _evidence_count FROM h JOIN documents USING (doc_id) WHERE score >= 0.1 GROUP BY query_id
""")
def kb_context_augment(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return retrieval.context(retrieval.bm25(docs, _queries(spark, d), 3), docs, "query_id", "doc_id", "text", 0.1)


@query("chunk_fixed", f"""
    WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents),
    u AS (SELECT doc_id, unnest(s) AS s, unnest(range(1, len(s) + 1)) AS i FROM t), n AS (SELECT *, len({_words('s')}) AS n FROM u),
    c AS (SELECT doc_id, i, 0 AS chunk, n AS held FROM n WHERE i = 1 UNION ALL SELECT n.doc_id, n.i, CASE WHEN held + n.n > 128 THEN chunk + 1 ELSE chunk END, CASE WHEN held + n.n > 128 THEN n.n ELSE held + n.n END FROM c JOIN n ON n.doc_id = c.doc_id AND n.i = c.i + 1)
    SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, string_agg(s, ' ' ORDER BY i) AS text, CAST(sum(n) AS INTEGER) AS n_tokens FROM c JOIN n USING (doc_id, i) GROUP BY doc_id, chunk
""")
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fixed_chunks(table(spark, d, "documents"), "doc_id", "text", 128)


_SENTENCES = "list_filter(string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1)), lambda x: x <> '')"


@query("chunk_semantic", f"""
    WITH RECURSIVE t AS (SELECT doc_id, {_SENTENCES} AS s FROM documents),
    u AS (SELECT doc_id, unnest(s) AS s, unnest(range(1, len(s) + 1)) AS i FROM t), e AS (SELECT *, len({_words('s')}) AS n, {_LETTER_SQL.format('s')} AS e FROM u),
    m AS (SELECT b.doc_id, b.i, round(list_inner_product(b.e, a.e) / (sqrt(list_inner_product(b.e, b.e)) * sqrt(list_inner_product(a.e, a.e)) + 1e-10), 9) AS sim FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
    p AS (SELECT doc_id, quantile_cont(sim, 0.25) AS cut FROM m GROUP BY doc_id),
    n AS (SELECT e.doc_id, e.i, e.n, e.s, coalesce(sim < cut, false) AS far FROM e LEFT JOIN m USING (doc_id, i) LEFT JOIN p USING (doc_id)),
    c AS (SELECT doc_id, i, 0 AS chunk, n AS held FROM n WHERE i = 1 UNION ALL SELECT n.doc_id, n.i, CASE WHEN far OR held + n.n > 128 THEN chunk + 1 ELSE chunk END, CASE WHEN far OR held + n.n > 128 THEN n.n ELSE held + n.n END FROM c JOIN n ON n.doc_id = c.doc_id AND n.i = c.i + 1)
    SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, string_agg(s, ' ' ORDER BY i) AS text FROM c JOIN n USING (doc_id, i) GROUP BY doc_id, chunk
""")
def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.semantic_chunks(table(spark, d, "documents"), "doc_id", "text", 128, embed=retrieval.letter_embedding)


# ---------------------------------------------------------------- grounding
_GROUND = f"{_QA}, {_pairs_sql('p', 'id')}, g AS (SELECT id, round(similarity, 6) AS similarity, CASE WHEN round(similarity, 6) >= 0.05 THEN round(similarity, 6) ELSE 0.0 END AS _grounding_score, round(similarity, 6) >= 0.05 AS grounded FROM sim)"


@query("grounding_score", f"WITH {_GROUND} SELECT * FROM g")
def grounding_score(spark: SparkSession, d: str) -> DataFrame:
    return grounding.grounding(_answers(spark, d), "id", "answer", ["question"], 0.05)


@query("confidence_modes", f"WITH {_GROUND} SELECT id, round(least(1.0, _grounding_score * 0.7 + (id % 7) / 5 * 0.3 * (CASE WHEN id % 7 <= 5 THEN 1 ELSE 5.0 / (id % 7) END)), 6) AS standard, round(1 / (1 + exp(-10 * (_grounding_score - 0.3))), 6) AS sigmoid, round(least(1.0, _grounding_score), 6) AS grounding_only FROM g")
def confidence_modes(spark: SparkSession, d: str) -> DataFrame:
    g = grounding.grounding(_answers(spark, d), "id", "answer", ["question"], 0.05)
    s = F.col("_grounding_score")
    return g.select("id", F.round(grounding.confidence(s, F.col("id") % 7), 6).alias("standard"), F.round(grounding.confidence(s, mode="sigmoid"), 6).alias("sigmoid"), F.round(grounding.confidence(s, mode="grounding_only"), 6).alias("grounding_only"))


@query("contradiction_pairs", """
    WITH o AS (SELECT concat(o_custkey, '/', o_orderpriority) AS k, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS v, min(o_orderkey) AS o FROM orders GROUP BY ALL)
    SELECT a.k AS k, a.o AS first, b.o AS second, a.v AS value_a, b.v AS value_b FROM o a JOIN o b ON a.k = b.k AND (a.o, a.v) < (b.o, b.v) AND abs(CAST(a.v AS DOUBLE) - CAST(b.v AS DOUBLE)) > 100000
""")
def contradiction_pairs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.concat_ws("/", "o_custkey", "o_orderpriority").alias("k"), F.floor("o_totalprice").alias("v"), "o_orderkey")
    return grounding.contradictions(o, "k", "v", "o_orderkey", 100000)


@query("contradiction_symmetric", """
    WITH o AS (SELECT o_custkey AS k, o_orderpriority AS v, min(o_orderkey) AS o FROM orders GROUP BY ALL), p AS (SELECT a.o AS first, b.o AS second FROM o a JOIN o b ON a.k = b.k AND (a.o, a.v) < (b.o, b.v) AND a.v <> b.v)
    SELECT first, second FROM p UNION SELECT second, first FROM p
""")
def contradiction_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return grounding.symmetric(grounding.contradictions(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey"))


@query("evidence_support", "SELECT user_id, count(*) AS support_count FROM (SELECT DISTINCT user_id, event_type, props FROM events) GROUP BY user_id")
def evidence_support(spark: SparkSession, d: str) -> DataFrame:
    return grounding.support(table(spark, d, "events"), "user_id", ["event_type", "props"])


@query("first_claims", "SELECT user_id, min(event_id) AS event_id, count(*) AS stored FROM events GROUP BY user_id")
def first_claims(spark: SparkSession, d: str) -> DataFrame:
    return grounding.first_claims(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


# ---------------------------------------------------------------- composition, batches, streams, models
@query("composer_two_step", f"SELECT doc_id, {_BAND} AS band, concat({_BAND}, '-', lang) AS label FROM documents")
def composer_two_step(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    c = Composer()
    c.add_column("label", lambda x: x.withColumn("label", prompt.render(x, "{band}-{lang}")), ["band"])
    c.add_column("band", lambda x: x.withColumn("band", _band(prompt.render(x, "size {n_chars}"))))
    return c.execute(docs).select("doc_id", "band", "label")


@query("provider_batch_jsonl", "SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_index, text AS reply, CAST(NULL AS VARCHAR) AS error FROM conversations")
def provider_batch_jsonl(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("__key", F.struct("conv_id", "turn"))
    requests = jsonl.encode(rows.with_row_index(c, "__key"), rows.INDEX, "text", "small-v1")
    content = F.get_json_object("line", "$.body.messages[0].content")
    body = F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"))
    return jsonl.decode(requests.select(F.to_json(F.struct("custom_id", F.struct(body.alias("body")).alias("response"))).alias("line")))


@query("stream_window_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS rows FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return windowed(table(spark, d, "events"), "ts", "1 day", "1 hour", ["event_type"])


@query("stream_foreachbatch_equals_batch", "SELECT event_id, concat('type ', event_type) AS out FROM events")
def stream_foreachbatch_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """The table as files that come in four at a time, each batch through the pipeline."""
    base = new_path(spark, "stream")
    table(spark, d, "events").select("event_id", "event_type").repartition(8, "event_id").write.parquet(f"{base}/in")
    p = PipelineBuilder(spark).from_source(f"{base}/in", ["event_type"], ["out"], "event_id").with_prompt("type {event_type}").with_column_model(lambda c: c).build()
    p.execute_stream(f"{base}/out", f"{base}/checkpoint", files_per_batch=4).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "out")


@query("provider_batch_roundtrip", r"SELECT conv_id, turn, regexp_replace(concat('Turn of ', role, ': ', text), '\s+$', '') AS out FROM conversations")
def provider_batch_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Handed in as request lines, answered by a provider, collected by row."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", (F.col("conv_id") * 100_000 + F.col("turn")).alias("key"))
    p = PipelineBuilder(spark).from_source(c, ["role", "text"], ["out"], "key").with_prompt("Turn of {role}: {text}").with_client(EchoClient).build()
    to = provider.LiveProvider(spark, EchoClient)
    return p.collect(p.submit(to, new_path(spark, "batch")), to).select("conv_id", "turn", F.col("out"))


@query("remote_model_ledger", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, concat('Document ', doc_id, ' in ', lang) AS reply, CAST(4 AS BIGINT) AS tokens_in, CAST(NULL AS VARCHAR) AS error FROM documents")
def remote_model_ledger(spark: SparkSession, d: str) -> DataFrame:
    """What the log of a run with a remote model holds."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    log = new_path(spark, "responses")
    b = PipelineBuilder(spark).from_source(docs, ["doc_id", "lang"], ["out"], "doc_id").with_prompt("Document {doc_id} in {lang}").with_client(EchoClient)
    b.with_log(log, "s").build().execute()
    return resume.ResponseLog(spark, log).read("s", "session string, row_index long, version long, reply string, tokens_in long, error string").select("row_index", "reply", "tokens_in", "error")


@query("batch_metrics_split", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS _row_index, CAST(CASE WHEN (row_number() OVER (ORDER BY event_id) - 1) % 100 % 30 < 7 THEN (CASE WHEN (row_number() OVER (ORDER BY event_id) - 1) % 100 >= 90 THEN 10 ELSE 4 END) ELSE (CASE WHEN (row_number() OVER (ORDER BY event_id) - 1) % 100 >= 90 THEN 9 ELSE 3 END) END AS BIGINT) AS tokens FROM events")
def batch_metrics_split(spark: SparkSession, d: str) -> DataFrame:
    """97 tokens a call, shared by its rows; every hundred rows are calls of 30, 30, 30 and 10."""
    e = rows.with_row_index(table(spark, d, "events").select("event_id", "event_type"), "event_id")
    calls = batches.pack(e, 30, rows.INDEX, batches.BLOCK, "event_type").withColumns({"tokens": F.lit(97).cast("long"), "reply": F.lit("[]")})
    return batches.unpack(calls, "reply", rows.INDEX, shared=("tokens",)).select(rows.INDEX, "tokens")


@query("unpack_structured", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS _row_index, CASE WHEN event_id % 4 > 0 THEN event_type END AS kind, CASE WHEN event_id % 4 > 0 THEN event_id END AS nr, CASE WHEN event_id % 4 = 0 THEN 'missing id' END AS failure FROM events")
def unpack_structured(spark: SparkSession, d: str) -> DataFrame:
    e = rows.with_row_index(table(spark, d, "events").select("event_id", "event_type"), "event_id")
    calls = batches.pack(e, 20, rows.INDEX, batches.BLOCK, "event_id", "event_type")
    kept = F.filter(F.transform("items", lambda x, i: F.struct((i + 1).alias("id"), x["event_type"].alias("kind"), x["event_id"].alias("nr"))), lambda x: x["nr"] % 4 > 0)
    got = batches.unpack_structured(calls.withColumn("reply", F.to_json(F.struct(kept.alias("items")))), "reply", rows.INDEX, "kind string, nr long")
    return got.select(rows.INDEX, "result.kind", "result.nr", "failure")


@query("pending_embeddings", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS size FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_embeddings(spark: SparkSession, d: str) -> DataFrame:
    got = retrieval.embed_pending(table(spark, d, "documents"), table(spark, d, "labels"), lambda c: F.array(F.length(c).cast("double")), "doc_id")
    return got.select("doc_id", F.col("embedding")[0].alias("size"))


@query("hydrate_ids", "SELECT doc_id, lang, source FROM labels JOIN documents USING (doc_id) WHERE quality = 1")
def hydrate_ids(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return grounding.hydrate(asked, table(spark, d, "documents"), "id", "doc_id").select("doc_id", "lang", "source")


@query("chunk_upsert", "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN lang ELSE concat('q', quality) END AS lang FROM documents LEFT JOIN labels l USING (doc_id)")
def chunk_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Each new chunk comes twice; the second counts."""
    new = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi")
    twice = new.select("doc_id", F.lit("old").alias("lang"), F.lit(0).alias("at")).union(new.select("doc_id", F.concat(F.lit("q"), "quality"), F.lit(1)))
    docs = table(spark, d, "documents").select("doc_id", "lang", F.lit(0).alias("at"))
    return retrieval.upsert(docs, twice, "doc_id", "at").select("doc_id", "lang")


# ---------------------------------------------------------------- runs
@query("run_state_ledger", """
    WITH e AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN 'submitted' WHEN 1 THEN 'running' WHEN 2 THEN 'paused' ELSE 'completed' END AS state FROM events),
    l AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY event_id), 'created') AS b FROM e),
    k AS (SELECT *, b = state OR (b, state) IN (('created', 'submitted'), ('created', 'running'), ('submitted', 'running'), ('running', 'paused'), ('running', 'completed'), ('paused', 'running')) AS ok FROM l)
    SELECT user_id, arg_max(state, event_id) AS state, count(*) AS changes, count(*) FILTER (NOT ok) AS illegal FROM k GROUP BY user_id
""")
def run_state_ledger(spark: SparkSession, d: str) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, ["submitted", "running", "paused", "completed"])), (F.col("event_id") % 4 + 1).cast("int"))
    return runs.run_states(table(spark, d, "events").select("user_id", "event_id", state.alias("state")), "user_id", "state", "event_id")


@query("event_metrics", "SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS total, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY user_id")
def event_metrics(spark: SparkSession, d: str) -> DataFrame:
    return runs.metrics(table(spark, d, "events"), "event_type", ["user_id"], "value")


@query("deployment_labels", "SELECT event_type, coalesce(['first', 'second'][row_number() OVER (ORDER BY min(event_id))], event_type) AS label FROM events GROUP BY event_type")
def deployment_labels(spark: SparkSession, d: str) -> DataFrame:
    return runs.labels(table(spark, d, "events"), "event_type", "event_id", ["first", "second"])


@query("routed_calls", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'east' WHEN 1 THEN 'west' ELSE 'south' END AS deployment FROM orders")
def routed_calls(spark: SparkSession, d: str) -> DataFrame:
    return runs.assign(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "round-robin", {"east": {}, "west": {}, "south": {}})


@query("progress_throughput", "WITH e AS (SELECT ts, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) SELECT count(*) AS processed, round(count(*) / (epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6), 6) AS rows_per_second FROM e")
def progress_throughput(spark: SparkSession, d: str) -> DataFrame:
    return resume.throughput(rows.with_row_index(table(spark, d, "events").select("event_id", "ts"), "event_id"), rows.INDEX, "ts", "ts")


@query("rag_scores", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS faithfulness, CASE WHEN turn % 3 = 1 THEN NULL ELSE 0.5::DOUBLE END AS relevancy, CASE WHEN turn % 3 = 2 THEN 0.0::DOUBLE END AS context_precision, CASE WHEN turn % 3 = 0 THEN 0.75 WHEN turn % 3 = 1 THEN 0.25 ELSE 0.25 END::DOUBLE AS overall FROM conversations")
def rag_scores(spark: SparkSession, d: str) -> DataFrame:
    reply = F.when(F.col("turn") % 3 == 0, '```json\n{"faithfulness": 7, "relevancy": 0.5}\n```').when(F.col("turn") % 3 == 1, '{"faithfulness": 0.25, "relevancy": "none"}').otherwise('{"faithfulness": 0.25, "relevancy": 0.5, "context_precision": -2}')
    got = retrieval.rag_scores(reply)
    return table(spark, d, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in got.items()], retrieval.rag_overall(got).alias("overall"))


@query("verification_skip", f"WITH {_GROUND} SELECT g.id, CASE WHEN grounded THEN p.a END AS answer, _grounding_score FROM g JOIN p USING (id)")
def verification_skip(spark: SparkSession, d: str) -> DataFrame:
    return grounding.verify(_answers(spark, d), "id", ["answer"], ["question"], 0.05, "skip").select("id", "answer", "_grounding_score")


@query("contradiction_flags", """
    SELECT o_orderkey, EXISTS (SELECT 1 FROM orders e WHERE e.o_custkey = o.o_custkey AND e.o_orderkey < o.o_orderkey AND abs(e.o_totalprice - o.o_totalprice) > 100000) AS _contradiction FROM orders o
""")
def contradiction_flags(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return grounding.flag_contradictions(o, "o_custkey", "o_totalprice", "o_orderkey", 100000).select("o_orderkey", "_contradiction")


_CLAIMS_SQL = f"""
    c0 AS (SELECT conv_id * 1000 + turn AS claim, text AS ct FROM conversations WHERE role = 'assistant'), q0 AS (SELECT item_id AS query_id, text AS qt FROM benchmark),
    cw AS (SELECT claim, word, count(*) AS y FROM (SELECT claim, unnest({_tokens('ct')}) AS word FROM c0) GROUP BY ALL), qw AS (SELECT query_id, word, count(*) AS x FROM (SELECT query_id, unnest({_tokens('qt')}) AS word FROM q0) GROUP BY ALL),
    cc AS (SELECT claim, sum(y * y) AS cc FROM cw GROUP BY claim), qq AS (SELECT query_id, sum(x * x) AS qq FROM qw GROUP BY query_id),
    m AS (SELECT query_id, claim, sum(x * y) AS dot, sum(x * x) AS xs, sum(y * y) AS ys FROM qw JOIN cw USING (word) GROUP BY ALL),
    cs AS (SELECT query_id, claim, round(dot / sqrt((xs + (qq - xs) * {(1 + math.log(2)) ** 2}) * (ys + (cc - ys) * {(1 + math.log(2)) ** 2})), 6) AS score FROM m JOIN cc USING (claim) JOIN qq USING (query_id))"""


def _claim_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("claim"), "text", F.concat(F.lit("conv "), "conv_id").alias("source"))


@query("claim_search", f"WITH {_CLAIMS_SQL} {_RANKED.format('cs', 'claim', 5)}")
def claim_search(spark: SparkSession, d: str) -> DataFrame:
    return grounding.search_claims(_claim_table(spark, d), _queries(spark, d), 5)


@query("evidence_priming", f"""
    WITH {_CLAIMS_SQL}, h AS ({_RANKED.format('cs', 'claim', 3)})
    SELECT query_id, string_agg(concat('[', printf('%.2f', round(score, 2)), '] ', ct, ' (conv ', claim // 1000, ')'), chr(10) ORDER BY rank) AS _evidence_context, count(*) AS _evidence_count FROM h JOIN c0 USING (claim) WHERE score >= 0.02 GROUP BY query_id
""")
def evidence_priming(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.evidence(_claim_table(spark, d), _queries(spark, d), 3, 0.02, source="source")


@query("claim_store", "SELECT user_id::VARCHAR AS claim, arg_min(event_type, event_id) AS text, count(DISTINCT (event_type, props)) AS support_count FROM events GROUP BY user_id")
def claim_store(spark: SparkSession, d: str) -> DataFrame:
    """Said in two lots; the first text of each claim stays."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("claim"), F.col("event_type").alias("text"), F.lit("events").alias("source"), F.col("event_type").alias("asserted_by"), F.col("props").alias("decision"), F.lit("p").alias("phase"), F.col("event_id").alias("seq"))
    kept = grounding.ClaimStore(spark, new_path(spark, "claims"))
    kept.add(e.where("seq % 2 = 1"))
    kept.add(e.where("seq % 2 = 0"))
    return kept.claims().select("claim", "text", "support_count")


@query("kb_search_variants", f"""
    WITH w AS (SELECT item_id, string_split_regex(trim(text), '\\s+') AS w FROM benchmark),
    v AS (SELECT DISTINCT query_id, query FROM (SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL SELECT item_id, array_to_string(w[1:CAST(ceil(len(w) / 2) AS BIGINT)], ' ') FROM w WHERE len(w) > 3 UNION ALL SELECT item_id, array_to_string(w[CAST(ceil(len(w) / 2) AS BIGINT) + 1:len(w)], ' ') FROM w WHERE len(w) > 3)),
    q AS (SELECT DISTINCT query_id, query, unnest({_tokens('query')}) AS word FROM v), d AS (SELECT doc_id, {_tokens("coalesce(text, '')")} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS average FROM d),
    tf AS (SELECT doc_id, size, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM q) GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
    s0 AS (SELECT query_id, query, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / average))), 6) AS score FROM q JOIN tf USING (word) JOIN df USING (word), st GROUP BY ALL),
    s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, doc_id) AS r FROM s0) WHERE r <= 15), s AS (SELECT query_id, doc_id, max(score) AS score FROM s1 GROUP BY ALL)
    {_RANKED.format('s', 'doc_id', 5)}
""")
def kb_search_variants(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.search(table(spark, d, "documents"), _queries(spark, d), 5, "doc_id", variants=retrieval.TRANSFORMS["multi_query"])


@query("rerank_hits", f"""
    WITH {_BM25}, h AS ({_RANKED.format('s', 'doc_id', 10)}), n AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY n_chars, rank, doc_id) AS r FROM h JOIN documents USING (doc_id))
    SELECT query_id, doc_id, score, CAST(r AS INTEGER) AS rank FROM n WHERE r <= 5
""")
def rerank_hits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hits = retrieval.bm25(docs, _queries(spark, d), 10).join(docs.select("doc_id", "n_chars"), "doc_id")
    return retrieval.rerank(hits, -F.col("n_chars"), 5, "query_id", "doc_id").select("query_id", "doc_id", "score", "rank")
