"""Many rows in one call: packing prompts and unpacking replies by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.parsing import json_text
from rowloom.functions.text import _strip

BLOCK = 100
LOST = "null"
_RULES = "Answer every item. Reply with one JSON array of objects with the keys id and result, in the order of the ids, and nothing else."


def pack(df: DataFrame, size: int, position: str, block: int = BLOCK, *columns: str) -> DataFrame:
    """Groups of ``size`` consecutive rows; no group crosses a block of ``block`` rows.

    ``position`` numbers the rows without gaps.  Returns block, slot, first, n and ``items``: the rows' position
    and ``columns`` in order.
    """
    p = F.col(position)
    keyed = df.withColumns({"block": F.floor(p / block), "slot": F.floor((p % block) / size)})
    items = F.array_sort(F.collect_list(F.struct(position, *columns)))
    return keyed.groupBy("block", "slot").agg(items.alias("items")).select("block", "slot", F.col(f"items.{position}")[0].alias("first"), F.size("items").alias("n"), "items")


def mega_prompt(items: Column, prompt: str) -> Column:
    """The text of one call: rules, and a compact JSON array of ids from 1 and inputs."""
    array = F.transform(items, lambda x, i: F.struct((i + 1).alias("id"), x[prompt].alias("input")))
    return F.concat(F.lit(f"{_RULES}\n\n"), F.to_json(array))


def pack_tokens(tokens: Column) -> Column:
    """Tokens of a call over an array of its rows' tokens: 200, 25 a row, and theirs."""
    return F.lit(200) + 25 * F.size(tokens) + F.aggregate(tokens, F.lit(0).cast("long"), lambda s, t: s + t)


def reply_items(reply: Column) -> Column:
    """The (id, result) items of a reply: an array, or the one under ``items``; a sole object is one item.

    An id counts if it is a whole number; without any the place in the array does.  An item without ``result``
    is itself the result.  Text around the outermost brackets is ignored.
    """
    plain = _strip(reply)
    found = F.coalesce(_array(plain), _array(json_text(reply)), _array(F.regexp_extract(reply, r"(?s)(\[.*\])", 1)))
    return F.transform(found, _item)


def _array(doc: Column) -> Column:
    """The items of a JSON text as texts; NULL if it is none."""
    inner = F.when(doc.startswith("{"), F.coalesce(F.get_json_object(doc, "$.items"), doc)).otherwise(doc)
    return F.coalesce(F.from_json(inner, "array<string>"), F.when(inner.startswith("{") & F.json_object_keys(inner).isNotNull(), F.array(inner)))


def _item(x: Column, i: Column) -> Column:
    # the usual item is read in one go; only others are looked at again
    got = F.from_json(x, "id string, result string")
    whole = F.when(got["id"].isNull(), x).otherwise(F.to_json(F.map_filter(F.from_json(x, "map<string,string>"), lambda k, _: k != "id")))
    result = F.coalesce(got["result"], whole)
    return F.struct(F.coalesce(F.when(F.regexp_like(got["id"], F.lit(r"^\d{1,9}$")), got["id"].cast("int")), i + 1).alias("id"), result.alias("result"))


def unpack(calls: DataFrame, reply: str, position: str, shared: tuple[str, ...] = (), also: str | None = None) -> DataFrame:
    """One row for each packed row: position, ``result`` and ``failure``.

    Every row comes back: one whose id is missing from the reply has the result ``null`` and the failure
    ``missing id``, all rows of a reply without items ``null`` and ``unreadable reply``.  Of ids that occur twice
    the first counts; ids beyond the call's rows are dropped.

    Whole numbers in the columns ``shared`` are divided evenly among a call's rows, what is left over to the first of
    them.  ``also`` names a column with the call's own error, which is the failure of all its rows.

    A reply is parsed once, and its items are put in the rows' places by one sort: the work is n log n in the items.
    """
    known = reply_items(F.col(reply))
    # (place, order, result) of each item and each row: after the sort an item stands before the row that it answers
    answers = F.transform("__items", lambda x, i: F.struct(x["id"].alias("place"), i.alias("nth"), x["result"].alias("result"), F.lit(False).alias("own")))
    rows = F.transform("items", lambda x, i: F.struct((i + 1).alias("place"), F.lit(-1).alias("nth"), F.lit(None).cast("string").alias("result"), F.lit(True).alias("own")))
    merged = F.array_sort(F.concat(rows, F.filter(answers, lambda x: (x["place"] >= 1) & (x["place"] <= F.size("items")))))
    # each row comes right before its answers, the first of which counts
    placed = F.filter(F.zip_with(merged, F.slice(merged, 2, F.greatest(F.size(merged) - 1, F.lit(1))), lambda x, y: F.struct(x["own"].alias("own"), (F.coalesce(~y["own"], F.lit(False)) & (F.coalesce(y["place"], F.lit(0)) == x["place"])).alias("hit"), y["result"].alias("result"))), lambda z: z["own"])
    read = calls.withColumn("__items", F.coalesce(known, F.array().cast("array<struct<id:int,result:string>>")))
    kept = [F.col(f"`{c}`") for c in shared] + ([F.col(f"`{also}`").alias("__also")] if also else [F.lit(None).cast("string").alias("__also")])
    flat = read.select(*kept, F.size("items").alias("__rows"), F.size("__items").alias("__n"), F.posexplode(F.arrays_zip(F.col(f"items.{position}").alias("p"), placed.alias("a"))).alias("__at", "__z"))
    hit = F.col("__z.a.hit")
    failure = F.coalesce("__also", F.when(F.col("__n") == 0, "unreadable reply").when(~hit, "missing id"))
    parts = [(F.floor(F.col(f"`{c}`") / F.col("__rows")) + F.when(F.col("__at") < F.pmod(F.col(f"`{c}`"), F.col("__rows")), 1).otherwise(0)).cast("long").alias(c) for c in shared]
    return flat.select(F.col("__z.p").alias(position), F.when(hit, F.col("__z.a.result")).otherwise(LOST).alias("result"), failure.alias("failure"), *parts)


def result_text(result: Column, id_: Column) -> Column:
    """A result as the text of a cell: NULL is empty, and an object gets its ``id`` unless it has one."""
    is_object = F.coalesce(F.json_object_keys(result).isNotNull(), F.lit(False))
    known = F.get_json_object(result, "$.id").isNotNull()
    body = F.substring(F.trim(result), 2, 1 << 30)
    joint = F.when(F.size(F.json_object_keys(result)) > 0, ",").otherwise("")
    return F.when(result.isNull(), "").when(is_object & ~known, F.concat(F.lit('{"id":'), id_.cast("string"), joint, body)).otherwise(result)


def with_row_ids(schema: str) -> str:
    """The DDL of a structured batch reply: ``items`` of the given fields, each with the ``id`` that ties it to its row."""
    from pyspark.sql import types as T

    item = T.StructType.fromDDL(schema)
    if "id" not in item.fieldNames():
        item = T.StructType([T.StructField("id", T.IntegerType(), False), *item.fields])
    return f"items array<{item.simpleString()}>"


def unpack_structured(calls: DataFrame, reply: str, position: str, schema: str) -> DataFrame:
    """``unpack`` for replies of the DDL ``with_row_ids(schema)``: (position, ``result`` struct, ``failure``).

    Items are typed as they are read; no text is parsed twice.
    """
    typed = F.from_json(F.col(reply), with_row_ids(schema))["items"]
    rows_ = calls.withColumn("__items", F.coalesce(typed, F.array())).select("__items", F.posexplode("items").alias("__at", "__row"))
    hit = F.filter("__items", lambda x: x["id"] == F.col("__at") + 1)
    one = F.try_element_at(hit, F.lit(1))
    failure = F.when(F.size("__items") == 0, "unreadable reply").when(F.size(hit) == 0, "missing id")
    return rows_.select(F.col(f"__row.{position}").alias(position), one.alias("result"), failure.alias("failure"))


def split_metrics(calls: DataFrame, latency: str, cost: str) -> DataFrame:
    """Latency and cost of a call shared evenly by its rows."""
    return calls.withColumns({latency: F.col(latency) / F.col("n"), cost: F.col(cost) / F.col("n")})
