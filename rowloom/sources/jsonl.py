"""Requests and replies of provider batches: one JSON object a line, joined by ``row-N``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode(df: DataFrame, index: str, prompt: str, model: str, system: Column | None = None) -> DataFrame:
    """(custom_id, line): a chat request for each row."""
    user = F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content"))
    messages = F.array(user) if system is None else F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), user)
    row = F.concat(F.lit("row-"), F.col(index).cast("string"))
    request = F.struct(row.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), F.struct(F.lit(model).alias("model"), messages.alias("messages")).alias("body"))
    return df.select(row.alias("custom_id"), F.to_json(request).alias("line"))


def decode(lines: DataFrame, line: str = "line") -> DataFrame:
    """(row_index, reply, error) of reply lines in any order; lines without a ``row-N`` id are dropped."""
    c = F.col(line)
    index = F.regexp_extract(F.get_json_object(c, "$.custom_id"), r"^row-(\d+)$", 1)
    rows = lines.select(F.when(index != "", index).cast("long").alias("row_index"), F.get_json_object(c, "$.response.body.choices[0].message.content").alias("reply"), F.get_json_object(c, "$.error.message").alias("error"))
    return rows.where("row_index is not null")
