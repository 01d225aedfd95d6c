"""Replies to typed columns: raw, JSON, schema and regular expressions.  Nothing here fails a row: it gives NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.text import _strip, strip_role

_FENCED_JSON = r"(?is)```json\s*(.*?)```"
_FENCED = r"(?s)```[a-zA-Z]*\s*(.*?)```"


def raw(reply: Column) -> Column:
    """The reply without role prefix and outer white space."""
    return strip_role(reply)


def json_text(reply: Column) -> Column:
    """The JSON document of a reply: all of it, else the first ```json block, else the first block; NULL if none parses."""

    def valid(c: Column) -> Column:
        return F.when(F.try_parse_json(c).isNotNull(), c)

    block = F.when(F.regexp_like(reply, F.lit(_FENCED_JSON)), F.regexp_extract(reply, _FENCED_JSON, 1)).otherwise(F.when(F.regexp_like(reply, F.lit(_FENCED)), F.regexp_extract(reply, _FENCED, 1)))
    return F.coalesce(valid(_strip(reply)), valid(_strip(block)))


def json_fields(reply: Column, names: list[str]) -> dict[str, Column]:
    """Output columns of a JSON reply as text.

    One output: its own key, else ``output``, else the reply itself if it is no JSON or has neither.  Several: each
    by its key, at the top or under ``result`` or ``items[0].result``.  A fence that holds no JSON gives NULLs.
    """
    doc = json_text(reply)
    fenced = F.regexp_like(reply, F.lit(_FENCED))

    def get(path: str) -> Column:
        return F.get_json_object(doc, path)

    if len(names) == 1:
        n = names[0]
        keys = F.json_object_keys(doc)
        first = F.element_at(F.map_values(F.from_json(doc, "map<string,string>")), 1)
        found = F.coalesce(get(f"$.{n}"), get("$.output"), first)
        scalar = F.when(keys.isNull(), doc)
        return {n: F.when(doc.isNotNull(), F.coalesce(found, scalar)).when(~fenced, raw(reply))}
    return {n: F.coalesce(get(f"$.{n}"), get(f"$.result.{n}"), get(f"$.items[0].result.{n}")) for n in names}


def schema_struct(reply: Column, schema: str) -> Column:
    """The reply as a struct of the DDL ``schema``; NULL if it is no JSON."""
    return F.from_json(json_text(reply), schema)


def schema_error(reply: Column, schema: str, required: list[str] | None = None) -> Column:
    """Why a reply does not fit: ``no json``, the first required field that is missing, the first that is there but not
    of its type, or NULL."""
    from pyspark.sql import types as T

    got, doc = schema_struct(reply, schema), json_text(reply)
    error = F.lit(None).cast("string")
    for name in reversed(T.StructType.fromDDL(schema).fieldNames()):
        there = F.get_json_object(doc, f"$.{name}")
        error = F.when(there.isNotNull() & got[name].isNull(), F.lit(f"wrong type {name}")).otherwise(error)
    for name in reversed(required or []):
        error = F.when(F.get_json_object(doc, f"$.{name}").isNull(), F.lit(f"missing {name}")).otherwise(error)
    return F.when(doc.isNull(), "no json").otherwise(error)


def schema_fields(reply: Column, names: list[str], schema: str, strict: bool = False) -> dict[str, Column]:
    """Output columns from a struct of the schema, as text.  A reply that does not fit gives NULLs; ``strict`` ends the
    job with what is wrong."""
    got, error = schema_struct(reply, schema), schema_error(reply, schema)
    bad = F.raise_error(F.concat(F.lit("reply does not fit: "), error)).cast("string") if strict else F.lit(None).cast("string")
    kinds = _kinds(schema)
    if missing := [n for n in names if n not in kinds]:
        raise ValueError(f"the schema has no {missing}")

    def shown(n: str) -> Column:
        return F.to_json(got[n]) if kinds[n].startswith(("array", "struct", "map")) else got[n].cast("string")

    return {n: F.when(reply.isNull(), F.lit(None).cast("string")).when(error.isNotNull(), bad).otherwise(shown(n)) for n in names}


def _kinds(schema: str) -> dict[str, str]:
    from pyspark.sql import types as T

    return {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(schema).fields}


def strict_json(reply: Column) -> Column:
    """The JSON document of a reply; one without ends the job."""
    doc = json_text(reply)
    return F.when(reply.isNull() | doc.isNotNull(), doc).otherwise(F.raise_error(F.concat(F.lit("no JSON in: "), F.substring(reply, 1, 80))).cast("string"))


def regex_field(reply: Column, pattern: str) -> Column:
    """Group 1 of the first match, or the whole match of a pattern without groups; NULL without a match."""
    import re

    group = 1 if re.compile(pattern.replace("\\p{L}", "a")).groups else 0
    return F.when(F.regexp_like(reply, F.lit(pattern)), F.regexp_extract(reply, pattern, group))


def regex_fields(reply: Column, patterns: dict[str, str], names: list[str]) -> dict[str, Column]:
    if missing := [n for n in names if n not in patterns]:
        raise ValueError(f"no patterns for {missing}")
    return {n: regex_field(reply, patterns[n]) for n in names}


def outputs(reply: Column, names: list[str], parser: str = "raw", patterns: dict[str, str] | None = None, schema: str | None = None) -> dict[str, Column]:
    """The output columns by the parser's name."""
    if parser == "raw":
        return {n: raw(reply) for n in names}
    if parser in ("json", "strict_json"):
        return json_fields(strict_json(reply) if parser == "strict_json" else reply, names)
    if parser == "regex":
        return regex_fields(reply, patterns or {}, names)
    if parser in ("schema", "strict_schema"):
        if not schema:
            raise ValueError("the schema parser needs a schema")
        return schema_fields(reply, names, schema, parser == "strict_schema")
    if parser in PARSERS:
        return PARSERS[parser](reply, names)
    raise ValueError(f"parser must be raw, json, strict_json, regex, schema, strict_schema or one of {sorted(PARSERS)}, not {parser!r}")


#: Parsers of your own, by name: (reply, output names) to columns.
PARSERS: dict[str, Callable[[Column, list[str]], dict[str, Column]]] = {}


#: Parts of a message, in the order in which they decide, and the error that they stand for.
ERROR_KINDS: list[tuple[str, tuple[str, ...]]] = [
    ("network", ("network", "timeout", "connection", "service unavailable", "503", "502")),
    ("quota", ("quota exceeded", "insufficient_quota", "billing", "credits exhausted", "limit exceeded")),
    ("rate_limit", ("rate", "429")),
    ("auth", ("invalid api key", "401", "403", "unauthorized")),
    ("model", ("decommissioned", "not found", "does not exist", "invalid model")),
]
RETRYABLE = ("network", "rate_limit")


def error_kind(message: Column) -> Column:
    """network, quota, rate_limit, auth, model or other; NULL without a message."""
    low = F.lower(message)
    kind = F.when(message.isNull(), F.lit(None).cast("string"))
    for name, parts in ERROR_KINDS:
        hit = F.lit(False)
        for part in parts:
            hit = hit | low.contains(part)
        kind = kind.when(hit, name)
    return kind.otherwise("other")
