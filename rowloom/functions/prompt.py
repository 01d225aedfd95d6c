"""Prompt templates compiled to column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def placeholders(template: str) -> list[str]:
    """The names that a template asks for, in order, each once; ``{{x}}`` is the other spelling of ``{x}``."""
    return list(dict.fromkeys(n for _, n, _, _ in string.Formatter().parse(_plain(template)) if n))


def _plain(template: str) -> str:
    if "{%" in template:
        raise ValueError("templates with loops or conditions need a Python stage")
    out = template
    while "{{" in out:
        a = out.index("{{")
        b = out.find("}}", a)
        if b < 0:
            raise ValueError(f"unclosed placeholder in {template!r}")
        out = f"{out[:a]}{{{out[a + 2 : b].strip()}}}{out[b + 2 :]}"
    return out


def as_text(df: DataFrame, name: str, spec: str = "") -> Column:
    """A column as Python would print it: NULL is ``None``, booleans are ``True`` and ``False``."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if spec:
        if spec.endswith("f") and isinstance(kind, (T.FractionalType, T.DecimalType)):
            shown = F.format_string(f"%{spec}", c.cast("double"))
        elif spec.endswith("d") and isinstance(kind, T.IntegralType):
            shown = F.format_string(f"%{spec}", c)
        else:
            raise ValueError(f"format {spec!r} does not fit column {name} of {kind.simpleString()}")
    elif isinstance(kind, T.BooleanType):
        shown = F.when(c, "True").otherwise("False")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        # Spark writes 1.0E7 from ten million on; Python only from 1e16 on
        plain = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,10)").cast("string"), "0+$", ""), r"\.$", ".0")
        shown = F.when((F.abs(c) >= 1e7) & (F.abs(c) < 1e16), plain).otherwise(c.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        shown = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        shown = F.to_json(c)
    else:
        shown = c.cast("string")
    return F.when(c.isNull(), "None").otherwise(shown)


def few_shot(examples: list[tuple[str, str]]) -> str:
    """Numbered examples in front of a prompt."""
    if not examples:
        return ""
    shown = "\n\n".join(f"Example {i}\nInput: {a}\nOutput: {b}" for i, (a, b) in enumerate(examples, 1))
    return f"{shown}\n\n"


def render(df: DataFrame, template: str, examples: list[tuple[str, str]] | None = None, context: str | None = None, evidence: str | None = None) -> Column:
    """The prompt of each row.  A placeholder without a column is an error of the plan, not of a row.

    ``context`` names a column that goes before the prompt, ``evidence`` one that goes after it, unless the
    template places them itself; empty and NULL ones add nothing.
    """
    plain = _plain(template)
    if missing := [n for n in placeholders(template) if n not in df.columns]:
        raise ValueError(f"no columns {missing} for the template")
    parts: list[Column] = []
    if context and context not in placeholders(template):
        parts.append(F.when(F.length(context) > 0, F.concat(F.col(context), F.lit("\n\n"))).otherwise(""))
    if examples:
        parts.append(F.lit(few_shot(examples)))
    for text, name, spec, _ in string.Formatter().parse(plain):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(as_text(df, name, spec or ""))
    if evidence and evidence not in placeholders(template):
        parts.append(F.when(F.length(evidence) > 0, F.concat(F.lit("\n\n"), F.col(evidence))).otherwise(""))
    return F.concat(*parts) if parts else F.lit("")
