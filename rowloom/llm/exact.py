"""Exact deduplication (operator 9): group by a 128-bit content hash, compare bytes, keep the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNT, HASH = "n_copies", "content_hash"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """One row for each distinct text, that of the smallest id; with ``counts`` also ``n_copies`` and ``content_hash``.

    The grouping key is (md5(text), text): rows meet by hash and are told apart by their bytes, so two texts
    whose hashes collide are both kept.  Copies collapse before the shuffle (partial aggregation), so a text
    with millions of copies sends one row a task.

    NULL texts have no content to compare: each such row is kept, with a NULL hash and ``n_copies`` 1.  Empty
    texts are content like any other.  NULL ids sort last, so they are kept only if no copy has an id.  Of rows
    that tie on the id, the one smallest in the remaining columns stays, maps and variants compared by how they print.
    The row that stays is whole: no column is taken from another copy.  Columns of any name and type pass through, but
    with ``counts`` those named ``n_copies`` or ``content_hash`` are replaced.  An empty table gives an empty table.
    """
    kept = [c for c in docs.columns if not counts or c not in (COUNT, HASH)]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    key, text = (f"c{kept.index(c)}" for c in (id_col, text_col))
    rest = [F.col(f.name) if _orderable(f.dataType) else F.col(f.name).cast("string") for f in plain.schema.fields if f.name not in (key, text)]
    order = F.struct(F.col(key).isNull(), F.col(key), *rest)
    row = F.struct(*[c for c in plain.columns if c != text], F.lit(0).alias("pad"))
    grouped = plain.where(F.col(text).isNotNull()).groupBy(F.md5(text).alias("hash"), F.col(text)).agg(F.min_by(row, order).alias("row"), F.count("*").alias("n"))
    one = grouped.select(*[F.col(c if c == text else f"row.{c}").alias(c) for c in plain.columns], "n", "hash")
    blank = plain.where(F.col(text).isNull()).select("*", F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("hash"))
    both = one.unionByName(blank)
    return both.toDF(*kept, COUNT, HASH) if counts else both.drop("n", "hash").toDF(*kept)


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))
