"""Results to files."""

from __future__ import annotations

from pathlib import PurePath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom import store


def write(df: DataFrame, path: str, mode: str = "overwrite", array: bool = False) -> DataFrame:
    """Write by suffix (.csv, .parquet, .pq, .json, .jsonl, .ndjson, .xlsx; else CSV) and return the DataFrame.

    Spark's committer publishes a folder at once or not at all.  JSON is one object a line; ``array`` makes each file one
    array instead.  An Excel sheet is one file, made on the driver, of a million rows at most.
    """
    suffix = PurePath(path).suffix.lower()
    out = df.write.mode(mode)
    if suffix in (".parquet", ".pq"):
        out.parquet(path)
    elif suffix == ".json" and array:
        lines(df).write.mode(mode).text(path)
    elif suffix in (".json", ".jsonl", ".ndjson"):
        out.json(path)
    elif suffix in (".xlsx", ".xls"):
        few = df.limit(SHEET_ROWS + 1).toPandas()
        if len(few) > SHEET_ROWS:
            raise ValueError(f"a sheet holds {SHEET_ROWS} rows at most")
        few.to_excel(path, index=False)  # needs an Excel engine beside pandas
    else:
        out.option("header", True).option("escape", '"').csv(path)
    return df


SHEET_ROWS = 1_000_000


def lines(df: DataFrame) -> DataFrame:
    """The lines of one JSON array a partition: a bracket, the rows with commas between, a bracket."""

    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
    return rows.mapInPandas(_array_lines, "value string")


def _array_lines(frames):
    first = True
    for frame in frames:
        if len(frame):
            yield pd.DataFrame({"value": [("[" if first and i == 0 else ",") + x for i, x in enumerate(frame["value"])]})
            first = False
    yield pd.DataFrame({"value": ["[]" if first else "]"]})


def write_all(df: DataFrame, paths: list[str], mode: str = "overwrite") -> DataFrame:
    """The same rows to several files: the plan runs once, into the shared folder, and is copied from there."""
    once = store.written(df)
    for p in paths:
        write(once, p, mode)
    return once
