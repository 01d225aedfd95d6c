"""Tables by suffix, documents by folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePath
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SUFFIXES = tuple(f".{x}" for x in "txt md html htm xml json tsv csv".split())
IMAGE_SUFFIXES = tuple(f".{x}" for x in "png jpg jpeg tif tiff bmp".split())
#: Spark's name of a format, by suffix.
FORMATS = {"csv": "csv", "parquet": "parquet", "pq": "parquet", "json": "json", "jsonl": "json", "ndjson": "json"}


def format_of(path: str) -> str:
    """The format of a file or of a folder of files, by the suffix; Parquet if there is none."""
    suffix = PurePath(path).suffix.lower().lstrip(".")
    if suffix and suffix not in FORMATS:
        raise ValueError(f"cannot stream {path}")
    return FORMATS.get(suffix, "parquet")


def read(spark: SparkSession, source: Any, columns: list[str] | None = None, sep: str = ",", encoding: str = "UTF-8", sheet: str | int = 0, infer: bool = False) -> DataFrame:
    """A DataFrame from a path (.csv, .parquet, .pq, .json, .jsonl, .ndjson, .xlsx, .xls), rows, pandas or itself.

    CSV cells stay text unless ``infer``; ``columns`` are pushed to the scan.
    """
    if isinstance(source, DataFrame):
        df = source
    elif isinstance(source, list):
        df = spark.createDataFrame(source)
    elif isinstance(source, dict):
        df = spark.createDataFrame(list(zip(*source.values())), list(source))
    elif hasattr(source, "to_arrow"):
        df = spark.createDataFrame(source.to_arrow())
    elif hasattr(source, "to_dict") and hasattr(source, "columns"):
        df = spark.createDataFrame(source)
    else:
        path = str(source)
        kind = PurePath(path).suffix.lower().lstrip(".")
        if kind in ("xlsx", "xls"):
            df = spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))  # needs an Excel engine beside pandas
        elif kind == "csv":
            df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=True, escape='"', inferSchema=infer)
        elif not kind or kind in FORMATS:  # a folder without a suffix holds Parquet
            df = spark.read.format(FORMATS.get(kind, "parquet")).option("multiLine", kind == "json").load(path)
        else:
            raise ValueError(f"unknown kind of file: {path}")
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns]) if columns else df


def chunks(df: DataFrame, size: int = 10_000, index: str = "_row_index") -> Iterator[DataFrame]:
    """A numbered table in pieces of ``size`` rows, each a filter on the index."""
    top = df.agg(F.max(index)).first()[0]
    for a in range(0, 0 if top is None else top + 1, size):
        yield df.where(F.col(index).between(a, a + size - 1))


Extract = Callable[[bytes], list[str]]
"""The texts of a file's pages."""


def pdf_pages(data: bytes) -> list[str]:
    """By pypdf, if it is installed."""
    import io

    from pypdf import PdfReader

    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]


def tesseract(data: bytes) -> list[str]:
    """By pytesseract, if it is installed."""
    import io

    import pytesseract
    from PIL import Image

    return [pytesseract.image_to_string(Image.open(io.BytesIO(data)))]


#: Readers of images by name; any function from bytes to pages will do.
OCR: dict[str, Extract] = {"tesseract": tesseract}


def documents(spark: SparkSession, path: str, suffixes: tuple[str, ...] = TEXT_SUFFIXES, pdf: Extract | None = None, ocr: Extract | str | None = None) -> DataFrame:
    """(source, page, text) of the files under a folder; pages without text are left out.

    Text files are one page.  PDF files and images are read where ``pdf`` and ``ocr`` are given.
    """
    files = spark.read.option("recursiveFileLookup", True)
    plain = files.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.lit(0).alias("page"), F.col("value").alias("text"))
    found = plain.where(_ends(suffixes))
    for read_, kinds in ((pdf, (".pdf",)), (OCR[ocr] if isinstance(ocr, str) else ocr, IMAGE_SUFFIXES)):
        if read_ is not None:
            binary = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("source"), "content").where(_ends(kinds))
            found = found.union(binary.mapInPandas(_paged(read_), "source string, page int, text string"))
    return found.where(F.trim("text") != "")


def _ends(suffixes: tuple[str, ...]):
    return F.regexp_like(F.lower("source"), F.lit(r"(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))


def _paged(read_: Extract) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(s, i, t) for s, c in zip(frame["source"], frame["content"]) for i, t in enumerate(read_(bytes(c)))], columns=["source", "page", "text"])

    return run


def infer_types(df: DataFrame) -> dict[str, str]:
    """int, float, bool or str for each column, by the first row's text."""
    first = df.first()

    def kind(v: Any) -> str:
        if v is None:
            return "str"
        for cast, name in ((int, "int"), (float, "float")):
            try:
                cast(str(v))
                return name
            except ValueError:
                pass
        return "bool" if str(v).lower() in ("true", "false") else "str"

    return {c: kind(first[c]) if first else "str" for c in df.columns}


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of the result."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
