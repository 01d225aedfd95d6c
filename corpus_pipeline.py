"""The corpus pipeline: raw documents to packed training sequences, in five stages.

Each stage is (name, function); the function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the
last return the columns of documents, whatever their names: columns of the stages' own never meet them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.llm import exact, jaccard, mixing, packing, quality
from rowloom.llm.common import Table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry ranker rejects go.

    NULL texts go: there is nothing to judge.  Empty and very long texts are scored whole like any other; equal scores
    and repeated rows are kept or rejected together.  If no preference can be learnt (no labels, one side only, an empty
    table) every row with a text stays.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the smallest id stays, whole.

    NULL texts all stay; empty texts are equal to each other.  A NULL id is the greatest; of rows that tie on the id the
    smallest in the other columns stays.  An empty table stays empty.
    """
    return exact.exact_dedup(docs, counts=False)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays.

    NULL, empty and blank texts and rows without an id stay.  Texts are compared whole.  Rows that repeat the smallest
    id of their group all stay.  An empty table stays empty.
    """
    return jaccard.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources and languages reach their target shares by repetition: with a floor of 1 every row stays at least once.

    NULL sources and languages are groups of their own.  NULL and blank texts bear on no share and get their group's
    rate.  Rows that repeat an id are repeated alike.  An empty table stays empty.
    """
    return mixing.repeat_documents(docs, floor=1.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of whole documents and pieces of long ones: (shard, bin, used, capacity, doc_ids, starts, lengths).

    NULL, empty and blank texts are in no bin; rows without an id are packed under NULL; repeated rows are packed as often
    as they occur.  An empty table gives no bins.
    """
    return packing.pack(docs)


STAGES = [("quality classifier", keep_quality), ("exact dedup", drop_copies), ("n-gram jaccard join", drop_near_copies), ("mixing sources", mix_sources), ("best-fit packing", pack_sequences)]

#: SQL cannot express the ranker, the Newton iterations or the packing; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what each returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            table = Table(docs)
            docs = table.df
            if before is not None:
                before.drop()
            before = table
    return docs
