"""Lexical and vector similarity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.text import tokenize

#: In a corpus of two texts a word that both have weighs 1, any other 1 + ln 2.
ALONE = 1 + math.log(2)


def tfidf_pairs(df: DataFrame, key: str, a: str, b: str, unicode: bool = False) -> DataFrame:
    """(key, similarity): the TF-IDF cosine of two text columns; two empty texts give 1, one gives 0.

    Words are counted by (key, word) and summed by key; word counts do for frequencies, as lengths cancel out.
    Rows that share a key are one.
    """
    sides = F.array(
        F.struct(F.lit(True).alias("left"), tokenize(F.col(a), unicode).alias("t")),
        F.struct(F.lit(False).alias("left"), tokenize(F.col(b), unicode).alias("t")),
    )
    words = df.select(key, F.explode(sides).alias("s")).select(key, "s.left", F.explode_outer("s.t").alias("t"))
    counts = words.groupBy(key, "t").agg(F.count_if(F.col("left")).alias("a"), F.count_if(~F.col("left")).alias("b")).withColumns({c: F.when(F.col("t").isNull(), 0).otherwise(F.col(c)) for c in ("a", "b")})
    weight = F.when((F.col("a") > 0) & (F.col("b") > 0), 1.0).otherwise(ALONE)
    sums = counts.groupBy(key).agg(F.sum(F.col("a") * F.col("b")).alias("dot"), F.sum(F.pow(F.col("a") * weight, 2)).alias("aa"), F.sum(F.pow(F.col("b") * weight, 2)).alias("bb"))
    score = F.when((F.col("aa") == 0) & (F.col("bb") == 0), 1.0).when((F.col("aa") == 0) | (F.col("bb") == 0), 0.0).otherwise(F.col("dot") / F.sqrt(F.col("aa") * F.col("bb")))
    return sums.select(key, score.alias("similarity"))


def term_frequency(df: DataFrame, key: str, text: str, unicode: bool = False) -> DataFrame:
    """(key, term, n, tf) with tf the share of the row's words."""
    tokens = df.select(key, tokenize(F.col(text), unicode).alias("w")).where(F.size("w") > 0)
    rows = tokens.select(key, F.size("w").alias("size"), F.explode("w").alias("term"))
    return rows.groupBy(key, "term").agg(F.count("*").alias("n"), (F.count("*") / F.first("size")).alias("tf"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers in double precision; 0 for different lengths, empty or zero vectors."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | a.isNull() | b.isNull() | (norm == 0), 0.0).otherwise(dot(a, b) / norm)
