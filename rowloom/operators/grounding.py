"""Grounding, contradiction, support and confidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.functions.similarity import ALONE, tfidf_pairs
from rowloom.operators import ranking


def grounding(df: DataFrame, key: str, answer: str, sources: list[str], threshold: float = 0.3, digits: int = 6) -> DataFrame:
    """(key, similarity, _grounding_score, grounded): the best TF-IDF cosine of the answer with a source column.

    Below the threshold the score is 0.
    """
    pairs = df.select(F.col(key).alias("__k"), F.col(answer).alias("__a"), F.posexplode(F.array(*[F.col(s).cast("string") for s in sources])).alias("__s", "__t")).withColumn("__p", F.struct("__k", "__s"))
    best = tfidf_pairs(pairs, "__p", "__a", "__t").groupBy(F.col("__p.__k").alias(key)).agg(F.round(F.max("similarity"), digits).alias("similarity"))
    ok = F.col("similarity") >= threshold
    return best.select(key, "similarity", F.when(ok, F.col("similarity")).otherwise(0.0).alias("_grounding_score"), ok.alias("grounded"))


def contradicts(a: Column, b: Column, tolerance: float | None = None) -> Column:
    """Whether two texts differ: as numbers by more than the tolerance, if both are numbers."""
    if tolerance is None:
        return a != b
    x, y = F.try_cast(a, "double") if hasattr(F, "try_cast") else a.try_cast("double"), b.try_cast("double")
    return F.when(a == b, False).when(x.isNotNull() & y.isNotNull(), F.abs(x - y) > tolerance).otherwise(a != b)


def contradictions(df: DataFrame, key: str, value: str, order: str, tolerance: float | None = None) -> DataFrame:
    """(key, first, second, value_a, value_b): the first rows of distinct values of a key that contradict.

    Only the first row of each (key, value) takes part, so a frequent value costs one row; empty and NULL values
    say nothing.  Of values that share their first row, the smaller text comes first.  With a ``tolerance``, keys whose
    values are all numbers no further apart than that are left out before rows meet.
    """
    text = F.col(value).cast("string")
    once = df.where(text.isNotNull() & (text != "")).groupBy(F.col(key).alias("k"), text.alias("v")).agg(F.min(order).alias("o"))
    number = F.col("v").try_cast("double")
    spread = (F.max(number) - F.min(number) > F.lit(tolerance)) | (F.count(number) < F.count("*")) if tolerance is not None else F.lit(True)
    some = once.groupBy("k").agg(F.count("*").alias("n"), spread.alias("apart")).where("n > 1 and apart").select("k")
    once = once.join(some, "k", "left_semi")
    a, b = once.alias("a"), once.alias("b")
    pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.struct("a.o", "a.v") < F.struct("b.o", "b.v")) & contradicts(F.col("a.v"), F.col("b.v"), tolerance))
    return pairs.select(F.col("a.k").alias(key), F.col("a.o").alias("first"), F.col("b.o").alias("second"), F.col("a.v").alias("value_a"), F.col("b.v").alias("value_b"))


def flag_contradictions(df: DataFrame, key: str, value: str, order: str, tolerance: float | None = None) -> DataFrame:
    """``_contradiction``: whether an earlier row of the same key has a value that contradicts this one.

    One window a key: the extremes of the numbers before a row and of the texts before it decide, so no row meets
    another.  Empty and NULL values say nothing and are not flagged.
    """
    text = F.col(value).cast("string")
    known = F.when(text != "", text)
    number = known.try_cast("double") if tolerance is not None else F.lit(None).cast("double")
    word = F.when(number.isNull(), known)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = {"__nl": F.min(number), "__nh": F.max(number), "__wl": F.min(word), "__wh": F.max(word)}
    rows = df.withColumns({k: v.over(before) for k, v in seen.items()})
    apart = F.when(number.isNotNull(), (number - F.col("__nl") > F.lit(tolerance)) | (F.col("__nh") - number > F.lit(tolerance)) | F.col("__wl").isNotNull())
    other = F.when(word.isNotNull(), (F.col("__wl") != word) | (F.col("__wh") != word) | F.col("__nl").isNotNull())
    return rows.withColumn("_contradiction", F.coalesce(apart, other, F.lit(False))).drop(*seen)


def symmetric(pairs: DataFrame, a: str = "first", b: str = "second") -> DataFrame:
    """Each pair in both directions, once."""
    return pairs.select(a, b).union(pairs.select(F.col(b), F.col(a))).distinct()


def support(claims: DataFrame, claim: str, by: list[str]) -> DataFrame:
    """(claim, support_count): distinct combinations of ``by`` that assert a claim; NULLs are values of their own."""
    return claims.select(claim, *by).distinct().groupBy(claim).agg(F.count("*").alias("support_count"))


def first_claims(claims: DataFrame, claim: str, order: str) -> DataFrame:
    """The first record of each claim, with how often it was stored."""
    w = Window.partitionBy(claim)
    return claims.withColumns({"stored": F.count("*").over(w), "__r": F.row_number().over(w.orderBy(order))}).where("__r = 1").drop("__r")


def confidence(score: Column, support_count: Column | None = None, mode: str = "default") -> Column:
    """default: 0.7 of the score and 0.3 of the support, full at five; sigmoid around 0.3; grounding_only."""
    if mode == "sigmoid":
        return 1.0 / (1.0 + F.exp(-10 * (score - 0.3)))
    if mode == "grounding_only":
        return F.least(F.lit(1.0), score)
    if mode != "default":
        raise ValueError(f"unknown mode {mode!r}")
    s = F.lit(0) if support_count is None else F.coalesce(support_count, F.lit(0))
    return F.when(score.isNotNull(), F.least(F.lit(1.0), score * 0.7 + F.least(s, F.lit(5)) / 5 * 0.3))


CLAIM = "claim string, text string, source string, asserted_by string, decision string, phase string, seq long"


class ClaimStore:
    """Claims in a folder: what was first said stays, who said it again is kept beside it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, rows: DataFrame) -> None:
        """Append (claim, text, source, asserted_by, decision, phase, seq) rows; a claim that exists keeps its text."""
        names = [f.split()[0] for f in CLAIM.split(", ")]
        rows.select(*names).write.mode("append").parquet(self.path)

    def records(self) -> DataFrame:
        return self.spark.read.schema(CLAIM).parquet(self.path)

    def claims(self) -> DataFrame:
        """(claim, text, source, support_count): the first record of each claim."""
        r = self.records()
        first = r.groupBy("claim").agg(F.min_by(F.struct("text", "source"), "seq").alias("r")).select("claim", "r.text", "r.source")
        return first.join(support(r, "claim", ["asserted_by", "decision", "phase"]), "claim")

    def get(self, ids: DataFrame, claim: str = "claim") -> DataFrame:
        """The claims of the ids; those that do not exist are left out."""
        return hydrate(ids, self.claims(), claim, "claim")

    def contradictions(self, key: str = "source", tolerance: float | None = None) -> DataFrame:
        """(first, second): claims of one key whose texts contradict, in both directions."""
        c = self.claims().select(F.col("claim").alias("__id"), F.col(key).alias("__key"), F.col("text").alias("__text"))
        return symmetric(contradictions(c, "__key", "__text", "__id", tolerance))

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", query: str = "query") -> DataFrame:
        """(query_id, claim, score, rank): the claims that are most like a query by TF-IDF, none at 0."""
        return search_claims(self.claims(), queries, k, query_id, query)


def hydrate(ids: DataFrame, table: DataFrame, left: str, right: str) -> DataFrame:
    """The table's rows for a list of ids, once for each time an id is listed; unknown ids are left out."""
    asked = ids.select(F.col(left).alias("__asked"))
    return asked.join(table, F.col("__asked") == F.col(right)).drop("__asked")


def search_claims(claims: DataFrame, queries: DataFrame, k: int, query_id: str = "query_id", query: str = "query", claim: str = "claim", text: str = "text", digits: int = 6) -> DataFrame:
    """(query_id, claim, score, rank) by the TF-IDF cosine of query and claim, 0 left out.

    The cosine is 0 without a common word; what is not in common only enters the lengths, which are sums over each side
    less what is in common.  Claims are scored where they lie, and only the k best of a task are shuffled.
    """
    parts, most = [], 0
    for asked in ranking.passes(queries, query_id, query):
        parts.append(ranking.best_rows(claims, claim, F.col(text), asked.ids, (asked, asked.lengths), _by_tfidf, k, (query_id, queries.schema[query_id].dataType), digits))
        most += k * len(asked.ids)
    if not parts:
        kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, query_id), (claims, claim))]
        return claims.sparkSession.createDataFrame([], f"`{query_id}` {kinds[0]}, `{claim}` {kinds[1]}, score double, rank int")
    return ranking.merged(parts, k, query_id, claim, most)


def _by_tfidf(shared: tuple[ranking.Asked, np.ndarray]) -> ranking.Scorer:
    asked, qq = shared
    words, w = asked.encoded, ALONE * ALONE

    def add(best: ranking.Best, ids: np.ndarray, texts: pa.Array) -> None:
        row, word, y, _, cc = ranking.bags(texts, words)
        cc = cc[:, None]
        dot = ranking.totals(row, word, y, len(cc), asked, asked.times)
        xs = ranking.totals(row, word, np.ones(len(y)), len(cc), asked, asked.times**2)
        ys = ranking.totals(row, word, y * y, len(cc), asked)
        length = np.sqrt((xs + (qq - xs) * w) * (ys + (cc - ys) * w))
        s = np.divide(dot, length, out=np.zeros_like(dot), where=dot > 0)
        best.add(ids, s, s >= 0.5 / best.unit)  # not those that count as 0

    return add


def verify(df: DataFrame, key: str, outputs: list[str], sources: list[str], threshold: float = 0.3, action: str = "flag") -> DataFrame:
    """Outputs held against source columns: ``flag`` adds ``_grounding_score`` (0 below the threshold), ``skip`` also
    makes the outputs of rows below it NULL."""
    said = df.withColumn("__said", F.concat_ws(" ", *[F.col(f"`{c}`") for c in outputs]))
    got = grounding(said, key, "__said", sources, threshold).select(key, "_grounding_score", "grounded")
    out = df.join(got, key, "left")
    if action == "skip":
        out = out.withColumns({c: F.when(F.col("grounded"), F.col(f"`{c}`")) for c in outputs})
    return out.drop("grounded")
