"""Mixing sources to target weights by entropy balancing (operator 3)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import Table, n_words

TEMPERATURE = 0.7
#: Sources times languages, at most: the driver keeps a few numbers for each, and they are broadcast.
MOST_CELLS = 1 << 20
#: A multiplier beyond this means that constraints exclude each other.
DIVERGED = 25.0


def temperature_weights(tokens: dict[str, int], temperature: float) -> dict[str, float]:
    """Shares in proportion to tokens ** temperature."""
    raised = {k: float(v) ** temperature for k, v in tokens.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


@dataclass
class Tilt:
    """Log rates by (source, language) and the multiplier of log length around ``centre``; no ``base`` is rate 1."""

    base: dict[tuple[str, str], float] | None
    nu: float = 0.0
    centre: float = 0.0
    floor: float = 0.0
    by_lang: bool = False


@dataclass
class _Cells:
    """One entry a cell (source, language): its source, its language or -1 if that is not constrained, and sums."""

    source: np.ndarray
    lang: np.ndarray
    n_sources: int
    n_langs: int

    def system(self, s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Constraint sums, and the Hessian as its diagonal over sources, the rest, and what lies between."""
        k, on = self.n_langs, self.lang >= 0
        sums = np.concatenate((np.bincount(self.source, s["w"], self.n_sources), np.bincount(self.lang[on], s["w"][on], k), [s["wx"].sum()]))
        diagonal = np.bincount(self.source, s["h"], self.n_sources)
        between = np.zeros((self.n_sources, k + 1))
        np.add.at(between, (self.source[on], self.lang[on]), s["h"][on])
        between[:, k] = np.bincount(self.source, s["hx"], self.n_sources)
        rest = np.diag(np.append(np.bincount(self.lang[on], s["h"][on], k), s["hxx"].sum()))
        rest[:k, k] = rest[k, :k] = np.bincount(self.lang[on], s["hx"][on], k)
        return sums, diagonal, between, rest


def newton(cells: _Cells, evaluate: Callable[[np.ndarray, float], dict[str, np.ndarray]], target: np.ndarray, start: np.ndarray, tol: float, max_iter: int) -> tuple[np.ndarray, float]:
    """Multipliers that minimise the dual, and the largest constraint residual as a share of the total.

    ``evaluate(log rate of each cell, nu)`` gives the cells' sums.  The Hessian is diagonal over sources, so those are
    eliminated and a system of one row a language is solved.
    """
    s_, k = cells.n_sources, cells.n_langs
    total = float(target[:s_].sum())

    def at(lam: np.ndarray) -> tuple[float, np.ndarray, tuple]:
        base = lam[cells.source] + np.where(cells.lang >= 0, np.append(lam[s_ : s_ + k], 0.0)[cells.lang], 0.0)
        got = evaluate(base, float(lam[-1]))
        sums, *hessian = cells.system(got)
        return float(got["p"].sum() - lam @ target), sums - target, tuple(hessian)

    lam = start
    value, grad, (diagonal, between, rest) = at(lam)
    for _ in range(max_iter):
        if np.abs(grad).max() <= tol * total or np.abs(lam).max() > DIVERGED:
            break
        ridge = 1e-9 * total
        d = diagonal + ridge
        small = rest + ridge * np.eye(k + 1) - between.T @ (between / d[:, None])
        tail = np.linalg.lstsq(small, -grad[s_:] + between.T @ (grad[:s_] / d), rcond=None)[0]
        step = np.concatenate(((-grad[:s_] - between @ tail) / d, tail))
        step *= min(1.0, 4.0 / max(float(np.abs(step).max()), 1e-12))
        scale, slope = 1.0, float(grad @ step)
        while True:
            new = at(lam + scale * step)
            if new[0] <= value + 1e-4 * scale * slope + 1e-12 * abs(value):
                break
            scale /= 2
            if scale < 1e-6:  # no better point this way: this is as far as the arithmetic goes
                return lam, float(np.abs(grad).max()) / total
        lam = lam + scale * step
        value, grad, (diagonal, between, rest) = new
    return lam, float(np.abs(grad).max()) / total


def solve(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: float | None = None, floor: float = 0.0, tol: float = 1e-7, max_iter: int = 60, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> Tilt:
    """The tilt that meets the constraints (see ``balance``)."""
    spark = docs.sparkSession
    has_lang = lang_col in docs.columns
    # documents of one cell and length have one rate: they are one row, with their tokens in all
    table = Table(_keyed(docs, text_col, source_col, lang_col if has_lang else None).groupBy("s", "g", "n").agg(F.sum("n").alias("t")))
    log_n = F.log(F.greatest("n", F.lit(1)))
    sums = Table(table.df.groupBy("s", "g").agg(F.sum("t").alias("n"), F.sum(F.col("t") * log_n).alias("l")))
    if sums.df.count() > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} pairs of source and language")
    cells = sorted(sums.df.collect())
    sums.drop()
    try:
        n_all = float(sum(c["n"] for c in cells))
        if not n_all:
            return Tilt(None)
        by_source: dict[str, int] = {}
        by_lang: dict[str, int] = {}
        logs: dict[str, float] = {}
        for c in cells:
            by_source[c["s"]] = by_source.get(c["s"], 0) + c["n"]
            by_lang[c["g"]] = by_lang.get(c["g"], 0) + c["n"]
            logs[c["s"]] = logs.get(c["s"], 0.0) + c["l"]
        given = {k: v for k, v in (weights or temperature_weights(by_source, temperature)).items() if v > 0 and by_source.get(k)}
        if not given:
            raise ValueError("no source with tokens has a weight above 0")
        share = {k: v / sum(given.values()) for k, v in given.items()}
        ses = sorted(share)
        held = [c for c in cells if c["s"] in share and c["n"]]
        lw = temperature_weights({k: v for k, v in by_lang.items() if any(c["g"] == k for c in held)}, temperature) if has_lang else {}
        centre = sum(c["l"] for c in cells) / n_all
        # Languages are constrained but for the last, which follows from the total.
        for lgs in ([sorted(lw)[:-1]] if len(lw) > 1 else []) + [[]]:
            whole = total
            if whole is None:
                whole = n_all if not floor else max(n_all, floor * max([by_source[s] / share[s] for s in ses] + [sum(c["n"] for c in held if c["g"] == g) / lw[g] for g in (lw if lgs else ())]))
            si, li = {s: i for i, s in enumerate(ses)}, {g: i for i, g in enumerate(lgs)}
            where = _Cells(np.array([si[c["s"]] for c in held]), np.array([li.get(c["g"], -1) for c in held]), len(ses), len(lgs))
            shares = np.array([share[s] for s in ses])
            mean = np.array([logs[s] / by_source[s] - centre for s in ses])
            target = whole * np.concatenate((shares, [lw[g] for g in lgs], [shares @ mean]))
            start = np.concatenate((np.log(np.maximum(whole * shares / np.array([by_source[s] for s in ses]), 1e-12)), np.zeros(len(lgs) + 1)))
            lam, off = newton(where, _evaluator(spark, table.df, held, centre, floor), target, start, tol, max_iter)
            if off <= 1e-4:
                break
        else:
            raise RuntimeError(f"the constraints on sources are off by {off:.2g} of the total after {max_iter} steps")
    finally:
        table.drop()
    base = {(c["s"], c["g"]): float(lam[si[c["s"]]] + (lam[len(ses) + li[c["g"]]] if c["g"] in li else 0.0)) for c in held}
    # a source without tokens bears on nothing: its texts stay as they are, unless the weights leave it out
    for c in cells:
        if c["s"] in share:
            base.setdefault((c["s"], c["g"]), float(lam[si[c["s"]]]))
        elif not by_source[c["s"]] and (weights is None or weights.get(c["s"], 0) > 0):
            base[c["s"], c["g"]] = 0.0
    return Tilt(base, float(lam[-1]), centre, floor, bool(lgs))


def _keyed(docs: DataFrame, text_col: str, source_col: str, lang_col: str | None) -> DataFrame:
    """The columns as c0, c1, ..., with s and g (source and language, NULLs as "") and n (words of the text)."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def name(c: str) -> str:
        return f"c{docs.columns.index(c)}"

    lang = F.coalesce(F.col(name(lang_col)).cast("string"), F.lit("")) if lang_col else F.lit("")
    return plain.withColumns({"s": F.coalesce(F.col(name(source_col)).cast("string"), F.lit("")), "g": lang, "n": n_words(name(text_col))})


def _evaluator(spark: SparkSession, narrow: DataFrame, cells: list, centre: float, floor: float) -> Callable[[np.ndarray, float], dict[str, np.ndarray]]:
    """The sums over each cell at a tilt: one distributed pass, aggregated by cell before it leaves a task."""
    x = F.log(F.greatest("n", F.lit(1))) - F.lit(centre)
    names = pa.array([c["s"] for c in cells]), pa.array([c["g"] for c in cells])
    small = float(np.log(floor)) if floor > 0 else -np.inf

    def evaluate(base: np.ndarray, nu: float) -> dict[str, np.ndarray]:
        rates = spark.createDataFrame(pa.table([pa.array(range(len(base)), pa.int32()), *names, pa.array(base)], ["cell", "s", "g", "base"]))
        u = F.col("base") + F.lit(nu) * x
        r = F.exp(u)
        phi = rate = curve = r
        if floor > 0:
            phi = F.when(u >= small, r).otherwise(F.lit(floor) * (1 + u - F.lit(small)))
            rate, curve = F.greatest(r, F.lit(floor)), F.when(u >= small, r).otherwise(F.lit(0.0))
        parts = {"p": F.col("t") * phi, "w": F.col("t") * rate, "h": F.col("t") * curve, "x": x}
        rows = narrow.where("n > 0").join(F.broadcast(rates), ["s", "g"]).withColumns(parts)
        sums = {"p": "p", "w": "w", "wx": "w * x", "h": "h", "hx": "h * x", "hxx": "h * x * x"}
        out = {k: np.zeros(len(base)) for k in sums}
        for row in rows.groupBy("cell").agg(*[F.sum(F.expr(e)).alias(k) for k, e in sums.items()]).collect():
            for k in sums:
                out[k][row["cell"]] = row[k]
        return out

    return evaluate


def _rated(docs: DataFrame, tilt: Tilt, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """``_keyed`` with ``rate`` and ``copies``."""
    df = _keyed(docs, text_col, source_col, lang_col if lang_col in docs.columns else None)
    if tilt.base is None:
        df = df.withColumn("rate", F.lit(1.0))
    else:
        rows = [(s, g, b) for (s, g), b in tilt.base.items()]
        table = df.sparkSession.createDataFrame(pa.table(dict(zip(("s", "g", "b"), map(pa.array, zip(*rows))))))
        u = F.col("b") + F.when(F.col("n") > 0, F.lit(tilt.nu) * (F.log(F.greatest("n", F.lit(1))) - F.lit(tilt.centre))).otherwise(0.0)
        rate = F.when(F.col("b").isNull(), F.lit(0.0)).otherwise(F.greatest(F.exp(u), F.lit(float(tilt.floor))))
        df = df.join(F.broadcast(table), ["s", "g"], "left").withColumn("rate", rate)
    whole = F.floor("rate")
    dice = F.pmod(F.xxhash64(f"c{docs.columns.index(id_col)}"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return df.withColumn("copies", (whole + F.when(dice < F.col("rate") - whole, 1).otherwise(0)).cast("long"))


def balance(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **params) -> DataFrame:
    """Rates r of the documents that are nearest to 1 in token-weighted entropy and meet token constraints.

    Minimises ``sum n (r log r - r + 1)`` over ``r >= floor`` such that every source has its share ``weights``
    of the ``total`` tokens, every language its share at ``temperature``, and the token-weighted mean of log length is
    that of the sources as they are, in their new shares.  Languages are left free without ``lang_col``, and where the
    sources' shares exclude theirs (Newton finds no solution), as when a source has one language.  A RuntimeError says
    that the sources' own constraints were not met to 1e-4 of the total.

    The convex dual has one multiplier a constraint, and ``r = max(floor, exp(lambda . z))``.  Each Newton step is one
    pass of the narrow table (source, language, length, tokens), one row for all documents that share the first three:
    gradient and Hessian are sums over it, aggregated by Spark by source and language; the driver solves a system of one row a language.  Sources times languages are at
    most ``MOST_CELLS``, else a ValueError.

    ``copies`` rounds r without bias: ``floor(r)`` plus one where a hash of the id lies under the fraction,
    so no shuffle or order is needed and a rerun gives the same.  Each document is rounded by itself, so a source's
    tokens miss their target by about the root of the sum of ``n ** 2 / 4``: little for many documents, and up to the
    size of one for few.  ``weights`` default to ``temperature_weights`` of the input; they are scaled to 1, sources
    that they leave out get no copies.  ``total`` defaults to the input's tokens; with a ``floor`` to the least total in
    which no source and no constrained language falls below the floor, so that with 1 no document is dropped.

    Returns (doc_id, source, n_tokens, rate, copies) for every row.  NULL sources and languages are
    groups of their own (named "" in ``weights``).  NULL or blank texts have 0 tokens and bear on no
    constraint; they get their group's rate, 1 in a source without tokens.  NULL ids are rounded by the hash of NULL.
    Repeated rows count each, and are rounded alike.  Other columns are ignored, whatever their names.  An empty table,
    or one without tokens, gives rate 1.
    """
    tilt = solve(docs, text_col=text_col, source_col=source_col, lang_col=lang_col, **params)
    rated = _rated(docs, tilt, id_col, text_col, source_col, lang_col)
    i, s = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, source_col))
    return rated.select(i.alias("doc_id"), s.alias("source"), F.col("n").alias("n_tokens"), "rate", "copies")


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **params) -> DataFrame:
    """The documents, each as often as ``balance`` gives copies; all columns as they were, nothing is shuffled."""
    tilt = solve(docs, text_col=text_col, source_col=source_col, lang_col=lang_col, **params)
    rated = _rated(docs, tilt, id_col, text_col, source_col, lang_col).where("copies > 0")
    many: Column = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return rated.withColumn("nth", many).select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
