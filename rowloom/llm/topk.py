"""Exact top-k search with no random access (operator 5).

Every query is a bag of words, every document's score the sum of its BM25 impacts.  The documents are spread over
partitions; each holds, for every word of any query, a list of (document, impact) by falling impact.  A query
reads its lists of a partition from the top, a stretch of each in turn, and keeps for every document the sum of
what was read (lower bound) and that sum plus the impacts at which the other lists stand (upper bound).  It stops
when no document outside its k best can reach their lowest score; the lists are then read on only to complete the
scores of those k.  The best of all partitions are ranked in the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import Table, Words, pieces, with_row_key

K = 10
K1, B = 1.2, 0.75
#: Impacts are integers, in millionths, so that sums are exact and ties are ties.
SCALE = 1_000_000
#: Words over all queries of one pass over the documents; more queries than that take more passes.
PASS_WORDS = 1 << 20
#: Documents of a partition.
PART_DOCS = 8192
STRETCH = 64


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (documents, scores) by falling score, then rising document, and the postings read to find them.

    Each list is (documents, impacts) with impacts falling; documents count from 0 to ``n_docs``.
    """
    low = np.zeros(n_docs, np.int64)
    seen = np.zeros((n_docs, len(lists)), bool)
    pos, step, read = [0] * len(lists), STRETCH, 0
    front = np.array([int(i[0]) if len(i) else 0 for _, i in lists], np.int64)
    while True:
        for j, (docs, impacts) in enumerate(lists):
            a, b = pos[j], min(pos[j] + step, len(docs))
            if a < b:
                low[docs[a:b]] += impacts[a:b]
                seen[docs[a:b], j] = True
                pos[j], read = b, read + b - a
                front[j] = int(impacts[b - 1]) if b < len(docs) else 0
        open_ = int(front.sum())
        if not open_:
            break
        step *= 2
        if n_docs <= k:
            continue
        best = np.argpartition(-low, k - 1)[:k]
        worst = int(low[best].min())
        if worst <= open_:
            continue  # a document that no list has shown yet could still reach it
        rest = low + open_ >= worst
        rest[best] = False
        rest = np.flatnonzero(rest)
        if not len(rest) or int((low[rest] + open_ - seen[rest] @ front).max()) < worst:
            break
    if not front.any():
        some = np.flatnonzero(low)
        order = some[np.lexsort((some, -low[some]))][:k]
        return order, low[order], read
    # no outsider can come in: read on, for the scores of the k only
    mark = np.zeros(n_docs, bool)
    mark[best] = True
    for j, (docs, impacts) in enumerate(lists):
        if pos[j] < len(docs):
            d = docs[pos[j] :]
            hit = mark[d]
            low[d[hit]] += impacts[pos[j] :][hit]
    order = best[np.lexsort((best, -low[best]))]
    return order, low[order], read


def _bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(row, word, times) of the distinct words of each row, the vocabulary, and the rows' lengths."""
    words = Words(texts, lower=True)
    n = np.diff(words.off)
    pair, times = np.unique(np.repeat(np.arange(len(n)), n) << 32 | words.codes.astype(np.int64), return_counts=True)
    return pair >> 32, pair & 0xFFFFFFFF, times, words.vocab, n


def _queries(table: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[dict[str, int], dict[int, list[int]]]]:
    """Batches of queries: the number of each word, and the distinct words of each query.

    Rows that repeat an id are one query and meet before the batches are cut, so a query is never in two of them.  A
    batch holds at most ``PASS_WORDS`` words over all its queries (or one query alone), which bounds what is sent.
    """

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "k1"):
                row, word, _, names, _ = _bags(part.column("k1"))
                ids = part.column("k0").cast(pa.int64()).to_numpy(zero_copy_only=False)
                yield pa.record_batch({"id": pa.array(ids[row], pa.int64()), "word": pa.array(names, pa.string()).take(pa.array(word))})

    rows = with_row_key(table, [id_col, text_col]).where("k0 is not null and k1 is not null").mapInArrow(bags, "id long, word string")
    whole = Table(rows.groupBy("id").agg(F.array_sort(F.collect_set("word")).alias("words")))
    vocab: dict[str, int] = {}
    queries: dict[int, list[int]] = {}
    held = 0
    for row in whole.df.toLocalIterator():
        if queries and held + len(row["words"]) > PASS_WORDS:
            yield vocab, queries
            vocab, queries, held = {}, {}, 0
        queries[row["id"]] = sorted(vocab.setdefault(w, len(vocab)) for w in row["words"])
        held += len(row["words"])
    if queries:
        yield vocab, queries
    whole.drop()


def _search(src: DataFrame, vocab: dict[str, int], queries: dict[int, list[int]], k: int) -> DataFrame:
    spark = src.sparkSession
    words = spark.sparkContext.broadcast(vocab)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for batch in batches:
            for part in pieces(batch, "k1"):
                row, word, times, names, n = _bags(part.column("k1"))
                code = np.fromiter((known.get(w, -1) for w in names), np.int64, len(names))[word] if len(names) else word
                keep = code >= 0
                row, code, times = row[keep], code[keep], times[keep]
                ids = part.column("k0").cast(pa.int64()).to_numpy(zero_copy_only=False)
                yield pa.record_batch(
                    {
                        "n_docs": pa.array([len(n)], pa.int64()),
                        "n_words": pa.array([int(n.sum())], pa.int64()),
                        "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
                        "sizes": pa.array([n.astype(np.int32).tobytes()], pa.binary()),
                        "docs": pa.array([row.astype(np.int32).tobytes()], pa.binary()),
                        "words": pa.array([code.astype(np.int32).tobytes()], pa.binary()),
                        "times": pa.array([times.astype(np.int32).tobytes()], pa.binary()),
                    }
                )

    blocks = Table(src.mapInArrow(postings, "n_docs long, n_words long, ids binary, sizes binary, docs binary, words binary, times binary"))
    words.unpersist()
    n, total = blocks.df.agg(F.sum("n_docs"), F.sum("n_words")).first()
    n, total, v = n or 0, total or 0, len(vocab)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(v, np.int64)
        for batch in batches:
            for blob in batch.column("words").to_pylist():
                df += np.bincount(np.frombuffer(blob, np.int32), minlength=v)
        some = np.flatnonzero(df)
        yield pa.record_batch({"word": pa.array(some, pa.int32()), "df": pa.array(df[some], pa.int64())})

    df = np.zeros(v, np.int64)
    for row in blocks.df.select("words").mapInArrow(frequencies, "word int, df long").groupBy("word").agg(F.sum("df").alias("df")).toLocalIterator():
        df[row["word"]] = row["df"]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    average = total / n if n else 1.0
    shared = spark.sparkContext.broadcast((idf, queries))

    def best_of(ids: np.ndarray, sizes: np.ndarray, docs: np.ndarray, word: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, int, int]]:
        idf, asked = shared.value
        by_id = np.argsort(ids, kind="stable")  # so that ties go to the smaller id
        new = np.empty(len(ids), np.int64)
        new[by_id] = np.arange(len(ids))
        impact = np.floor(idf[word] * (times * (K1 + 1) / (times + K1 * (1 - B + B * sizes[docs] / average))) * SCALE + 0.5).astype(np.int64)
        docs = new[docs]
        order = np.lexsort((docs, -impact, word))
        docs, impact = docs[order], impact[order]
        cuts = np.searchsorted(word[order], np.arange(v + 1))
        for q, mine in asked.items():
            lists = [(docs[cuts[t] : cuts[t + 1]], impact[cuts[t] : cuts[t + 1]]) for t in mine if cuts[t + 1] > cuts[t]]
            if lists:
                at, scores, _ = nra(lists, len(ids), k)
                for d, s in zip(ids[by_id[at]].tolist(), scores.tolist()):
                    yield q, d, s

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            base = np.cumsum([0] + [len(h[0]) for h in held])[:-1]
            ids, sizes, docs, word, times = (np.concatenate(c) for c in zip(*[(h[0], h[1], h[2] + b, h[3], h[4]) for h, b in zip(held, base)]))
            found = list(zip(*best_of(ids, sizes, docs, word, times))) or [()] * 3
            return pa.record_batch({"query_id": pa.array(found[0], pa.int64()), "doc_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})

        for batch in batches:
            cols = [[np.frombuffer(x, t) for x in batch.column(c).to_pylist()] for c, t in (("ids", np.int64), ("sizes", np.int32), ("docs", np.int32), ("words", np.int32), ("times", np.int32))]
            for block in zip(*cols):
                held.append((block[0], block[1], block[2].astype(np.int64), *block[3:]))
                size += len(block[0])
                if size >= PART_DOCS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return blocks.df.select("ids", "sizes", "docs", "words", "times").mapInArrow(answer, "query_id long, doc_id long, score long")


def top_k(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank): the k documents of the highest BM25 score for each query, exactly.

    Words are split at whitespace and lower-cased; a query's words count once.  Scores are sums of impacts in
    millionths; of equal scores the smaller doc_id comes first.  Documents that share no word with a query are not
    returned, so there may be fewer than k.  NULL, empty and blank documents match nothing but count as documents
    of 0 words; rows with a NULL id in either table are left out.  Repeated rows are ranked each; queries that
    repeat an id are one.  Other columns are ignored.  An empty table on either side gives an empty result.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    src = with_row_key(docs, [id_col, text_col]).where("k0 is not null")
    found = None
    for vocab, asked in _queries(queries, query_id_col, query_text_col):
        part = _search(src, vocab, asked, k)
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score long, rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
