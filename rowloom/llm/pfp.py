"""Suffix-array dedup by prefix-free parsing (operator 2).

A word stream is parsed into phrases: a phrase runs from one *trigger* (``w`` words whose rolling hash is 0
modulo ``p``) to the end of the next.  A trigger depends on its words alone, so equal passages are parsed alike,
and no phrase suffix longer than a trigger is a prefix of another.  Hence corpus order follows from two small
suffix arrays: that of the dictionary of distinct phrases orders positions by the rest of their phrase, that of
the parse orders what comes after it.

To distribute it:

1. Count phrases over the whole corpus.  A passage of ``m`` words that occurs twice holds only phrases that occur
   twice, so all other text is left out from here on.
2. Each start of such a passage goes to the shard of the smallest phrase hash inside its ``m`` words, which is the
   same for all its occurrences; neighbouring starts travel as one window of text.  Passages with fewer than two
   triggers, and so no whole phrase, go by a hash of all their words.
3. Each shard parses its windows, builds both suffix arrays and combines them.  Neighbours in the order that have
   their first ``m`` words in common are compared word by word; a run of such neighbours that more than one
   document has is a repeated passage.
4. The starts are joined to maximal spans for each document.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import KEY_BITS, Words, frequent, mix, pieces, release, rolling, shards_for, starts_within, text_bytes, to_shards, with_row_key

MIN_WORDS = 50
TRIGGER_WORDS, TRIGGER_MODULUS = 4, 6
_DROP = np.uint64(64 - KEY_BITS)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: A batch (k0, k1, ...) to (id of each row, the document it counts as, offsets, a 64-bit hash of each token).
Tokens = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def triggers(h: np.ndarray, w: int, p: int) -> np.ndarray:
    """Which runs of w words, by where they start, are triggers."""
    return rolling(h, w) % np.uint64(p) == 0


def phrase_keys(h: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
    """A 64-bit hash of each phrase ``h[at[i] : at[i + 1] + w]``."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, len(h))[:-1], dtype=np.uint64)))
    a, b = at[:-1], at[1:] + w
    return mix(mix((sums[b] - sums[a]) * _powers(_BASE_INV, len(h))[a]) + (b - a).astype(np.uint64))


class Parse:
    """The phrases of a batch, and for each start of m words the phrases that lie inside."""

    def __init__(self, off: np.ndarray, h: np.ndarray, m: int, w: int, p: int):
        self.m, self.off = m, off
        trig = triggers(h, w, p)
        self.at = np.flatnonzero(trig)
        self.keys = phrase_keys(h, self.at, w) if len(self.at) > 1 else np.empty(0, np.uint64)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        self.doc = doc
        self.inside = doc[self.at[:-1]] == doc[self.at[1:] + w - 1] if len(self.at) > 1 else np.empty(0, bool)
        before = np.concatenate(([0], np.cumsum(trig)))
        self.starts = np.flatnonzero(starts_within(off, m)) if len(h) else np.empty(0, np.int64)
        self.first, self.last = before[self.starts], before[self.starts + m - w + 1] - 1
        self.bare = self.last <= self.first  # fewer than two triggers
        self.bare_starts = self.starts[self.bare]
        self.bare_keys = np.empty(0, np.uint64)
        if len(self.bare_starts):
            key = h[self.bare_starts].copy()
            for j in range(1, m):
                key = key * np.uint64(_BASE) + h[self.bare_starts + j]
            self.bare_keys = mix(key ^ np.uint64(0xA5A5A5A5A5A5A5A5))

    def all_keys(self) -> np.ndarray:
        return np.concatenate((self.keys[self.inside], self.bare_keys))

    def candidates(self, repeated: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The starts whose phrases are all repeated, with the key of the shard that each belongs to, in order."""
        bare_ok = repeated(self.bare_keys)
        lost = np.concatenate(([0], np.cumsum(~repeated(self.keys))))
        ok = ~self.bare
        ok[ok] = lost[self.last[ok]] == lost[self.first[ok]]
        a, b = self.first[ok], self.last[ok]
        key = _range_min(self.keys, a, b)
        starts = np.concatenate((self.starts[ok], self.bare_starts[bare_ok]))
        key = np.concatenate((key, self.bare_keys[bare_ok]))
        order = np.argsort(starts, kind="stable")
        return starts[order], key[order]


def _range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(x[a:b]) of each range, none of them empty, from a table of minima over powers of two."""
    out = np.empty(len(a), x.dtype)
    level = np.zeros(len(a), np.int64)
    size = b - a
    if len(size):
        level = np.log2(size).astype(np.int64)
    cur = x
    for k in range(int(level.max(initial=-1)) + 1):
        at = level == k
        out[at] = np.minimum(cur[a[at]], cur[b[at] - (1 << k)])
        if len(cur) > 1 << k:
            cur = np.minimum(cur[: len(cur) - (1 << k)], cur[1 << k :])
    return out


def _ranks(symbols: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
    """Ranks from 1 of the suffixes of many strings by prefix doubling; position i's string stops at ``end[i]``.

    Equal suffixes share a rank, a suffix comes before its extensions; only ``most`` symbols are compared.
    """
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    here, step = np.arange(len(symbols)), 1
    while step < most:
        there = here + step
        nxt = np.where(there < end, rank[np.minimum(there, len(rank) - 1)], 0)
        rank = np.unique(rank << 32 | nxt, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    return rank


def corpus_order(text: np.ndarray, cut: np.ndarray, where: np.ndarray, m: int, w: int, p: int) -> np.ndarray:
    """The positions ``where`` of the windows ``text[cut[i] : cut[i + 1]]``, as indices into it, in suffix order.

    The suffix arrays of the dictionary of phrases and of the parse give it; it is exact to ``m`` words at least.
    """
    window_end = np.repeat(cut[1:], np.diff(cut))
    is_trig = np.zeros(len(text), bool)
    is_trig[: max(0, len(text) - w + 1)] = triggers(text.astype(np.uint64), w, p)
    is_trig &= np.arange(len(text)) + w <= window_end
    begins = is_trig.copy()
    begins[cut[:-1]] = True
    start = np.flatnonzero(begins)
    last_of_window = np.append(window_end[start[1:]] != window_end[start[:-1]], True)
    stop = np.where(last_of_window, window_end[start], np.append(start[1:] + w, 0))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(text.astype(np.uint64) * _powers(_BASE, len(text))[:-1], dtype=np.uint64)))
    keys = mix(mix((sums[stop] - sums[start]) * _powers(_BASE_INV, len(text))[start]) + (stop - start).astype(np.uint64))
    _, one, word = np.unique(keys, return_index=True, return_inverse=True)
    # dictionary: the distinct phrases one after the other, and its suffix array
    size = stop[one] - start[one]
    base = np.cumsum(size) - size
    inside = np.arange(int(size.sum())) - np.repeat(base, size)
    dictionary = text[np.repeat(start[one], size) + inside]
    suffix = _ranks(dictionary, np.repeat(base + size, size), int(size.max()))
    # parse: a phrase's rank is that of its whole; then the suffix array of the parse
    parse = suffix[base[word]]
    tail = np.flatnonzero(last_of_window)
    parse_end = np.repeat(tail + 1, np.diff(tail, prepend=-1))
    after = np.append(_ranks(parse, parse_end, min(m, int(np.diff(tail, prepend=-1).max()))), 0)
    # corpus order: by the rest of the phrase, then by the parse that follows it
    phrase = np.searchsorted(start, where, side="right") - 1
    rest = suffix[base[word[phrase]] + where - start[phrase]]
    follows = np.where(last_of_window[phrase], 0, after[phrase + 1])
    return np.argsort(rest << 32 | follows, kind="stable")


def _equal_runs(text: np.ndarray, where: np.ndarray, order: np.ndarray, m: int) -> np.ndarray:
    """For each position in the order, whether its first m words are those of its predecessor."""
    a, b = where[order[1:]], where[order[:-1]]
    alive = np.arange(len(a))
    for k in range(m):
        if not len(alive):
            break
        alive = alive[text[a[alive] + k] == text[b[alive] + k]]
    same = np.zeros(len(order), bool)
    same[alive + 1] = True
    return same


def _shard_spans(ids: np.ndarray, as_doc: np.ndarray, starts: np.ndarray, counts: np.ndarray, lengths: np.ndarray, words: np.ndarray, m: int, w: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (id, start, end) of the repeated passages among a shard's windows.

    Window i stands for ``counts[i]`` starts from ``starts[i]`` of row ``ids[i]`` and holds ``lengths[i]`` words.
    """
    off = np.concatenate(([0], np.cumsum(lengths)))
    raw = words.tobytes()
    digest = np.fromiter((xxhash.xxh3_64_intdigest(raw[4 * a : 4 * b]) for a, b in pairwise(off.tolist())), np.uint64, len(lengths))
    _, one, group = np.unique(digest, return_index=True, return_inverse=True)
    low, high = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
    np.minimum.at(low, group, as_doc)
    np.maximum.at(high, group, as_doc)
    size, n = lengths[one], counts[one]
    cut = np.concatenate(([0], np.cumsum(size)))
    text = words[np.repeat(off[one] - cut[:-1], size) + np.arange(int(cut[-1]))]
    owner = np.repeat(np.arange(len(one)), n)
    first = np.cumsum(n) - n
    where = cut[:-1][owner] + np.arange(len(owner)) - first[owner]
    order = corpus_order(text, cut, where, m, w, p)
    same = _equal_runs(text, where, order, m)
    run = np.flatnonzero(~same)
    lows, highs = np.minimum.reduceat(low[owner[order]], run), np.maximum.reduceat(high[owner[order]], run)
    hit = np.zeros(len(owner), bool)
    hit[order] = np.repeat(lows != highs, np.diff(np.append(run, len(order))))
    # maximal runs of repeated starts of each distinct window, then of each of its occurrences
    edge = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.empty(0, bool)
    opens = hit & (edge | ~np.concatenate(([False], hit[:-1])))
    closes = hit & (np.append(edge[1:], True) | ~np.append(hit[1:], False))
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    of, lo, hi = owner[a], a - first[owner[a]], b - first[owner[a]] + m
    by = np.argsort(group, kind="stable")
    begin = np.searchsorted(group[by], of)
    many = np.searchsorted(group[by], of, side="right") - begin
    pick = by[np.repeat(begin, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]
    return ids[pick], starts[pick] + np.repeat(lo, many), starts[pick] + np.repeat(hi, many)


def join_spans(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each id joined where they overlap or touch, in order."""
    order = np.lexsort((b, a, ids))
    ids, a, b = ids[order], a[order], b[order]
    if not len(ids):
        return ids, a, b
    new_id = np.concatenate(([True], ids[1:] != ids[:-1]))
    shift = np.cumsum(new_id) * (int(b.max()) + 2)  # one running maximum serves all ids
    top = np.maximum.accumulate(b + shift)
    opens = np.concatenate(([True], (a + shift)[1:] > top[:-1]))
    at = np.flatnonzero(opens)
    return ids[at], a[at], (top - shift)[np.append(at[1:], len(ids)) - 1]


def repeated_spans(src: DataFrame, text: str, tokens: Tokens, m: int, w: int, p: int, n_shards: int) -> DataFrame:
    """(id, start, length) of the maximal spans whose every ``m`` tokens occur in another document of ``src``."""
    spark = src.sparkSession
    if m < w + 1:
        raise ValueError("a passage must be longer than a trigger")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                _, _, off, h = tokens(part)
                rows = list(to_shards(Parse(off, h, m, w, p).all_keys() >> _DROP, n_shards))
                if rows:
                    yield pa.record_batch({"shard": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})

    freq = spark.sparkContext.broadcast(frequent(src.mapInArrow(count, "shard int, payload binary"), [2], n_shards))
    release(spark)
    schema = "shard int, ids binary, docs binary, starts binary, counts binary, lengths binary, words binary"

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, to_shard = freq.value, np.uint64(64 - int(math.log2(n_shards)))
        for batch in batches:
            for part in pieces(batch, text):
                ids, as_doc, off, h = tokens(part)
                parse = Parse(off, h, m, w, p)
                starts, key = parse.candidates(lambda k: f.has(0, k >> _DROP))
                if not len(starts):
                    continue
                doc = parse.doc[starts]
                new = np.concatenate(([True], (np.diff(starts) != 1) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
                at = np.flatnonzero(new)
                counts = np.diff(np.append(at, len(starts)))
                # the key decides the shard; mixing again spreads minima, which are small by nature
                shard = (mix(key[at]) >> to_shard).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                at, counts, shard = at[order], counts[order], shard[order]
                length = counts + m - 1
                base = np.cumsum(length) - length
                word = (h >> np.uint64(32)).astype(np.uint32)[np.repeat(starts[at] - base, length) + np.arange(int(length.sum()))]
                cuts = np.searchsorted(shard, np.arange(n_shards + 1))
                word_cuts = np.append(base, len(word))[cuts]
                used = [s for s in range(n_shards) if cuts[s + 1] > cuts[s]]
                d = doc[at]
                cols = [ids[d].astype(np.int64), as_doc[d].astype(np.int64), (starts[at] - off[d]).astype(np.int32), counts.astype(np.int32), length.astype(np.int32)]
                out = [[c[cuts[s] : cuts[s + 1]].tobytes() for s in used] for c in cols] + [[word[word_cuts[s] : word_cuts[s + 1]].tobytes() for s in used]]
                yield pa.record_batch([pa.array(used, pa.int32()), *[pa.array(c, pa.binary()) for c in out]], names=["shard", "ids", "docs", "starts", "counts", "lengths", "words"])

    def search(table: pa.Table) -> pa.Table:
        def col(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])

        ids, a, b = _shard_spans(col("ids", np.int64), col("docs", np.int64), col("starts", np.int32).astype(np.int64), col("counts", np.int32).astype(np.int64), col("lengths", np.int32).astype(np.int64), col("words", np.uint32), m, w, p)
        return pa.table(dict(zip(("id", "a", "b"), map(pa.array, join_spans(ids, a, b)))))

    def merge(table: pa.Table) -> pa.Table:
        ids, a, b = join_spans(*[table.column(c).to_numpy() for c in ("id", "a", "b")])
        return pa.table({"id": pa.array(ids), "start": pa.array(a), "length": pa.array(b - a)})

    spans = src.mapInArrow(windows, schema).groupBy("shard").applyInArrow(search, "id long, a long, b long")
    return spans.groupBy(F.pmod(F.xxhash64("id"), F.lit(n_shards)).alias("bucket")).applyInArrow(merge, "id long, start long, length long")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, w: int = TRIGGER_WORDS, p: int = TRIGGER_MODULUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length): the maximal spans of a document, in words, whose every ``min_words`` words in a row
    occur in another document too.

    Words are split at whitespace and compared as 32-bit hashes, case included.  A document is an id: repeats within
    one do not count, nor do those between rows that repeat an id, whose spans are joined.  NULL, empty and blank
    texts, and texts of fewer than ``min_words`` words, have no span; rows with a NULL id are left out.  Other
    columns are ignored.  An empty table gives an empty result.
    """

    def tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        words = Words(part.column("k1"))
        ids = part.column("k0").cast(pa.int64()).to_numpy(zero_copy_only=False)
        return ids, ids, words.off, words.hashes()

    src = with_row_key(docs, [id_col, text_col]).where("k0 is not null and k1 is not null")
    found = repeated_spans(src, "k1", tokens, min_words, w, p, shards_for(text_bytes(src, "k1")))
    return found.select(F.col("id").alias("doc_id"), "start", "length")
