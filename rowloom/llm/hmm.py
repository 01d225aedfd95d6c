"""Hidden Markov language model (operator 1): Baum-Welch over the whole corpus, exact likelihood of every document.

The recursions run over blocks of ``BLOCK`` words, all blocks of a batch abreast.  A block's transfer matrix
(the product of its transitions and emissions) is computed once; chaining those matrices along a document gives
the exact forward vector at the start of each block and the exact backward vector at its end, so long documents
are as parallel as short ones and nothing is cut off or approximated.

Every distinct word is a symbol of its own, known by a 64-bit key, and has a row of emissions; these grow with the
corpus and are held by no task as a whole.  Documents are stored in parts with the sorted keys of their words.  In
a round each part meets the emissions of its own keys, sends what it expects of them to the keys' shards, and the
shards send the sums back to the parts that asked: two shuffles, and only the transitions pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rowloom.llm.common import Table, Words, mix, pieces, release, shards_for, text_bytes, with_row_key

#: Rounds at most; training ends sooner once a round gains less than ``TOLERANCE`` of the log-likelihood.
STATES, ROUNDS, TOLERANCE = 4, 4, 1e-4
#: ``train`` alone folds words to 2 ** BITS symbols, for a model that fits in memory.
BITS = 18
BLOCK = 64
#: Added to every expected count of an emission.
SMOOTH = 0.01
#: Words that a task works on at a time.
CHUNK = 1 << 20
#: Words of a part: more of them share more rows of emissions, and so send less.
PART_WORDS = 1 << 22
_RESCALE = 8


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # one row a symbol
    log_likelihood: list[float]

    @property
    def bits(self) -> int:
        return int(math.log2(len(self.emit)))


class _Blocks:
    """Documents cut to blocks, longest block first."""

    def __init__(self, sizes: np.ndarray):
        n_blocks = -(-sizes // BLOCK)
        self.doc = np.repeat(np.arange(len(sizes)), n_blocks)
        first = np.cumsum(n_blocks) - n_blocks
        self.nth = np.arange(len(self.doc)) - np.repeat(first, n_blocks)
        base = np.cumsum(sizes) - sizes
        start = np.repeat(base, n_blocks) + self.nth * BLOCK
        length = np.minimum(BLOCK, np.repeat(sizes, n_blocks) - self.nth * BLOCK)
        order = np.argsort(-length, kind="stable")
        self.doc, self.nth, self.start, self.length = self.doc[order], self.nth[order], start[order], length[order]
        self.is_first = self.nth == 0
        # how many blocks are longer than t
        self.live = np.searchsorted(-self.length, -np.arange(BLOCK), side="left")
        by_nth = np.argsort(self.nth, kind="stable")
        cuts = np.searchsorted(self.nth[by_nth], np.arange(int(self.nth.max(initial=-1)) + 2))
        self.rank = [by_nth[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _transfer(blocks: _Blocks, codes: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """The transfer matrix of each block, scaled to a maximum of 1, and the logs of the scales."""
    n, k = len(blocks.start), len(m.start)
    t = np.where(blocks.is_first[:, None, None], np.eye(k), m.move) * m.emit[codes[blocks.start]][:, None, :]
    logs = np.zeros(n)
    for i in range(1, BLOCK):
        live = blocks.live[i]
        if not live:
            break
        t[:live] = (t[:live].reshape(-1, k) @ m.move).reshape(live, k, k) * m.emit[codes[blocks.start[:live] + i]][:, None, :]
        if i % _RESCALE == 0:
            top = t[:live].max((1, 2))
            t[:live] /= top[:, None, None]
            logs[:live] += np.log(top)
    return t, logs


def _chain(blocks: _Blocks, t: np.ndarray, logs: np.ndarray, m: Model, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The forward vector that enters each block, and each document's log-likelihood."""
    enter = np.empty((len(t), len(m.start)))
    now, ll = np.tile(m.start, (n_docs, 1)), np.zeros(n_docs)
    for at in blocks.rank:
        d = blocks.doc[at]
        enter[at] = now[d]
        out = np.einsum("bi,bij->bj", now[d], t[at])
        total = out.sum(1)
        now[d] = out / total[:, None]
        ll[d] += np.log(total) + logs[at]
    return enter, ll


def log_likelihood(codes: np.ndarray, sizes: np.ndarray, m: Model) -> np.ndarray:
    """The exact log-likelihood of each document; 0 for one without words."""
    blocks = _Blocks(sizes)
    if not len(blocks.start):
        return np.zeros(len(sizes))
    return _chain(blocks, *_transfer(blocks, codes, m), m, len(sizes))[1]


def expectations(codes: np.ndarray, sizes: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of emissions (symbol, state), transitions and starts, and the log-likelihood."""
    k, v = len(m.start), len(m.emit)
    blocks = _Blocks(sizes)
    if not len(blocks.start):
        return np.zeros((v, k)), np.zeros((k, k)), np.zeros(k), 0.0
    t, logs = _transfer(blocks, codes, m)
    enter, ll = _chain(blocks, t, logs, m, len(sizes))
    leave = np.ones((len(t), k))
    back = np.ones((len(sizes), k))
    for at in reversed(blocks.rank):
        d = blocks.doc[at]
        leave[at] = back[d]
        into = np.einsum("bij,bj->bi", t[at], back[d])
        back[d] = into / into.sum(1)[:, None]
    alphas = np.empty((BLOCK + 1, len(t), k))
    alphas[0] = enter
    for i in range(BLOCK):
        live = blocks.live[i]
        if not live:
            break
        went = alphas[i, :live] @ m.move
        if i == 0:
            went[blocks.is_first] = enter[blocks.is_first]
        went *= m.emit[codes[blocks.start[:live] + i]]
        alphas[i + 1, :live] = went / went.sum(1)[:, None]
    moves, starts, gamma = np.zeros((k, k)), np.zeros(k), np.empty((len(codes), k))
    beta = leave.copy()
    for i in range(BLOCK - 1, -1, -1):
        live = blocks.live[i]
        if not live:
            continue
        at = blocks.start[:live] + i
        b = beta[:live]
        g = alphas[i + 1, :live] * b
        g /= g.sum(1)[:, None]
        gamma[at] = g
        eb = m.emit[codes[at]] * b
        back_one = eb @ m.move.T
        prev = alphas[i, :live]
        z = (prev * back_one).sum(1)
        if i == 0:
            starts += g[blocks.is_first].sum(0)
            go = ~blocks.is_first
            moves += (prev[go] / z[go, None]).T @ eb[go]
        else:
            moves += (prev / z[:, None]).T @ eb
        beta[:live] = back_one / back_one.sum(1)[:, None]
    emits = np.stack([np.bincount(codes, weights=gamma[:, j], minlength=v) for j in range(k)], 1)
    return emits, moves * m.move, starts, float(ll.sum())


def _chunks(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about ``CHUNK`` words: the slice, its symbols, and the words of each of its documents."""
    for part in pieces(batch, "codes", 4 * CHUNK):
        blobs = part.column("codes").to_pylist()
        codes = np.frombuffer(b"".join(blobs), np.uint32)
        yield part, (codes >> np.uint32(32 - bits)).astype(np.int64), np.array([len(b) // 4 for b in blobs], np.int64)


def _sum_rows(rows: DataFrame, n_shards: int, v: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (shard, ids, counts) rows over the corpus: one shuffle of sparse counts, dense shares to the driver."""
    share = v // n_shards

    def add(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        if shard == n_shards:
            total = np.sum([np.frombuffer(x) for x in table.column("counts").to_pylist()], axis=0)
        else:
            total = np.zeros((share, width))
            for ids, counts in zip(table.column("ids").to_pylist(), table.column("counts").to_pylist()):
                total[np.frombuffer(ids, np.uint32).astype(np.int64) - shard * share] += np.frombuffer(counts, np.float32).reshape(-1, width)
        return pa.table({"shard": pa.array([shard], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    dense, rest = np.zeros((v, width)), np.zeros(0)
    for row in rows.groupBy("shard").applyInArrow(add, "shard int, counts binary").toLocalIterator():
        got = np.frombuffer(row["counts"])
        if row["shard"] == n_shards:
            rest = got
        else:
            dense[row["shard"] * share : (row["shard"] + 1) * share] = got.reshape(share, width)
    return dense, rest


def _send(dense: np.ndarray, rest: np.ndarray, n_shards: int) -> pa.RecordBatch:
    """The counts above 0 of a task, a row a shard; the few others in a shard of their own."""
    share = len(dense) // n_shards
    ids = np.flatnonzero(dense.any(1))
    cuts = np.searchsorted(ids, np.arange(n_shards + 1) * share)
    shard, keys, counts = [n_shards], [b""], [rest.astype(float).tobytes()]
    for s in range(n_shards):
        own = ids[cuts[s] : cuts[s + 1]]
        if len(own):
            shard.append(s)
            keys.append(own.astype(np.uint32).tobytes())
            counts.append(dense[own].astype(np.float32).tobytes())
    return pa.record_batch({"shard": pa.array(shard, pa.int32()), "ids": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})


def initial(unigram: np.ndarray, states: int) -> Model:
    """The word frequencies, shaken for each state by a hash of symbol and state."""
    v = len(unigram)
    noise = mix(np.arange(v * states, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)).astype(float).reshape(v, states) / 2.0**64
    emit = (unigram[:, None] + SMOOTH) * (0.5 + noise)
    move = np.full((states, states), 0.5 / states) + 0.5 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0), [])


def maximise(emits: np.ndarray, moves: np.ndarray, starts: np.ndarray, ll: list[float]) -> Model:
    emit, move, start = emits + SMOOTH, moves + SMOOTH, starts + SMOOTH
    return Model(start / start.sum(), move / move.sum(1)[:, None], emit / emit.sum(0), ll)


def encode(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, codes): the words of each document as 32-bit hashes; none for NULL, empty and blank texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "k1"):
                words = Words(part.column("k1"), lower=True)
                h = (words.hashes() >> np.uint64(32)).astype(np.uint32)
                yield pa.record_batch({"id": part.column("k0").cast(pa.int64()), "codes": pa.array([h[a:b].tobytes() for a, b in zip(words.off[:-1].tolist(), words.off[1:].tolist())], pa.binary())})

    return with_row_key(docs, [id_col, text_col]).mapInArrow(run, "id long, codes binary")


def train(encoded: DataFrame, states: int = STATES, rounds: int = ROUNDS, bits: int = BITS) -> Model:
    """Baum-Welch on every word of every document; each round is one pass and one shuffle of expected counts."""
    spark = encoded.sparkSession
    v, n_shards = 1 << bits, min(shards_for(text_bytes(encoded, "codes")), 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(v)
        for batch in batches:
            for _, codes, _ in _chunks(batch, bits):
                total += np.bincount(codes, minlength=v)
        yield _send(total[:, None], np.zeros(1), n_shards)

    columns = "shard int, ids binary, counts binary"
    model = initial(_sum_rows(encoded.mapInArrow(count, columns), n_shards, v, 1)[0][:, 0], states)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            emits, rest = np.zeros((v, states)), np.zeros(states * states + states + 1)
            for batch in batches:
                for _, codes, sizes in _chunks(batch, bits):
                    e, a, s, ll = expectations(codes, sizes, m)
                    emits += e
                    rest += np.concatenate((a.ravel(), s, [ll]))
            yield _send(emits, rest, n_shards)

        emits, rest = _sum_rows(encoded.mapInArrow(expect, columns), n_shards, v, states)
        shared.unpersist()
        if not len(rest):
            return model
        model = maximise(emits, rest[: states * states].reshape(states, states), rest[states * states : -1], [*model.log_likelihood, float(rest[-1])])
    return model


def score(encoded: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, log_likelihood, perplexity) of every row, without a shuffle."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, codes, sizes in _chunks(batch, m.bits):
                ll = log_likelihood(codes, sizes, m)
                ppl = np.exp(np.minimum(-ll / np.maximum(sizes, 1), 700))
                yield pa.record_batch({"doc_id": part.column("id"), "n_words": pa.array(sizes), "log_likelihood": pa.array(ll), "perplexity": pa.array(ppl, mask=sizes == 0)})

    return encoded.mapInArrow(run, "doc_id long, n_words long, log_likelihood double, perplexity double")


# ---------------------------------------------------------------- every word a symbol
_PARTS = "part long, ids array<long>, sizes binary, keys binary, codes binary"
_COUNTS = "shard int, part long, keys binary, counts binary"
#: What a shard sends back: to each part the emissions of its keys, times the state's total, and to part -1 the totals.
_EMITS = "part long, shard int, emits binary"


def encode_parts(docs: DataFrame, id_col: str, text_col: str, words: int = PART_WORDS) -> DataFrame:
    """Parts of at least ``words`` words, less at the end of a task: ids and sizes of the documents, the sorted
    64-bit keys of the distinct words, and each word as an index into them (byte planes, compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, many = TaskContext.get().partitionId(), 0, [], 0
        pack = zstandard.ZstdCompressor(3)

        def flush() -> pa.RecordBatch:
            keys, at = np.unique(np.concatenate([k for _, _, k, _ in held]), return_inverse=True)
            base = np.cumsum([0, *(len(k) for _, _, k, _ in held)])
            codes = np.concatenate([at[b + c] for b, (_, _, _, c) in zip(base, held)]).astype("<u4")
            planes = np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T).tobytes()
            ids = pa.concat_arrays([i for i, _, _, _ in held])
            sizes = np.concatenate([z for _, z, _, _ in held])
            return pa.record_batch({"part": pa.array([task << 32 | n], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "sizes": pa.array([sizes.tobytes()], pa.binary()), "keys": pa.array([keys.tobytes()], pa.binary()), "codes": pa.array([pack.compress(planes)], pa.binary())})

        for batch in batches:
            for piece in pieces(batch, "k1"):
                w = Words(piece.column("k1"), lower=True)
                keys = np.fromiter(map(xxhash.xxh3_64_intdigest, w.vocab), np.uint64, len(w.dictionary))
                held.append((piece.column("k0").cast(pa.int64()), np.diff(w.off), keys, w.codes))
                many += len(w.codes)
                if many >= words:
                    yield flush()
                    n, held, many = n + 1, [], 0
        if held:
            yield flush()

    return with_row_key(docs, [id_col, text_col]).mapInArrow(run, _PARTS)


def _open(part: dict) -> tuple[np.ndarray, Iterator[tuple[slice, np.ndarray, np.ndarray]]]:
    """The keys of a part, and its documents in slices of about ``CHUNK`` words: slice, codes, sizes."""
    keys, sizes = np.frombuffer(part["keys"], np.uint64), np.frombuffer(part["sizes"], np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(part["codes"]), np.uint8)
    codes = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    ends = np.cumsum(sizes)

    def slices() -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        at, done = 0, 0
        while at < len(sizes):
            stop = max(at + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
            yield slice(at, stop), codes[done : int(ends[stop - 1])], sizes[at:stop]
            at, done = stop, int(ends[stop - 1])

    return keys, slices()


def _to_key_shards(part: int, keys: np.ndarray, counts: np.ndarray, rest: np.ndarray, n_shards: int) -> pa.Table:
    """A part's counts, a row a shard (the leading bits of the key); the few others in a shard of their own."""
    top = np.arange(1, n_shards, dtype=np.uint64) << np.uint64(64 - int(math.log2(n_shards)))
    cuts = np.concatenate(([0], np.searchsorted(keys, top), [len(keys)]))
    rows = [(s, keys[a:b].tobytes(), counts[a:b].astype(np.float32).tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
    rows.append((n_shards, b"", rest.astype(float).tobytes()))
    s, k, c = zip(*rows)
    return pa.table({"shard": pa.array(s, pa.int32()), "part": pa.array([part] * len(rows), pa.int64()), "keys": pa.array(k, pa.binary()), "counts": pa.array(c, pa.binary())})


def _shake(keys: np.ndarray, counts: np.ndarray, states: int) -> np.ndarray:
    """First emissions: the word's frequency, shaken for each state by a hash of key and state."""
    noise = mix(keys[:, None] + np.arange(1, states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(float) / 2.0**64
    return (counts + SMOOTH) * (0.5 + noise)


def _exchange(counted: DataFrame, n_shards: int, states: int, first: bool) -> Table:
    """Sum the counts of each key over all parts and send each part the emissions of its own keys."""
    width = 1 if first else states

    def add(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        if shard == n_shards:
            rest = np.array([np.frombuffer(x) for x in table.sort_by("part").column("counts").to_pylist()]).sum(0)
            return pa.table({"part": pa.array([-1], pa.int64()), "shard": pa.array([shard], pa.int32()), "emits": pa.array([rest.tobytes()], pa.binary())})
        table = table.sort_by("part")  # sums do not depend on which part came first
        own = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        keys, at = np.unique(np.concatenate(own), return_inverse=True)
        cuts = np.cumsum([0, *map(len, own)]).tolist()
        total = np.zeros((len(keys), width))
        for a, b, x in zip(cuts[:-1], cuts[1:], table.column("counts").to_pylist()):
            total[at[a:b]] += np.frombuffer(x, np.float32).reshape(-1, width)
        emit = (_shake(keys, total, states) if first else total + SMOOTH).astype(np.float32)
        sums = np.append(emit.sum(0, dtype=float), len(keys))
        parts = [*table.column("part").to_pylist(), -1]
        emits = [emit[at[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:])] + [sums.tobytes()]
        return pa.table({"part": pa.array(parts, pa.int64()), "shard": pa.array([shard] * len(parts), pa.int32()), "emits": pa.array(emits, pa.binary())})

    return Table(counted.groupBy("shard").applyInArrow(add, _EMITS))


@dataclass
class Corpus:
    """A model whose emissions lie in ``emits``, a table of the shared folder; ``totals`` are each state's sum."""

    start: np.ndarray
    move: np.ndarray
    totals: np.ndarray
    n_symbols: int
    emits: Table
    log_likelihood: list[float]

    def of(self, right: pa.Table) -> Model:
        """The model over the keys of one part, from the rows that the shards sent it."""
        rows = right.sort_by("shard").column("emits").to_pylist()
        emit = np.frombuffer(b"".join(rows), np.float32).reshape(-1, len(self.start)) / self.totals
        return Model(self.start, self.move, emit, [])


def _gathered(emits: Table, n_shards: int, states: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Each state's total, the number of distinct words, and what the parts sent beside emissions."""
    totals, rest = np.zeros(states + 1), np.zeros(0)
    for row in emits.df.where("part = -1").orderBy("shard").toLocalIterator():
        if row["shard"] == n_shards:
            rest = np.frombuffer(row["emits"])
        else:
            totals += np.frombuffer(row["emits"])
    return totals[:states], int(totals[states]), rest


def train_words(parts: DataFrame, states: int = STATES, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Corpus:
    """Baum-Welch on every word of every document, each distinct word a symbol, until a round gains too little."""
    spark = parts.sparkSession
    n_shards = shards_for((1 + states / 2) * text_bytes(parts, "keys"))  # a key and its counts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1).to_pylist()[0]
                keys, slices = _open(part)
                total = np.zeros(len(keys))
                for _, codes, _ in slices:
                    total += np.bincount(codes, minlength=len(keys))
                yield from _to_key_shards(part["part"], keys, total[:, None], np.zeros(1), n_shards).to_batches()

    emits = _exchange(parts.mapInArrow(count, _COUNTS), n_shards, states, True)
    totals, n_symbols, _ = _gathered(emits, n_shards, states)
    move = np.full((states, states), 0.5 / states) + 0.5 * np.eye(states)
    model = Corpus(np.full(states, 1 / states), move, totals, n_symbols, emits, [])
    for _ in range(rounds if n_symbols else 0):
        light = _light(model)

        def expect(left: pa.Table, right: pa.Table) -> pa.Table:
            part, m = left.to_pylist()[0], light.of(right)  # noqa: B023 (sent to the tasks in this round)
            keys, slices = _open(part)
            counts, rest = np.zeros((len(keys), states)), np.zeros(states * states + states + 1)
            for _, codes, sizes in slices:
                e, a, s, ll = expectations(codes, sizes, m)
                counts += e
                rest += np.concatenate((a.ravel(), s, [ll]))
            return _to_key_shards(part["part"], keys, counts, rest, n_shards)

        emits = _exchange(_meet(parts, model).applyInArrow(expect, _COUNTS), n_shards, states, False)
        totals, _, rest = _gathered(emits, n_shards, states)
        model.emits.drop()
        release(spark)
        moves, starts = rest[: states * states].reshape(states, states) + SMOOTH, rest[states * states : -1] + SMOOTH
        model = Corpus(starts / starts.sum(), moves / moves.sum(1)[:, None], totals, n_symbols, emits, [*model.log_likelihood, float(rest[-1])])
        if len(model.log_likelihood) > 1 and model.log_likelihood[-1] - model.log_likelihood[-2] < tolerance * abs(model.log_likelihood[-2]):
            break
    return model


def _light(model: Corpus) -> Corpus:
    """The model without its table, to be sent to tasks."""
    return Corpus(model.start, model.move, model.totals, model.n_symbols, None, [])


def _meet(parts: DataFrame, model: Corpus):
    """Each part beside the emissions of its own keys."""
    return parts.groupBy("part").cogroup(model.emits.df.where("part >= 0").groupBy("part"))


def score_words(parts: DataFrame, model: Corpus) -> DataFrame:
    """(doc_id, n_words, log_likelihood, perplexity) of every row."""
    light = _light(model)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        part, m = left.to_pylist()[0], light.of(right)
        sizes = np.frombuffer(part["sizes"], np.int64)
        ll = np.zeros(len(sizes))
        for where, codes, own in _open(part)[1]:
            ll[where] = log_likelihood(codes, own, m)
        ppl = np.exp(np.minimum(-ll / np.maximum(sizes, 1), 700))
        return pa.table({"doc_id": pa.array(part["ids"], pa.int64()), "n_words": pa.array(sizes), "log_likelihood": pa.array(ll), "perplexity": pa.array(ppl, mask=sizes == 0)})

    return _meet(parts, model).applyInArrow(run, "doc_id long, n_words long, log_likelihood double, perplexity double")


def lm_score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, bits: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train the model on the documents and score each one: (doc_id, n_words, log_likelihood, perplexity).

    Training takes ``rounds`` rounds at most, fewer if one gains less than ``TOLERANCE`` of the log-likelihood.

    Words are split at whitespace and lower-cased; each distinct word is a symbol, known by a 64-bit hash.  With
    ``bits`` they are folded to 2 ** bits symbols instead, and words may share one.  The likelihood is that of the
    whole text.  NULL, empty and blank texts are empty sequences: likelihood 1, hence a log of 0, and a NULL
    perplexity.  Rows with a NULL id are trained on and scored under a NULL doc_id; repeated rows count each and
    score alike.  Other columns are ignored.  An empty table gives an empty result.
    """
    if bits is not None:
        encoded = Table(encode(docs, id_col, text_col))
        return score(encoded.df, train(encoded.df, states, rounds, bits))
    parts = Table(encode_parts(docs, id_col, text_col))
    return score_words(parts.df, train_words(parts.df, states, rounds))
