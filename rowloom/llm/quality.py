"""Quality classifier (operator 8): Bradley-Terry ranking of documents, cut at a score quantile."""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rowloom.llm.common import KEY_BITS, Table, Words, frequent, mix, pieces, shards_for, to_shards, with_row_key

#: At most so many labelled documents of each side (preferred or not) are fitted on.
TRAIN_DOCS = 4000
#: Preferred documents that each other one is compared with.
PAIRS_EACH = 6
#: A word is a feature if so many documents of the sample hold it.
MIN_DOCS = 10
#: One labelled document in so many is held out of the fit, to set the threshold by.
HELD_OUT = 4
#: The shares of preferred documents under the threshold that are tried.
QUANTILES = [i / 1000 for i in range(201)]
#: Scores are counted in so many bins of equal width; the threshold is the edge of one.
BINS = 1 << 16
#: The share if no document that is not preferred is held out.
QUANTILE = 0.002
#: Beginnings of rare words are features if at most this share of documents hold them.
RARE = 0.08
ROUNDS = 120
#: Bytes of text scored at a time, and words whose features a task remembers.
SCORE_BYTES, SEEN_WORDS = 2 << 20, 200_000
L2 = 1e-3

_UPPER, _DIGIT, _BANG, _BAR, _MARK, _SPACE, _LINE, _STOP, _OTHER = range(9)
_CLASS = np.full(256, _OTHER, np.uint8)
for _chars, _to in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"0123456789", _DIGIT), (b"!?", _BANG), (b"|<>{}[]\\/=_~", _BAR), (b"#$%&*@^+", _MARK), (b" \t", _SPACE), (b"\n\r", _LINE), (b".,;:", _STOP)):
    _CLASS[list(_chars)] = _to
NUMERIC = 13


def numeric_features(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """One row a document: logs of length, shares of byte classes, word lengths and repetition; and the distinct
    (document << 32 | word) pairs."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    size = np.diff(off)
    x = np.zeros((len(texts), NUMERIC))
    classes = _CLASS[data]
    for c in range(8):
        run = np.concatenate(([0], np.cumsum(classes == c)))
        x[:, c] = np.sqrt((run[off[1:]] - run[off[:-1]]) / np.maximum(size, 1))
    n = np.diff(words.off)
    doc = np.repeat(np.arange(len(texts)), n)
    x[:, 8] = np.log1p(n) / 5
    x[:, 9] = np.minimum(size / np.maximum(n, 1), 40) / 10
    # distinct words and the commonest word, from sorted (document, word) pairs
    pair = np.sort(doc.astype(np.int64) << 32 | words.codes.astype(np.int64))
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(pair)))
    at = (pair[first] >> 32).astype(np.int64) if len(pair) else np.empty(0, np.int64)
    distinct = np.bincount(at, minlength=len(texts))
    most = np.zeros(len(texts))
    np.maximum.at(most, at, times)
    x[:, 10] = distinct / np.maximum(n, 1)
    x[:, 11] = most / np.maximum(n, 1)
    x[:, 12] = n == 0
    return x, pair[first]


def _bare(word: str) -> str:
    return word.strip(".,;:!?\"'()")


def _beginnings(word: str) -> tuple[str, ...]:
    """What stands for a word that too few documents hold: its first four and five letters."""
    return (f"^{word[:4]}", f"^{word[:5]}") if len(word) > 5 else (f"^{word[:4]}",)


def _features(word: str, lexicon: dict[str, int]) -> list[int]:
    own = lexicon.get(word)
    return [i for f in _beginnings(word) if (i := lexicon.get(f)) is not None] if own is None else [own]


def _expand(doc: np.ndarray, word: np.ndarray, features: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, feature) pairs of (document, word) pairs, as two arrays."""
    many = np.fromiter(map(len, features), np.int64, len(features))
    flat, first = np.array([c for f in features for c in f], np.int64), np.cumsum(many) - many
    reps = many[word]
    inside = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
    pair = np.unique(np.repeat(doc, reps).astype(np.int64) << 32 | flat[np.repeat(first[word], reps) + inside])
    return pair >> 32, pair & 0xFFFFFFFF


def _expand_all(doc: np.ndarray, word: np.ndarray, features: list[list[int]], step: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """``_expand`` of rising documents, ``step`` of them at a time: what it needs in between stays small."""
    cuts = np.append(np.searchsorted(doc, np.arange(0, int(doc[-1]) + 1, step)), len(doc)) if len(doc) else np.zeros(1, np.int64)
    parts = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b > a:
            own, at = np.unique(word[a:b], return_inverse=True)
            d, c = _expand(doc[a:b], at, [features[w] for w in own.tolist()])
            parts.append((d.astype(np.int32), c.astype(np.int32)))
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


@dataclass
class Ranker:
    """score(d) = numeric . w + the weights of d's distinct words and, for rare words, of their distinct beginnings."""

    w: np.ndarray
    lexicon: dict[str, float] = field(default_factory=dict)
    threshold: float = -np.inf
    #: Of the labelled documents held out: the preferred ones under the threshold, and the others under it.
    lost: float | None = None
    caught: float | None = None

    def __post_init__(self) -> None:
        self.number = {f: i for i, f in enumerate(self.lexicon)}
        self.weights = np.fromiter(self.lexicon.values(), np.float64, len(self.lexicon))

    def scores(self, texts: pa.Array, seen: dict[str, list[int]]) -> np.ndarray:
        """The score of each text.  ``seen`` remembers the features of words between calls."""
        words = Words(texts)
        x, pair = numeric_features(texts, words)
        out = x @ self.w
        if len(pair) and len(self.weights):
            if len(seen) > SEEN_WORDS:
                seen.clear()
            features = []
            for w in words.vocab:
                got = seen.get(w)
                if got is None:
                    got = seen[w] = _features(_bare(w.lower()), self.number)
                features.append(got)
            doc, col = _expand(pair >> 32, pair & 0xFFFFFFFF, features)
            out += np.bincount(doc, weights=self.weights[col], minlength=len(texts))
        return out


def _bradley_terry(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, n_words: int, good: np.ndarray, bad: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Weights that minimise mean log(1 + exp(s_bad - s_good)) + L2, by accelerated gradient descent."""
    a = rng.choice(good, (len(bad), PAIRS_EACH)).ravel()
    b = np.repeat(bad, PAIRS_EACH)
    n, d = x.shape
    w = np.zeros(d + n_words)
    look, speed = w.copy(), 1.0
    scale = np.bincount(cols, minlength=n_words).astype(float)
    step = np.concatenate((np.full(d, 2.0), 2.0 / np.sqrt(np.maximum(scale, 1) / max(n, 1) + 0.01)))
    step /= 4
    for _ in range(ROUNDS):
        s = x @ look[:d] + np.bincount(rows, weights=look[d:][cols], minlength=n)
        p = 1 / (1 + np.exp(np.clip(s[a] - s[b], -40, 40)))
        g = (np.bincount(b, weights=p, minlength=n) - np.bincount(a, weights=p, minlength=n)) / len(a)
        grad = np.concatenate((g @ x, np.bincount(cols, weights=g[rows], minlength=n_words))) + L2 * look
        new = look - step * grad
        nxt = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        look, w, speed = new + (speed - 1) / nxt * (new - w), new, nxt
    return w[:d], w[d:]


def set_threshold(model: Ranker, held: DataFrame, quantile: float | None = None) -> None:
    """The threshold from (score, ok) of documents that the model was not fitted on.

    Of the quantiles of the preferred documents' scores, that with the least sum of the share of preferred
    documents lost and the share of others missed; the smallest of equals.  A given ``quantile`` is taken as it is.
    Scores are counted in ``BINS`` bins between the least and the greatest, so no task sees them all: the quantiles
    are exact to the width of a bin.
    """
    least, most, goods, all_ = held.agg(F.min("score"), F.max("score"), F.count_if("ok"), F.count("*")).first()
    if not goods:
        return
    width = (most - least) / BINS or 1.0
    counts = np.zeros((2, BINS + 1))
    at = F.least(F.floor((F.col("score") - F.lit(least)) / F.lit(width)), F.lit(BINS - 1)).cast("int")
    for row in held.groupBy("ok", at.alias("bin")).count().toLocalIterator():
        counts[int(row["ok"]), row["bin"]] += row["count"]
    # shares under the lower edge of each bin
    bad, good = (np.concatenate(([0], np.cumsum(c)[:-1])) / max(c.sum(), 1) for c in counts)
    tried = QUANTILES if quantile is None else [quantile]
    if quantile is None and goods == all_:
        tried = [QUANTILE]
    edges = np.maximum(np.searchsorted(good, np.array(tried) + 1e-12, side="right") - 1, 0)
    best = int(edges[np.argmin(good[edges] + 1 - bad[edges])])
    model.threshold, model.lost = float(least + best * width), float(good[best])
    model.caught = float(bad[best]) if goods < all_ else None


def fit(docs: DataFrame, labels: DataFrame, quantile: float | None = None, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> Ranker | None:
    """Learn scores from preferences: a document labelled good and not toxic is preferred to one that is neither.

    ``train_docs`` labelled documents of each side, those with the smallest hash of their id, are fitted on (the
    only sample that is taken; its size does not grow).  One labelled document in ``HELD_OUT`` is never fitted on;
    all of these set the threshold (see ``set_threshold``).  A document with contradicting labels counts as not preferred.  Labels with NULLs
    in id or quality are left out; a NULL toxic counts as 0.  Returns None if either side is missing, when there
    is nothing to rank by.
    """
    lab = with_row_key(labels, [id_col, "quality", "toxic"]).select(F.col("k0").alias("i"), F.expr("k1 = 1 and coalesce(k2, 0) = 0").alias("ok")).where("i is not null and ok is not null").groupBy("i").agg(F.min("ok").alias("ok"))
    held_out = F.pmod(F.xxhash64("i", F.lit("held out")), F.lit(HELD_OUT)) == 0
    src = with_row_key(docs, [id_col, text_col]).where("k1 is not null")
    # the smallest hashes of each side: take() of a sorted column is a bounded heap a task
    known = lab.join(src.select(F.col("k0").alias("i")), "i", "left_semi")
    picked = [known.where((F.col("ok") == ok) & ~held_out).orderBy(F.xxhash64("i"), "i").limit(train_docs) for ok in (True, False)]
    sample = src.join(F.broadcast(picked[0].union(picked[1])), F.col("k0") == F.col("i")).groupBy("k0").agg(F.min(F.struct(F.xxhash64("k1"), "k1"))["k1"].alias("k1"), F.first("ok").alias("ok"))
    rows = sorted(sample.toLocalIterator(), key=lambda r: r["k0"])
    ok = np.array([r["ok"] for r in rows], bool)
    if not ok.any() or ok.all():
        return None
    xs, docs_at, words_at, vocab = [], [], [], {}
    texts = pa.record_batch({"t": pa.array([r["k1"] for r in rows], pa.string())})
    n_rows = len(rows)
    del rows
    for part in pieces(texts, "t", SCORE_BYTES):
        xs.append(numeric_features(part.column("t"), Words(part.column("t")))[0])
        words = Words(part.column("t"), lower=True)
        ids = np.array([vocab.setdefault(_bare(w), len(vocab)) for w in words.vocab], np.int64)
        base = sum(len(x) for x in xs[:-1])
        pair = np.unique((np.repeat(np.arange(len(xs[-1])), np.diff(words.off)) + base) << 32 | ids[words.codes])
        docs_at.append((pair >> 32).astype(np.int32))
        words_at.append((pair & 0xFFFFFFFF).astype(np.int32))
    x, at, word = np.concatenate(xs), np.concatenate(docs_at), np.concatenate(words_at)
    del texts, xs, docs_at, words_at
    names = list(vocab)
    held = np.bincount(word, minlength=len(names))
    known = [w for w, n in zip(names, held.tolist()) if n >= MIN_DOCS and w]
    starts = {f: len(known) + i for i, f in enumerate(dict.fromkeys(f for w, n in zip(names, held.tolist()) if n < MIN_DOCS for f in _beginnings(w)))}
    every = {**{w: i for i, w in enumerate(known)}, **starts}
    _, col = _expand_all(at, word, [_features(w, every) for w in names])
    share = np.bincount(col, minlength=len(every))
    lexicon = {f: i for i, f in enumerate(f for f, i in every.items() if i < len(known) or MIN_DOCS <= share[i] <= RARE * n_rows)}
    doc, col = _expand_all(at, word, [_features(w, lexicon) for w in names])
    w, lw = _bradley_terry(x, doc, col, len(lexicon), np.flatnonzero(ok), np.flatnonzero(~ok), np.random.default_rng(seed))
    model = Ranker(w, {k: float(lw[i]) for k, i in lexicon.items() })
    held = Table(_score_some(src, lab.where(held_out), model))
    set_threshold(model, held.df, quantile)
    held.drop()
    return model


def _score_some(src: DataFrame, lab: DataFrame, model: Ranker) -> DataFrame:
    """(score, ok) of the rows whose id is in ``lab``.  A bitmap of the ids says where a row need not be scored; the
    others are scored where they lie, and only ids and scores meet the labels."""
    drop = np.uint64(64 - KEY_BITS)

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        return mix(pc.fill_null(batch.column(0).cast(pa.int64()), -1).to_numpy(zero_copy_only=False).view(np.uint64)) >> drop

    n_shards = shards_for(8 * lab.count())

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(to_shards(keys(batch), n_shards))
            if rows:
                yield pa.record_batch({"shard": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})

    spark = src.sparkSession
    asked = spark.sparkContext.broadcast(frequent(lab.select("i").mapInArrow(key, "shard int, payload binary"), [1], n_shards))

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(asked.value.has(0, keys(batch))))

    few = src.select(F.col("k0").cast("long").alias("k0"), "k1")
    return score(few, model, "k0", "k1", only).join(lab, F.col("doc_id") == F.col("i")).select("score", "ok")


def score(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text", only=None) -> DataFrame:
    """(doc_id, score) of every row, in one pass without a shuffle.  ``only`` may thin out the batches first."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in only(batches) if only else batches:
            for part in pieces(batch, "k1", SCORE_BYTES):
                yield pa.record_batch({"doc_id": part.column("k0").cast(pa.int64()), "score": pa.array(shared.value.scores(part.column("k1"), seen))})

    return with_row_key(docs, [id_col, text_col]).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Ranker | None, text_col: str = "text", with_score: bool = False) -> DataFrame:
    """The rows that score at least the model's threshold, with all their columns (and ``score`` if asked).

    NULL texts are rejected: there is nothing to judge.  Empty texts are scored like any other.  Equal scores
    are kept or rejected together; repeated rows likewise.  Columns of any name and type pass through; with
    ``with_score`` one named ``score`` is replaced.  An empty table gives an empty table.
    Without a model (no preference could be learnt) every row with a text is kept, with a NULL score.
    """
    names = [c for c in docs.columns if not (with_score and c == "score")]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    text = f"c{names.index(text_col)}"
    plain = plain.where(F.col(text).isNotNull())
    if model is None:
        kept = plain.withColumn("s", F.lit(None).cast("double"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        schema = StructType([*plain.schema.fields, StructField("s", DoubleType())])

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, seen = shared.value, {}
            for batch in batches:
                for part in pieces(batch, text, SCORE_BYTES):
                    s = m.scores(part.column(text), seen)
                    yield from pa.Table.from_batches([part]).append_column("s", pa.array(s)).filter(pa.array(s >= m.threshold)).to_batches()

        kept = plain.mapInArrow(rank, schema)
    return kept.toDF(*names, "score") if with_score else kept.drop("s").toDF(*names)
