"""What the corpus operators share: the shared folder, vectorised word streams, packed exchanges.

Per-token work happens in NumPy over Arrow batches.  Instead of one JVM row a token, a task sends
one binary row per (block, shard): sorted 48-bit keys, delta-coded in byte planes so that the
shuffle's LZ4 squeezes the empty planes out.
"""

from __future__ import annotations

import atexit
import gc
import math
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at a time.
PIECE_BYTES = 6 << 20
KEY_BITS = 48
_own_dirs: dict[str, str] = {}


# ---------------------------------------------------------------- shared folder
def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="rowloom-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Table:
    """A DataFrame written once to the shared folder: lineage ends there and survives lost executors."""

    def __init__(self, df: DataFrame, codec: str = "zstd"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/rowloom/{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.option("compression", codec).parquet(self.path)
        atexit.register(self._quietly_drop)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; call it when no DataFrame over them will run any more."""
        _delete(self.spark, self.path)
        atexit.unregister(self._quietly_drop)

    def _quietly_drop(self) -> None:
        try:
            _delete(self.spark, self.path)
        except Exception:  # the session may be gone at interpreter exit
            pass


#: Bytes that one shard of an exchange holds, about.
SHARD_BYTES = 8 << 20


def shards_for(size: float, each: int = SHARD_BYTES) -> int:
    """A power of two: so many shards that each gets about ``each`` of ``size`` bytes; 4 at least, 2**20 at most."""
    return 1 << min(20, max(2, math.ceil(math.log2(max(size, 1) / each))))


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are done: they leave the disk with the driver's garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(df: DataFrame, col: str) -> int:
    """The bytes of a text column, from one scan of it."""
    return df.agg(F.sum(F.octet_length(col))).first()[0] or 0


def n_words(text: str) -> Column:
    """How many words ``Words`` finds in a column: the same white space, Unicode's and the four separators of ASCII."""
    return F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(F.col(text), F.lit(r"(?U)[^\s\x1c-\x1f]+"))).cast("long")


# ---------------------------------------------------------------- word streams
def pieces(batch: pa.RecordBatch, col: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of ``col``; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        base, start = int(ends[stop - 1]), stop


class Words:
    """The whitespace-separated words of a column: ``codes`` into ``vocab``; document d holds ``off[d]:off[d+1]``.

    With ``sep`` only spaces and line ends separate: for texts that were split before.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, sep: bool = False):
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pc.utf8_lower(texts)
        if sep:
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
        off = split.offsets.to_numpy().astype(np.int64)
        flat = split.flatten()
        empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
        if empty.any():
            off = off - np.concatenate(([0], np.cumsum(empty)))[off]
            flat = flat.filter(pa.array(~empty))
        enc = flat.dictionary_encode()
        self.off, self.codes = off - off[0], enc.indices.to_numpy(zero_copy_only=False)
        self.dictionary = enc.dictionary

    @property
    def vocab(self) -> list[str]:
        return self.dictionary.to_pylist()

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash for each word."""
        h = xxhash.xxh3_64_intdigest
        return np.fromiter((h(w, seed) for w in self.vocab), np.uint64, len(self.dictionary))[self.codes] if len(self.codes) else np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every k consecutive items (those at the end would run over; they are left out)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : j + n]
    return mix(out)


def starts_within(off: np.ndarray, size: int) -> np.ndarray:
    """Mask over positions: a window of ``size`` items that starts there stays inside its document."""
    ok = np.zeros(int(off[-1]), bool)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a >= size:
            ok[a : b - size + 1] = True
    return ok


# ---------------------------------------------------------------- packed exchange of keys
def pack_keys(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct 48-bit keys with their counts, as byte planes of deltas."""
    d = np.diff(keys, prepend=np.uint64(0))
    width = 4 if not len(d) or int(d[1:].max(initial=0)) < 1 << 32 else 8
    first = int(keys[0]) if len(keys) else 0
    if len(d):
        d[0] = 0
    planes = np.ascontiguousarray(d.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T.tobytes()
    kind = np.uint8 if int(counts.max(initial=0)) < 256 else np.dtype("<u4")
    return len(keys).to_bytes(8, "little") + first.to_bytes(8, "little") + bytes([width | np.dtype(kind).itemsize << 4]) + planes + counts.astype(kind).tobytes()


def unpack_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, first, width, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little"), blob[16] & 15, blob[16] >> 4
    planes = np.frombuffer(blob, np.uint8, n * width, 17).reshape(width, n)
    d = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64)
    if n:
        d[0] = first
    return np.cumsum(d, dtype=np.uint64), np.frombuffer(blob, f"<u{size}", n, 17 + n * width)


def to_shards(keys: np.ndarray, n_shards: int) -> Iterator[tuple[int, bytes]]:
    """Rows (shard, payload) of one block's 48-bit keys; a key counts once for each time it is given."""
    keys, counts = np.unique(keys, return_counts=True)
    shift = np.uint64(KEY_BITS - int(math.log2(n_shards)))
    cuts = np.searchsorted(keys, (np.arange(n_shards + 1, dtype=np.uint64) << shift))
    for s in range(n_shards):
        a, b = cuts[s], cuts[s + 1]
        if b > a:
            yield s, pack_keys(keys[a:b], counts[a:b])


class Frequent:
    """Which keys at least ``levels[i]`` documents hold.

    The first levels are bitmaps over the keys' leading bits.  They hold eight bits for each key of the lowest level,
    at most ``2**max_bits``; keys that share a bit are taken for frequent.  That only costs work, as every answer is
    verified later: it never drops a pair or a window.  Further levels are the sorted keys themselves.
    """

    def __init__(self, bits: int, maps: list[np.ndarray], lists: list[np.ndarray]):
        self.bits, self.maps, self.lists = bits, maps, lists

    def has(self, level: int, keys: np.ndarray) -> np.ndarray:
        if level >= len(self.maps):
            known = self.lists[level - len(self.maps)]
            if not len(known):
                return np.zeros(len(keys), bool)
            return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
        at = keys >> np.uint64(KEY_BITS - self.bits)
        return (self.maps[level][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def frequent(keyed: DataFrame, levels: list[int], n_shards: int, max_bits: int = 30, rare: tuple[int, ...] = ()) -> Frequent:
    """Count the keys of rows (shard int, payload binary) over the whole input and map the frequent ones.

    ``levels`` become bitmaps, the levels ``rare`` above them lists: so few keys are held so often that all of them fit.
    """
    n_maps, levels = len(levels), [*levels, *rare]

    def count(table: pa.Table) -> pa.Table:
        got = [unpack_keys(x) for x in table.column("payload").to_pylist()]
        keys = np.concatenate([k for k, _ in got])
        counts = np.concatenate([c for _, c in got]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        total, keys = np.add.reduceat(counts, first), keys[first]
        keep = total >= levels[0]
        rank = np.zeros(int(keep.sum()), np.uint8)
        for i, least in enumerate(levels):
            rank[total[keep] >= least] = i + 1
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "n": pa.array([int(keep.sum())], pa.int64()), "payload": pa.array([pack_keys(keys[keep], rank)], pa.binary())})

    kept = Table(keyed.groupBy("shard").applyInArrow(count, "shard int, n long, payload binary"))
    n = kept.df.agg(F.sum("n")).first()[0] or 0
    bits = min(max_bits, max(int(math.log2(n_shards)) + 3, math.ceil(math.log2(8 * n + 8))))
    share = 1 << (bits - int(math.log2(n_shards)))

    def to_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("payload").to_pylist()):
                keys, rank = unpack_keys(blob)
                at = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int64) - shard * share
                maps = []
                for i in range(n_maps):
                    m = np.zeros(share, np.uint8)
                    m[at[rank > i]] = 1
                    maps.append(zlib.compress(np.packbits(m, bitorder="little").tobytes(), 1))
                lists = [keys[rank > i].tobytes() for i in range(n_maps, len(levels))]
                yield pa.record_batch({"shard": pa.array([shard], pa.int32()), "maps": pa.array([maps], pa.list_(pa.binary())), "lists": pa.array([lists], pa.list_(pa.binary()))})

    maps, lists = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(n_maps)], [[np.empty(0, np.uint64)] for _ in rare]
    for row in kept.df.mapInArrow(to_maps, "shard int, maps array<binary>, lists array<binary>").toLocalIterator():
        for m, blob in zip(maps, row["maps"]):
            part = np.frombuffer(zlib.decompress(blob), np.uint8)
            m[row["shard"] * len(part) : (row["shard"] + 1) * len(part)] = part
        for x, blob in zip(lists, row["lists"]):
            x.append(np.frombuffer(blob, np.uint64))
    kept.drop()
    return Frequent(bits, maps, [np.sort(np.concatenate(x)) for x in lists])


# ---------------------------------------------------------------- connected components
def components(edges: DataFrame) -> Table:
    """(a, b) edges to (id, root): the smallest id of each connected component, for every id that has an edge.

    Alternates large-star and small-star steps (each one grouping shuffle, no edge ever held on the
    driver) until nothing changes; every round is a table in the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(low, "a")
        if large:
            out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def sign(t: Table) -> tuple:
        return tuple(t.df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = Table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = sign(now)
    while True:
        nxt = Table(star(star(now.df, True), False))
        now.drop()
        now, seen = nxt, sign(nxt)
        if seen == before:
            break
        before = seen
    stars = now.df
    out = Table(stars.select(F.col("a").alias("id"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()))
    now.drop()
    return out


def with_row_key(df: DataFrame, cols: list[str]) -> DataFrame:
    """Only ``cols``, under the names k0, k1, ...: extra columns of the caller can't clash with ours."""
    return df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(cols)])


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
