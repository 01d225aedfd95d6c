"""N-gram Jaccard join with token-combination prefixes (operator 4).

A document is its set of distinct word n-grams.  Those are put in one global order: n-grams that no
other document has, then rare ones, then frequent ones.  ``|x & y| >= t |x|`` for every partner of x, so
at most ``slack = |x| - ceil(t |x|)`` of its n-grams are missing from a partner.

* If the first ``slack + 1`` n-grams hold no frequent one, they are the prefix; each is a signature.
* Else the prefix is extended.  Frequent n-grams fall into G sub-classes by hash, and in each only
  *pairs* are signatures: whoever wants to remove every common pair of a sub-class with m prefix
  n-grams has to remove m - 1 of them.  The prefix ends where these sums pass the slack, so a partner
  must share a rare n-gram or a pair.  G depends on the size class of the pair's smaller document, so
  that both sides form the same pairs; below ``SINGLES`` n-grams every n-gram is a signature.

N-grams that only one document has fill prefixes but are never sent, hence text without copies costs
next to nothing after the counting pass.  Documents with the same set are one *node* from there on, so a
group of copies weighs as much as one text.  Signatures that one node has alone are dropped before
anything is sent for them.  Nodes that share a signature, and whose bitmaps do not rule out the
threshold, form components; each node's set is sent once to its component (to a few tiles of it, when it is
large), where all pairs are verified exactly on the whole sets.  The verified pairs give the classes.
"""


from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import KEY_BITS, Frequent, Table, Words, components, frequent, mix, pieces, rolling, shards_for, text_bytes, to_shards, with_row_key

N, THRESHOLD, FREQUENT = 3, 0.5, 64
SINGLES = 16
TILE = 1024
#: Nodes of one signature that meet in one task; a signature that more have is cut into pairs of chunks.
HOT_NODES = 1 << 15
#: Each level is so many times the nodes of the one before; a level has so many more chunks.
HOT_STEP, HOT_LEVELS = 8, 6
_DROP = np.uint64(64 - KEY_BITS)


def shingles(words: Words, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each document; one shorter than n words is a single n-gram."""
    h = words.hashes()
    grams = rolling(h, n)
    out = []
    for a, b in zip(words.off[:-1].tolist(), words.off[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(rolling(h[a:b], b - a) if b > a else h[:0])
    return out


def _id_keys(batch: pa.RecordBatch) -> np.ndarray:
    return mix(batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64)) >> _DROP


def scheme(size: int) -> int:
    return size.bit_length() - 1


def signatures(s: np.ndarray, freq: Frequent, t: float) -> np.ndarray:
    """Hashes of the prefix signatures of the set s."""
    keys = s >> _DROP
    common = freq.has(0, keys)
    hot = freq.has(1, keys) & common
    m = len(s)
    slack = m - math.ceil(t * m - 1e-9)
    n_cold = m - int(hot.sum())
    unique = int((~common).sum())
    if unique > slack:
        return s[:0]
    rare = s[common & ~hot]
    if n_cold >= slack + 1:
        return rare[: slack + 1 - unique]
    hots = s[hot]
    out = [rare]
    for sch in range(scheme(math.ceil(t * m - 1e-9)), scheme(m) + 1):
        if 1 << sch < SINGLES:
            out.append(hots)
            continue
        groups: dict[int, list[int]] = {}
        g, sums = (1 << sch) // 8, n_cold
        for h, sub in zip(hots.tolist(), (hots % np.uint64(g)).tolist()):
            sums += sub in groups
            groups.setdefault(sub, []).append(h)
            if sums > slack:
                break
        for members in groups.values():
            if len(members) > 1:
                ab = np.array(list(combinations(members, 2)), np.uint64)
                out.append(mix(ab[:, 0] * np.uint64(3) + mix(ab[:, 1] + np.uint64(sch))))
    return np.concatenate(out)


def _map_words(sizes: np.ndarray) -> np.ndarray:
    """64-bit words of the bitmap of a set of so many n-grams: two bits for each, rounded up to a power of two."""
    return np.maximum(1, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64) >> 6)


def bitmap(s: np.ndarray) -> bytes:
    """The set's n-grams by their low bits."""
    n = 64 * int(_map_words(np.array([len(s)]))[0])
    bits = np.zeros(n, bool)
    bits[s & np.uint64(n - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def linked(sig: np.ndarray, row: np.ndarray, ids: np.ndarray, sizes: np.ndarray, maps: bytes, t: float) -> np.ndarray:
    """Star edges (id, id) of the components of the documents that share a signature and may be similar enough.

    Document ``row[i]`` has the signature ``sig[i]``.  Every bit of x's bitmap that y's lacks is an n-gram of x that
    y lacks, so ``|x & y| <= |x| - bits(x, not y)``; a pair that this rules out is no edge.  Nor is a pair looked at
    that is connected already, hence copies cost one comparison each.
    """
    n_words = _map_words(sizes)
    off = np.cumsum(n_words) - n_words
    flat = np.frombuffer(maps, np.uint64)
    level = np.log2(n_words).astype(np.int64)
    at = np.empty(len(ids), np.int64)
    own: dict[int, np.ndarray] = {}
    half: dict[int, np.ndarray] = {}
    for v in np.unique(level).tolist():
        who = np.flatnonzero(level == v)
        at[who] = np.arange(len(who))
        own[v] = flat[off[who][:, None] + np.arange(1 << v)]
        if v:
            half[v] = own[v][:, : 1 << v >> 1] | own[v][:, 1 << v >> 1 :]
    parent = list(range(len(ids)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def may_match(i: int, others: np.ndarray) -> np.ndarray:
        m, mine = int(sizes[i]), int(level[i])
        others = others[(sizes[others] >= t * m - 1e-9) & (t * sizes[others] <= m + 1e-9)]
        found = []
        for v in (mine - 1, mine, mine + 1, mine + 2, mine - 2):
            ys = others[level[others] == v]
            if not len(ys):
                continue
            if abs(v - mine) > 1:
                found.append(ys)  # sizes so far apart only meet at low thresholds; the verification decides
                continue
            x = half[mine][at[i]] if v < mine else own[mine][at[i]]
            y = half[v][at[ys]] if v > mine else own[v][at[ys]]
            most = np.minimum(m - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), sizes[ys] - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
            found.append(ys[most * (1 + t) >= t * (m + sizes[ys]) - 1e-9])
        return np.concatenate(found) if found else others[:0]

    order = np.lexsort((row, sig))
    sig, row = sig[order], row[order]
    cuts = np.append(np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))), len(sig))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a < 2:
            continue
        group = row[a:b]
        root = np.array([find(i) for i in group.tolist()])
        for k in range(b - a - 1):
            other = root[k + 1 :] != root[k]
            if not other.any():
                if (root == root[0]).all():
                    break
                continue
            hit = may_match(int(group[k]), group[k + 1 :][other])
            for j in hit.tolist():
                r, q = find(int(group[k])), find(j)
                if r != q:
                    parent[max(r, q)] = min(r, q)
            if len(hit):
                root = np.array([find(i) for i in group.tolist()])
    edge = [(int(ids[find(i)]), int(ids[i])) for i in range(len(ids)) if find(i) != i]
    return np.array(edge, np.int64).reshape(-1, 2)


def _pairs(sets: list[np.ndarray], left: range, right: range, t: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, js, common, total) with Jaccard >= t for i in left and js in right, each pair once."""
    if not left or not right:
        return
    sizes = np.array([len(x) for x in sets], np.int64)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    code = code.astype(np.int32)
    off = np.concatenate(([0], np.cumsum(sizes)))
    mark = np.zeros(int(code.max()) + 1, np.int32)
    same = left == right
    for i in left:
        lo = i + 1 if same else right[0]
        if lo > right[-1]:
            continue
        mark[code[off[i] : off[i + 1]]] = 1
        common = np.add.reduceat(mark[code[off[lo] : off[right[-1] + 1]]], off[lo : right[-1] + 1] - off[lo]).astype(np.int64)
        total = sizes[i] + sizes[lo : right[-1] + 1] - common
        hit = np.flatnonzero(common >= t * total - 1e-9)
        if len(hit):
            yield i, lo + hit, common[hit], total[hit]
        mark[code[off[i] : off[i + 1]]] = 0


def _hot_chunks(level: int) -> int:
    """The chunks of a signature of the level: enough that each has ``HOT_NODES`` nodes at most, by the next level."""
    return HOT_STEP**level if level else 1


class Search:
    """The verified neighbourhoods of a table.

    ``members`` (id, text, node): the rows that may have a neighbour, each with the hash of its text and the node of
    its set.  ``nodes`` (node, rep, n): the smallest id of a set and how many rows have it.  ``hits(emit)`` runs
    ``emit(nodes, sets, left, right, weights)`` over every tile in which pairs may be similar.
    """

    def __init__(self, docs: DataFrame, n: int, t: float, hot: int, id_col: str, text_col: str, tile: int):
        if not 0.25 <= t <= 1:
            raise ValueError("t must lie between 0.25 and 1")
        self.n, self.t, self.tile = n, t, tile
        spark = self.spark = docs.sparkSession
        self.src = with_row_key(docs, [id_col, text_col]).where("k0 is not null and k1 is not null").withColumn("k2", F.xxhash64("k1"))
        size = text_bytes(self.src, "k1")
        n_shards = shards_for(size)
        src = self.src

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "k1"):
                    yield from _shard_rows(np.concatenate(shingles(Words(part.column("k1"), lower=True), n)) >> _DROP, n_shards)

        freq = spark.sparkContext.broadcast(frequent(src.select("k0", "k1").mapInArrow(count, "shard int, payload binary"), [2, hot], n_shards))

        def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = freq.value
            for batch in batches:
                for part in pieces(batch, "k1"):
                    sets = shingles(Words(part.column("k1"), lower=True), n)
                    rows = [(i, h, _digest(s), len(s), bitmap(s), sig.tobytes()) for i, h, s in zip(part.column("k0").to_pylist(), part.column("k2").to_pylist(), sets) if len(s) and len(sig := signatures(s, f, t))]
                    if rows:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()))], names=["id", "text", "digest", "size", "map", "sigs"])

        found = Table(src.mapInArrow(candidates, "id long, text long, digest binary, size long, map binary, sigs binary"))
        freq.unpersist()
        one = found.df.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("map").alias("map"), F.first("sigs").alias("sigs"))
        # numbered as written: what reads the table later sees the same numbers
        self._nodes = Table(one.withColumn("node", F.monotonically_increasing_id()))
        self.nodes = self._nodes.df.select("node", "rep", "n")
        self._members = Table(found.df.select("id", "text", "digest").join(self._nodes.df.select("digest", "node"), "digest").select("id", "text", "node"))
        self.members = self._members.df
        found.drop()
        self._placed = self._place(self._linked())

    def _linked(self) -> DataFrame:
        """(node, root): the components of the nodes that share a signature and may be similar enough."""
        spark, t = self.spark, self.t
        nodes = self._nodes.df
        sig_bytes, map_bytes = nodes.agg(F.sum(F.octet_length("sigs")), F.sum(F.octet_length("map"))).first()
        n_sig = shards_for(sig_bytes or 0)

        def sig_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield from _shard_rows(np.concatenate([np.unique(np.frombuffer(x, np.uint64)) for x in batch.column("sigs").to_pylist()]) >> _DROP, n_sig)

        hot = tuple(HOT_NODES * HOT_STEP**i for i in range(HOT_LEVELS))
        shared = spark.sparkContext.broadcast(frequent(nodes.select("sigs").mapInArrow(sig_keys, "shard int, payload binary"), [2], n_sig, rare=hot))
        # a node's bitmap goes to each shard that has a signature of it: as few shards as hold the bytes
        n_link = shards_for((sig_bytes or 0) + 16 * (map_bytes or 0), 64 << 20)
        shift = np.uint64(64 - int(math.log2(n_link)))

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = shared.value
            for batch in batches:
                own = [np.unique(np.frombuffer(x, np.uint64)) for x in batch.column("sigs").to_pylist()]
                if not own:
                    continue
                row, sig = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)
                held = f.has(0, sig >> _DROP)
                row, sig = row[held], sig[held]
                level = np.zeros(len(sig), np.int64)
                for i in range(1, 1 + len(hot)):
                    level[f.has(i, sig >> _DROP)] = i
                ids = batch.column("node").to_numpy(zero_copy_only=False)
                if level.any():
                    row, sig = _cut_hot(row, sig, level, ids)
                order = np.argsort(sig, kind="stable")
                sig, row = sig[order], row[order]
                cuts = np.searchsorted(sig >> shift, np.arange(n_link + 1, dtype=np.uint64))
                sizes, maps = batch.column("size").to_numpy(zero_copy_only=False), batch.column("map").to_pylist()
                out: list[tuple] = []
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    here, at = np.unique(row[cuts[s] : cuts[s + 1]], return_inverse=True)
                    out.append((s, sig[cuts[s] : cuts[s + 1]].tobytes(), at.astype(np.int32).tobytes(), ids[here].tobytes(), sizes[here].astype(np.int32).tobytes(), b"".join(maps[i] for i in here)))
                if out:
                    cols = list(zip(*out))
                    yield pa.record_batch([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["shard", "sig", "row", "ids", "sizes", "maps"])

        def link(table: pa.Table) -> pa.Table:
            def col(name: str, kind: type) -> list[np.ndarray]:
                return [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]

            ids, rows = col("ids", np.int64), col("row", np.int32)
            base = np.cumsum([0] + [len(x) for x in ids])[:-1]
            edge = linked(np.concatenate(col("sig", np.uint64)), np.concatenate([r + b for r, b in zip(rows, base)]), np.concatenate(ids), np.concatenate(col("sizes", np.int32)).astype(np.int64), b"".join(table.column("maps").to_pylist()), t)
            return pa.table({"a": pa.array(edge[:, 0], pa.int64()), "b": pa.array(edge[:, 1], pa.int64())})

        edges = nodes.select("node", "size", "map", "sigs").mapInArrow(split, "shard int, sig binary, row binary, ids binary, sizes binary, maps binary").groupBy("shard").applyInArrow(link, "a long, b long")
        self._roots = components(edges)
        shared.unpersist()
        return self._roots.df.withColumnRenamed("id", "node")

    def _place(self, member: DataFrame) -> DataFrame:
        """(bucket, root, ti, tj, mine, node, weight, grams): every linked node's set, once for each of its tiles."""
        n = self.n
        wanted = self._nodes.df.join(member, "node").select("node", "root", "rep", "digest", "size", F.col("n").alias("weight"))
        n_ids = shards_for(8 * member.count())

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _shard_rows(_id_keys(batch), n_ids)

        # Only documents that stand for a linked node are parsed again and sent; a bitmap of their ids picks them.
        picked = self.spark.sparkContext.broadcast(frequent(wanted.select("rep").mapInArrow(key, "shard int, payload binary"), [1], n_ids))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(picked.value.has(0, _id_keys(batch))))
                for part in pieces(batch, "k1"):
                    sets = shingles(Words(part.column("k1"), lower=True), n)
                    yield pa.record_batch({"rep": part.column("k0").cast(pa.int64()), "digest": pa.array([_digest(x) for x in sets], pa.binary()), "grams": pa.array([x.tobytes() for x in sets], pa.binary())})

        sets = self.src.select("k0", "k1").mapInArrow(whole, "rep long, digest binary, grams binary")
        sizes = member.groupBy("root").agg(F.count("*").alias("n"))
        # A component of up to `tile` nodes is one tile; a larger one has ceil(n / tile) chunks and a tile for each two.
        placed = (
            wanted.join(sizes, "root")
            .withColumn("chunks", F.ceil(F.col("n") / self.tile).cast("int"))
            .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("node", "root", "rep", "digest", "weight", "mine", F.least("mine", "other").alias("ti"), F.greatest("mine", "other").alias("tj"))
        )
        load = wanted.join(sizes, "root").agg(F.sum(8 * F.col("size") * F.ceil(F.col("n") / self.tile))).first()[0]
        placed = placed.withColumn("bucket", F.pmod(F.xxhash64("root", "ti", "tj"), F.lit(shards_for(load or 0))).cast("int"))
        # rows that repeat an id and a text bring their set twice; one is enough
        return placed.join(sets, ["rep", "digest"]).drop("rep", "digest")

    def close(self) -> None:
        """Delete what only the search needed: ``nodes`` and ``hits`` end, ``members`` stay."""
        self._nodes.drop()
        self._roots.drop()

    def hits(self, emit, schema: str) -> DataFrame:
        t = self.t

        def verify(table: pa.Table) -> pa.Table:
            cols = {c: table.column(c).to_pylist() for c in ("root", "ti", "tj", "mine", "node", "weight", "grams")}
            order = sorted(range(table.num_rows), key=lambda r: (cols["root"][r], cols["ti"][r], cols["tj"][r], cols["mine"][r], cols["node"][r]))
            out, at = [], 0
            while at < len(order):
                key = tuple(cols[c][order[at]] for c in ("root", "ti", "tj"))
                rows: list[int] = []
                while at < len(order) and tuple(cols[c][order[at]] for c in ("root", "ti", "tj")) == key:
                    if not rows or cols["node"][rows[-1]] != cols["node"][order[at]]:
                        rows.append(order[at])
                    at += 1
                ids, weights = (np.array([cols[c][r] for r in rows], np.int64) for c in ("node", "weight"))
                n_left = sum(cols["mine"][r] == key[1] for r in rows)
                left, right = range(n_left), range(n_left, len(rows))
                out.append(emit(ids, weights, _pairs([np.frombuffer(cols["grams"][r], np.uint64) for r in rows], left, left if key[1] == key[2] else right, t)))
            return pa.concat_tables(out)

        return self._placed.groupBy("bucket").applyInArrow(verify, schema)


def _shard_rows(keys: np.ndarray, n_shards: int) -> Iterator[pa.RecordBatch]:
    rows = list(to_shards(keys, n_shards))
    if rows:
        yield pa.record_batch({"shard": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})


def _digest(s: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return xxhash.xxh3_128_digest(s.tobytes())


def _cut_hot(row: np.ndarray, sig: np.ndarray, level: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of too many nodes, salted: a node falls into one of c chunks and goes to the c tiles of that chunk."""
    rows, sigs = [row[level == 0]], [sig[level == 0]]
    for lv in np.unique(level[level > 0]).tolist():
        r, s, c = row[level == lv], sig[level == lv], _hot_chunks(lv)
        mine = (mix(ids[r].view(np.uint64) + np.uint64(1)) % np.uint64(c)).astype(np.int64)
        for other in range(c):
            a, b = np.minimum(mine, other), np.maximum(mine, other)
            rows.append(r)
            sigs.append(mix(s ^ mix((a * c + b + 1).astype(np.uint64))))
    return np.concatenate(rows), np.concatenate(sigs)


def jaccard_pairs(docs: DataFrame, n: int = N, t: float = THRESHOLD, hot: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """All pairs of different n-gram sets with a Jaccard similarity of at least ``t``, each as a pair of documents.

    Returns (doc_a, doc_b, common, total, jaccard) with doc_a < doc_b.  Documents with the same set are stood for by
    the smallest id; ``jaccard_classes`` tells which they are.  See there for words, NULLs, blanks and repeats.
    """
    s = Search(docs, n, t, hot, id_col, text_col, tile)

    def emit(ids: np.ndarray, weights: np.ndarray, pairs: Iterator[tuple]) -> pa.Table:
        got = [np.stack((np.full(len(j), ids[i]), ids[j], common, total), 1) for i, j, common, total in pairs]
        ab = np.concatenate([np.empty((0, 4), np.int64), *got])
        return pa.table({c: pa.array(ab[:, k], pa.int64()) for k, c in enumerate(("a", "b", "common", "total"))})

    rep = s.nodes.select("node", "rep")
    found = s.hits(emit, "a long, b long, common long, total long")
    both = found.join(rep.select(F.col("node").alias("a"), F.col("rep").alias("x")), "a").join(rep.select(F.col("node").alias("b"), F.col("rep").alias("y")), "b")
    return both.where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "common", "total", (F.col("common") / F.col("total")).alias("jaccard"))


def _classes(docs: DataFrame, n: int, t: float, hot: int, id_col: str, text_col: str, tile: int) -> DataFrame:
    """(id, text, class_id, n_links) of the rows that have a link, once for each id and hash of the text."""
    s = Search(docs, n, t, hot, id_col, text_col, tile)

    def emit(ids: np.ndarray, weights: np.ndarray, pairs: Iterator[tuple]) -> pa.Table:
        links, parent = np.zeros(len(ids), np.int64), list(range(len(ids)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, j, _, _ in pairs:
            links[i] += weights[j].sum()
            links[j] += weights[i]
            for x in j.tolist():
                a, b = find(i), find(x)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        root = np.array([find(i) for i in range(len(ids))], np.int64)
        return pa.table({"node": pa.array(ids), "root": pa.array(ids[root] if len(ids) else ids), "links": pa.array(links)}).filter(pa.array(links > 0))

    tiles = Table(s.hits(emit, "node long, root long, links long"))
    links = tiles.df.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(tiles.df.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = found.df.withColumnRenamed("id", "node")
    nodes = s.nodes.join(links, "node", "left").join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")).where("n_links > 0")
    nodes = Table(nodes)
    for table in (found, tiles, s):
        (table.close if table is s else table.drop)()
    least = nodes.df.groupBy("root").agg(F.min("rep").alias("class_id"))
    return s.members.dropDuplicates(["id", "text"]).join(nodes.df.join(least, "root").select("node", "class_id", "n_links"), "node").select("id", "text", "class_id", "n_links")


def jaccard_classes(docs: DataFrame, n: int = N, t: float = THRESHOLD, hot: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """One row for each document: (doc_id, class_id, n_links).

    ``n_links`` is the number of other documents whose sets of word n-grams have a Jaccard similarity of at least
    ``t`` with its own; every pair counts, copies included.  Classes are the connected components of these links,
    named by their smallest id; a document without a link is a class of its own.

    Words are lower-cased and split at whitespace; n-grams are compared by 64-bit hash, whole sets by 128 bits.  NULL,
    empty and blank texts have no n-grams and no link; a text of fewer than n words is one n-gram.  Rows with a NULL id
    are left out.  Rows that repeat an id are documents each, linked if their texts are alike.  Columns beside the two
    are ignored, whatever their names.  An empty table gives an empty result.
    """
    found = _classes(docs, n, t, hot, id_col, text_col, tile)
    rows = with_row_key(docs, [id_col, text_col]).where("k0 is not null").select(F.col("k0").alias("id"), F.xxhash64("k1").alias("text"))
    return rows.join(found, ["id", "text"], "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_duplicates(docs: DataFrame, n: int = N, t: float = THRESHOLD, hot: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """The documents of the smallest id of each class of ``jaccard_classes``, with all their columns.

    Documents without a link stay, as do NULL, empty and blank texts and rows without an id.  A row goes if the class
    of its text has a smaller id; rows that repeat the smallest id of a class with texts of that class all stay.
    Columns of any name and type pass through.  An empty table gives an empty table.
    """
    gone = _classes(docs, n, t, hot, id_col, text_col, tile).where("id <> class_id").select("id", "text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    i, x = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    left = plain.join(gone, (F.col(i) == F.col("id")) & (F.xxhash64(x) == F.col("text")), "left_anti")
    return left.toDF(*docs.columns)
