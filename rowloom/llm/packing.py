"""Best-fit packing (operator 10): best-fit decreasing with a segment tree over remaining capacities."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import n_words, with_row_key

CAPACITY = 2048
#: Documents that are packed together; more of them waste no less.
SHARD_DOCS = 50_000


class Bins:
    """Open bins by remaining capacity; ``take(n)`` finds the tightest that holds n in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, capacity).bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, room: int, bin_id: int) -> None:
        self.at[room].append(bin_id)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of the open bin with the least room >= need, taken out; None if there is none."""
        count, i = self.count, need + self.size
        if not count[i]:
            while True:  # up to the first ancestor whose right sibling holds a bin, then down to its leftmost leaf
                if i <= 1:
                    return None
                if not i & 1 and count[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        found = self.at[room].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return room, found


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item.  Items are taken by falling size (ties in the order given), each into the tightest
    open bin; of bins with equal room the one that reached it last."""
    bins, out, n = Bins(capacity), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        if (hit := bins.take(sizes[i])) is None:
            room, b, n = capacity, n, n + 1
        else:
            room, b = hit
        out[i] = b
        if room > sizes[i]:
            bins.put(room - sizes[i], b)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Pack the documents' words into sequences of at most ``capacity`` words.

    A document longer than ``capacity`` is cut into full pieces and a remainder; every piece is an item.  Rows
    are spread over ``ceil(rows / shard_docs)`` shards by a hash of id and text, and each shard is packed on
    its own, so no task grows with the input.  Returns one row for each bin: shard, bin, used, capacity,
    doc_ids, starts, lengths (parallel arrays by falling length, then id and start; ``starts`` in words).

    Blank, empty and NULL texts have no words and are in no bin.  Rows with a NULL id are packed, with NULL in
    ``doc_ids``.  Repeated rows are packed as often as they occur.  Other columns are ignored.  An empty table
    gives no bins.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sized = with_row_key(docs, [id_col, text_col]).select(F.col("k0").cast("long").alias("id"), F.xxhash64("k0", "k1").alias("h"), n_words("k1").alias("n")).where("n > 0")
    n_shards = max(1, math.ceil(docs.count() / shard_docs))

    def fill(table: pa.Table) -> pa.Table:
        items: list[tuple[int, bool, int, int]] = []
        for doc, n in zip(table.column("id").to_pylist(), table.column("n").to_pylist()):
            for start in range(0, n, capacity):
                items.append((-min(capacity, n - start), doc is None, doc or 0, start))
        items.sort()
        where = best_fit_decreasing([-x[0] for x in items], capacity)
        bins: list[list[tuple[int, bool, int, int]]] = [[] for _ in range(max(where, default=-1) + 1)]
        for b, item in zip(where, items):
            bins[b].append(item)
        shard = table.column("shard")[0].as_py()
        return pa.table(
            {
                "shard": pa.array([shard] * len(bins), pa.int32()),
                "bin": pa.array(range(len(bins)), pa.int64()),
                "used": pa.array([-sum(x[0] for x in b) for b in bins], pa.int64()),
                "capacity": pa.array([capacity] * len(bins), pa.int64()),
                "doc_ids": pa.array([[None if x[1] else x[2] for x in b] for b in bins], pa.list_(pa.int64())),
                "starts": pa.array([[x[3] for x in b] for b in bins], pa.list_(pa.int64())),
                "lengths": pa.array([[-x[0] for x in b] for b in bins], pa.list_(pa.int64())),
            }
        )

    sharded = sized.select(F.pmod("h", F.lit(n_shards)).cast("int").alias("shard"), "id", "n")
    return sharded.groupBy("shard").applyInArrow(fill, "shard int, bin long, used long, capacity long, doc_ids array<long>, starts array<long>, lengths array<long>")
