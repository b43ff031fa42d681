"""Sharding of indivisible groups by best-fit-decreasing bin packing.

Groups (equal texts) enter in order of size the shard with the least room that still holds them, found in a balanced tree of the shards' rooms. Best fit looks at sizes
only, so all groups of one size pass through the tree as a run: the tightest shard stays the tightest while groups of the same size enter it, and takes as many of the run as it has
room for. The driver gets the number of groups of each size, which are at most about the root of twice all bytes, and tells for each size from which rank on groups go to which shard.
"""

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_total, staged

SHARDS = 40


class RoomTree:
    """A height-balanced search tree of (room, shard)."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _node(key, left, right):
        high = 1 + max(left[3] if left else 0, right[3] if right else 0)
        return (key, left, right, high)

    def _balance(self, key, left, right):
        tall = lambda n: n[3] if n else 0
        node = self._node
        if tall(left) > tall(right) + 1:
            k, a, b, _ = left
            if tall(b) > tall(a):
                return node(b[0], node(k, a, b[1]), node(key, b[2], right))
            return node(k, a, node(key, b, right))
        if tall(right) > tall(left) + 1:
            k, a, b, _ = right
            if tall(a) > tall(b):
                return node(a[0], node(key, left, a[1]), node(k, a[2], b))
            return node(k, node(key, left, a), b)
        return node(key, left, right)

    def add(self, key) -> None:
        def put(n):
            if n is None:
                return self._node(key, None, None)
            return self._balance(n[0], put(n[1]), n[2]) if key < n[0] else self._balance(n[0], n[1], put(n[2]))

        self.root = put(self.root)

    def _least(self, n):
        return n[0] if n[1] is None else self._least(n[1])

    def remove(self, key) -> None:
        def cut(n, key):
            if key < n[0]:
                return self._balance(n[0], cut(n[1], key), n[2])
            if key > n[0]:
                return self._balance(n[0], n[1], cut(n[2], key))
            if n[1] is None or n[2] is None:
                return n[1] or n[2]
            then = self._least(n[2])
            return self._balance(then, n[1], cut(n[2], then))

        self.root = cut(self.root, key)

    def tightest(self, size):
        """The least key with room for size, else the one with the most room."""
        n, found = self.root, None
        while n is not None:
            if n[0][0] >= size:
                found, n = n[0], n[1]
            else:
                n = n[2]
        if found is None:
            n = self.root
            while n[2] is not None:
                n = n[2]
            found = n[0]
        return found


def pack(runs: list[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """For each run (size, groups), sizes falling: (rank, shard) from which rank of the run on its groups go to which shard.

    Capacities are equal but for groups that alone are above. A group that nothing has room for goes where most room is.
    """
    total, own, alone = sum(s * n for s, n in runs), 0, 0
    for s, n in runs:
        while n and alone < shards - 1 and s * (shards - alone) > total - own:
            own, alone, n = own + s, alone + 1, n - 1
        if n:
            break
    room = -(-(total - own) // (shards - alone))
    tree, found = RoomTree(), []
    for b in range(shards):
        tree.add((room, b))
    for s, n in runs:
        at, cuts = 0, []
        while at < n:
            key = tree.tightest(s)
            many = min(n - at, max(1, key[0] // s))
            tree.remove(key)
            tree.add((key[0] - many * s, key[1]))
            cuts.append((at, key[1]))
            at += many
        found.append(cuts)
    return found


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16), text_crc32, law (`bytes`), shard, slot (gapless from 0 in each shard) and grown_shard (null) of every row.

    Rows of equal text stay together; a null text counts as empty. A group larger than a fair share has a shard to itself as far as there are enough.
    Repeated rows and equal or null ids have slots of their own. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(text, 256))
    rows = staged(docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("_key")), "shard-rows")
    groups = staged(rows.groupBy("_key").agg(F.sum("size").alias("_bytes")), "shard-groups")
    sizes = groups.groupBy("_bytes").agg(F.count("*").alias("n")).toArrow()
    runs = sorted(zip(sizes["_bytes"].to_pylist(), sizes["n"].to_pylist(), strict=True), reverse=True)
    before = [0, *accumulate(n for _, n in runs)]
    cuts = pack(runs, shards)
    kinds = {"_bytes": pa.int64(), "_first": pa.int64(), "_ranks": pa.list_(pa.int64()), "_shards": pa.list_(pa.int32())}
    columns = ([s for s, _ in runs], before[:-1], [[r for r, _ in c] for c in cuts], [[b for _, b in c] for c in cuts])
    places = spark.createDataFrame(pa.table([pa.array(x, k) for x, k in zip(columns, kinds.values(), strict=True)], names=list(kinds)))
    ranked = running_total(groups.select("_key", "_bytes", (-F.col("_bytes")).alias("_falling"), F.lit(1).cast("long").alias("_one")), ["_falling", "_key"], "_one", "_rank")
    here = F.size(F.filter("_ranks", lambda r: r <= F.col("_rank") - F.col("_first")))
    packed = ranked.join(places, "_bytes").select("_key", F.element_at("_shards", here).alias("shard"))
    placed = staged(rows.join(packed, "_key").select("doc_id", "size", "text_crc32", "shard", F.lit(1).cast("long").alias("_one")), "shard-placed")
    ranked = running_total(placed, ["shard", "doc_id", "text_crc32"], "_one", "_before")
    counts = {r[0]: r[1] for r in placed.groupBy("shard").count().collect()}
    starts = [0, *accumulate(counts.get(b, 0) for b in range(shards))]
    start = F.element_at(F.array(*map(F.lit, starts)), F.col("shard") + 1)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
