"""Exact deduplication with an extendible-hash index on shared files.

The key of a text is a 64-bit hash of its normal form. A directory maps key prefixes to buckets; it starts with
one bucket and doubles whenever a bucket that is over its capacity is as deep as the directory itself, so buckets split only
where the data need it. Owner tasks take whole key ranges, keep a chain of entries for each key, compare the
bytes of every text with the chain, and write the buckets as Parquet.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_az, staged

#: The directory has at most 2 ** MAX_DEPTH entries, which bounds what the driver sees and what is broadcast. What it can't divide is divided further by a second level: a
#: directory of its own for each entry, whose depth is all that has to be known.
MAX_DEPTH = 16
#: Owner tasks at most; one may own several buckets.
OWNERS = 1 << 16
CAPACITY = 32 << 20
FLUSH = 8 << 20

_ENTRY = "bucket int, key long, slot int, text_sha256 string, keep_id long, group_size long, text string"


def directory(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bucket of every prefix. sizes: bytes under each prefix of log2(len(sizes)) bits, a power of two.

    Buckets are numbered in key order. A bucket is split while it is over the capacity and a longer prefix can
    still divide it.
    """
    deepest = len(sizes).bit_length() - 1
    total = np.concatenate([[0], np.cumsum(sizes)])
    depth, slots = 0, [(0, 0)]  # of each directory entry: the bucket's prefix and local depth
    todo = [(0, 0)]
    while todo:
        prefix, local = todo.pop()
        width = 1 << (deepest - local)
        if local == deepest or total[(prefix + 1) * width] - total[prefix * width] <= capacity:
            continue
        if local == depth:  # the directory doubles
            slots = [s for s in slots for _ in (0, 1)]
            depth += 1
        span = 1 << (depth - local - 1)
        for side in (0, 1):
            child = (2 * prefix + side, local + 1)
            at = child[0] * span
            slots[at : at + span] = [child] * span
            todo.append(child)
    numbers = {s: i for i, s in enumerate(dict.fromkeys(slots))}
    return np.repeat([numbers[s] for s in slots], 1 << (deepest - depth)).astype(np.int32)


def second_level(sizes: np.ndarray, slots: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each prefix the depth of its own directory (0 where it needs none) and its first bucket, and the number of buckets. Keys are hashes, so that equal parts of a
    prefix's range hold about equally much."""
    over = np.maximum(1, -(-sizes // max(1, capacity)))
    deeper = np.ceil(np.log2(over)).astype(np.int64)
    opens = np.diff(slots, prepend=-1) != 0  # a bucket that begins here; one that is divided further has this prefix alone
    held = np.where(opens, 1 << deeper, 0)
    return deeper, (np.cumsum(held) - (1 << deeper))[np.maximum.accumulate(np.where(opens, np.arange(len(slots)), 0))], int(held.sum())


def _few(batches, n: int = 256):
    """The same rows, a few at a time, so that few texts are held as Python's whatever the batches are."""
    for b in batches:
        for start in range(0, b.num_rows, n):
            yield b.slice(start, n)


def _combine(batches):
    """One row for each distinct text of a stretch of a partition, so that a large group arrives as few rows."""

    def rows():
        texts = list(held)
        keys, ids, counts = zip(*held.values(), strict=True)
        return pa.record_batch({"key": pa.array(keys, pa.int64()), "text": pa.array(texts, pa.string()), "keep_id": pa.array(ids, pa.int64()), "n": pa.array(counts, pa.int64())})

    held, size = {}, 0
    for batch in _few(batches):
        for key, text, doc in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "doc_id")), strict=True):
            entry = held.get(text)
            if entry is None:
                held[text] = [key, doc, 1]
                size += len(text)
            else:
                entry[1] = doc if entry[1] is None else entry[1] if doc is None else max(entry[1], doc)
                entry[2] += 1
            if size > FLUSH:
                yield rows()
                held, size = {}, 0
    if held:
        yield rows()


def _own(batches):
    """Buckets from rows in order of their key: a chain of (text, largest id, rows) for each key."""
    names = ("bucket", "key", "slot", "text_sha256", "keep_id", "group_size", "text")
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
    out, size, at, chain = [], 0, None, []

    def close():
        for slot, (text, doc, n) in enumerate(chain):
            out.append((*at, slot, hashlib.sha256(text.encode()).hexdigest(), doc, n, text))
        return sum(len(e[0]) for e in chain)

    def rows():
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for batch in _few(batches):
        for bucket, key, text, doc, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "text", "keep_id", "n")), strict=True):
            if (bucket, key) != at:
                size += close()
                at, chain = (bucket, key), []
                if size > FLUSH:
                    yield rows()
                    out, size = [], 0
            for entry in chain:
                if entry[0] == text:
                    entry[1] = doc if entry[1] is None else entry[1] if doc is None else max(entry[1], doc)
                    entry[2] += n
                    break
            else:
                chain.append([text, doc, n])
    close()
    if out:
        yield rows()


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index as a table on shared files: bucket, key, slot in the key's chain, text_sha256, keep_id, group_size, text."""
    keyed = docs.select("doc_id", lower_az(F.col("text")).alias("text")).withColumn("key", F.xxhash64("text"))
    prefix = F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int")
    held = keyed.groupBy("key").agg(F.max(F.octet_length("text")).alias("bytes"))
    found = held.groupBy(prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes")).toPandas()  # 2 ** MAX_DEPTH rows at most
    sizes = np.zeros(1 << MAX_DEPTH, np.int64)
    sizes[found["prefix"].to_numpy(int)] = found["bytes"]
    slots = directory(sizes, capacity)
    deeper, first, buckets = second_level(sizes, slots, capacity)
    rows = keyed.mapInArrow(_combine, "key long, text string, keep_id long, n long")
    if buckets == 1:
        rows = rows.withColumn("bucket", F.lit(0))
    else:
        table = docs.sparkSession.createDataFrame(pa.table({"prefix": pa.array(np.arange(1 << MAX_DEPTH, dtype=np.int32)), "_first": pa.array(first), "_deeper": pa.array(deeper)}))
        within = F.expr(f"if(_deeper = 0, 0L, shiftrightunsigned(shiftleft(key, {MAX_DEPTH}), cast(64 - _deeper as int)))")
        rows = rows.withColumn("prefix", prefix).join(F.broadcast(table), "prefix").withColumn("bucket", (F.col("_first") + within).cast("int"))
    owned = rows.select("bucket", "key", "text", "keep_id", "n").repartition(min(buckets, OWNERS), "bucket").sortWithinPartitions("bucket", "key")
    return staged(owned.mapInArrow(_own, _ENTRY), "extendible-hash")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the largest doc_id stays.
    Null ids: a null doc_id loses to any other; a group with null ids only keeps null. Repeated rows count one by one in
    group_size and each repeat of the row that stays is marked as kept. Empty tables give no rows. The columns in carry go along with their rows; others are not read.
    """
    index = build_index(docs, capacity).select("key", "text_sha256", "keep_id", "group_size")
    norm = lower_az(F.col("text"))
    rows = docs.select("doc_id", F.xxhash64(norm).alias("key"), F.sha2(norm, 256).alias("text_sha256"), *carry)
    return rows.join(index, ["key", "text_sha256"], "left").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *carry)
