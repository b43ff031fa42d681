import hashlib
from collections import defaultdict

import numpy as np

from hopweave.llm import exact_dedup as ed
from hopweave.llm.exact_dedup import build_index, directory, exact_dedup

from .helpers import SCHEMA, low, rows, table, tuples


def brute(data):
    groups = defaultdict(list)
    for r in data:
        groups[low(r[1])].append(r[0])
    out = []
    for r in data:
        ids = [i for i in groups[low(r[1])] if i is not None]
        keep = max(ids) if ids else None
        out.append((r[0], keep, len(groups[low(r[1])]), r[0] == keep, hashlib.sha256(low(r[1]).encode()).hexdigest()))
    return out


def test_like_brute_force(spark):
    data = rows()
    key = lambda r: tuple(map(str, r))
    for capacity in (1 << 25, 2000):  # one bucket, and many
        found = tuples(exact_dedup(table(spark, data), capacity))
        assert sorted(found, key=key) == sorted(brute(data), key=key)


def test_only_null_ids_and_empty_table(spark):
    found = tuples(exact_dedup(table(spark, [(None, "a", None, None, None), (None, "A", None, None, None)])))
    assert [r[:4] for r in found] == [(None, None, 2, True)] * 2
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_directory_doubles_only_where_needed():
    sizes = np.zeros(16, np.int64)
    sizes[0], sizes[1], sizes[15] = 9, 9, 1
    buckets = directory(sizes, 10)
    assert buckets[0] != buckets[1] and len(set(buckets[8:])) == 1
    assert (np.diff(buckets) >= 0).all()
    assert len(set(directory(np.array([5] * 8), 1000))) == 1
    assert len(set(directory(np.array([50, 0]), 10))) == 2  # a key that can't be split further


def test_buckets_keep_to_their_capacity(spark):
    index = build_index(table(spark, [(i, f"text number {i}" * 20, None, None, None) for i in range(400)]), 20_000)
    sizes = [r[0] for r in index.groupBy("bucket").agg({"text": "count"}).select("count(text)").collect()]
    assert len(sizes) > 3 and sum(sizes) == 400


def test_a_second_level_where_the_directory_ends(spark, monkeypatch):
    monkeypatch.setattr(ed, "MAX_DEPTH", 2)
    data = rows() + [(1000 + i, f"text number {i // 2}" * 20, None, None, None) for i in range(600)]
    key = lambda r: tuple(map(str, r))
    assert sorted(tuples(exact_dedup(table(spark, data), 4000)), key=key) == sorted(brute(data), key=key)
    index = build_index(table(spark, data), 4000)
    keys = sorted((r["key"] % (1 << 64), r["bucket"]) for r in index.collect())
    assert len({b for _, b in keys}) > 20 and [b for _, b in keys] == sorted(b for _, b in keys)  # buckets are ranges of keys
