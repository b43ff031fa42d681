import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from hopweave.llm.sharding import RoomTree, pack, shard

from .helpers import SCHEMA, rows, table, tuples


def check(found, data, shards):
    size = lambda t: len((t or "").encode()) + 16
    assert Counter(r[:3] for r in found) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in data)
    slots = defaultdict(list)
    for r in found:
        slots[r[4]].append(r[5])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(0 <= b < shards for b in slots)
    assert {r[3] for r in found} <= {"bytes"} and {r[6] for r in found} <= {None}
    where = defaultdict(set)
    for r in found:
        where[r[2], r[1]].add(r[4])
    assert all(len(x) == 1 for x in where.values())


def test_groups_slots_and_sizes(spark):
    data = rows()
    check(tuples(shard(table(spark, data), 5), "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"), data, 5)


def test_even(spark):
    rng = random.Random(3)
    data = [(i, "w" * int(rng.paretovariate(1.2) * 20), None, None, None) for i in range(3000)]
    found = tuples(shard(table(spark, data, extra=False), 8), "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    check(found, data, 8)
    loads = Counter()
    for r in found:
        loads[r[4]] += r[1]
    groups = Counter()
    for r in found:
        groups[r[2], r[1]] += r[1]
    if max(groups.values()) <= sum(loads.values()) / 8:
        assert max(loads.values()) - min(loads.values()) <= 0.01 * sum(loads.values()) / 8 + 40


def test_one_group_larger_than_a_share(spark):
    data = [(i, "same", None, None, None) for i in range(500)] + [(1000 + i, f"text {i}", None, None, None) for i in range(300)]
    found = tuples(shard(table(spark, data), 4), "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    check(found, data, 4)
    loads = Counter()
    for r in found:
        loads[r[4]] += r[1]
    rest = sorted(loads.values())[:3]
    assert rest[-1] - rest[0] <= 60


def test_empty(spark):
    assert shard(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tree_finds_the_tightest():
    rng = random.Random(5)
    tree, have = RoomTree(), []
    for i in range(300):
        have.append((rng.randrange(100), i))
        tree.add(have[-1])
        if i % 3 == 0:
            gone = rng.choice(have)
            have.remove(gone)
            tree.remove(gone)
        want = rng.randrange(120)
        fit = [k for k in have if k[0] >= want]
        if have:
            assert tree.tightest(want) == (min(fit) if fit else max(have))
    high = lambda n: 1 + max(high(n[1]), high(n[2])) if n else 0
    assert high(tree.root) <= 1.45 * len(have).bit_length() + 1


def plain(data, shards):
    """Best fit decreasing, a group at a time: the shard of each text."""
    groups = Counter()
    for _, t, *_ in data:
        groups[t or ""] += len((t or "").encode()) + 16
    order = sorted(groups, key=lambda t: (-groups[t], hashlib.sha256(t.encode()).digest()))
    total, own, alone = sum(groups.values()), 0, 0
    for t in order:
        if alone == shards - 1 or groups[t] * (shards - alone) <= total - own:
            break
        own, alone = own + groups[t], alone + 1
    rooms, where = [-(-(total - own) // (shards - alone))] * shards, {}
    for t in order:
        fit = [(r, b) for b, r in enumerate(rooms) if r >= groups[t]]
        b = min(fit)[1] if fit else max((r, b) for b, r in enumerate(rooms))[1]
        rooms[b] -= groups[t]
        where[t] = b
    return where


@pytest.mark.parametrize(("seed", "n", "shards"), [(1, 900, 7), (2, 3000, 40), (3, 50, 40)])
def test_like_plain_best_fit_decreasing(spark, seed, n, shards):
    rng = random.Random(seed)
    data = [(i, rng.choice("abcdefgh") * int(rng.paretovariate(1.1) * 4) + str(rng.randrange(n)), None, None, None) for i in range(n)]
    data += [(n + i, None if i % 2 else "", None, None, None) for i in range(9)] + [(2 * n + i, "copies of one text", None, None, None) for i in range(n // 3)]
    where = plain(data, shards)
    found = dict(tuples(shard(table(spark, data, extra=False), shards), "doc_id", "shard"))
    assert found == {i: where[t or ""] for i, t, *_ in data}


def test_a_run_goes_through_the_tree_as_its_groups_would():
    assert pack([(7, 1), (6, 1), (5, 1), (4, 1), (3, 2), (2, 1)], 3) == [[(0, 0)], [(0, 1)], [(0, 2)], [(0, 1)], [(0, 0), (1, 2)], [(0, 2)]]
    assert pack([(10, 4), (1, 1000)], 4) == [[(0, 0)], [(0, 0), (220, 1), (480, 2), (740, 3)]]
    assert pack([], 3) == []
