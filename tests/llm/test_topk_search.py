import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hopweave.llm import topk_search as ts
from hopweave.llm.near_dedup import WordHashes

from .helpers import SCHEMA, rows, table, tuples, words


def brute(data, every, k):
    texts = [Counter(words(r[1])) for r in data]
    n, df = len(data), Counter(w for t in texts for w in t)
    mean = sum(sum(t.values()) for t in texts) / max(1, n)
    out = {}
    for r, query in zip(data, texts, strict=True):
        if r[0] is None or r[0] % every:
            continue
        found = []
        for s, t in zip(data, texts, strict=True):
            if s[0] is not None and s[0] != r[0]:
                size = sum(t.values())
                score = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t[w] * 2.2 / (t[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in query if w in t)
                if score > 0:
                    found.append((-round(score, 8), s[0]))
        out[r[0]] = [(i, -x) for x, i in sorted(found)[:k]]
    return {q: x for q, x in out.items() if x}


def result(df):
    out = {}
    for q, rank, doc, score in tuples(df, "query_id", "rank", "doc_id", "score"):
        out.setdefault(q, []).append((doc, round(score, 8)))
        assert rank == len(out[q])
    return out


@pytest.mark.parametrize("every,k", [(5, 10), (50, 3)])
def test_like_brute_force(spark, every, k):
    data = rows()
    assert result(ts.topk_search(table(spark, data), every, k)) == brute(data, every, k)


def test_many_shards_and_blocks_give_the_same(spark):
    data = rows(7)
    prepared = ts.prepare(table(spark, data), 4000)
    index = ts.build_index(prepared)
    assert index.count() > 10
    assert result(ts.search(index, prepared.where("doc_id % 5 = 0"), 5, 1500)) == brute(data, 5, 5)


def test_empty(spark):
    assert ts.topk_search(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ts.topk_search(table(spark, [(0, None, None, None, None), (50, "", None, None, None)])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefghij"), max_size=12), min_size=1, max_size=120), st.integers(1, 6))
def test_pruning_loses_nothing(texts, k):
    seen = WordHashes()
    hashes = [ts.word_hashes(" ".join(t), seen) for t in texts]
    row = ts.build_shard([np.unique(h, return_counts=True) for h in hashes], list(range(len(texts))))
    vocabulary = np.unique(ts.word_hashes("a b c d e f g h i j zz", seen))
    mean = sum(map(len, texts)) / len(texts)
    shard = ts.Shard(row, mean, vocabulary)
    weight = np.linspace(0.01, 3, len(vocabulary))
    for q in range(min(4, len(texts))):
        own = np.searchsorted(vocabulary, np.unique(hashes[q]))
        found = shard.best(q, own, weight[own], k, 0.0)
        every = shard.best(q, own, weight[own], len(texts), 0.0)
        scores = []
        for i, h in enumerate(hashes):
            tf = Counter(h.tolist())
            s = sum(weight[w] * tf[int(vocabulary[w])] * 2.2 / (tf[int(vocabulary[w])] + 1.2 * (0.25 + 0.75 * len(h) / max(mean, 1e-9))) for w in own)
            if s > 0 and i != q:
                scores.append((-round(s, 9), i))
        assert [i for _, i in found] == [i for _, i in sorted(scores)][:k]
        assert [i for _, i in every] == [i for _, i in sorted(scores)]


def test_negative_ids_are_found(spark):
    data = [(None if r[0] is None else r[0] - 150, *r[1:]) for r in rows()]
    assert any(i < 0 for found in brute(data, 5, 10).values() for i, _ in found)
    assert result(ts.topk_search(table(spark, data), 5, 10)) == brute(data, 5, 10)


def test_queries_of_one_id_are_the_same_in_every_run(spark):
    data = [(50, f"word{i} other{i % 3} text", None, None, None) for i in range(6)] + [(i, f"word{i} other{i % 3} text", None, None, None) for i in range(1, 7)]
    once = result(ts.topk_search(table(spark, data), 50, 10))
    assert list(once) == [50] and result(ts.topk_search(table(spark, data[::-1]).repartition(5), 50, 10)) == once


def test_blocks_are_skipped(monkeypatch):
    seen, rng = WordHashes(), np.random.default_rng(1)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 200, 40)) for _ in range(3000)] + [" ".join(f"x{j}" for j in rng.integers(0, 8, 40)) for _ in range(200)]
    hashes = [ts.word_hashes(t, seen) for t in texts]
    row = ts.build_shard([np.unique(h, return_counts=True) for h in hashes], list(range(len(texts))))
    vocabulary = np.unique(hashes[-1])
    shard = ts.Shard(row, 40.0, vocabulary)
    own = np.arange(len(vocabulary))
    whole, calls = shard.dense, []
    shard.dense = type("Seen", (), {"__getitem__": lambda self, key: calls.append(np.size(key[1])) or whole[key]})()
    assert len(shard.best(-1, own, np.ones(len(own)), 10, 0.0)) == 10
    assert 0 < sum(calls) < 3200 / 4


def test_counts_of_any_size():
    for counts in ([], [1, 2, 3], [254, 255, 256, 1, 70_000, 255]):
        assert ts.large(ts.small(np.array(counts, np.int64)), len(counts)).tolist() == counts


def test_queries_of_a_shard_share_its_products():
    seen, rng = WordHashes(), np.random.default_rng(2)
    texts = [" ".join(f"w{j}" for j in rng.zipf(1.3, 60) if j < 500) for _ in range(1000)]
    hashes = [ts.word_hashes(t, seen) for t in texts]
    row = ts.build_shard([np.unique(h, return_counts=True) for h in hashes], [None if i % 90 == 1 else i for i in range(len(texts))])
    vocabulary = np.unique(np.concatenate([*hashes, ts.word_hashes("unknown words", seen)]))
    shard, weight = ts.Shard(row, 50.0, vocabulary), rng.random(len(vocabulary)) * 5
    lists = [np.searchsorted(vocabulary, np.unique(h)) for h in [*hashes[:200], ts.word_hashes("unknown words", seen), hashes[0][:0]]]
    own, ends, ids = np.concatenate(lists), np.append(0, np.cumsum([len(x) for x in lists])), np.arange(len(lists))
    one_by_one = [shard.best(int(i), x, weight[x], 5, 0.0) for i, x in zip(ids, lists, strict=True)]
    assert shard.best_of(ids, ends, own, weight[own], 5, np.zeros(len(ids))) == one_by_one
    assert one_by_one[-2:] == [[], []] and all(len(x) == 5 for x in one_by_one[2:90])
    floors = np.array([x[2][0] if len(x) == 5 else 0.1 for x in one_by_one])
    whole, calls = shard.dense, []
    shard.dense = type("Seen", (), {"__getitem__": lambda self, key: calls.append(np.size(key[1])) or whole[key]})()
    found = shard.best_of(ids, ends, own, weight[own], 5, floors)
    assert all([x for x in a if x[0] >= f] == [x for x in b if x[0] >= f] for a, b, f in zip(found, one_by_one, floors, strict=True))
    assert 0 < sum(c for c in calls if c >= ts.BLOCK) <= shard.blocks * ts.BLOCK  # each block once for all queries; exact scores are of fewer documents
