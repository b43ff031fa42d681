import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hopweave.llm import lm_score as lm
from hopweave.llm.elias_fano import EliasFano, mapped, packed

from .helpers import SCHEMA, rows, table, tuples, words


def held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def brute(data):
    """The model without quantised probabilities."""
    texts = [(r[0], words(r[1]) + [None]) for r in data]
    train = [t for i, t in texts if not held_out(i)]
    one = Counter(w for t in train for w in t)
    two = Counter(pair for t in train for pair in zip(["<s>", *t], t))
    context, followers = Counter(), Counter()
    for (v, _), c in two.items():
        context[v] += c
        followers[v] += 1
    total, distinct = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 0.5) / (total + 0.5 * (distinct + 1))
    out = []
    for i, t in texts:
        score = 0.0
        for v, w in zip(["<s>", *t], t):
            c = two[v, w]
            score += math.log10((max(0, c - 0.75) / context[v] + 0.75 * followers[v] / context[v] * p1(w)) if context[v] else p1(w))
        out.append((i, held_out(i), len(t), sum(one[w] > 0 for w in t), total, sum(math.log10(p1(w)) for w in t), score))
    return out


def same(found, wanted):
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=1e-3, abs=1e-3)


def key(r):
    return (r[0] is not None, r[0] or 0, r[2], round(r[5], 6))


def test_like_brute_force(spark):
    data = rows()
    found = sorted(tuples(lm.lm_score(table(spark, data))), key=key)
    same(found, sorted(brute(data), key=key))


def test_many_chunks_and_shards_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 20_000)
    monkeypatch.setattr(lm, "SHARD", 300)
    data = rows(3)
    hot = lm.hot_contexts(table(spark, data), 100)
    assert len(hot.words) > 20 and hot.parts.min() >= 2 and len(set(hot.keys.tolist())) == hot.parts.sum()
    assert hot.owner(np.append(hot.keys, [np.uint64(5)])).tolist() == [*hot.of.tolist(), -1]
    same(sorted(tuples(lm.lm_score(table(spark, data))), key=key), sorted(brute(data), key=key))


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(60) if held_out(i)]
    found = tuples(lm.lm_score(table(spark, [(i, "a b", None, None, None) for i in ids])))
    assert [r[:5] for r in found] == [(i, True, 3, 0, 0) for i in ids]
    assert lm.lm_score(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=200), st.lists(st.integers(0, (1 << 64) - 1), max_size=30), st.integers(0, 58))
def test_elias_fano(values, asked, shift):
    values = sorted(v >> shift for v in values)
    universe = (1 << 64) >> shift
    sequence = EliasFano(np.array(values, np.uint64), universe)
    wanted = np.array([a >> shift for a in asked] + values, np.uint64)
    at, equal = sequence.successor(wanted)
    assert at.tolist() == np.searchsorted(np.array(values, np.uint64), wanted).tolist()
    assert equal.tolist() == [int(w) in set(values) for w in wanted]
    if values:
        assert sequence.access(np.arange(len(values))).tolist() == values
    assert sequence.nbytes() <= len(values) * (2 + max(1, (universe // max(1, len(values))).bit_length())) / 8 + 64


def test_a_mapped_level_is_what_was_packed():
    arrays = [np.arange(5, dtype=np.int64), np.empty(0, np.uint64), np.arange(3, dtype=np.uint8), np.arange(7, dtype=np.uint16)]
    found = mapped(packed(arrays))
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(arrays, found, strict=True))
    assert mapped(packed([])) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 65535)), st.sampled_from([np.uint16, np.uint32, np.int64]))
def test_squeezed_values_come_back(values, kind):
    found = lm.spread(lm.squeezed(np.array(values, kind)), kind)
    assert found.dtype == kind and found.tolist() == values
