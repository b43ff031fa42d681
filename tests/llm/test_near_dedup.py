from collections import Counter

import numpy as np
import pytest

from hopweave.llm import near_dedup as nd

from .helpers import SCHEMA, rows, table, tuples, words


def sets(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(data, width):
    ids = sorted({r[0] for r in data if r[0] is not None})
    own = {r[0]: sets(r[1], width) for r in data}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and own[i] and own[j] and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return Counter((r[0], len(sets(r[1], width)), None if r[0] is None else find(r[0]), r[0] is None or find(r[0]) == r[0]) for r in data)


@pytest.mark.parametrize("width", [4, 5])
def test_like_brute_force(spark, width):
    data = rows()
    assert Counter(tuples(nd.near_dedup(table(spark, data), width))) == brute(data, width)


def test_chains_and_short_texts(spark):
    base = [f"w{i}" for i in range(60)]
    chain = [" ".join([w if k >= i else f"y{k}" for k, w in enumerate(base)]) for i in range(0, 24, 3)]
    data = [(50 - i, t, None, None, None) for i, t in enumerate(chain)] + [(60, "one two", None, None, None), (61, "ONE  two", None, None, None), (62, "one", None, None, None)]
    assert Counter(tuples(nd.near_dedup(table(spark, data), 4))) == brute(data, 4)


def test_empty(spark):
    assert nd.near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    assert tuples(nd.near_dedup(table(spark, [(3, None, None, None, None)]))) == [(3, 0, 3, True)]


def made(rng, shared, own):
    common = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
    return [np.unique(nd.mixed(np.append(common, rng.integers(0, 1 << 63, own, dtype=np.uint64)))) for _ in range(2)]


def judged(pairs):
    (a, x), (b, y) = (nd.odd_sketches([p[k] for p in pairs]) for k in (0, 1))
    nx, ny = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return nd.near_enough(np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1, dtype=np.int64), x, y, nx, ny)


@pytest.mark.parametrize(("shared", "own"), [(8, 1), (40, 5), (160, 20), (480, 60), (1600, 200)])
def test_bands_and_sketches_together_lose_no_pair_at_the_threshold(shared, own):
    rng = np.random.default_rng(2)
    pairs = [made(rng, shared, own) for _ in range(2000)]
    bands = [nd.band_keys(np.array([nd.minhash(p[k]) for p in pairs])) for k in (0, 1)]
    assert (bands[0] == bands[1]).any(axis=1).all() and judged(pairs).all()


def test_sketches_tell_lower_similarities_apart():
    rng = np.random.default_rng(1)
    assert judged([made(rng, 1300, 350) for _ in range(500)]).mean() < 0.05  # 0.65
    assert judged([made(rng, 120, 40) for _ in range(500)]).mean() < 0.05  # 0.6


def test_a_frequent_passage_in_different_texts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(70)]
    data = [(i, " ".join(passage + [f"u{i}x{k}" for k in range(int(rng.integers(8, 24)))]), None, None, None) for i in range(60)]
    for i in range(60, 90):  # among them chains of near ones
        own = [f"c{i // 10}x{k}" for k in range(14)]
        own[i % 10] = f"d{i}"
        data.append((i, " ".join(passage + own), None, None, None))
    met = []
    kept = nd._rarest
    monkeypatch.setattr(nd, "_rarest", lambda member, sets: met.append(kept(member, sets)) or met[-1])
    assert Counter(tuples(nd.near_dedup(table(spark, data), 4))) == brute(data, 4)
    assert met and met[0].count() < 300  # of 4,005 pairs
