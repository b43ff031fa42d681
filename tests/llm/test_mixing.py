import math
from collections import defaultdict

import pytest

from hopweave.llm.mixing import mix

from .helpers import SCHEMA, rows, table, tuples, words

COLUMNS = ("doc_id", "source", "size", "source_size", "target", "taken", "position", "again")


def targets(sizes):
    """Share 150 % by weight, with what is above twice a source's size shared anew until none is."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), list(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_targets_and_takes(spark):
    data = rows()
    found = tuples(mix(table(spark, data)), *COLUMNS)
    assert sorted((r[0] is None, r[0] or 0, r[2]) for r in found) == sorted((r[0] is None, r[0] or 0, len(words(r[1]))) for r in data)
    sizes = defaultdict(int)
    for r in data:
        sizes[r[3]] += len(words(r[1]))
    wanted, taken = targets(sizes), defaultdict(int)
    for r in found:
        assert r[3] == sizes[r[1]] and r[4] == pytest.approx(wanted[r[1]]) and 0 <= r[5] <= 2 * r[2]
        assert (r[6] is None) == (r[5] == 0) and all(p is None or 0 <= p <= 1 for p in r[6:])
        taken[r[1]] += r[5]
    assert all(taken[s] == math.floor(wanted[s] + 1e-6) for s in sizes)


def test_reruns_agree_and_rows_come_by_position(spark):
    data = rows(4)
    first, again = ([tuple(r) for r in mix(table(spark, data)).select(*COLUMNS).collect()] for _ in range(2))
    key = lambda r: tuple(map(str, r))
    assert sorted(first, key=key) == sorted(again, key=key)
    placed = [r[6] for r in first if r[6] is not None]
    assert placed == sorted(placed)


def test_schedules_shift_over_time(spark):
    """The first source's weight falls with time, the third's rises."""
    data = [(i, "w " * 10, f"s{i % 3}", f"s{i % 3}", None) for i in range(3000)]
    found = [(r["source"], p) for r in mix(table(spark, data, extra=False)).collect() for p in (r["position"], r["again"]) if p is not None]
    early = lambda s: sum(p < 0.5 for source, p in found if source == s) / sum(source == s for source, _ in found)
    assert early("s0") > early("s1") > early("s2")


def test_without_words_and_empty(spark):
    found = tuples(mix(table(spark, [(1, None, "a", "a", None), (2, "", None, None, None)])), "doc_id", "size", "source_size", "target", "taken")
    assert found == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python(spark):
    text = mix(table(spark, [(1, "a", None, None, None)], extra=False))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
