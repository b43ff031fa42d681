import os
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp

from .helpers import SCHEMA, low, rows, table, words
from .test_near_dedup import sets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def docs(spark, data):
    return table(spark, data, extra=False)


def test_stages_are_as_asked():
    assert [name for name, _ in cp.STAGES] == ["language", "exact", "near", "mixture", "encode"]


def test_each_stage(spark, tmp_path):
    data = list({r[0]: r for r in reversed(rows()) if r[0] is not None}.values())
    at, seen = docs(spark, data), {}
    for name, stage in cp.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = at
        if name != "encode":
            assert at.columns == COLUMNS
    text = {r[0]: r[1] for r in data}
    ids = {name: [r["doc_id"] for r in df.select("doc_id").collect()] for name, df in seen.items()}
    lettered = {i for i, t in text.items() if any(c.isalpha() for c in t or "")}
    assert sorted(ids["language"]) == sorted(lettered)
    largest = {}
    for i in lettered:
        largest[low(text[i])] = max(i, largest.get(low(text[i]), i))
    assert sorted(ids["exact"]) == sorted(largest.values())
    own = {i: sets(text[i], 5) for i in ids["exact"]}
    root = {i: i for i in sorted(own)}
    for i in sorted(own):
        for j in sorted(own):
            if i < j and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j]):
                a, b = sorted((_find(root, i), _find(root, j)))
                root[b] = a
    assert sorted(ids["near"]) == [i for i in sorted(root) if root[i] == i]
    times = Counter(ids["mixture"])
    assert set(times) <= set(ids["near"]) and max(times.values()) <= 2
    spent = sum(len(words(text[i])) * n for i, n in times.items())
    assert spent >= 1.4 * sum(len(words(text[i])) for i in ids["near"])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    wanted = Counter((i, len(library.encode(text[i] or "", add_special_tokens=False).ids)) for i in ids["mixture"])
    assert Counter((r["doc_id"], r["n_tokens"]) for r in seen["encode"].collect()) == wanted


def _find(root, i):
    while root[i] != i:
        i = root[i]
    return i


def test_empty(spark, tmp_path):
    at = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        at = stage(spark, at, str(tmp_path))
    assert at.collect() == []


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test data")
def test_run(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "n_tokens" in out.columns
