import os
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from hopweave.llm import language_id as li
from hopweave.llm.language_id import KernelRidge, fit, identify, language_id, presence

from .helpers import SCHEMA, rows, table, tuples

SF = os.environ.get("HOPWEAVE_TEST_DATA", "/root/testdata/sf0.01")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(found) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.95


def test_rows_and_undetermined(spark):
    data = rows()
    found = tuples(language_id(table(spark, data)), "doc_id", "held_out", "lang_pred", "score")
    text = {r[0]: r[1] for r in data}
    assert sorted(map(str, (r[0] for r in found))) == sorted(str(r[0]) for r in data)
    for doc, held, lang, score in found:
        assert held == (zlib.crc32(b"" if doc is None else str(doc).encode()) % 3 == 1) and 0 <= score <= 1
        if doc is not None:
            assert (lang == "und") == (not any(c.isalpha() for c in text[doc] or ""))
            assert lang in ("en", "de", "und")


def test_only_the_text_counts(spark):
    data = rows()
    model = fit(table(spark, data))
    first = tuples(identify(table(spark, data), model), "doc_id", "lang_pred", "score")
    other = [(i, t, "zz", "other", 9) for i, t, *_ in data]
    assert tuples(identify(table(spark, other), model), "doc_id", "lang_pred", "score") == first


def test_nothing_to_learn_from(spark):
    assert {r[2] for r in tuples(language_id(table(spark, [(1, "text", None, None, None), (2, None, "en", None, None)])))} == {"und"}
    assert language_id(spark.createDataFrame([], SCHEMA)).collect() == []


def test_presence_of_long_texts_is_whole():
    text = "ab" * 40_000
    end = presence(text + "qz")
    assert (end & ~presence(text)).sum() >= 2 and (presence("ab") & end).sum() == presence("ab").sum() == 3
    assert pytest.approx(presence("ABC").sum()) == presence("abc").sum() == 6


def test_sample_is_of_different_texts_with_letters(spark):
    data = [(i, "123 456", "de", None, None) for i in range(900)] + [(900, "ein deutscher Text", "de", None, None)] + [(1000, "an English text", "en", None, None)] * 900 + [(i, f"English text of number {i}", "en", None, None) for i in range(1001, 1030)]
    model = fit(table(spark, data))
    assert model.classes == ["de", "en"] and model.landmarks == 1 + 24


def dense(packed, langs, each):
    """The same in double precision, with the kernel written out between all pairs that are needed."""
    grams = [set(np.flatnonzero(np.unpackbits(np.frombuffer(p, np.uint8))).tolist()) for p in packed]
    kernel = lambda a, b: len(a & b) / max(1, len(a) * len(b)) ** 0.5
    classes = sorted(set(langs))
    marks = [g for c in classes for g in [g for g, x in zip(grams, langs, strict=True) if x == c][:each]]
    k = np.array([[kernel(g, m) for m in marks] for g in grams])
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    good = values > 1e-6 * values[-1]
    span = vectors[:, good] / np.sqrt(values[good])
    x = np.hstack([k @ span, np.ones((len(grams), 1))])
    y = np.array([[1.0 if c == x else -1.0 for c in classes] for x in langs])
    w = np.diag([1 / langs.count(x) for x in langs])
    solved = np.linalg.solve(x.T @ w @ x + li.RIDGE / len(classes) * np.eye(x.shape[1]), x.T @ w @ y)
    return lambda text: np.append(np.array([kernel(set(np.flatnonzero(presence(text)).tolist()), m) for m in marks]) @ span, 1) @ solved, classes


def made(rng, lang, n):
    letters = "".join(chr(97 + (7 * lang + 3 * k) % 26) for k in range(9))
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))


def test_like_a_dense_model():
    rng = random.Random(4)
    langs = sorted(f"l{i % 5}" for i in range(60))
    packed = [np.packbits(presence(made(rng, int(x[1]), 30))).tobytes() for x in langs]
    model, (margins, classes) = KernelRidge(packed, langs), dense(packed, langs, li.LANDMARKS)
    texts = [made(rng, i % 5, rng.randint(1, 60)) for i in range(80)]
    found = [presence(t) for t in texts]
    predicted, scores = model.predict(np.array(found)[:, model.features], np.array([f.sum() for f in found]))
    for text, lang, score in zip(texts, predicted, scores, strict=True):
        wanted = margins(text)
        assert lang == classes[int(wanted.argmax())] and abs(score - min(1, max(0, (wanted.max() + 1) / 2))) < 1e-3


def test_many_languages_in_bounded_memory():
    rng = random.Random(5)
    langs = sorted(f"l{i % 80:02d}" for i in range(80 * 30))
    packed = [np.packbits(presence(made(rng, int(x[1:]), 20))).tobytes() for x in langs]
    tracemalloc.start()
    model = KernelRidge(packed, langs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.classes) == 80 and peak < 400 << 20 and model.weights.nbytes < 32 << 20


def test_ties_go_to_the_first_by_name():
    packed = [np.packbits(presence("the same words")).tobytes()] * 4
    model = KernelRidge(packed, ["b", "a", "b", "a"])
    found = presence("the same words")
    assert model.predict(found[None, model.features], np.array([found.sum()]))[0] == ["a"]
