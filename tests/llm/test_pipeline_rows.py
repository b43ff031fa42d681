"""The stages on rows without an id, repeated rows and rows that share an id."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp

from .helpers import low, rows, table, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(spark, name, data, tmp_path, extra=False):
    out = dict(cp.STAGES)[name](spark, table(spark, data, extra=extra), str(tmp_path))
    return [tuple(r) for r in out.select(*COLUMNS).collect()]


def test_rows_without_an_id_stay(spark, tmp_path):
    data = [*rows(), (None, "another text of its own", "de", "src1", 5)]
    lettered = [r for r in data if any(c.isalpha() for c in r[1] or "")]
    found = stage(spark, "language", data, tmp_path)
    assert Counter((r[0], r[1], *r[3:]) for r in found) == Counter((r[0], r[1], *r[3:]) for r in lettered)
    texts = {r[1] for r in data if r[0] is None and r[1]}
    for name in ("exact", "near"):
        assert {r[1] for r in stage(spark, name, data, tmp_path) if r[0] is None and r[1]} == texts
    assert {r[1] for r in stage(spark, "mixture", [(None, f"text number {i}", "en", "src0", 1) for i in range(40)], tmp_path)}


def test_one_row_of_each_group_stays(spark, tmp_path):
    data = rows() + [(7, "a repeated row of seven words here", "en", "src0", 1)] * 30 + [(None, "repeated without an id", "en", "src0", 1)] * 5 + [(9, "an id of two texts", "en", "src0", 1), (9, "the other one of them", "de", "src1", 2)]
    found = stage(spark, "exact", data, tmp_path)
    assert Counter(low(r[1]) for r in found) == Counter({low(r[1]) for r in data})
    largest = {}
    for i, text, *_ in data:
        largest[low(text)] = max((x for x in (i, largest.get(low(text))) if x is not None), default=None)
    assert all(r[0] == largest[low(r[1])] for r in found)
    near = stage(spark, "near", [r for r in data if r[0] in (7, 9)], tmp_path)
    assert Counter(r[1] for r in near) == Counter({r[1] for r in data if r[0] in (7, 9)})


def test_takes_are_of_rows(spark, tmp_path):
    data = [(7, "a repeated row of seven words here", "en", "src0", 1)] * 30 + [(i, "one two three", "en", "src1", 1) for i in range(20)] + [(9, "an id of two texts", "en", "src0", 1), (9, "the other one of them", "de", "src1", 2)]
    found = Counter(stage(spark, "mixture", data, tmp_path))
    assert all(n <= 2 * Counter(data)[r] for r, n in found.items())
    size = sum(len(words(r[1])) for r in data)
    spent = sum(len(words(r[1])) * n for r, n in found.items())
    assert 1.5 * size - 3 <= spent <= 1.5 * size + 2 * 7


def test_extra_columns_of_any_name(spark, tmp_path):
    data = [(i, f"some text of number {i}", "en", "src0", 1) for i in range(8)]
    clash = table(spark, data).withColumns({c: F.lit("clash") for c in ("lang_pred", "_takes", "_row", "_hash", "component_id", "kept", "position")})
    for name, one in cp.STAGES:
        found, wanted = (sorted(map(str, one(spark, df, str(tmp_path)).collect())) for df in (clash, table(spark, data, extra=False)))
        assert found == wanted, name


def test_rows_of_files_are_keyed_by_their_place(spark, tmp_path):
    data = rows() + rows()
    table(spark, data, extra=False).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    first = {(r["_row"], r["_hash"]) for r in cp._keyed(docs).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # other splits
    try:
        again = {(r["_row"], r["_hash"]) for r in cp._keyed(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert first == again and len({r for r, _ in first}) == len(data)
