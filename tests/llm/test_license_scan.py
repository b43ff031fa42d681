import re
from collections import Counter

from hopweave.llm.license_scan import LICENSES, PHRASES, TEMPLATES, scan, votes

from .helpers import SCHEMA, low, rows, table, tuples

SPLIT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(data):
    out = []
    for r in data:
        w = SPLIT.findall(low(r[1]))
        starts, labels = [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split(" ")
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    starts.append(i)
                    labels.add(label)
        out.append((r[0], len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    return out


BASE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def test_base_like_brute_force(spark):
    data = rows() + [(400, "cc by cc by CC-BY all rights reserved GENERAL public license " * 40, None, None, None), (401, "cc  by", None, None, None), (402, "cc byx all rights", None, None, None)]
    found = tuples(scan(table(spark, data)), *BASE)
    assert Counter(found) == Counter(brute(data))


def test_templates_with_changed_words(spark):
    text = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction".split(" ")
    changed = [w for i, w in enumerate(text) if i not in (7, 15)]
    changed.insert(20, "added")
    data = [(1, "lead in " + " ".join(changed) + " and on", None, None, None), (2, " ".join(text[:8]), None, None, None), (3, " ".join(reversed(text)), None, None, None), (4, " ".join(text).title(), None, None, None)]
    found = {r[0]: r[1:] for r in tuples(scan(table(spark, data)), "doc_id", "labels", "score", "n_base")}
    assert found[1][0] == "mit" and 0.75 <= found[1][1] < 1 and found[4] == ("mit", 1.0, 0)
    assert found[2] == ("", 0.0, 0) and found[3] == ("", 0.0, 0)


def test_every_template_is_found_and_scores_are_shares(spark):
    data = [(i, f"x {t} y", None, None, None) for i, t in enumerate(TEMPLATES)]
    found = tuples(scan(table(spark, data)), "doc_id", "labels", "score")
    assert all(TEMPLATES[list(TEMPLATES)[i]] in labels.split(",") and score == 1.0 for i, labels, score in found)


def test_long_repeats_and_empty(spark):
    data = [(1, "all rights reserved " * 20_000, None, None, None)]
    assert tuples(scan(table(spark, data)), *BASE) == brute(data)
    assert scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python(spark):
    text = scan(table(spark, [(1, "a", None, None, None)], extra=False))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
    text = votes(table(spark, [(1, "a", None, None, None)], extra=False))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "BroadcastHashJoin" in text


def test_templates_beside_repeats_of_their_words(spark):
    whole, long = list(TEMPLATES)[:2]
    data = [(n, "lead in " + whole + " mit license" * n, None, None, None) for n in (0, 4, 5, 400)]
    data += [(1000 + n, "mit license " * n + whole + " the mit license" * n, None, None, None) for n in (4, 50)]
    data += [(2000, "the software " * 60 + long + " the software" * 60, None, None, None), (3000, "mit license " * 500, None, None, None), (3001, "the mit license under the mit " * 50, None, None, None)]
    found = {r[0]: r[1:] for r in tuples(scan(table(spark, data)), "doc_id", "labels", "score")}
    assert all(found[i] == ("mit", 1.0) for i in found if i < 3000)
    assert found[3000] == ("", 0.0)
    assert found[3001] == ("mit", 0.75)


def test_whole_licenses(spark):
    data, wanted = [], {}
    for i, (label, text) in enumerate(LICENSES.items()):
        split = SPLIT.findall(low(text))
        kept = [w for j, w in enumerate(split) if j % 40 != 20]
        shuffled = sorted(split)
        data += [(10 * i + j, x, None, None, None) for j, x in enumerate((f"Copyright 2020 somebody\n{text}\nmore", "a b " + " ".join(kept), " ".join(split[: len(split) // 2]), " ".join(shuffled), (text + " ") * 30))]
        wanted |= {10 * i: (label, 1.0), 10 * i + 4: (label, 1.0), 10 * i + 1: (label, None)}
    found = {r[0]: r[1:] for r in tuples(scan(table(spark, data)), "doc_id", "labels", "score")}
    for i, (label, score) in wanted.items():
        assert label in found[i][0].split(",") and found[i][1] == (score or found[i][1]), i
    assert all(label not in found[10 * i + 3][0] for i, label in enumerate(LICENSES))
    assert not found[12][0] and not found[32][0]  # half a license; those of the two others hold whole passages of theirs


def test_rows_of_one_id_and_text(spark):
    data = [(7, "cc by", None, None, None)] * 3 + [(7, "", None, None, None), (7, None, None, None, None), (None, "cc by", None, None, None)]
    assert Counter(tuples(scan(table(spark, data)), *BASE)) == Counter(brute(data))
