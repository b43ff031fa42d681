import pytest

from hopweave.sources.fixture import VIEWS, views_sql
from hopweave.sources.params import read_params, write_results
from hopweave.sources.schema import EDGES, VERTICES, edge_schema, vertex_schema


def test_catalogue():
    assert vertex_schema("Person")["birthday"].dataType.simpleString() == "bigint"
    assert edge_schema("workAt").fieldNames() == ["src", "dst", "workFrom"]
    assert edge_schema("isLocatedIn", "Person").fieldNames() == ["src", "dst"]
    for bad in ("", "person"):
        with pytest.raises(KeyError):
            vertex_schema(bad)
    with pytest.raises(KeyError):
        edge_schema("isLocatedIn")
    with pytest.raises(KeyError):
        edge_schema("likes", "Tag")
    assert all(e.source in VERTICES and e.target in VERTICES for e in EDGES)


def test_views_come_after_what_they_need():
    text = views_sql(list(VIEWS))
    for name in VIEWS:
        assert f"{name} as (" in text
    assert views_sql(["v_city"]).count(" as (") == 1


def test_params(spark, tmp_path):
    (tmp_path / "p.txt").write_text("personId firstName\n17 Anna Maria\n18 Bo\n\nx y\n")
    found = [(r["personId"], r["firstName"]) for r in read_params(spark, str(tmp_path / "p.txt"), "personId long, firstName string").orderBy("query_id").collect()]
    assert found == [(17, "Anna Maria"), (18, "Bo")]


def test_results(spark, tmp_path):
    write_results(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
