"""A graph stored under the catalogue's names gives the same answers as the derived graph it was made from."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hopweave.plans import files, nested, registry, social
from hopweave.sources.graph import read_catalogue
from hopweave.sources.schema import EDGES, VERTICES, column, edge_schema, vertex_schema

from .test_oracle import SF

#: Labels of the derived graph that are rows of another one in the catalogue, and what is added to their ids.
PLACES = {"City": 10_000, "Country": 0}


@pytest.fixture(scope="module")
def derived(spark):
    return registry.graph_of(spark, SF)


@pytest.fixture(scope="module")
def path(spark, derived, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("catalogue"))
    number = {x: derived.vertices[x].select("id", F.row_number().over(Window.orderBy("id")).cast("long").alias("_n")) for x in ("TagClass", "Forum")}

    def long_ids(df, label, name):
        if label in number:
            return df.join(number[label].withColumnRenamed("id", name), name).drop(name).withColumnRenamed("_n", name)
        return df.withColumn(name, F.col(name).cast("long") + PLACES.get(label, 0))

    def put(df, schema, folder):
        have = set(df.columns)
        df.select(*((F.col(column(f.name)) if column(f.name) in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema), F.lit(1).alias("unknown")).coalesce(2).write.parquet(f"{path}/{folder}")

    for label in VERTICES:
        if label == "Place":
            parts = [long_ids(derived.vertices[x], x, "id").select("id", (F.col("name") if x == "Country" else F.lit(None).cast("string")).alias("name")) for x in PLACES]
            df = parts[0].union(parts[1])
        else:
            df = long_ids(derived.vertices[label], label, "id")
        put(df, vertex_schema(label), f"vertices/{label}")
    for e in EDGES:
        base = lambda x: "Place" if x in PLACES else derived.base(x)
        found = [x for x in derived.edges if (x.label, base(x.source), base(x.target)) == (e.label, e.source, e.target)]
        schema = edge_schema(e.label, e.source)
        df = long_ids(long_ids(found[0].table, found[0].source, "src"), found[0].target, "dst") if found else spark.createDataFrame([], "src long, dst long")
        put(df, schema, f"edges/{e.source}_{e.label}_{e.target}")
    return path


def test_columns():
    assert [column(x) for x in ("id", "firstName", "locationIP", "workFrom", "url")] == ["id", "first_name", "location_ip", "work_from", "url"]


def test_queries_on_a_stored_graph(spark, path):
    stored = read_catalogue(spark, path).cached()
    assert "unknown" not in stored.vertex("Person").columns
    wanted = registry.queries(registry.SMALL_START)
    for name, (query, _, _) in registry.QUERIES.items():
        columns = ["post_count"] if name == "ic5" else wanted[name](spark, SF).columns  # ids of forums are other ones
        rows = lambda df: [tuple(r) for r in df.select(*columns).collect()]  # noqa: E731, B023
        assert rows(query(stored, registry.SMALL_START)) == rows(wanted[name](spark, SF)), name


def test_wrong_types_are_refused(spark, path, tmp_path):
    for label in VERTICES:
        spark.read.parquet(f"{path}/vertices/{label}").limit(1).withColumn("name" if label == "Tag" else "other", F.lit(1)).write.parquet(f"{tmp_path}/vertices/{label}")
    for e in EDGES:
        spark.read.parquet(f"{path}/edges/{e.source}_{e.label}_{e.target}").limit(1).write.parquet(f"{tmp_path}/edges/{e.source}_{e.label}_{e.target}")
    with pytest.raises(ValueError, match="Tag should have name: string"):
        read_catalogue(spark, str(tmp_path))


#: A line of each format; the rest of the arguments.
LINES = {
    "ic1": ("17 HOUSEHOLD", {}), "ic2": (f"17 {registry.Y2000}", {}), "ic3": (f"17 {registry.Y1996} {registry.FEB2024} NATION_1 NATION_2", {}), "ic4": (f"17 {registry.Y1998} {registry.Y2000}", {}),
    "ic5": (f"17 {registry.Y1998}", {}), "ic6": ("17 " + registry.TAG, {}), "ic7": ("17", {}), "ic8": ("17", {}), "ic9": (f"17 {registry.FEB2024}", {}), "ic10": ("17 4", {}), "ic11": ("17 NATION_3 2002", {}), "ic12": ("17 PROMO", {}),
    "cq1": ("17", {}), "cq2": ("17", {}), "cq3": ("17", {"tag_class": "PROMO"}), "cq4": ("17", {"at_least": 2}), "cq5": ("17", {"tag_class": "PROMO"}), "cq6": ("17", {"tag_class": "PROMO"}),
}


def test_parameter_files(spark, derived, tmp_path):
    assert set(LINES) == set(files.FORMATS)
    for name, (line, others) in LINES.items():
        (tmp_path / name).write_text(f"header of some kind\n{line}\n{line.replace('17', '5', 1)}\n")
        first, second = files.load(spark, str(tmp_path / name), name, **others)
        assert first.func is getattr(social if name.startswith("ic") else nested, name) and (first.keywords["start"], second.keywords["start"]) == (17, 5)
        assert None not in first.keywords.values()
        if name in ("ic3", "ic6", "cq5"):
            assert first(derived).collect() == registry.queries(registry.SMALL_START)[name](spark, SF).collect()
    with pytest.raises(KeyError):
        files.load(spark, str(tmp_path / "ic1"), "ic13")
