"""A property graph as DataFrames: one table for each vertex label and for each typed edge, and how they are stored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import EDGES, KINDS, VERTICES, column, edge_schema, vertex_schema


@dataclass(frozen=True)
class Edges:
    """Edges of one label between two vertex labels. by_target is a second copy, laid out by dst, if there is one."""

    label: str
    source: str
    target: str
    table: DataFrame
    by_target: DataFrame | None = None


class PropertyGraph:
    """vertices: a table with `id` and properties for each label. edges: tables with `src`, `dst` and properties."""

    def __init__(self, vertices: dict[str, DataFrame], edges: list[Edges], kinds: dict[str, str] = KINDS):
        self.vertices, self.edges, self.kinds = vertices, edges, kinds

    def base(self, label: str) -> str:
        return self.kinds.get(label, label)

    def vertex(self, label: str) -> DataFrame:
        if label in self.vertices:
            return self.vertices[label]
        if self.base(label) not in self.vertices:
            raise KeyError(f"no vertex label {label!r}; there are {sorted(self.vertices)}")
        return self.vertices[self.base(label)].where(F.col("label") == label)

    def edge(self, name: str, at: str, forward: bool) -> Edges:
        """The only edge type of this name that leaves (or enters) this vertex label."""
        found = [e for e in self.edges if e.label == name and self.base(e.source if forward else e.target) == self.base(at)]
        if len(found) != 1:
            raise KeyError(f"{len(found)} edge types {name!r} {'from' if forward else 'to'} {at!r}")
        return found[0]

    def mapped(self, f) -> PropertyGraph:
        """The same graph with f applied to each table."""
        return PropertyGraph({k: f(t) for k, t in self.vertices.items()}, [Edges(e.label, e.source, e.target, f(e.table), e.by_target and f(e.by_target)) for e in self.edges], self.kinds)

    def cached(self) -> PropertyGraph:
        """The same graph, kept where it has been used. Edges from a label to itself, which loops follow time after time, are laid out by src, so that each time shuffles what it found and not the edges."""

        def laid(e: Edges) -> DataFrame:
            if self.base(e.source) != self.base(e.target):
                return e.table
            return e.table.repartition(int(e.table.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src").sortWithinPartitions("src")

        edges = [Edges(e.label, e.source, e.target, laid(e), e.by_target) for e in self.edges]
        return PropertyGraph(self.vertices, edges, self.kinds).mapped(lambda t: t.persist())

    def warm(self) -> int:
        """Fills the cache; the number of rows."""
        return sum(t.count() for t in [*self.vertices.values(), *(e.table for e in self.edges), *(e.by_target for e in self.edges if e.by_target is not None)])


def _name(e: Edges) -> str:
    return f"{e.source}_{e.label}_{e.target}".lower()


def save_graph(graph: PropertyGraph, prefix: str, buckets: int) -> None:
    """Saves the graph as bucketed tables in the session's warehouse: vertices by id, edges once by src and once by dst.

    Steps along either direction then read their side of the join as it lies; only the frontier is shuffled. Choose the number of
    buckets so that one of the largest table fits a task's memory.
    """

    def put(table: DataFrame, key: str, name: str) -> None:
        table.repartition(buckets, key).sortWithinPartitions(key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(f"{prefix}_{name}")

    for label, table in graph.vertices.items():
        put(table, "id", f"v_{label.lower()}")
    for e in graph.edges:
        put(e.table, "src", f"e_{_name(e)}_out")
        put(e.table, "dst", f"e_{_name(e)}_in")


def load_graph(spark: SparkSession, prefix: str, like: PropertyGraph) -> PropertyGraph:
    """The graph that save_graph saved; like names its labels."""
    vertices = {label: spark.table(f"{prefix}_v_{label.lower()}") for label in like.vertices}
    edges = [Edges(e.label, e.source, e.target, spark.table(f"{prefix}_e_{_name(e)}_out"), spark.table(f"{prefix}_e_{_name(e)}_in")) for e in like.edges]
    return PropertyGraph(vertices, edges, like.kinds)


def read_graph(spark: SparkSession, path: str, labels: list[str], edges: list[tuple[str, str, str]], kinds: dict[str, str] = KINDS) -> PropertyGraph:
    """A graph from Parquet folders: path/vertices/<label> and path/edges/<source>_<label>_<target>."""
    found = [Edges(name, s, t, spark.read.parquet(f"{path}/edges/{s}_{name}_{t}")) for name, s, t in edges]
    return PropertyGraph({x: spark.read.parquet(f"{path}/vertices/{x}") for x in labels}, found, kinds)


def read_catalogue(spark: SparkSession, path: str) -> PropertyGraph:
    """The graph of the catalogue, from folders laid out as for read_graph whose columns bear the catalogue's names.

    A label whose folder lacks a property, or has it in another type, is refused; columns that the catalogue doesn't know are left out. Cities and countries are rows of Place.
    """

    def table(folder: str, schema) -> DataFrame:
        found = spark.read.parquet(f"{path}/{folder}")
        kinds = dict(found.dtypes)
        wrong = [f"{f.name}: {f.dataType.simpleString()}" for f in schema if kinds.get(f.name) != f.dataType.simpleString()]
        if wrong:
            raise ValueError(f"{folder} should have {', '.join(wrong)}")
        return found.select(*(F.col(f.name).alias(column(f.name)) for f in schema))

    edges = [Edges(e.label, e.source, e.target, table(f"edges/{e.source}_{e.label}_{e.target}", edge_schema(e.label, e.source))) for e in EDGES]
    return PropertyGraph({x: table(f"vertices/{x}", vertex_schema(x)) for x in VERTICES}, edges)


def write_graph(graph: PropertyGraph, path: str) -> None:
    for label, table in graph.vertices.items():
        table.write.parquet(f"{path}/vertices/{label}")
    for e in graph.edges:
        e.table.write.parquet(f"{path}/edges/{e.source}_{e.label}_{e.target}")
