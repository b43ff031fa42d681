"""The six nested queries: loops, correlated existence tests, and one within the other.

Each comes twice: as a traversal with scopes, and (the x forms) written out with DataFrame operations that carry the context as a column. Both
give the same rows.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.functions.predicates import eq
from hopweave.operators.traversal import Traversal, seeds
from hopweave.sources.graph import PropertyGraph


def knows(t: Traversal) -> Traversal:
    return t.out("knows")


def _first(t: Traversal, n: int | None) -> DataFrame:
    rows = t.df.select(F.col("v").alias("person_id")).orderBy("person_id")
    return rows if n is None else rows.limit(n)


def _about(tag_class: str):
    """Whether a person wrote a message on a tag of the class."""
    return lambda t: t.in_("hasCreator").out("hasTag").dedup().out("hasType").has("name", eq(tag_class))


def _companies(graph: PropertyGraph, start: int) -> Traversal:
    return seeds(graph, "Person", start).out("workAt")


def _colleague(graph: PropertyGraph, start: int):
    return lambda t: t.where_exists(lambda u: u.out("workAt").within(_companies(graph, start)))


def cq1(graph: PropertyGraph, start: int, n: int | None = 100, times: int = 5) -> DataFrame:
    """Where a walk of five steps can end."""
    return _first(seeds(graph, "Person", start).repeat(knows, times), n)


def cq2(graph: PropertyGraph, start: int, n: int | None = 20, times: int = 5) -> DataFrame:
    """Persons up to five steps away who share a company with the start."""
    return _first(seeds(graph, "Person", start).repeat(knows, times, emit=_colleague(graph, start), once=True), n)


def cq3(graph: PropertyGraph, start: int, tag_class: str, n: int | None = 10) -> DataFrame:
    """Friends and their friends who wrote on a tag of a class."""
    near = seeds(graph, "Person", start).out("knows").union(lambda t: t, knows).dedup()
    return _first(near.where_exists(_about(tag_class)), n)


def cq4(graph: PropertyGraph, start: int, n: int | None = 10, at_least: int = 1, times: int = 4) -> DataFrame:
    """Friends from whom at least so many persons who share a company with the start are up to four steps away."""
    return _first(seeds(graph, "Person", start).out("knows").dedup().where_exists(lambda t: t.repeat(knows, times, emit=_colleague(graph, start), once=True), at_least), n)


def cq5(graph: PropertyGraph, start: int, tag_class: str, n: int | None = 5, times: int = 5) -> DataFrame:
    """Persons of cq2 who wrote on a tag of a class."""
    found = seeds(graph, "Person", start).repeat(knows, times, emit=_colleague(graph, start), once=True)
    return _first(found.where_exists(_about(tag_class)), n)


def cq6(graph: PropertyGraph, start: int, tag_class: str, n: int | None = 10, times: int = 5) -> DataFrame:
    """Where a walk of five steps can end when everyone on the way wrote on a tag of a class."""
    return _first(seeds(graph, "Person", start).repeat(lambda t: t.out("knows").where_exists(_about(tag_class)), times), n)


# the same, written out


def _knows(graph: PropertyGraph) -> DataFrame:
    return graph.edge("knows", "Person", True).table


def _writers(graph: PropertyGraph, tag_class: str) -> DataFrame:
    """Everyone who wrote on a tag of the class, once."""
    kinds = graph.edge("hasType", "Tag", True).table.join(graph.vertex("TagClass").where(F.col("name") == tag_class).select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("tag"))
    messages = graph.edge("hasTag", "Message", True).table.select(F.col("src").alias("message"), F.col("dst").alias("tag")).join(kinds, "tag", "left_semi")
    made = graph.edge("hasCreator", "Message", True).table.select(F.col("src").alias("message"), F.col("dst").alias("v"))
    return made.join(messages, "message", "left_semi").select("v").distinct()


def _colleagues(graph: PropertyGraph, start: int) -> DataFrame:
    work = graph.edge("workAt", "Person", True).table
    return work.join(work.where(F.col("src") == start).select("dst"), "dst", "left_semi").select(F.col("src").alias("v")).distinct()


def _next(graph: PropertyGraph, at: DataFrame) -> DataFrame:
    kept = [c for c in at.columns if c != "v"]
    return at.join(_knows(graph).select(F.col("src").alias("v"), "dst"), "v").select(*kept, F.col("dst").alias("v")).distinct()


def _walk(graph: PropertyGraph, at: DataFrame, times: int) -> list[DataFrame]:
    found = []
    for _ in range(times):
        at = _next(graph, at)
        found.append(at)
    return found


def _start(graph: PropertyGraph, start: int) -> DataFrame:
    return graph.vertex("Person").where(F.col("id") == start).select(F.col("id").alias("v"))


def _sorted(df: DataFrame, n: int | None) -> DataFrame:
    rows = df.select(F.col("v").alias("person_id")).orderBy("person_id")
    return rows if n is None else rows.limit(n)


def cq3x(graph: PropertyGraph, start: int, tag_class: str, n: int | None = 10) -> DataFrame:
    near = reduce(DataFrame.union, _walk(graph, _start(graph, start), 2)).distinct()
    return _sorted(near.join(_writers(graph, tag_class), "v", "left_semi"), n)


def cq4x(graph: PropertyGraph, start: int, n: int | None = 10, at_least: int = 1, times: int = 4) -> DataFrame:
    owners = _next(graph, _start(graph, start)).withColumn("owner", F.col("v"))
    hits = reduce(DataFrame.union, _walk(graph, owners, times)).join(_colleagues(graph, start), "v", "left_semi")
    return _sorted(hits.groupBy(F.col("owner")).agg(F.count_distinct("v").alias("hits")).where(F.col("hits") >= at_least).select(F.col("owner").alias("v")), n)


def cq5x(graph: PropertyGraph, start: int, tag_class: str, n: int | None = 5, times: int = 5) -> DataFrame:
    found = reduce(DataFrame.union, _walk(graph, _start(graph, start), times)).join(_colleagues(graph, start), "v", "left_semi").distinct()
    return _sorted(found.join(_writers(graph, tag_class), "v", "left_semi"), n)


def cq6x(graph: PropertyGraph, start: int, tag_class: str, n: int | None = 10, times: int = 5) -> DataFrame:
    writers, at = _writers(graph, tag_class), _start(graph, start)
    for _ in range(times):
        at = _next(graph, at).join(writers, "v", "left_semi")
    return _sorted(at, n)
