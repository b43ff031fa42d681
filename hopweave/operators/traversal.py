"""Graph traversals as DataFrame plans.

A traversal is a DataFrame with the current vertex in `v` and the columns it carries along: names given by as_, properties, the
depth of a loop, or a context such as a query's number when many parameters run as one plan. A step is a join, a semi join or a
distinct that Catalyst orders and places; loops are unrolled; a correlated sub-traversal runs once for all its distinct inputs, with the
input carried as a context column, and ends in a semi join. No step starts a job.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopweave.functions.predicates import Predicate
from hopweave.sources.graph import PropertyGraph

Body = Callable[["Traversal"], "Traversal"]


def seeds(graph: PropertyGraph, label: str, *ids) -> Traversal:
    """The vertices of these ids, or all of the label. Ids that the table lacks are left out."""
    table = graph.vertex(label)
    return Traversal(graph, (table.where(F.col("id").isin(*ids)) if ids else table).select(F.col("id").alias("v")), label)


def seeds_from(graph: PropertyGraph, label: str, params: DataFrame, column: str) -> Traversal:
    """The vertices that a table of parameters names. Its other columns are carried, so that many queries run as one plan."""
    carried = [c for c in params.columns if c != column]
    found = params.select(F.col(column).alias("v"), *carried).join(graph.vertex(label).select(F.col("id").alias("v")), "v", "left_semi")
    return Traversal(graph, found, label)


def scan_edges(graph: PropertyGraph, name: str, source: str, where: Column | None = None) -> DataFrame:
    """The edges of one type, with their properties."""
    table = graph.edge(name, source, True).table
    return table if where is None else table.where(where)


class Traversal:
    def __init__(self, graph: PropertyGraph, df: DataFrame, label: str):
        self.graph, self.df, self.label = graph, df, label

    def _with(self, df: DataFrame, label: str | None = None) -> Traversal:
        return Traversal(self.graph, df, label or self.label)

    # filters

    def has_label(self, label: str) -> Traversal:
        """Those whose vertex has the label."""
        return self._with(self.df.join(self.graph.vertex(label).select(F.col("id").alias("v")), "v", "left_semi"), label)

    def has(self, prop: str, test: Predicate) -> Traversal:
        """Those whose property passes. The test reaches the scan of the vertex table."""
        return self.where_vertex(test(F.col(prop)))

    def where_vertex(self, condition: Column) -> Traversal:
        """Those whose vertex meets a condition on its properties."""
        ids = self.graph.vertex(self.label).where(condition).select(F.col("id").alias("v"))
        return self._with(self.df.join(ids, "v", "left_semi"))

    def where(self, condition: Column) -> Traversal:
        """Those that meet a condition on carried columns."""
        return self._with(self.df.where(condition))

    def within(self, other: DataFrame | Traversal, by: tuple[str, ...] = ()) -> Traversal:
        """Those that are in another traversal's result, of the same context columns `by`."""
        return self._with(self.df.join(_keys(other, by), ["v", *by], "left_semi"))

    def without(self, other: DataFrame | Traversal, by: tuple[str, ...] = ()) -> Traversal:
        return self._with(self.df.join(_keys(other, by), ["v", *by], "left_anti"))

    def marked(self, other: DataFrame | Traversal, name: str, by: tuple[str, ...] = ()) -> Traversal:
        """Adds whether the vertex is in another traversal's result."""
        flags = _keys(other, by).withColumn(name, F.lit(True))
        return self._with(self.df.join(flags, ["v", *by], "left").withColumn(name, F.coalesce(name, F.lit(False))))

    # steps

    def out(self, name: str, where: Column | None = None, **carry: str) -> Traversal:
        """To the neighbours along edges of this type. where: on edge properties; carry: new column names for edge properties."""
        return self._hop(name, True, where, carry)

    def in_(self, name: str, where: Column | None = None, **carry: str) -> Traversal:
        """The same against the edges' direction."""
        return self._hop(name, False, where, carry)

    def _hop(self, name: str, forward: bool, where: Column | None, carry: dict[str, str]) -> Traversal:
        edge = self.graph.edge(name, self.label, forward)
        table = edge.table if forward or edge.by_target is None else edge.by_target
        if where is not None:
            table = table.where(where)
        near, far = ("src", "dst") if forward else ("dst", "src")
        table = table.select(F.col(near).alias("v"), F.col(far).alias("_to"), *(F.col(p).alias(alias) for alias, p in carry.items()))
        df = self.df.join(table, "v").drop("v").withColumnRenamed("_to", "v")
        return self._with(df.select("v", *(c for c in df.columns if c != "v")), edge.target if forward else edge.source)

    def values(self, **carry: str) -> Traversal:
        """Carries vertex properties under new names."""
        table = self.graph.vertex(self.label).select(F.col("id").alias("v"), *(F.col(p).alias(alias) for alias, p in carry.items()))
        return self._with(self.df.join(table, "v"))

    def edge_values(self, name: str, source: str, **carry: str) -> Traversal:
        """Carries properties of the edge of this type from the vertex in column source to the current one. Rows without such an edge go."""
        found = [e for e in self.graph.edges if e.label == name and self.graph.base(e.target) == self.graph.base(self.label)]
        if len(found) != 1:
            raise KeyError(f"{len(found)} edge types {name!r} to {self.label!r}")
        table = found[0].table.select(F.col("src").alias(source), F.col("dst").alias("v"), *(F.col(p).alias(alias) for alias, p in carry.items()))
        return self._with(self.df.join(table, ["v", source]))

    def as_(self, name: str) -> Traversal:
        return self._with(self.df.withColumn(name, F.col("v")))

    def select(self, name: str, label: str) -> Traversal:
        """Back to a vertex that as_ named."""
        return self._with(self.df.withColumn("v", F.col(name)), label)

    def carry(self, **columns: Column) -> Traversal:
        return self._with(self.df.withColumns(columns))

    def drop(self, *names: str) -> Traversal:
        return self._with(self.df.drop(*names))

    def dedup(self) -> Traversal:
        """Equal rows once: a vertex once for each context that it is carried in."""
        return self._with(self.df.distinct())

    def union(self, *bodies: Body) -> Traversal:
        """All rows of several bodies, each applied to this traversal."""
        found = [b(self) for b in bodies]
        bases = {self.graph.base(t.label) for t in found}
        if len(bases) > 1:
            raise ValueError(f"the bodies of a union end in different labels: {sorted(bases)}")
        return self._with(reduce(DataFrame.unionByName, [t.df for t in found]), found[0].label)

    # scopes

    def repeat(self, body: Body, times: int, emit: str | Body = "last", depth: str | None = None, simple: str | None = None, once: bool = False) -> Traversal:
        """Applies body again and again, each time to what it found before, equal rows once.

        emit: `last` gives what the last time found, `all` what any time found, a body, which only filters, those of any time that it lets through. depth:
        a column that gets the number of the time. simple: a column that gets the path, an array; vertices that it holds already are left out. once: a row
        comes once, not once for each time that found it.

        What any time found comes from one chain of `times` bodies, as body treats each row for itself: the start joins in before each time, so the last one
        finds what the walks of all lengths find. Without once, rows carry the number of their time.
        """
        if times < 1:
            raise ValueError("times must be at least 1")
        start, number = self.dedup(), "_time" + "_" * sum(c.startswith("_time") for c in self.df.columns)
        counted = emit != "last" and (depth is not None or not (once or simple))
        if simple:
            start = start.carry(**{simple: F.array("v")})
        if counted:
            start = start.carry(**{number: F.lit(0)})

        def step(at: Traversal) -> Traversal:
            at = body(at)
            if simple:
                at = at.where(~F.array_contains(simple, F.col("v"))).carry(**{simple: F.concat(simple, F.array("v"))})
            return (at.carry(**{number: F.col(number) + 1}) if counted else at).dedup()

        found = [step(start)]
        # the start can only join in where the first time ends as it began
        joins_in = emit != "last" and found[0].label == start.label and set(found[0].df.columns) == set(start.df.columns)
        for _ in range(1, times):
            at = found[-1]
            found.append(step(at._with(at.df.unionByName(start.df)) if joins_in else at))
        out = found[-1]
        if emit != "last" and not joins_in:
            out = out._with(reduce(DataFrame.unionByName, [t.df for t in found]))
            out = out.dedup() if once else out
        if depth:
            out = out.carry(**{depth: F.col(number) if counted else F.lit(times)})
        out = out.drop(number) if counted else out
        return emit(out) if callable(emit) else out

    def _owned(self, body: Body) -> tuple[str, DataFrame]:
        """What body finds for each distinct vertex, which is carried as its owner."""
        owner = "_owner" + "_" * sum(c.startswith("_owner") for c in self.df.columns)
        inner = self._with(self.df.select("v").distinct().withColumn(owner, F.col("v")))
        return owner, body(inner).df.select(owner, "v")

    def where_exists(self, body: Body, at_least: int = 1) -> Traversal:
        """Those for whose vertex body finds at least so many vertices.

        A body that is a chain of hops and filters is followed backwards from its filters, once, to the set of all vertices for which it finds something. The set doesn't depend on
        where the traversal is, so the rounds of a loop share it. Other bodies run forwards from this traversal's distinct vertices.
        """
        hit = _sources(self.graph, self.label, body) if at_least == 1 else None
        if hit is not None:
            return self._with(self.df.join(hit, "v", "left_semi"))
        owner, found = self._owned(body)
        hit = found.select(F.col(owner).alias("v")) if at_least == 1 else found.groupBy(F.col(owner).alias("v")).agg(F.count_distinct("v").alias("_n")).where(F.col("_n") >= at_least).select("v")
        return self._with(self.df.join(hit, "v", "left_semi"))

    def where_not_exists(self, body: Body) -> Traversal:
        hit = _sources(self.graph, self.label, body)
        if hit is not None:
            return self._with(self.df.join(hit, "v", "left_anti"))
        owner, found = self._owned(body)
        return self._with(self.df.join(found.select(F.col(owner).alias("v")), "v", "left_anti"))

    # ends

    def group(self, *keys: str | Column, **aggregates: Column) -> DataFrame:
        return self.df.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items()))

    def count(self, name: str = "n") -> DataFrame:
        return self.df.agg(F.count("*").alias(name))

    def top(self, n: int, *order: Column | str) -> DataFrame:
        return self.df.orderBy(*order).limit(n)


def _keys(other: DataFrame | Traversal, by: tuple[str, ...]) -> DataFrame:
    return (other.df if isinstance(other, Traversal) else other).select("v", *by).distinct()


class _NoChainError(Exception):
    """The body does something else than hops and filters."""


class _Chain:
    """Stands for a traversal while a body is read: keeps its hops and filters in order, and doesn't read any data."""

    def __init__(self, graph: PropertyGraph, label: str, steps: tuple = ()):
        self.graph, self.label, self.steps = graph, label, steps

    def __getattr__(self, name: str):
        raise _NoChainError(name)

    def _hop(self, name: str, forward: bool, where: Column | None, carry: dict[str, str]) -> _Chain:
        if carry:
            raise _NoChainError("carried properties")
        edge = self.graph.edge(name, self.label, forward)
        return _Chain(self.graph, edge.target if forward else edge.source, (*self.steps, (edge, forward, where)))

    def out(self, name: str, where: Column | None = None, **carry: str) -> _Chain:
        return self._hop(name, True, where, carry)

    def in_(self, name: str, where: Column | None = None, **carry: str) -> _Chain:
        return self._hop(name, False, where, carry)

    def _keep(self, ids: DataFrame, label: str | None = None) -> _Chain:
        return _Chain(self.graph, label or self.label, (*self.steps, ids))

    def has(self, prop: str, test: Predicate) -> _Chain:
        return self.where_vertex(test(F.col(prop)))

    def where_vertex(self, condition: Column) -> _Chain:
        return self._keep(self.graph.vertex(self.label).where(condition).select(F.col("id").alias("v")))

    def has_label(self, label: str) -> _Chain:
        return self._keep(self.graph.vertex(label).select(F.col("id").alias("v")), label)

    def within(self, other: DataFrame | Traversal, by: tuple[str, ...] = ()) -> _Chain:
        if by:
            raise _NoChainError("context columns")
        return self._keep(_keys(other, ()))

    def where_exists(self, body: Body, at_least: int = 1) -> _Chain:
        found = _sources(self.graph, self.label, body) if at_least == 1 else None
        if found is None:
            raise _NoChainError("a nested body")
        return self._keep(found)

    def dedup(self) -> _Chain:
        return self


def _sources(graph: PropertyGraph, label: str, body: Body) -> DataFrame | None:
    """All vertices from which body, a chain with a filter behind its first hop, finds something; None for other bodies."""
    try:
        chain = body(_Chain(graph, label))
    except _NoChainError:
        return None
    if not isinstance(chain, _Chain) or not any(isinstance(s, DataFrame) for s in chain.steps[1:]):
        return None
    found = None
    for step in reversed(chain.steps):
        if isinstance(step, DataFrame):
            found = step if found is None else found.join(step, "v", "left_semi")
        else:
            edge, forward, where = step
            table = edge.table if not forward or edge.by_target is None else edge.by_target
            if where is not None:
                table = table.where(where)
            near, far = ("src", "dst") if forward else ("dst", "src")
            back = table.select(F.col(near).alias("_near"), F.col(far).alias("v"))
            found = (back if found is None else back.join(found, "v", "left_semi")).select(F.col("_near").alias("v")).distinct()
    return found
