"""A graph of ten persons made by hand: a path, a triangle and one alone; answers worked out on paper."""

import re

import pytest
from pyspark.sql import functions as F

from hopweave.functions import predicates as P
from hopweave.operators.traversal import _sources, seeds, seeds_from
from hopweave.plans import nested, social
from hopweave.sources.graph import Edges, PropertyGraph, load_graph, read_graph, save_graph, write_graph

# path 1-2-3-4-5, triangle 6-7-8 with 5-6, 9-10 apart, 11 alone
FRIENDS = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (6, 8), (9, 10)]


@pytest.fixture(scope="module")
def graph(spark):
    make = spark.createDataFrame
    people = [(i, f"first{i % 3}", f"last{i}", 19900000 + m * 100 + d) for i, m, d in [(1, 1, 1), (2, 12, 21), (3, 1, 21), (4, 12, 20), (5, 12, 31), (6, 2, 3), (7, 3, 4), (8, 4, 5), (9, 5, 6), (10, 6, 7), (11, 7, 8)]]
    messages = [(100 + i, "Post", 1000 * i, None, f"image{i}") for i in range(1, 6)] + [(200, "Comment", 9000, "hello", None), (201, "Comment", 9000, None, None)]
    edge = lambda rows: make(rows, "src long, dst long")
    knows = edge(FRIENDS + [(b, a) for a, b in FRIENDS])
    return PropertyGraph(
        {
            "Person": make(people, "id long, first_name string, last_name string, birthday long"), "Message": make(messages, "id long, label string, creation_date long, content string, image_file string"),
            "Tag": make([(1, "red"), (2, "blue")], "id long, name string"), "TagClass": make([(1, "colour"), (2, "warm")], "id long, name string"),
            "Organisation": make([(1, "acme"), (2, "bolt")], "id long, name string"), "City": make([(1,), (2,)], "id long"), "Country": make([(1, "X"), (2, "Y"), (3, "Z")], "id long, name string"), "Forum": make([(1,), (2,)], "id long"),
        },
        [
            Edges("knows", "Person", "Person", knows), Edges("hasCreator", "Message", "Person", edge([(100 + i, i) for i in range(1, 6)] + [(200, 3), (201, 2)])),
            Edges("hasTag", "Message", "Tag", edge([(101, 1), (102, 1), (102, 2), (103, 2), (105, 1)])), Edges("hasType", "Tag", "TagClass", edge([(1, 2), (2, 1)])), Edges("isSubclassOf", "TagClass", "TagClass", edge([(2, 1)])),
            Edges("workAt", "Person", "Organisation", make([(1, 1, 1999), (3, 1, 2000), (6, 1, 2001), (2, 2, 1998)], "src long, dst long, work_from long")),
            Edges("hasInterest", "Person", "Tag", edge([(1, 1)])), Edges("replyOf", "Comment", "Post", edge([(200, 101), (201, 105)])),
            Edges("likes", "Person", "Post", make([(2, 101, 5000), (4, 101, 5000), (2, 101, 7000)], "src long, dst long, creation_date long")),
            Edges("isLocatedIn", "Person", "City", edge([(i, 1 + i % 2) for i in range(1, 12)])), Edges("isPartOf", "City", "Country", edge([(1, 1), (2, 3)])),
            Edges("isLocatedIn", "Message", "Country", edge([(102, 1), (201, 2)])), Edges("isLocatedIn", "Organisation", "Country", edge([(1, 1), (2, 2)])),
            Edges("hasMember", "Forum", "Person", make([(1, 2, 50), (2, 3, 10)], "src long, dst long, join_date long")), Edges("containerOf", "Forum", "Post", edge([(1, 102), (1, 103), (1, 105), (2, 103)])),
        ],
    )


def ids(t):
    return sorted(r[0] for r in (t.df if hasattr(t, "df") else t).select("v").collect())


def test_steps(graph):
    assert ids(seeds(graph, "Person", 2).out("knows")) == [1, 3]
    assert ids(seeds(graph, "Person", 2, 99).in_("hasCreator")) == [102, 201]
    assert ids(seeds(graph, "Person", 2).in_("hasCreator").has_label("Comment")) == [201]
    assert ids(seeds(graph, "Person").out("workAt", where=F.col("work_from") < 2000)) == [1, 2]
    with pytest.raises(KeyError):
        seeds(graph, "Person").out("isPartOf")
    with pytest.raises(KeyError):
        seeds(graph, "Robot")


def test_missing_properties_never_pass(graph):
    messages = seeds(graph, "Message")
    for test in (P.eq("hello"), P.neq("hello"), P.without("x"), P.contains("e")):
        assert 201 not in ids(messages.has("content", test))
    assert ids(messages.has("creation_date", P.inside(2000, 4000))) == [102, 103]
    assert ids(messages.has("creation_date", P.outside(2000, 9000))) == [101, 200, 201]


def test_repeat(graph):
    at = seeds(graph, "Person", 1)
    knows = lambda t: t.out("knows")
    assert ids(at.repeat(knows, 3)) == [2, 4]
    assert ids(at.repeat(knows, 3, emit="all").dedup()) == [1, 2, 3, 4]
    assert ids(at.repeat(knows, 3, simple="path")) == [4]
    assert ids(at.repeat(knows, 4, emit=lambda t: t.has("first_name", P.eq("first1"))).dedup()) == [1, 4]
    depth = {r["v"]: r["d"] for r in at.repeat(knows, 4, emit="all", depth="d").group("v", d=F.min("d")).collect()}
    assert depth == {1: 2, 2: 1, 3: 2, 4: 3, 5: 4}


def test_scopes(graph):
    people = seeds(graph, "Person")
    assert ids(people.where_exists(lambda t: t.in_("hasCreator"))) == [1, 2, 3, 4, 5]
    assert ids(people.where_exists(lambda t: t.in_("hasCreator"), 2)) == [2, 3]
    assert ids(people.where_not_exists(lambda t: t.out("knows"))) == [11]
    # nested: persons with a friend who has a friend that wrote on red
    deep = people.where_exists(lambda t: t.out("knows").where_exists(lambda u: u.out("knows").where_exists(lambda w: w.in_("hasCreator").out("hasTag").has("name", P.eq("red")))))
    assert ids(deep) == [1, 2, 3, 4, 5, 7, 8]


def test_many_starts_in_one_plan(spark, graph):
    params = spark.createDataFrame([(0, 1), (1, 9), (2, 1)], "query_id long, start long")
    found = seeds_from(graph, "Person", params, "start").repeat(lambda t: t.out("knows"), 2)
    assert sorted((r["query_id"], r["v"]) for r in found.df.collect()) == [(0, 1), (0, 3), (1, 9), (2, 1), (2, 3)]


def test_ic1_leaves_the_start_out(graph):
    assert [tuple(r) for r in social.ic1(graph, 1, "first1").collect()] == [(4, "last4", 3)]
    assert [r["person_id"] for r in social.ic1(graph, 8, "first2").collect()] == [5]


def test_dates_are_half_open_and_december_wraps(graph):
    assert [tuple(r) for r in social.ic4(graph, 1, 2000, 2001).collect()] == [("blue", 1), ("red", 1)]
    assert social.ic4(graph, 1, 1000, 2000).collect() == []
    # friends of friends of 4 are 2, 4 and 6; of these, 2 was born on the 21st of December and 4 a day too early
    assert [tuple(r) for r in social.ic10(graph, 4, 12).collect()] == [(2, -2)]
    # of 3: 1 (1 January), 3 (21 January), 5 (31 December)
    assert [tuple(r) for r in social.ic10(graph, 3, 12).collect()] == [(1, -1), (5, -1), (3, -2)]
    # those without messages stay, with score 0: 7 and 8 reach each other by 6
    assert [tuple(r) for r in social.ic10(graph, 6, 3).collect()] == [(8, 0)]


def test_likes_and_replies(graph):
    assert [tuple(r) for r in social.ic7(graph, 1).collect()] == [(2, 7000, 101, "image1", 6000, True), (2, 5000, 101, "image1", 4000, True), (4, 5000, 101, "image1", 4000, False)]
    assert [tuple(r) for r in social.ic8(graph, 1).collect()] == [(3, 200, 9000)]
    assert [tuple(r)[::3] for r in social.ic9(graph, 3, 9001, 2).collect()] == [(200, "hello"), (201, "")]


def test_classes_and_their_parents(graph):
    assert [tuple(r) for r in social.ic12(graph, 2, "colour").collect()] == [(3, 1, "red")]
    assert [tuple(r) for r in social.ic12(graph, 2, "warm").collect()] == [(3, 1, "red")]


def test_nested(graph):
    found = lambda df: [r[0] for r in df.collect()]
    assert found(nested.cq1(graph, 1)) == [2, 4, 6]
    assert found(nested.cq2(graph, 1)) == [1, 3, 6]
    assert found(nested.cq3(graph, 3, "colour")) == found(nested.cq3x(graph, 3, "colour")) == [2, 3]
    for n in (1, 2, 3):
        assert found(nested.cq4(graph, 1, at_least=n)) == found(nested.cq4x(graph, 1, at_least=n))
    assert found(nested.cq5(graph, 1, "warm")) == found(nested.cq5x(graph, 1, "warm")) == [1]
    assert found(nested.cq6(graph, 1, "warm")) == found(nested.cq6x(graph, 1, "warm")) == [2]


def test_storage(spark, graph, tmp_path):
    write_graph(graph, f"{tmp_path}/g")
    again = read_graph(spark, f"{tmp_path}/g", list(graph.vertices), [(e.label, e.source, e.target) for e in graph.edges])
    save_graph(again, "golden", 4)
    stored = load_graph(spark, "golden", graph)
    for g in (again, stored):
        assert [r[0] for r in nested.cq2(g, 1).collect()] == [1, 3, 6]
        assert ids(seeds(g, "Person", 2).in_("hasCreator")) == [102, 201]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = seeds(stored, "Person").out("knows").df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning" not in plan  # both sides lie by the key already


def test_bodies_are_followed_backwards_to_the_same_vertices(graph):
    people, red = seeds(graph, "Person"), lambda t: t.in_("hasCreator").dedup().out("hasTag").has("name", P.eq("red"))
    bodies = [
        red, lambda t: t.in_("hasCreator").has_label("Comment"), lambda t: t.out("workAt", where=F.col("work_from") > 1998).within(seeds(graph, "Organisation", 1)),
        lambda t: t.out("knows").where_exists(red), lambda t: t.out("knows").has("first_name", P.eq("first0")).out("knows"),
    ]
    for body in bodies:
        assert _sources(graph, "Person", body) is not None
        owner, found = people._owned(body)
        wanted = sorted({r[0] for r in found.select(owner).collect()})
        assert ids(people.where_exists(body)) == wanted and wanted
        assert ids(people.where_not_exists(body)) == sorted(set(range(1, 12)) - set(wanted))
    for body in (lambda t: t.out("knows"), lambda t: t.values(n="first_name"), lambda t: t.repeat(lambda u: u.out("knows"), 2).has("first_name", P.eq("first0")), lambda t: t.out("workAt", since="work_from").has("name", P.eq("acme"))):
        assert _sources(graph, "Person", body) is None


def test_edge_property_by_both_ends(graph):
    jobs = seeds(graph, "Person", 1, 2, 4).as_("who").out("workAt").edge_values("workAt", "who", since="work_from").df
    assert sorted(tuple(r) for r in jobs.select("who", "v", "since").collect()) == [(1, 1, 1999), (2, 2, 1998)]
    with pytest.raises(KeyError):
        seeds(graph, "Person").edge_values("workAt", "who")


def test_union_of_different_labels_is_an_error(graph):
    with pytest.raises(ValueError, match="different labels"):
        seeds(graph, "Person", 1).union(lambda t: t.out("knows"), lambda t: t.out("workAt"))


def test_rounds_of_a_loop_are_one_chain(spark, graph):
    knows = lambda t: t.out("knows")
    params = spark.createDataFrame([(0, 1), (1, 8)], "query_id long, start long")
    start = seeds_from(graph, "Person", params, "start")
    whole = start.repeat(knows, 5, emit="all", once=True).df
    # at most two joins a round, the hop and the lookup of the start; separate rounds would hop 1 + 2 + 3 + 4 + 5 times
    assert len(re.findall(r"\bJoin ", whole._jdf.queryExecution().optimizedPlan().toString())) <= 10
    rounds = [sorted(tuple(r) for r in start.repeat(knows, t).df.select("query_id", "v").collect()) for t in range(1, 6)]
    assert sorted(tuple(r) for r in whole.select("query_id", "v").collect()) == sorted({r for found in rounds for r in found})
    each = start.repeat(knows, 5, emit="all")
    assert sorted(each.df.columns) == ["query_id", "v"] and sorted(tuple(r) for r in each.df.select("query_id", "v").collect()) == sorted(r for found in rounds for r in found)
    timed = start.repeat(knows, 5, emit="all", depth="d").df.select("d", "query_id", "v").collect()
    assert sorted(tuple(r) for r in timed) == sorted((t, *r) for t, found in enumerate(rounds, 1) for r in found)
    paths = seeds(graph, "Person", 5).repeat(knows, 3, emit="all", simple="p").df.collect()
    assert sorted(tuple(r["p"]) for r in paths) == [(5, 4), (5, 4, 3), (5, 4, 3, 2), (5, 6), (5, 6, 7), (5, 6, 7, 8), (5, 6, 8), (5, 6, 8, 7)]
    assert not any(r[0] for r in seeds(graph, "Person", 11).repeat(knows, 2, emit="all").df.collect())
    with pytest.raises(ValueError, match="times"):
        start.repeat(knows, 0, emit="all")


def test_loop_that_ends_in_another_label_or_with_other_columns(graph):
    """The start can't join in there; the rounds are put together one by one."""
    body = lambda t: t.as_("at").out("knows")
    found = seeds(graph, "Person", 1).repeat(body, 2, emit="all", depth="d").df.select("d", "at", "v").collect()
    assert sorted(tuple(r) for r in found) == [(1, 1, 2), (2, 2, 1), (2, 2, 3)]
    replies = seeds(graph, "Post", 101, 105).repeat(lambda t: t.in_("replyOf"), 1, emit="all", once=True)
    assert replies.label == "Comment" and ids(replies) == [200, 201]


def _exchanges(df):
    """The shuffles of a plan as it ran, without those that filled the cache."""
    df.collect()
    found, below = 0, None
    for line in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines():
        depth = len(line) - len(line.lstrip(" :+-*("))
        if below is None or depth <= below:
            below = depth if "InMemoryTableScan" in line else None
            found += "Exchange hashpartitioning" in line
    return found


def test_loops_over_a_cached_graph_shuffle_what_they_found_only(spark, graph):
    cached = graph.cached()
    cached.warm()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _exchanges(seeds(cached, "Person").out("knows").df) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        cached.mapped(lambda t: t.unpersist())


def test_a_loop_in_a_condition_is_one_chain(graph):
    for n in (1, 2, 3):
        df = nested.cq4(graph, 1, at_least=n)
        # four hops, the friends in front and the colleagues at the end; separate rounds would take ten hops and four times the start's
        assert len(re.findall(r"\bJoin ", df._jdf.queryExecution().optimizedPlan().toString())) <= 4 * 3 + 6
        assert df.collect() == nested.cq4x(graph, 1, at_least=n).collect()
