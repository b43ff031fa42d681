"""Many parameters in one plan: the number of the query is a context column, so 50 starts cost one pass over the edges, not 50."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopweave.functions.predicates import eq, lt, lte
from hopweave.operators.traversal import Traversal, seeds_from
from hopweave.sources.graph import PropertyGraph


def _top(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of each query."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def ic1(graph: PropertyGraph, params: DataFrame, first_name: str, n: int = 20) -> DataFrame:
    start = seeds_from(graph, "Person", params, "start").as_("start")
    walks = start.repeat(lambda t: t.out("knows"), 3, emit="all", depth="depth").where(F.col("v") != F.col("start"))
    near = Traversal(graph, walks.group("query_id", "v", distance=F.min("depth").cast("long")), "Person")
    found = near.has("first_name", eq(first_name)).values(last_name="last_name")
    return _top(found.df.select("query_id", F.col("v").alias("person_id"), "last_name", "distance"), n, "distance", "last_name", "person_id")


def ic2(graph: PropertyGraph, params: DataFrame, max_date: int | None = None, n: int = 20) -> DataFrame:
    """Without max_date each query has its own, in params."""
    posts = seeds_from(graph, "Person", params, "start").out("knows").in_("hasCreator").has_label("Post").values(creation_date="creation_date")
    posts = posts.where(F.col("creation_date") <= F.col("max_date") if max_date is None else lte(max_date)(F.col("creation_date")))
    return _top(posts.df.select("query_id", F.col("v").alias("post_id"), "creation_date"), n, F.desc("creation_date"), "post_id")


def ic8(graph: PropertyGraph, params: DataFrame, n: int = 20) -> DataFrame:
    replies = seeds_from(graph, "Person", params, "start").in_("hasCreator").in_("replyOf").has_label("Comment").values(creation_date="creation_date")
    found = replies.as_("comment_id").out("hasCreator").df.select("query_id", F.col("v").alias("commenter"), "comment_id", "creation_date")
    return _top(found, n, F.desc("creation_date"), "comment_id")


def ic9(graph: PropertyGraph, params: DataFrame, max_date: int, n: int = 20) -> DataFrame:
    people = seeds_from(graph, "Person", params, "start").repeat(lambda t: t.out("knows"), 2, emit="all", once=True)
    messages = people.as_("creator").in_("hasCreator").values(creation_date="creation_date").where(lt(max_date)(F.col("creation_date")))
    return _top(messages.df.select("query_id", F.col("v").alias("message_id"), "creation_date", "creator"), n, F.desc("creation_date"), "message_id")


def cq1(graph: PropertyGraph, params: DataFrame, n: int = 100, times: int = 5) -> DataFrame:
    found = seeds_from(graph, "Person", params, "start").repeat(lambda t: t.out("knows"), times)
    return _top(found.df.select("query_id", F.col("v").alias("person_id")), n, "person_id")


def cq2(graph: PropertyGraph, params: DataFrame, n: int = 20, times: int = 5) -> DataFrame:
    start = seeds_from(graph, "Person", params, "start")
    mates = start.out("workAt").in_("workAt")
    found = start.repeat(lambda t: t.out("knows"), times, emit=lambda t: t.within(mates, ("query_id",)), once=True)
    return _top(found.df.select("query_id", F.col("v").alias("person_id")), n, "person_id")
