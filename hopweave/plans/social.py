"""The twelve social-network interactive queries as traversals. Dates are epoch milliseconds; every order is total."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.functions.predicates import born_around, eq, gt, inside, lt, lte, without
from hopweave.operators.traversal import Traversal, seeds
from hopweave.sources.graph import PropertyGraph


def friends(graph: PropertyGraph, start: int) -> Traversal:
    return seeds(graph, "Person", start).out("knows")


def within_two(graph: PropertyGraph, start: int) -> Traversal:
    """Everyone one or two steps away, once; the start too if it can be reached."""
    return seeds(graph, "Person", start).repeat(lambda t: t.out("knows"), 2, emit="all", once=True)


def ic1(graph: PropertyGraph, start: int, first_name: str, n: int = 20) -> DataFrame:
    """Persons of a first name up to three steps away, nearest first; the start itself is left out."""
    walks = seeds(graph, "Person", start).repeat(lambda t: t.out("knows"), 3, emit="all", depth="depth").where(F.col("v") != start)
    near = Traversal(graph, walks.group("v", distance=F.min("depth").cast("long")), "Person")
    found = near.has("first_name", eq(first_name)).values(last_name="last_name")
    return found.top(n, "distance", "last_name", "v").select(F.col("v").alias("person_id"), "last_name", "distance")


def ic2(graph: PropertyGraph, start: int, max_date: int, n: int = 20) -> DataFrame:
    """The latest posts of friends up to a date."""
    posts = friends(graph, start).in_("hasCreator").has_label("Post").values(creation_date="creation_date").where(lte(max_date)(F.col("creation_date")))
    return posts.top(n, F.desc("creation_date"), "v").select(F.col("v").alias("post_id"), "creation_date")


def ic3(graph: PropertyGraph, start: int, begin: int, end: int, country_x: str, country_y: str, n: int = 20) -> DataFrame:
    """Persons within two steps who live in neither country and wrote from both in the time."""
    away = within_two(graph, start).where_exists(lambda t: t.out("isLocatedIn").out("isPartOf").has("name", without(country_x, country_y)))
    messages = away.as_("person").in_("hasCreator").has("creation_date", inside(begin, end))
    places = messages.out("isLocatedIn").values(country="name").where(F.col("country").isin(country_x, country_y))
    counts = places.group(F.col("person").alias("person_id"), x_count=F.count_if(F.col("country") == country_x), y_count=F.count_if(F.col("country") == country_y))
    return counts.where((F.col("x_count") > 0) & (F.col("y_count") > 0)).orderBy(F.desc("x_count"), "person_id").limit(n)


def ic4(graph: PropertyGraph, start: int, begin: int, end: int, n: int = 10) -> DataFrame:
    """Tags of friends' posts in a time that none of their earlier posts has."""
    posts = friends(graph, start).in_("hasCreator").has_label("Post")
    old = posts.has("creation_date", lt(begin)).out("hasTag")
    new = posts.has("creation_date", inside(begin, end)).out("hasTag").without(old)
    tags = Traversal(graph, new.group("v", tag_count=F.count("*")), "Tag").values(tag_name="name")
    return tags.top(n, F.desc("tag_count"), "tag_name", "v").select("tag_name", "tag_count")


def ic5(graph: PropertyGraph, start: int, min_date: int, n: int = 20) -> DataFrame:
    """Forums that persons within two steps joined after a date, by the posts of such persons in them."""
    people = within_two(graph, start)
    forums = people.in_("hasMember", where=gt(min_date)(F.col("join_date"))).dedup()
    posts = forums.as_("forum_id").out("containerOf").out("hasCreator").within(people)
    return posts.group("forum_id", post_count=F.count("*")).orderBy(F.desc("post_count"), "forum_id").limit(n)


def ic6(graph: PropertyGraph, start: int, tag_name: str, n: int = 10) -> DataFrame:
    """Tags that stand beside a given tag on posts of persons within two steps."""
    posts = within_two(graph, start).in_("hasCreator").has_label("Post").where_exists(lambda t: t.out("hasTag").has("name", eq(tag_name)))
    tags = posts.out("hasTag").values(tag_name="name").where(F.col("tag_name") != tag_name)
    return tags.group("tag_name", post_count=F.count("*")).orderBy(F.desc("post_count"), "tag_name").limit(n)


def ic7(graph: PropertyGraph, start: int, n: int = 20) -> DataFrame:
    """The latest likes of one's messages. What the messages say is fetched for the top rows only."""
    likes = seeds(graph, "Person", start).in_("hasCreator").as_("message").in_("likes", like_date="creation_date")
    top = Traversal(graph, likes.top(n, F.desc("like_date"), "v", "message"), "Person").as_("like_person").marked(friends(graph, start), "is_friend")
    full = top.select("message", "Message").values(content="content", image_file="image_file", sent="creation_date").df
    words = F.coalesce("content", "image_file", F.lit("")).alias("content")
    return full.select("like_person", "like_date", F.col("message").alias("message_id"), words, (F.col("like_date") - F.col("sent")).alias("latency"), "is_friend").orderBy(F.desc("like_date"), "like_person", "message_id")


def ic8(graph: PropertyGraph, start: int, n: int = 20) -> DataFrame:
    """The latest comments on one's messages."""
    replies = seeds(graph, "Person", start).in_("hasCreator").in_("replyOf").has_label("Comment").values(creation_date="creation_date")
    return replies.as_("comment_id").out("hasCreator").top(n, F.desc("creation_date"), "comment_id").select(F.col("v").alias("commenter"), "comment_id", "creation_date")


def ic9(graph: PropertyGraph, start: int, max_date: int, n: int = 20) -> DataFrame:
    """The latest messages of persons within two steps before a date. What they say is fetched for the top rows only."""
    messages = within_two(graph, start).as_("creator").in_("hasCreator").values(creation_date="creation_date").where(lt(max_date)(F.col("creation_date")))
    top = Traversal(graph, messages.top(n, F.desc("creation_date"), "v"), "Message").values(content="content", image_file="image_file")
    return top.df.select(F.col("v").alias("message_id"), "creation_date", "creator", F.coalesce("content", "image_file", F.lit("")).alias("content")).orderBy(F.desc("creation_date"), "message_id")


def ic10(graph: PropertyGraph, start: int, month: int, n: int = 10) -> DataFrame:
    """Friends of friends born around a month, by how much more they write about one's interests than about other things."""
    interests = seeds(graph, "Person", start).out("hasInterest")
    people = friends(graph, start).out("knows").dedup().where_vertex(born_around(F.col("birthday"), month)).as_("person_id")
    messages = people.in_("hasCreator")
    common = messages.where_exists(lambda t: t.out("hasTag").within(interests)).group("person_id", common=F.count("*"))
    total = messages.group("person_id", total=F.count("*"))
    score = 2 * F.coalesce("common", F.lit(0)) - F.coalesce("total", F.lit(0))
    rows = people.df.select("person_id").join(total, "person_id", "left").join(common, "person_id", "left")
    return rows.select("person_id", score.cast("long").alias("common_score")).orderBy(F.desc("common_score"), "person_id").limit(n)


def ic11(graph: PropertyGraph, start: int, country: str, year: int, n: int = 10) -> DataFrame:
    """Persons within two steps who began to work in a country before a year."""
    jobs = within_two(graph, start).as_("person_id").out("workAt", where=lt(year)(F.col("work_from")), work_from="work_from")
    jobs = jobs.where_exists(lambda t: t.out("isLocatedIn").has("name", eq(country))).values(organisation="name")
    return jobs.top(n, "work_from", "person_id", F.desc("organisation")).select("person_id", "work_from", "organisation")


def ic12(graph: PropertyGraph, start: int, tag_class: str, n: int = 20) -> DataFrame:
    """Friends by how many of their comments answer posts on tags of a class or of its direct subclasses, and those tags."""
    of_class = lambda t: t.out("hasType").union(lambda u: u, lambda u: u.out("isSubclassOf")).has("name", eq(tag_class))
    comments = friends(graph, start).as_("friend_id").in_("hasCreator").has_label("Comment").as_("comment")
    tags = comments.out("replyOf").has_label("Post").out("hasTag").where_exists(of_class).values(name="name")
    found = tags.group("friend_id", reply_count=F.count_distinct("comment"), tag_names=F.array_join(F.array_sort(F.collect_set("name")), ","))
    return found.orderBy(F.desc("reply_count"), "friend_id").limit(n)
