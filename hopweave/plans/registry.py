"""All graph queries and operators over the derived social graph, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.functions.predicates import always, birth_day, birth_month, both, contains, either, eq, gt, gte, inside, lt, lte, neq, outside, within, without
from hopweave.operators.traversal import Traversal, scan_edges, seeds, seeds_from
from hopweave.sources.fixture import VIEWS, fixture_graph, views_sql
from hopweave.sources.graph import PropertyGraph
from hopweave.sources.params import parse_params

from . import batch, files, nested, social

#: Parameters of the registered queries. Times are epoch milliseconds.
START, SMALL_START = 952, 17
Y1996, Y1998, Y2000 = 820454400000, 883612800000, 946684800000
FEB2024 = 1706745600000
BATCH = (952, 17, 5, 40, 101)
TAG = "blue rod #6"

_graphs: dict[tuple[str, str], PropertyGraph] = {}


def graph_of(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The session's graph of a data folder, cached where it has been used: Spark drops what does not fit and computes lost parts again."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        _graphs[key] = fixture_graph(spark, sf_dir).cached()
    return _graphs[key]


# single operators

def _ids(t: Traversal, name: str = "id") -> DataFrame:
    return t.df.select(F.col("v").alias(name))


def _posts(g: PropertyGraph) -> Traversal:
    return seeds(g, "Post").values(creation_date="creation_date")


def _cmp(test) -> Callable:
    return lambda g, s: _ids(seeds(g, "Person").has("birthday", test))


_ALL2 = """h1 as (select dst as v from e_knows where src = {s}), h2 as (select k.dst as v from h1 join e_knows k on k.src = h1.v), f12 as (select v from h1 union select v from h2)"""
_HOPS = ", ".join(["h1 as (select distinct dst as v from e_knows where src = {s})", *(f"h{t} as (select distinct k.dst as v from h{t - 1} join e_knows k on k.src = h{t - 1}.v)" for t in range(2, 6))])
_COLLEAGUES = "colleagues as (select distinct w.src as v from e_work_at w where w.dst in (select dst from e_work_at where src = {s}))"
_WRITERS = "writers as (select distinct c.dst as v from e_has_creator c join e_has_tag t on t.src = c.src join e_has_type y on y.src = t.dst join v_tagclass k on k.id = y.dst where k.name = 'PROMO')"

#: name: (query of a graph and a start person, CTEs and SQL)
OPERATORS: dict[str, tuple[Callable[[PropertyGraph, int], DataFrame], str, str]] = {
    "seed": (lambda g, s: _ids(seeds(g, "Person", s)), "", "select id from v_person where id = {s}"),
    "scan_vertex": (lambda g, s: _ids(seeds(g, "Tag").has("name", contains("#3"))), "", "select id from v_tag where name like '%#3%'"),
    "scan_edge": (lambda g, s: scan_edges(g, "workAt", "Person", F.col("work_from") < 1998).select("src", "dst", "work_from"), "", "select src, dst, work_from from e_work_at where work_from < 1998"),
    "get_vertex": (lambda g, s: seeds(g, "Person", s).values(first_name="first_name", last_name="last_name", birthday="birthday").df.withColumnRenamed("v", "id"), "", "select id, first_name, last_name, birthday from v_person where id = {s}"),
    "out": (lambda g, s: _ids(seeds(g, "Person", s).out("knows")), "", "select dst as id from e_knows where src = {s}"),
    "in_": (lambda g, s: _ids(seeds(g, "Person", s).in_("hasCreator")), "", "select src as id from e_has_creator where dst = {s}"),
    "out_edge_props": (lambda g, s: seeds(g, "Person", s).out("workAt", work_from="work_from").df.withColumnRenamed("v", "id"), "", "select dst as id, work_from from e_work_at where src = {s}"),
    "in_edge_props": (lambda g, s: seeds(g, "Person", s).in_("hasMember", join_date="join_date").df.withColumnRenamed("v", "id"), "", "select src as id, join_date from e_has_member where dst = {s}"),
    "edge_by_ends": (lambda g, s: seeds(g, "Person", s).as_("person").out("workAt").edge_values("workAt", "person", since="work_from").df.select("person", F.col("v").alias("organisation"), "since"), "", "select src as person, dst as organisation, work_from as since from e_work_at where src = {s}"),
    "always": (lambda g, s: _ids(seeds(g, "Person").has("first_name", always())), "", "select id from v_person"),
    "has_eq": (lambda g, s: _ids(seeds(g, "Person").has("first_name", eq("BUILDING"))), "", "select id from v_person where first_name = 'BUILDING'"),
    "has_neq": (lambda g, s: _ids(seeds(g, "Person").has("first_name", neq("BUILDING"))), "", "select id from v_person where first_name <> 'BUILDING'"),
    "within": (lambda g, s: _ids(seeds(g, "Person").has("first_name", within("BUILDING", "MACHINERY"))), "", "select id from v_person where first_name in ('BUILDING', 'MACHINERY')"),
    "without": (lambda g, s: _ids(seeds(g, "Person").has("first_name", without("BUILDING", "MACHINERY"))), "", "select id from v_person where first_name not in ('BUILDING', 'MACHINERY')"),
    "lt": (_cmp(lt(19700615)), "", "select id from v_person where birthday < 19700615"),
    "lte": (_cmp(lte(19700615)), "", "select id from v_person where birthday <= 19700615"),
    "gt": (_cmp(gt(19700615)), "", "select id from v_person where birthday > 19700615"),
    "gte": (_cmp(gte(19700615)), "", "select id from v_person where birthday >= 19700615"),
    "inside": (_cmp(inside(19700101, 19750101)), "", "select id from v_person where birthday >= 19700101 and birthday < 19750101"),
    "outside": (_cmp(outside(19700101, 19750101)), "", "select id from v_person where birthday < 19700101 or birthday >= 19750101"),
    "and_or": (lambda g, s: _ids(seeds(g, "Person").has("birthday", either(both(gte(19700101), lt(19720101)), gt(19950101))).has("first_name", neq("BUILDING"))), "", "select id from v_person where ((birthday >= 19700101 and birthday < 19720101) or birthday > 19950101) and first_name <> 'BUILDING'"),
    "label_filter": (lambda g, s: _ids(seeds(g, "Person", s).out("knows").in_("hasCreator").has_label("Comment")), "", "select c.src as id from e_knows k join e_has_creator c on c.dst = k.dst join v_comment m on m.id = c.src where k.src = {s}"),
    "union_identity_out": (lambda g, s: _ids(seeds(g, "Person", s).out("knows").union(lambda t: t, lambda t: t.out("knows"))), _ALL2, "select v as id from h1 union all select v from h2"),
    "dedup": (lambda g, s: _ids(seeds(g, "Person", s).out("knows").out("knows").dedup()), _ALL2, "select distinct v as id from h2"),
    "store_semi": (lambda g, s: _ids(seeds(g, "Person", s).out("knows").out("knows").within(seeds(g, "Person", s).out("knows"))), _ALL2, "select v as id from h2 where v in (select v from h1)"),
    "store_anti": (lambda g, s: _ids(seeds(g, "Person", s).out("knows").out("knows").without(seeds(g, "Person", s).out("knows"))), _ALL2, "select v as id from h2 where v not in (select v from h1)"),
    "mark_join": (lambda g, s: seeds(g, "Person", s).out("knows").out("knows").marked(seeds(g, "Person", s).out("knows"), "is_friend").df.withColumnRenamed("v", "id"), _ALL2, "select v as id, v in (select v from h1) as is_friend from h2"),
    "left_default": (lambda g, s: g.vertex("Person").select("id").join(Traversal(g, scan_edges(g, "hasCreator", "Message").select(F.col("dst").alias("id"), F.lit(1).alias("v")), "Person").group("id", n=F.count("*")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")), "", "select p.id, count(c.src) as n from v_person p left join e_has_creator c on c.dst = p.id group by p.id"),
    "group_count": (lambda g, s: seeds(g, "Tag").out("hasType").group(F.col("v").alias("type"), n=F.count("*")), "", "select dst as type, count(*) as n from e_has_type group by dst"),
    "cond_count_having": (lambda g, s: seeds(g, "Person").as_("id").in_("hasCreator").values(label="label").group("id", posts=F.count_if(F.col("label") == "Post"), comments=F.count_if(F.col("label") == "Comment")).where("posts > 0 and comments > 0"), "", "select c.dst as id, count(*) filter (m.label = 'Post') as posts, count(*) filter (m.label = 'Comment') as comments from e_has_creator c join v_message m on m.id = c.src join v_person p on p.id = c.dst group by c.dst having posts > 0 and comments > 0"),
    "count_distinct_collect": (lambda g, s: seeds(g, "Person", s).in_("hasCreator").as_("post").out("hasTag").out("hasType").group(posts=F.count_distinct("post"), types=F.array_join(F.array_sort(F.collect_set("v")), ",")), "", "select count(distinct c.src) as posts, coalesce(string_agg(distinct y.dst, ',' order by y.dst), '') as types from e_has_creator c join e_has_tag t on t.src = c.src join e_has_type y on y.src = t.dst where c.dst = {s}"),
    "partial_final_count": (lambda g, s: seeds(g, "Post").out("hasTag").group(F.col("v").alias("tag"), n=F.count("*")), "", "select t.dst as tag, count(*) as n from v_post p join e_has_tag t on t.src = p.id group by t.dst"),
    "topk": (lambda g, s: _posts(g).top(25, F.desc("creation_date"), "v").withColumnRenamed("v", "id"), "", "select id, creation_date from v_post order by creation_date desc, id limit 25"),
    "limit_ordered": (lambda g, s: seeds(g, "Person").top(10, "v").withColumnRenamed("v", "id"), "", "select id from v_person order by id limit 10"),
    "project": (lambda g, s: seeds(g, "Person").values(first="first_name", last="last_name").df.select(F.col("v").alias("id"), F.concat_ws(" ", "first", "last").alias("name")), "", "select id, first_name || ' ' || last_name as name from v_person"),
    "math_dateparts": (lambda g, s: g.vertex("Person").select("id", birth_month(F.col("birthday")).cast("long").alias("month"), birth_day(F.col("birthday")).cast("long").alias("day")), "", "select id, cast(floor(birthday / 100) % 100 as bigint) as month, birthday % 100 as day from v_person"),
    "coalesce_values": (lambda g, s: g.vertex("Message").select("id", F.coalesce("content", "image_file", F.lit("")).alias("content")), "", "select id, coalesce(content, image_file, '') as content from v_message"),
    "repeat_emit_all": (lambda g, s: _ids(seeds(g, "Person", s).repeat(lambda t: t.out("knows"), 3, emit="all").dedup()), _HOPS, "select v as id from h1 union select v from h2 union select v from h3"),
    "repeat_emit_last": (lambda g, s: _ids(seeds(g, "Person", s).repeat(lambda t: t.out("knows"), 3)), _HOPS, "select v as id from h3"),
    "repeat_emit_if": (lambda g, s: _ids(seeds(g, "Person", s).repeat(lambda t: t.out("knows"), 3, emit=lambda t: t.has("first_name", eq("BUILDING"))).dedup()), _HOPS, "select v as id from (select v from h1 union select v from h2 union select v from h3) join v_person on id = v where first_name = 'BUILDING'"),
    "repeat_min_depth": (lambda g, s: seeds(g, "Person", s).repeat(lambda t: t.out("knows"), 3, emit="all", depth="d").group(F.col("v").alias("id"), depth=F.min("d").cast("long")), _HOPS, "select v as id, min(d) as depth from (select v, cast(1 as bigint) as d from h1 union all select v, 2 from h2 union all select v, 3 from h3) group by v"),
    "simple_path": (lambda g, s: seeds(g, "Person", s).repeat(lambda t: t.out("knows"), 2, simple="path").df.select(F.col("v").alias("id"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path")), "", "select b.dst as id, a.src || '>' || a.dst || '>' || b.dst as path from e_knows a join e_knows b on b.src = a.dst where a.src = {s} and b.dst <> a.src and b.dst <> a.dst"),
    "where_exists": (lambda g, s: _ids(seeds(g, "Person").where_exists(lambda t: t.out("workAt"))), "", "select id from v_person where exists (select 1 from e_work_at where src = id)"),
    "where_not_exists": (lambda g, s: _ids(seeds(g, "Person").where_not_exists(lambda t: t.in_("hasCreator").has_label("Comment"))), "", "select id from v_person p where not exists (select 1 from e_has_creator c join v_comment m on m.id = c.src where c.dst = p.id)"),
    "where_loop": (lambda g, s: _ids(seeds(g, "Person", s).out("knows").where_exists(lambda t: t.repeat(lambda u: u.out("knows"), 2, emit=lambda u: u.has("first_name", eq("MACHINERY"))), 3)), "m as (select id from v_person where first_name = 'MACHINERY'), o1 as (select distinct f.dst as owner, k.dst as v from e_knows f join e_knows k on k.src = f.dst where f.src = {s}), o2 as (select distinct owner, k.dst as v from o1 join e_knows k on k.src = o1.v)", "select owner as id from (select * from o1 union select * from o2) where v in (select id from m) group by owner having count(distinct v) >= 3"),
    "loop_where": (lambda g, s: _ids(seeds(g, "Person", s).repeat(lambda t: t.out("knows").has("first_name", neq("MACHINERY")), 3)), "m as (select id from v_person where first_name <> 'MACHINERY'), w1 as (select distinct dst as v from e_knows where src = {s} and dst in (select id from m)), w2 as (select distinct k.dst as v from w1 join e_knows k on k.src = w1.v where k.dst in (select id from m))", "select distinct k.dst as id from w2 join e_knows k on k.src = w2.v where k.dst in (select id from m)"),
    "nested_group": (lambda g, s: seeds(g, "Person", s).out("knows").as_("friend").in_("hasCreator").as_("post").out("hasTag").group("friend", "post", n=F.count_distinct("v")).groupBy(F.col("friend").alias("id")).agg(F.count("*").alias("posts"), F.sum("n").alias("tags")), "", "select friend as id, count(*) as posts, cast(sum(n) as bigint) as tags from (select k.dst as friend, c.src as post, count(distinct t.dst) as n from e_knows k join e_has_creator c on c.dst = k.dst join e_has_tag t on t.src = c.src where k.src = {s} group by 1, 2) group by friend"),
    "late_materialize": (lambda g, s: Traversal(g, seeds(g, "Message").values(creation_date="creation_date").top(15, F.desc("creation_date"), "v"), "Message").values(content="content").df.select(F.col("v").alias("id"), "creation_date", F.coalesce("content", F.lit("")).alias("content")), "", "select id, creation_date, coalesce(content, '') as content from v_message order by creation_date desc, id limit 15"),
}

_N = "'NATION_1', 'NATION_2'"
QUERIES: dict[str, tuple[Callable[[PropertyGraph, int], DataFrame], str, str]] = {
    "ic1": (lambda g, s: social.ic1(g, s, "HOUSEHOLD"), _HOPS, "select id as person_id, last_name, min(d) as distance from (select v, cast(1 as bigint) as d from h1 union all select v, 2 from h2 union all select v, 3 from h3) join v_person on id = v where first_name = 'HOUSEHOLD' and v <> {s} group by id, last_name order by distance, last_name, id limit 20"),
    "ic2": (lambda g, s: social.ic2(g, s, Y2000), _ALL2, "select p.id as post_id, p.creation_date from h1 join e_has_creator c on c.dst = h1.v join v_post p on p.id = c.src where p.creation_date <= 946684800000 order by 2 desc, 1 limit 20"),
    "ic3": (lambda g, s: social.ic3(g, s, Y1996, FEB2024, "NATION_1", "NATION_2"), _ALL2, f"select f12.v as person_id, count(*) filter (k.name = 'NATION_1') as x_count, count(*) filter (k.name = 'NATION_2') as y_count from f12 join e_person_city pc on pc.src = f12.v join e_city_country cc on cc.src = pc.dst join v_country home on home.id = cc.dst and home.name not in ({_N}) join e_has_creator c on c.dst = f12.v join v_message m on m.id = c.src and m.creation_date >= 820454400000 and m.creation_date < 1706745600000 join e_message_country mc on mc.src = m.id join v_country k on k.id = mc.dst and k.name in ({_N}) group by f12.v having x_count > 0 and y_count > 0 order by x_count desc, person_id limit 20"),
    "ic4": (lambda g, s: social.ic4(g, s, Y1998, Y2000), _ALL2 + ", p as (select p.id, p.creation_date from h1 join e_has_creator c on c.dst = h1.v join v_post p on p.id = c.src), old as (select t.dst from p join e_has_tag t on t.src = p.id where p.creation_date < 883612800000)", "select g.name as tag_name, count(*) as tag_count from p join e_has_tag t on t.src = p.id join v_tag g on g.id = t.dst where p.creation_date >= 883612800000 and p.creation_date < 946684800000 and t.dst not in (select dst from old) group by g.id, g.name order by tag_count desc, tag_name, g.id limit 10"),
    "ic5": (lambda g, s: social.ic5(g, s, Y1998), _ALL2 + ", f as (select distinct m.src from f12 join e_has_member m on m.dst = f12.v where m.join_date > 883612800000)", "select f.src as forum_id, count(*) as post_count from f join e_container_of p on p.src = f.src join e_has_creator c on c.src = p.dst where c.dst in (select v from f12) group by f.src order by post_count desc, forum_id limit 20"),
    "ic6": (lambda g, s: social.ic6(g, s, TAG), _ALL2 + ", p as (select p.id from f12 join e_has_creator c on c.dst = f12.v join v_post p on p.id = c.src where p.id in (select t.src from e_has_tag t join v_tag g on g.id = t.dst where g.name = '{tag}'))", "select g.name as tag_name, count(*) as post_count from p join e_has_tag t on t.src = p.id join v_tag g on g.id = t.dst where g.name <> '{tag}' group by g.name order by post_count desc, tag_name limit 10"),
    "ic7": (lambda g, s: social.ic7(g, s), _ALL2, "select l.src as like_person, l.creation_date as like_date, m.id as message_id, coalesce(m.content, m.image_file, '') as content, l.creation_date - m.creation_date as latency, l.src in (select v from h1) as is_friend from e_has_creator c join e_likes l on l.dst = c.src join v_message m on m.id = c.src where c.dst = {s} order by like_date desc, like_person, message_id limit 20"),
    "ic8": (lambda g, s: social.ic8(g, s), "", "select d.dst as commenter, m.id as comment_id, m.creation_date from e_has_creator c join e_reply_of r on r.dst = c.src join v_comment m on m.id = r.src join e_has_creator d on d.src = m.id where c.dst = {s} order by m.creation_date desc, m.id limit 20"),
    "ic9": (lambda g, s: social.ic9(g, s, FEB2024), _ALL2, "select m.id as message_id, m.creation_date, f12.v as creator, coalesce(m.content, m.image_file, '') as content from f12 join e_has_creator c on c.dst = f12.v join v_message m on m.id = c.src where m.creation_date < 1706745600000 order by m.creation_date desc, m.id limit 20"),
    "ic10": (lambda g, s: social.ic10(g, s, 4), _ALL2 + ", who as (select id from v_person where id in (select v from h2) and ((floor(birthday / 100) % 100 = 4 and birthday % 100 >= 21) or (floor(birthday / 100) % 100 = 5 and birthday % 100 < 22))), m as (select who.id, c.src as message, c.src in (select t.src from e_has_tag t where t.dst in (select dst from e_has_interest where src = {s})) as common from who join e_has_creator c on c.dst = who.id)", "select who.id as person_id, cast(2 * count(*) filter (m.common) - count(m.message) as bigint) as common_score from who left join m on m.id = who.id group by who.id order by common_score desc, person_id limit 10"),
    "ic11": (lambda g, s: social.ic11(g, s, "NATION_3", 2002), _ALL2, "select f12.v as person_id, w.work_from, o.name as organisation from f12 join e_work_at w on w.src = f12.v and w.work_from < 2002 join e_org_country c on c.src = w.dst join v_country k on k.id = c.dst and k.name = 'NATION_3' join v_organisation o on o.id = w.dst order by w.work_from, person_id, organisation desc limit 10"),
    "ic12": (lambda g, s: social.ic12(g, s, "PROMO"), _ALL2 + ", ok as (select y.src from e_has_type y join v_tagclass k on k.id = y.dst where k.name = 'PROMO' union select y.src from e_has_type y join e_is_subclass_of u on u.src = y.dst join v_tagclass k on k.id = u.dst where k.name = 'PROMO')", "select h1.v as friend_id, count(distinct m.id) as reply_count, string_agg(distinct g.name, ',' order by g.name) as tag_names from h1 join e_has_creator c on c.dst = h1.v join v_comment m on m.id = c.src join e_reply_of r on r.src = m.id join v_post p on p.id = r.dst join e_has_tag t on t.src = p.id join v_tag g on g.id = t.dst where g.id in (select src from ok) group by h1.v order by reply_count desc, friend_id limit 20"),
    "cq1": (lambda g, s: nested.cq1(g, s), _HOPS, "select v as person_id from h5 order by v limit 100"),
    "cq2": (lambda g, s: nested.cq2(g, s), _HOPS + ", " + _COLLEAGUES, "select v as person_id from (select v from h1 union select v from h2 union select v from h3 union select v from h4 union select v from h5) where v in (select v from colleagues) order by v limit 20"),
    "cq3": (lambda g, s: nested.cq3(g, s, "PROMO"), _ALL2 + ", " + _WRITERS, "select v as person_id from f12 where v in (select v from writers) order by v limit 10"),
    "cq4": (lambda g, s: nested.cq4(g, s, at_least=2), ", ".join(["o0 as (select distinct dst as owner, dst as v from e_knows where src = {s})", *(f"o{t} as (select distinct owner, k.dst as v from o{t - 1} join e_knows k on k.src = o{t - 1}.v)" for t in range(1, 5)), _COLLEAGUES]), "select owner as person_id from (select * from o1 union select * from o2 union select * from o3 union select * from o4) where v in (select v from colleagues) group by owner having count(distinct v) >= 2 order by owner limit 10"),
    "cq5": (lambda g, s: nested.cq5(g, s, "PROMO"), _HOPS + ", " + _COLLEAGUES + ", " + _WRITERS, "select v as person_id from (select v from h1 union select v from h2 union select v from h3 union select v from h4 union select v from h5) where v in (select v from colleagues) and v in (select v from writers) order by v limit 5"),
    "cq6": (lambda g, s: nested.cq6(g, s, "PROMO"), ", ".join([_WRITERS, "w1 as (select distinct dst as v from e_knows where src = {s} and dst in (select v from writers))", *(f"w{t} as (select distinct k.dst as v from w{t - 1} join e_knows k on k.src = w{t - 1}.v where k.dst in (select v from writers))" for t in range(2, 6))]), "select v as person_id from w5 order by v limit 10"),
}
for _x, _query in {"cq3": lambda g, s: nested.cq3x(g, s, "PROMO"), "cq4": lambda g, s: nested.cq4x(g, s, at_least=2), "cq5": lambda g, s: nested.cq5x(g, s, "PROMO"), "cq6": lambda g, s: nested.cq6x(g, s, "PROMO")}.items():
    QUERIES[f"{_x}x"] = (_query, *QUERIES[_x][1:])


def _starts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s) for i, s in enumerate(BATCH)], "query_id long, start long")


def parsed_lines(spark: SparkSession) -> DataFrame:
    """The same starts from lines of a parameter file, each with a date of its own."""
    lines = ["personId maxDate", *(f"{s} {Y1998 if i % 2 else Y2000}" for i, s in enumerate(BATCH))]
    return parse_params(spark.createDataFrame(list(zip(lines, range(len(lines)), strict=True)), "value string, query_id long"), files.FORMATS["ic2"])


_STARTS = "starts as (select * from (values {rows}) t(query_id, start)), b1 as (select query_id, k.dst as v from starts join e_knows k on k.src = start), b12 as (select query_id, v from b1 union select query_id, k.dst from b1 join e_knows k on k.src = b1.v)"
#: Many parameters as one plan: the query's number is carried as a context column.
BATCHES: dict[str, tuple[Callable[[PropertyGraph, DataFrame], DataFrame], str, str]] = {
    "batch_ic2": (lambda g, p: batch.ic2(g, p, Y2000), _STARTS, "select query_id, post_id, creation_date from (select query_id, p.id as post_id, p.creation_date, row_number() over (partition by query_id order by p.creation_date desc, p.id) as rk from b1 join e_has_creator c on c.dst = b1.v join v_post p on p.id = c.src where p.creation_date <= 946684800000) where rk <= 20"),
    "batch_ic9": (lambda g, p: batch.ic9(g, p, FEB2024), _STARTS, "select query_id, message_id, creation_date, creator from (select query_id, m.id as message_id, m.creation_date, v as creator, row_number() over (partition by query_id order by m.creation_date desc, m.id) as rk from b12 join e_has_creator c on c.dst = v join v_message m on m.id = c.src where m.creation_date < 1706745600000) where rk <= 20"),
    "batch_ic1": (lambda g, p: batch.ic1(g, p, "HOUSEHOLD"), _STARTS + ", b3 as (select distinct query_id, k.dst as v from (select query_id, k.dst as v from b1 join e_knows k on k.src = b1.v) t join e_knows k on k.src = t.v), b2 as (select query_id, k.dst as v from b1 join e_knows k on k.src = b1.v), bd as (select query_id, v, min(d) as distance from (select query_id, v, cast(1 as bigint) as d from b1 union all select query_id, v, 2 from b2 union all select query_id, v, 3 from b3) group by query_id, v)", "select query_id, person_id, last_name, distance from (select bd.query_id, id as person_id, last_name, distance, row_number() over (partition by bd.query_id order by distance, last_name, id) as rk from bd join starts on starts.query_id = bd.query_id and start <> v join v_person on id = v where first_name = 'HOUSEHOLD') where rk <= 20"),
    "batch_ic8": (lambda g, p: batch.ic8(g, p), _STARTS, "select query_id, commenter, comment_id, creation_date from (select query_id, d.dst as commenter, m.id as comment_id, m.creation_date, row_number() over (partition by query_id order by m.creation_date desc, m.id) as rk from starts join e_has_creator c on c.dst = start join e_reply_of r on r.dst = c.src join v_comment m on m.id = r.src join e_has_creator d on d.src = m.id) where rk <= 20"),
    "batch_cq1": (lambda g, p: batch.cq1(g, p), _STARTS + ", " + ", ".join(f"b{t} as (select distinct query_id, k.dst as v from b{t - 1} join e_knows k on k.src = b{t - 1}.v)" for t in range(2, 6)), "select query_id, person_id from (select query_id, v as person_id, row_number() over (partition by query_id order by v) as rk from b5) where rk <= 100"),
    "params_ic2": (lambda g, p: batch.ic2(g, parsed_lines(p.sparkSession)), _STARTS, "select query_id, post_id, creation_date from (select query_id + 1 as query_id, p.id as post_id, p.creation_date, row_number() over (partition by query_id order by p.creation_date desc, p.id) as rk from b1 join e_has_creator c on c.dst = b1.v join v_post p on p.id = c.src where p.creation_date <= case when query_id % 2 = 0 then 946684800000 else 883612800000 end) where rk <= 20"),
    "batch_cq2": (lambda g, p: batch.cq2(g, p), _STARTS + ", " + ", ".join(f"b{t} as (select distinct query_id, k.dst as v from b{t - 1} join e_knows k on k.src = b{t - 1}.v)" for t in range(2, 6)) + ", mates as (select distinct query_id, w.src as v from starts join e_work_at s on s.src = start join e_work_at w on w.dst = s.dst)", "select query_id, person_id from (select query_id, v as person_id, row_number() over (partition by query_id order by v) as rk from (select * from b1 union select * from b2 union select * from b3 union select * from b4 union select * from b5) semi join mates using (query_id, v)) where rk <= 20"),
}


def queries(start: int = START) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: (lambda spark, sf_dir, f=f: f(graph_of(spark, sf_dir), start)) for name, (f, _, _) in (OPERATORS | QUERIES).items()}
    return found | {name: (lambda spark, sf_dir, f=f: f(graph_of(spark, sf_dir), _starts(spark))) for name, (f, _, _) in BATCHES.items()}


def oracle_sql(start: int = START) -> dict[str, str]:
    rows = ", ".join(f"(cast({i} as bigint), cast({s} as bigint))" for i, s in enumerate(BATCH))
    found = {}
    for name, (_, ctes, body) in (OPERATORS | QUERIES | BATCHES).items():
        text = [x.replace("{s}", str(start)).replace("{tag}", TAG).replace("{rows}", rows) for x in (ctes, body)]
        views = views_sql([v for v in VIEWS if re.search(rf"\b{v}\b", " ".join(text))])
        found[name] = "with " + ",\n".join(x for x in (views, text[0]) if x) + "\n" + text[1]
    return found
