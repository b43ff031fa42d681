"""A social graph derived from the generated sales tables. Each view is SQL that Spark and DuckDB both read, so that results can be compared."""

import re

from pyspark.sql import DataFrame, SparkSession

from .graph import Edges, PropertyGraph

TABLES = ("customer", "orders", "lineitem", "part", "supplier", "nation", "events")

_CITY = "c_nationkey * 10 + case c_mktsegment when 'AUTOMOBILE' then 0 when 'BUILDING' then 1 when 'FURNITURE' then 2 when 'HOUSEHOLD' then 3 else 4 end"
_COMMENT = "event_type in ('purchase', 'error', 'signup')"
#: {x} is a table or an earlier view; MS(x) are the epoch milliseconds of a timestamp.
VIEWS = {
    "li": "select l.*, o.o_custkey from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey",
    "v_person": "select c_custkey as id, c_mktsegment as first_name, c_name as last_name, cast((1960 + c_custkey % 40) * 10000 + (c_custkey % 12 + 1) * 100 + (c_custkey % 28 + 1) as bigint) as birthday from {customer}",
    "v_city": f"select distinct cast({_CITY} as bigint) as id from {{customer}}",
    "v_country": "select cast(n_nationkey as bigint) as id, n_name as name from {nation}",
    "v_organisation": "select s_suppkey as id, s_name as name from {supplier}",
    "v_tag": "select p_partkey as id, concat(p_name, ' #', cast(p_partkey % 10 as varchar(10))) as name from {part}",
    "v_tagclass": "select distinct p_type as id, p_type as name from {part} union select 'GOODS' as id, 'GOODS' as name",
    "v_forum": "select distinct concat(p_brand, '/', p_type) as id from {part}",
    "v_post": "select o_orderkey as id, MS(o_orderdate) as creation_date, o_orderpriority as image_file from {orders}",
    "v_comment": f"select 1000000000 + event_id as id, MS(ts) as creation_date, props as content from {{events}} where {_COMMENT}",
    "v_message": "select id, 'Post' as label, creation_date, cast(null as varchar(100)) as content, image_file from {v_post} union all select id, 'Comment' as label, creation_date, content, cast(null as varchar(100)) as image_file from {v_comment}",
    "e_knows": "select distinct a.o_custkey as src, b.o_custkey as dst from {li} a join {li} b on a.l_partkey = b.l_partkey and a.l_quantity = b.l_quantity and a.l_returnflag = b.l_returnflag and a.o_custkey <> b.o_custkey",
    "e_work_at": "select o_custkey as src, l_suppkey as dst, cast(min(year(l_shipdate)) as bigint) as work_from from {li} where l_quantity >= 48 and l_returnflag = 'R' group by o_custkey, l_suppkey",
    "e_has_creator": f"select o_orderkey as src, o_custkey as dst from {{orders}} union all select 1000000000 + event_id as src, user_id as dst from {{events}} where {_COMMENT}",
    "e_person_city": f"select c_custkey as src, cast({_CITY} as bigint) as dst from {{customer}}",
    "e_city_country": "select id as src, cast(floor(id / 10) as bigint) as dst from {v_city}",
    "e_message_country": f"select l_orderkey as src, cast(min(s_nationkey) as bigint) as dst from {{lineitem}} join {{supplier}} on l_suppkey = s_suppkey group by l_orderkey union all select 1000000000 + event_id as src, cast(event_id % 25 as bigint) as dst from {{events}} where {_COMMENT}",
    "e_org_country": "select s_suppkey as src, cast(s_nationkey as bigint) as dst from {supplier}",
    "e_has_tag": "select distinct l_orderkey as src, l_partkey as dst from {lineitem}",
    "e_has_type": "select p_partkey as src, p_type as dst from {part}",
    "e_is_subclass_of": "select distinct p_type as src, 'GOODS' as dst from {part}",
    "e_has_interest": "select distinct o_custkey as src, l_partkey as dst from {li} where l_quantity = 50",
    "e_reply_of": f"select 1000000000 + event_id as src, (event_id * 13) % (select count(*) from {{orders}}) as dst from {{events}} where {_COMMENT}",
    "e_likes": "select user_id as src, (event_id * 7) % (select count(*) from {orders}) as dst, MS(ts) as creation_date from {events} where event_type in ('click', 'view')",
    "e_has_member": "select concat(p_brand, '/', p_type) as src, o_custkey as dst, MS(min(l_shipdate)) as join_date from {li} join {part} on l_partkey = p_partkey where l_returnflag = 'A' group by concat(p_brand, '/', p_type), o_custkey",
    "e_container_of": "select concat(p_brand, '/', p_type) as src, l_orderkey as dst from (select l_orderkey, min(l_partkey) as p from {lineitem} group by l_orderkey) f join {part} q on f.p = q.p_partkey",
}
_VERTICES = {"Person": "v_person", "City": "v_city", "Country": "v_country", "Organisation": "v_organisation", "Tag": "v_tag", "TagClass": "v_tagclass", "Forum": "v_forum", "Message": "v_message"}
_EDGES = (
    ("knows", "Person", "Person", "e_knows"), ("workAt", "Person", "Organisation", "e_work_at"), ("hasCreator", "Message", "Person", "e_has_creator"), ("isLocatedIn", "Person", "City", "e_person_city"),
    ("isPartOf", "City", "Country", "e_city_country"), ("isLocatedIn", "Message", "Country", "e_message_country"), ("isLocatedIn", "Organisation", "Country", "e_org_country"), ("hasTag", "Message", "Tag", "e_has_tag"),
    ("hasType", "Tag", "TagClass", "e_has_type"), ("isSubclassOf", "TagClass", "TagClass", "e_is_subclass_of"), ("hasInterest", "Person", "Tag", "e_has_interest"), ("replyOf", "Comment", "Post", "e_reply_of"),
    ("likes", "Person", "Post", "e_likes"), ("hasMember", "Forum", "Person", "e_has_member"), ("containerOf", "Forum", "Post", "e_container_of"),
)
_MS = re.compile(r"MS\(((?:min\()?\w+\)?)\)")


def view(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame]) -> DataFrame:
    """The table or view of this name; made holds those that exist so far."""
    if name not in made:
        if name in TABLES:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            needs = {n: view(spark, sf_dir, n, made) for n in re.findall(r"\{(\w+)\}", VIEWS[name])}
            made[name] = spark.sql(_MS.sub(r"unix_millis(cast(\1 as timestamp))", VIEWS[name]), **needs)
    return made[name]


def views_sql(names: list[str]) -> str:
    """The same views, and those they need, as the CTEs that begin a DuckDB query."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in re.findall(r"\{(\w+)\}", VIEWS[name]):
                need(n)
            order.append(name)

    for n in names:
        need(n)
    return ",\n".join(f"{n} as ({_MS.sub(r'(epoch_us(\1) // 1000)', VIEWS[n]).format_map({k: k for k in (*TABLES, *VIEWS)})})" for n in order)


def fixture_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The whole graph; nothing is read until a query needs it, and a query reads only the tables of its steps."""
    made: dict[str, DataFrame] = {}
    get = lambda name: view(spark, sf_dir, name, made)
    return PropertyGraph({k: get(n) for k, n in _VERTICES.items()}, [Edges(name, s, t, get(n)) for name, s, t, n in _EDGES])
