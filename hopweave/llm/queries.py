"""The queries of the corpus operators, with production parameters over whole tables, and SQL for those that SQL can express."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .chat_format import rotate
from .exact_dedup import exact_dedup
from .language_id import language_id
from .license_scan import scan
from .lm_score import lm_score
from .mixing import mix
from .near_dedup import near_dedup
from .sharding import shard
from .topk_search import topk_search


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(_documents(spark, sf_dir)).withColumn("score", F.round("score", 4))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.withColumn("masks", spans)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_documents(spark, sf_dir))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_documents(spark, sf_dir), width=4)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False).drop("ids", "decoded")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_topk_search, op3_chat_format, op4_sharding, op5_near_dedup, op6_lm_score, op7_license_scan, op8_mixing, op9_language_id, op10_bpe)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": f"""
            with d as (select doc_id, {_LOWER} as t from documents)
            select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
                doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
            from d""",
        "op2_topk_search": f"""
            with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
            one as (select count(*) as n, avg(len(w)) as mean from d),
            t as (select doc_id, len(w) as size, unnest(w) as word from d),
            p as (select doc_id, size, word, count(*) as tf from t group by all),
            f as (select word, count(*) as df from p group by word),
            s as (
                select q.doc_id as query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 8) as score
                from (select distinct doc_id, word from p where doc_id % 50 = 0) q join p on p.word = q.word and p.doc_id <> q.doc_id join f on f.word = q.word, one group by all
            ), r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s)
            select query_id, rank, doc_id, round(score, 4) as score from r where rank <= 10""",
        "op3_chat_format": """
            with r as (
                select conv_id, turn, coalesce(role, 'unknown') as role, role is null as nameless, coalesce(text, '') as text,
                    cast(floor(turn / 64) as bigint) as stretch
                from conversations
            ), n as (
                select *, row_number() over (partition by conv_id, stretch order by turn nulls last, role, text) as rk from r
            ), s as (
                select distinct conv_id, role as speaker from r where not nameless and role <> 'system'
            ), t as (
                select n.conv_id, speaker, stretch, cast(floor((rk - 1) / 256) as bigint) as piece, rk, text, role = speaker as own,
                    case when role = speaker then '<|im_start|>assistant' when role = 'system' then '<|im_start|>system'
                        else '<|im_start|>user name=' || role end || chr(10) as head
                from n join s on n.conv_id is not distinct from s.conv_id
            ), u as (
                select *, head || text || '<|im_end|>' || chr(10) as seg from t
            ), v as (
                select *, sum(length(seg)) over (partition by conv_id, speaker, stretch, piece order by rk) as stop from u
            )
            , g as (
                select conv_id, speaker, stretch, piece, count(*) as n_turns, count(*) filter (own) as n_own, string_agg(seg, '' order by rk) as rendered,
                    coalesce(string_agg(cast(cast(stop - length(seg) + length(head) as bigint) as varchar) || '-' || cast(cast(stop as bigint) as varchar), ',' order by rk) filter (own), '') as masks
                from v group by conv_id, speaker, stretch, piece
            )
            select *, cast(coalesce(sum(length(rendered)) over (partition by conv_id, speaker order by stretch nulls last, piece rows between unbounded preceding and 1 preceding), 0) as bigint) as begins from g""",
        "op5_near_dedup": f"""
            with recursive d as (
                select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents
            ), s as (
                select distinct doc_id, unnest(case when len(w) < 4 then [array_to_string(w, ' ')]
                    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) end) as shingle
                from d where len(w) > 0
            ), n as (
                select doc_id, count(*) as size from s group by doc_id
            ), p as (
                select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all
            ), l as (
                select x, y from p join n i on p.x = i.doc_id join n j on p.y = j.doc_id where 100 * shared >= 80 * (i.size + j.size - shared)
            ), e as (
                select x as a, y as b from l union all select y, x from l
            ), r as (
                select doc_id, doc_id as root from d union select e.b, r.root from r join e on r.doc_id = e.a
            ), c as (
                select doc_id, min(root) as component_id from r group by doc_id
            )
            select doc_id, coalesce(size, 0) as n_shingles, component_id, doc_id = component_id as kept from d join c using (doc_id) left join n using (doc_id)""",
        "op8_mixing": """
            with d as (
                select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size,
                    md5(coalesce(cast(doc_id as varchar), '')) as h
                from documents
            ), s as (
                select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as rk from d group by source
            ), w as (
                select *, cast(case rk % 3 when 0 then 3 when 1 then 1 else 2 end as double) as weight,
                    cast(case rk % 3 when 0 then 0.5 when 1 then 0 else -0.5 end as double) as tilt, source_size * cast(2 as double) as cap
                from s
            ), l as (
                select *, cap / weight as ratio, (cast(sum(source_size) over () as double) * cast(1.5 as double)
                    - coalesce(sum(cap) over (order by cap / weight, rk rows between unbounded preceding and 1 preceding), 0))
                    / sum(weight) over (order by cap / weight, rk rows between current row and unbounded following) as level
                from w
            ), t as (
                select *, least(cap, weight * max(case when level < ratio then level end) over ()) as target from l
            ), b as (
                select d.*, source_size, target, tilt, sum(size) over (partition by d.source order by h, doc_id, size rows between unbounded preceding and current row) - size as before,
                    case when source_size > 0 then floor(target / source_size) else 0 end as rounds
                from d join t on d.source is not distinct from t.source
            ), p as (
                select *, least(greatest(floor(target - rounds * source_size) - before, 0), size) as part from b
            ), q as (
                select *, case when size > 0 then rounds + case when part > 0 then 1 else 0 end else 0 end as whole,
                    cast(before as double) / target as y, cast(before + source_size as double) / target as z
                from p
            )
            select doc_id, size, source, source_size, target, cast(rounds * size + part as bigint) as taken,
                case when whole >= 1 then case when tilt = 0 then y else (1 + tilt - sqrt((1 + tilt) * (1 + tilt) - 4 * tilt * y)) / (2 * tilt) end end as position,
                case when whole >= 2 then case when tilt = 0 then z else (1 + tilt - sqrt((1 + tilt) * (1 + tilt) - 4 * tilt * z)) / (2 * tilt) end end as again
            from q""",
    }
