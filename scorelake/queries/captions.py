"""Captions, filters and sizes (A1-A12, B1-B6, B15-B18, D1, D2) over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from scorelake.functions import captions as C
from scorelake.functions.geometry import crop_box
from scorelake.functions.hashing import hash_u
from scorelake.functions.quality import has_image_and_caption, passes_quality
from scorelake.operators import sampling, shards
from scorelake.operators.scores import resolve_captions
from scorelake.plans import requests
from scorelake.queries.fixtures import spark_text, table, view
from scorelake.queries.registry import query


@query("select key, replace(txt, '<PERSON>', '') as caption from samples_v")
def clean_captions(spark, sf):
    return view(spark, sf, "samples_v").select("key", C.clean_caption(F.col("txt")).alias("caption"))


_FENCED = "concat('```python', chr(10), 'x = 1', chr(10), '```  look: ', html, ' `end` ', case when U(page_id,'open') < 0.3 then '``` open' else '' end)"


@query(
    f"""with t as (select page_id, {_FENCED} as raw from pages),
a as (select page_id, regexp_replace(raw, '```(.|\\n)*?```', '', 'g') as t from t),
b as (select page_id, regexp_replace(t, '```(.|\\n)*', '', 'g') as t from a),
c as (select page_id, regexp_replace(t, '<[^>]+>', ' ', 'g') as t from b),
d as (select page_id, regexp_replace(replace(t, '`', ''), '\\s\\s+', ' ', 'g') as t from c)
select page_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') as caption from d"""
)
def strip_fences(spark, sf):
    pages = table(spark, sf, "pages")
    raw = F.expr(spark_text(_FENCED))
    return pages.select("page_id", C.strip_fences(raw).alias("caption"))


@query(
    """with c as (select substr(file_name, 1, length(file_name) - 4) as stem, min_by(short_caption, file_name) as s,
       min_by(struct_pack(l := long_caption), file_name).l as l from captions_v group by 1)
select s.key, replace(coalesce(c.l, s.txt), '<PERSON>', '') as long, replace(coalesce(c.s, s.txt), '<PERSON>', '') as short,
  replace(s.txt, '<PERSON>', '') as original
from samples_v s left join c on s.key = c.stem"""
)
def resolve_captions_lookup(spark, sf):
    out = resolve_captions(view(spark, sf, "samples_v"), view(spark, sf, "captions_v"))
    return out.select("key", "original", "long", "short")


_JSON_DOCS = """select key, txt, case when U(doc_id,'syn') < 0.5 then 'long <PERSON>'||txt end as synthetic_caption,
  case when U(doc_id,'short') < 0.4 then concat('short ', lang) end as short_synthetic_caption,
  case when U(doc_id,'cap') < 0.6 then concat('json ', source) end as caption from samples_v"""


@query(
    f"""with j as ({_JSON_DOCS})
select key, replace(coalesce(synthetic_caption, txt), '<PERSON>', '') as long,
  replace(coalesce(short_synthetic_caption, caption, txt, synthetic_caption), '<PERSON>', '') as short from j"""
)
def resolve_captions_json(spark, sf):
    samples = view(spark, sf, "samples_v")
    docs = spark.sql(spark_text(_JSON_DOCS).replace("from samples_v", "from {samples}"), samples=samples)
    fields = ["synthetic_caption", "short_synthetic_caption", "caption"]
    raw = docs.select("key", "txt", F.to_json(F.struct(*fields)).alias("json"))
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    parsed = raw.withColumn("j", F.from_json("json", schema))
    long, short = C.captions_from_json(
        F.col("txt"), F.col("j.synthetic_caption"), F.col("j.short_synthetic_caption"), F.col("j.caption")
    )
    return parsed.select("key", long.alias("long"), short.alias("short"))


@query("select key, shard from samples_v where has_image and txt is not null")
def presence_filter(spark, sf):
    s = view(spark, sf, "samples_v")
    return s.where(has_image_and_caption(F.col("has_image"), F.col("txt"))).select("key", "shard")


def _judged(spark, sf):
    s = view(spark, sf, "samples_v")
    scores = view(spark, sf, "scores_v").select("key", "clip_score", "synthetic_aesthetic_score")
    return s.join(scores, "key")


_PASS = """(width is null or height is null or (width >= 256 and height >= 256
  and coalesce(clip_score, 0) >= 0.2::float and coalesce(synthetic_aesthetic_score, 0) >= 0.1::float))"""


def _keep():
    return passes_quality(
        F.col("width"), F.col("height"), F.col("clip_score"), F.col("synthetic_aesthetic_score"),
        256, 0.2, 0.1,
    )


@query(f"select s.key, s.shard from samples_v s join scores_v c on s.key = c.key where {_PASS}")
def quality_filter(spark, sf):
    return _judged(spark, sf).where(_keep()).select("key", "shard")


@query("select key, aesthetic_score::double as aesthetic_score from scores_v where aesthetic_score * 10 >= 6.0")
def aesthetic_subset(spark, sf):
    scores = view(spark, sf, "scores_v")
    picked = scores.where(F.col("aesthetic_score") * 10 >= 6.0)
    return picked.select("key", F.col("aesthetic_score").cast("double").alias("aesthetic_score"))


@query(f"select count(*) as n from samples_v s join scores_v c on s.key = c.key where {_PASS}")
def corpus_size(spark, sf):
    return sampling.corpus_size(_judged(spark, sf), _keep())


@query(
    f"""with j as (select s.key, ({_PASS}) as ok from samples_v s join scores_v c on s.key = c.key),
p as (select avg(case when ok then 1.0::double else 0.0::double end) as rate
      from (select ok from j order by U(key,'sample/7'), key limit 500))
select (select count(*) from j) as total, floor((select count(*) from j) * rate)::bigint as estimate from p"""
)
def estimate_size(spark, sf):
    return sampling.estimate_size(_judged(spark, sf), _keep(), 500, 7)


@query(
    """with d as (select n_chars::int + 100 as w, (100 + doc_id * 7 % 900)::int as h, doc_id from documents),
t as (select doc_id, w, h, floor(w / 1.5::double)::int as fh, floor(h * 1.5::double)::int as fw from d)
select doc_id, case when w >= h then (case when fh <= h then fh else h end)
     else (case when fw <= w then h else fh end) end as crop_h,
  case when w >= h then (case when fh <= h then w else fw end)
     else (case when fw <= w then fw else w end) end as crop_w from t"""
)
def crop_boxes(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id",
        (F.col("n_chars").cast("int") + 100).alias("w"),
        (100 + F.col("doc_id") * 7 % 900).cast("int").alias("h"),
    )
    box = crop_box(F.col("w"), F.col("h"), "3:2")
    return d.select("doc_id", box["height"].alias("crop_h"), box["width"].alias("crop_w"))


@query("select item_id, case when length(text) > 50 then substr(text,1,50)||'...' else text end as label from benchmark")
def label_prompts(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", C.label(F.col("text")).alias("label"))


@query("select shard, count(distinct split_part(member, '.', 1)) as nsamples from members_v where contains(member, '.') group by shard")
def shard_index(spark, sf):
    return shards.shard_table(view(spark, sf, "members_v"))


@query(
    """select shard, key, max_by(case when ext = '.txt' then content end, case when ext = '.txt' then member_idx end) as txt,
  max_by(case when ext = '.json' then content end, case when ext = '.json' then member_idx end) as json,
  bool_or(ext = '.jpg') as has_jpg, min(member_idx) as first_idx from members_v group by shard, key"""
)
def group_members(spark, sf):
    grouped = shards.group_members(view(spark, sf, "members_v"), [".txt", ".json"], [".jpg"])
    return grouped.select("shard", "key", "txt", "json", "has_jpg", "first_idx")


@query(
    """with m as (select shard, member_idx, key, lower(ext) as ext from members_v),
r as (select *, case when key = lag(key) over (partition by shard order by member_idx) then 0 else 1 end as new_run from m),
i as (select *, sum(new_run) over (partition by shard order by member_idx) as run from r),
k as (select *, row_number() over (partition by shard, run, ext order by member_idx) as rep from i),
g as (select *, max(rep) over (partition by shard, run order by member_idx) as sample_no from k)
select shard, member_idx, ext, min(member_idx) over (partition by shard, run, sample_no) as sample_start from g"""
)
def group_member_runs(spark, sf):
    runs = shards.group_member_runs(view(spark, sf, "members_v"), chunk=1000)
    return runs.select("shard", "member_idx", "ext", "sample_start")


@query("select 0::int as root_idx, key, shard, txt, null::varchar as extra from samples_v union all "
       "select 1::int, key, shard, txt, 'labelled' from samples_v s join labels l on s.doc_id = l.doc_id")
def union_roots(spark, sf):
    s = view(spark, sf, "samples_v")
    first = s.select("key", "shard", "txt")
    second = s.join(table(spark, sf, "labels"), "doc_id").select("key", "shard", "txt", F.lit("labelled").alias("extra"))
    return shards.union_roots([first, second])


@query(
    """with a as (select shard, md5(string_agg(key, ',' order by key)) as md5, count(*) as nsamples from samples_v group by shard)
select shard, case when hash_u < 0.3 then false when hash_u < 0.6 then false else true end as ok,
  case when hash_u < 0.3 then 'md5' when hash_u < 0.6 then 'nsamples' end as problem
from (select shard, U(shard,'bad') as hash_u from a)"""
)
def verify_shards(spark, sf):
    s = view(spark, sf, "samples_v")
    # a shard's checksum from its sorted keys' digests: one digest per row, combined in parts
    digest = F.md5(F.concat(F.sum(F.xxhash64("key").cast("decimal(38,0)")).cast("string")))
    actual = s.groupBy("shard").agg(digest.alias("md5"), F.count(F.lit(1)).alias("nsamples"))
    u = hash_u("shard", "bad")
    expected = actual.select(
        "shard",
        F.when(u < 0.3, F.lit("0")).otherwise(F.col("md5")).alias("md5"),
        F.when((u >= 0.3) & (u < 0.6), F.col("nsamples") + 1).otherwise(F.col("nsamples")).alias("nsamples"),
    )
    return shards.verify_shards(actual, expected)


@query(
    """select s_suppkey, 1.5::double as weight, 's'||s_suppkey||'-'||lpad(n::varchar, 3, '0')||'.tar' as url
from supplier, lateral (select unnest(range(0, s_nationkey % 5 + 2)) as n) t
union all select s_suppkey, 2.0::double, 'extra/'||s_name||'.tar' from supplier"""
)
def expand_pattern(spark, sf):
    p = table(spark, sf, "supplier").select(
        "s_suppkey",
        F.concat(
            F.lit("s"), F.col("s_suppkey"), F.lit("-{000.."),
            F.lpad((F.col("s_nationkey") % 5 + 1).cast("string"), 3, "0"), F.lit("}.tar::extra/"),
            F.col("s_name"), F.lit(".tar"),
        ).alias("urls"),
        F.lit("1.5::2.0").alias("weights"),
    )
    return requests.expand_pattern(p).select("s_suppkey", "weight", "url")


@query(
    """select s_suppkey, 'r{'||s_suppkey||'}/'||case when n < 2 then 'old-'||n else 'new/'||k||'-'||lpad((n - 2)::varchar, 2, '0') end||'.tar' as url
from supplier, lateral (select unnest(range(0, 2 + s_nationkey % 4 + 1)) as n) t,
lateral (select unnest(case when n < 2 then [''] else ['a', 'b', 'c'] end) as k) u"""
)
def expand_nested(spark, sf):
    """Lists that hold runs and further lists, with literal braces."""
    last = F.lpad((F.col("s_nationkey") % 4).cast("string"), 2, "0")
    p = table(spark, sf, "supplier").select(
        "s_suppkey",
        F.concat(
            F.lit(r"r\{"), F.col("s_suppkey"), F.lit(r"\}/{old-{0..1},new/{a,{b,c}}-{00.."), last, F.lit("}}.tar")
        ).alias("urls"),
    )
    return requests.expand_pattern(p, weights=None).select("s_suppkey", "url")


@query(
    """with s as (select source, shard, count(*) as n from samples_v group by all)
select 'https://host/'||source||'/'||shard||'.tar' as url, n as nsamples, 2.0::double as weight, source as dataset
from s"""
)
def flatten_descriptor(spark, sf):
    """Descriptors per source and block of shards, built from the corpus, its shards given relative to a base."""
    s = view(spark, sf, "samples_v").groupBy("source", "shard").agg(F.count(F.lit(1)).alias("n"))
    shard = F.struct(
        F.concat("shard", F.lit(".tar")).alias("url"), F.col("n").alias("nsamples"),
        F.lit(None).cast("double").alias("weight"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("string").alias("dataset"),
    )
    # at most 1,000 shards per document (the shard number is nine digits)
    block = F.substring("shard", 1, 6).alias("block")
    part = s.groupBy("source", block).agg(F.collect_list(shard).alias("shardlist"))
    component = F.struct(
        F.col("source").alias("name"), F.lit(2.0).alias("weight"),
        F.concat(F.lit("https://host/x/../"), F.col("source"), F.lit("/")).alias("base"),
        F.lit(None).cast("string").alias("source_url"), F.col("shardlist"),
    )
    docs = part.select(
        F.lit(1).alias("wids_version"), F.lit("corpus").alias("name"), F.lit(None).cast("double").alias("weight"),
        F.array().cast(part.schema["shardlist"].dataType).alias("shardlist"),
        F.array(component).alias("datasets"),
    )
    return requests.flatten_descriptor(docs).select("url", "nsamples", "weight", "dataset")


@query(
    """select item_id, case when item_id % 2 = 0
     then json_object('prompt', text, 'category', 'c'||(item_id % 3), 'note', 'n')::varchar
     else json_object('prompt', text, 'category', 'c'||(item_id % 3))::varchar end as json from benchmark"""
)
def prompts_to_json(spark, sf):
    prompts = table(spark, sf, "benchmark").select(
        "item_id",
        F.col("text").alias("Prompt"),
        F.concat(F.lit("c"), F.col("item_id") % 3).alias("Category"),
        F.lit(None).cast("string").alias("Challenge"),
        F.when(F.col("item_id") % 2 == 0, "n").alias("Note"),
    )
    return requests.prompts_json(prompts, keep=["item_id"])
