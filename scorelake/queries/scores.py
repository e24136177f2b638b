"""Score tables and training columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import augment, targets
from scorelake.functions.hashing import hash_u
from scorelake.functions.scoring import normalise_score, route_scores as route, standardise_image_reward
from scorelake.functions.scoring import swap_synthetic as swap
from scorelake.operators import bins as B
from scorelake.operators import evaluate, sampling
from scorelake.operators.emit import emit_columns
from scorelake.operators import scores as S
from scorelake.operators.scores import resolve_captions
from scorelake.queries.fixtures import table, view
from scorelake.queries.registry import query
from scorelake.schema import AFFINE, IMAGE_REWARD_MEAN, IMAGE_REWARD_STD, SCORES


def _r(col, digits=6):
    return F.round(col.cast("double"), digits)


@query(
    "select key, "
    + ", ".join(
        f"round(((U(key,'raw/{s}') * 30 - 2) + {AFFINE[s][0]}::double) / {AFFINE[s][1]}::double, 6) as {s}" for s in SCORES
    )
    + f", round((U(key,'raw/head') - {IMAGE_REWARD_MEAN!r}::double) / {IMAGE_REWARD_STD!r}::double, 6) as standardised"
    + " from scores_v"
)
def normalise_scores(spark, sf):
    keys = view(spark, sf, "scores_v").select("key")
    raw = keys.select("key", *[(hash_u("key", f"raw/{s}") * 30 - 2).alias(s) for s in SCORES])
    head = standardise_image_reward(hash_u("key", "raw/head"))
    return raw.select("key", *[_r(normalise_score(s, F.col(s))).alias(s) for s in SCORES], _r(head).alias("standardised"))


_CAPTIONED = """c as (select substr(file_name, 1, length(file_name) - 4) as stem, min_by(short_caption, file_name) as s,
       min_by(struct_pack(l := long_caption), file_name).l as l from captions_v group by 1),
t as (select s.key, replace(s.txt, '<PERSON>', '') as original, replace(coalesce(c.l, s.txt), '<PERSON>', '') as long,
  replace(coalesce(c.s, s.txt), '<PERSON>', '') as short from samples_v s left join c on s.key = c.stem)"""


@query(
    f"""with {_CAPTIONED}, r(score_name, output, caption_kind) as (values
 ('clip_score','clip_score','original'), ('clip_score','synthetic_clip_score','long'),
 ('aesthetic_score','aesthetic_score','original'),
 ('image_reward_score','image_reward_score','original'), ('image_reward_score','synthetic_image_reward_score','short'),
 ('pick_a_score_score','pick_a_score_score','original'), ('pick_a_score_score','synthetic_pick_a_score_score','short'),
 ('hpsv2_score','hpsv2_score','original'), ('hpsv2_score','synthetic_hpsv2_score','short'),
 ('vqa_score','vqa_score','original'), ('vqa_score','synthetic_vqa_score','long'),
 ('sciscore_score','sciscore_score','original'), ('sciscore_score','synthetic_sciscore_score','short'))
select key, score_name, output, caption_kind,
  case caption_kind when 'original' then original when 'long' then long else short end as caption from t cross join r"""
)
def route_scores(spark, sf):
    resolved = resolve_captions(view(spark, sf, "samples_v"), view(spark, sf, "captions_v"))
    return route(resolved.select("key", "original", "long", "short"))




def _stages(spark, sf):
    """Stage 1: keys with a low draw, six scores. Stage 2: keys with a high draw, vqa and a new clip score."""
    s = view(spark, sf, "scores_v").withColumn("key", F.substring("key", 11, 2))  # repeats in every shard
    old = s.where(F.col("clip_score") < 0.8).select("shard", "key", "clip_score", "aesthetic_score")
    new = s.where(F.col("clip_score") > 0.3).select(
        "shard", "key", (F.col("clip_score") / 2).cast("float").alias("clip_score"), "vqa_score"
    )
    return old, new


@query(
    """with o as (select shard, substr(key, 11) as key, clip_score, aesthetic_score from scores_v where clip_score < 0.8::double),
n as (select shard, substr(key, 11) as key, clip_score / 2 as clip_score, vqa_score from scores_v where clip_score > 0.3::double)
select coalesce(n.shard, o.shard) as shard, coalesce(n.key, o.key) as key, round(aesthetic_score::double, 6) as aesthetic_score,
  round(case when n.key is not null then n.clip_score else o.clip_score end::double, 6) as clip_score,
  round(vqa_score::double, 6) as vqa_score from o full join n on o.key = n.key and o.shard = n.shard"""
)
def upsert_scores(spark, sf):
    out = S.upsert_scores(*_stages(spark, sf))
    return out.select("shard", "key", *[_r(F.col(c)).alias(c) for c in ("aesthetic_score", "clip_score", "vqa_score")])


@query(
    """select substr(s.key, 11) as key, shard, round(clip_score::double, 6) as clip_score from samples_v s
left join (select key, clip_score from scores_v where clip_score < 0.8::double) c on s.key = c.key"""
)
def merge_scores(spark, sf):
    old, _ = _stages(spark, sf)
    samples = view(spark, sf, "samples_v").select(F.substring("key", 11, 2).alias("key"), "shard")
    out = S.attach_scores(samples, old.select("shard", "key", "clip_score"))
    return out.select("key", "shard", _r(F.col("clip_score")).alias("clip_score"))


@query(
    """select s.key, s.source as source, coalesce(nullif(s.lang, 'en'), 'caption '||s.lang) as caption,
  round(coalesce(synthetic_clip_score::double, 2.0::double), 6) as clip_score,
  case when U(s.doc_id,'na') < 0.2 then 'n/a' else '1.5' end as vqa_score
from samples_v s join scores_v c on s.key = c.key"""
)
def merge_scores_json(spark, sf):
    """Metadata map with scores written over it: numbers, captions as text, odd values untouched."""
    s = view(spark, sf, "samples_v").join(view(spark, sf, "scores_v").select("key", "synthetic_clip_score"), "key")
    meta = F.create_map(
        F.lit("source"), F.col("source"), F.lit("clip_score"), F.lit("2.0"), F.lit("caption"), F.col("lang")
    )
    scored = s.select(
        "key",
        meta.alias("meta"),
        F.col("synthetic_clip_score").cast("double").alias("clip_score"),
        F.when(F.col("lang") == "en", F.concat(F.lit("caption "), "lang")).alias("caption"),
        F.when(hash_u("doc_id", "na") < 0.2, "n/a").otherwise("1.5").alias("vqa_score"),
    )
    merged = scored.withColumn("m", S.merge_scores_json(F.col("meta"), ["clip_score", "caption", "vqa_score"]))
    return merged.select(
        "key", F.col("m.source").alias("source"), F.col("m.caption").alias("caption"),
        _r(F.col("m.clip_score").cast("double")).alias("clip_score"), F.col("m.vqa_score").alias("vqa_score"),
    )


def _swapped_sql(p: float, seed: int) -> str:
    return ", ".join(
        f"case when U(key,'swap/{seed}') < {p}::double then coalesce(synthetic_{s}, {s}) else {s} end as {s}" for s in SCORES
    )


@query(
    f"with w as (select key, {_swapped_sql(0.5, 3)} from scores_v) select key, "
    + ", ".join(f"round({s}::double, 6) as {s}" for s in SCORES)
    + " from w"
)
def swap_synthetic(spark, sf):
    out = swap(view(spark, sf, "scores_v"), 0.5, 3)
    return out.select("key", *[_r(F.col(s)).alias(s) for s in SCORES])


_ALL_LONG = " union all ".join(f"select key, '{s}' as score_name, {s} as value from w" for s in SCORES)


@query(
    f"""with n as (select count(distinct shard) as n from scores_v),
c as (select *, row_number() over (partition by shard order by U(key,'cap/5'), key) as rn from scores_v),
w as (select key, {_swapped_sql(0.5, 5)} from c, n where rn <= greatest(1, 400 // n.n + 1)),
l as (select * from ({_ALL_LONG}) where value is not null),
d as (select *, key||'/'||score_name as draw from l),
r as (select *, row_number() over (partition by score_name order by U(draw,'values/5'), key) as k from d)
select score_name, key, round(value::double, 6) as value from r where k <= 400"""
)
def gather_values_capped(spark, sf):
    out = sampling.gather_values(view(spark, sf, "scores_v"), 400, 0.5, 5)
    return out.select("score_name", "key", _r(F.col("value")).alias("value"))


@query(
    """with names as (select score_name, count(*) as n from (unpivot (select """ + ", ".join(f"{s}::double as {s}" for s in SCORES) + """ from scores_v) on columns(*) into name score_name value v)
  where v is not null group by score_name),
stored as (select list(score_name) as s from names where score_name <> 'clip_score'), asked(a) as (values """
    + ", ".join(f"([{', '.join(repr(s) for s in SCORES if keep(s))}])" for keep in (lambda s: True, lambda s: s != "clip_score", lambda s: s == SCORES[-1]))
    + """)
select array_to_string(list_sort(a), ',') as asked, len(list_filter(a, lambda x: not list_contains(s, x))) = 0 and len(list_filter(s, lambda x: not list_contains(a, x))) = 0 as ok
  from asked, stored"""
)
def bins_key_sets(spark, sf):
    """A table of all scores but one, asked for all of them, for exactly its own, and for one."""
    long = B.to_long(view(spark, sf, "scores_v"), SCORES, []).where(F.col("score_name") != "clip_score")
    bins, out = B.compute_bins(long, B.BinSpec(8)), None
    for asked in (SCORES, [s for s in SCORES if s != "clip_score"], SCORES[-1:]):
        row = B.covers(bins, asked).select(F.lit(",".join(sorted(asked))).alias("asked"), "ok")
        out = row if out is None else out.unionByName(row)
    return out


@query("select true as exact, false as partial")
def bins_cache_check(spark, sf):
    """Is a bins table usable for exactly these scores, or for two of them?"""
    bins = B.compute_bins(B.to_long(view(spark, sf, "scores_v"), SCORES, []), B.BinSpec(8))
    exact, partial = B.covers(bins, SCORES), B.covers(bins, SCORES[:2])
    return exact.select(F.col("ok").alias("exact"), partial.scalar().alias("partial"))


@query(
    "select s.key, replace(coalesce(txt, ''), '<PERSON>', '') as text, "
    + ", ".join(f"synthetic_{s} is null as {s}_is_nan, round(synthetic_{s}::double, 6) as {s}_coherence" for s in SCORES)
    + " from samples_v s join scores_v c on s.key = c.key"
)
def emit_coherence(spark, sf):
    """Emitted row: caption and one coherence per score, NaN where the score is missing."""
    s = view(spark, sf, "samples_v").select("key", "txt").join(view(spark, sf, "scores_v"), "key")
    picked = s.select("key", "txt", *[F.col(f"synthetic_{n}").alias(n) for n in SCORES])
    out = emit_columns(picked, SCORES, 64)
    cols = []
    for n in SCORES:
        c = F.col(f"{n}_coherence").cast("double")
        cols += [F.isnan(c).alias(f"{n}_is_nan"), F.when(~F.isnan(c), F.round(c, 6)).alias(f"{n}_coherence")]
    return out.select("key", "text", *cols)




@query(
    "select p_partkey, "
    + ", ".join(
        f"round(case when p_partkey % 7 = {i} then p_size / 50.0::double else 1.0::double end, 6) as {s}"
        for i, s in enumerate(SCORES)
    )
    + " from part"
)
def resolve_targets(spark, sf):
    part = table(spark, sf, "part")
    name = F.get(F.lit(list(SCORES)), (F.col("p_partkey") % 7).cast("int"))
    req = part.select("p_partkey", F.create_map(name, F.col("p_size") / 50.0).alias("m"))
    out = targets.resolve_targets(req, "m")
    return out.select("p_partkey", *[F.round(s, 6).alias(s) for s in SCORES])


@query(
    "select p_partkey, case when p_partkey % 8 = 7 then 'bogus' end as unknown from part"
)
def unknown_targets(spark, sf):
    part = table(spark, sf, "part")
    name = F.get(F.lit([*SCORES, "bogus"]), (F.col("p_partkey") % 8).cast("int"))
    req = part.select("p_partkey", F.create_map(name, F.col("p_size") / 50.0).alias("m"))
    unknown = targets.unknown_keys(F.col("m"))
    return req.select("p_partkey", F.when(F.size(unknown) > 0, F.array_join(unknown, ",")).alias("unknown"))


@query("select p_partkey, least(greatest(round((p_size / 40.0::double - 0.1::double) * 64) / 64, 0), 1)::double as target from part")
def snap_targets(spark, sf):
    value = F.col("p_size") / F.lit(40.0) - F.lit(0.1)
    return table(spark, sf, "part").select("p_partkey", targets.snap(value).alias("target"))


@query(
    "with s(n) as (values " + ", ".join(f"('{s}')" for s in SCORES) + """)
select p_type, 'all' as variant, 7::bigint as n_keys, count(*) as n_parts from part group by p_type
union all select p_type, 'without_'||n, 6, count(*) from part, s group by p_type, n
union all select p_type, 'only_'||n, 1, count(*) from part, s group by p_type, n"""
)
def variant_keys(spark, sf):
    """Key sets of every model variant, requested once per part type."""
    types = table(spark, sf, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n_parts"))
    rows = types.select("p_type", "n_parts", F.inline(targets.variant_keys()))
    return rows.select("p_type", "variant", F.size("keys").cast("long").alias("n_keys"), "n_parts")


def _mask_columns(mask):
    return [F.get(mask, F.lit(i)).cast("long").alias(s) for i, s in enumerate(SCORES)]


_KEPT = [f"(case when U(key,'mask/1/{i}') < 1.0::double - 0.8::double then 1 else 0 end)" for i in range(7)]
_PICK = "floor(U(key,'mask/1/pick') * 7)::int"


@query(
    "select key, "
    + ", ".join(
        f"(case when {' + '.join(_KEPT)} > 0 then {_KEPT[i]} when {_PICK} = {i} then 1 else 0 end)::bigint as {s}"
        for i, s in enumerate(SCORES)
    )
    + " from scores_v"
)
def reward_mask_binomial(spark, sf):
    keys = view(spark, sf, "scores_v").select("key", augment.reward_mask("key", 7, "binomial", 0.8, 1).alias("m"))
    return keys.select("key", *_mask_columns(F.col("m")))


_RANKS = [
    "(" + " + ".join(
        f"(case when U(key,'mask/1/{j}') < U(key,'mask/1/{i}') then 1 else 0 end)" for j in range(7) if j != i
    ) + ")"
    for i in range(7)
]


@query(
    "select key, "
    + ", ".join(f"(case when {_RANKS[i]} >= {_PICK} then 1 else 0 end)::bigint as {s}" for i, s in enumerate(SCORES))
    + " from scores_v"
)
def reward_mask_uniform(spark, sf):
    keys = view(spark, sf, "scores_v").select("key", augment.reward_mask("key", 7, "uniform", 0.0, 1).alias("m"))
    return keys.select("key", *_mask_columns(F.col("m")))


@query("select key, " + ", ".join(f"1::bigint as {s}" for s in SCORES) + " from scores_v")
def reward_mask_none(spark, sf):
    """Without drop-out every reward of every row is kept."""
    keys = view(spark, sf, "scores_v").select("key", augment.reward_mask("key", 7, "none").alias("m"))
    return keys.select("key", *_mask_columns(F.col("m")))


@query(
    """with d as (select key, U(key,'drop/2') < 0.3::double as dropped, clip_score, vqa_score from scores_v)
select key, dropped as clip_is_nan, case when not dropped then round(clip_score::double, 6) end as clip,
  case when not dropped then round(vqa_score::double, 6) end as vqa,
  case when dropped then 0 else 2 end::bigint as token0, case when dropped then 1 else 3 end::bigint as n_mask from d"""
)
def condition_drop(spark, sf):
    s = view(spark, sf, "scores_v").select(
        "key", "clip_score", "vqa_score",
        F.array(F.lit(2), F.lit(2), F.lit(2)).alias("emb"),
        F.array(F.lit(True), F.lit(True), F.lit(True)).alias("mask"),
    )
    out = augment.condition_drop(
        s, 0.3, ["clip_score", "vqa_score"], "emb", F.array_repeat(F.lit(0), 5), "mask", seed=2
    )
    def value(c):
        return F.when(~F.isnan(c), _r(F.col(c)))
    return out.select(
        "key", F.isnan("clip_score").alias("clip_is_nan"), value("clip_score").alias("clip"), value("vqa_score").alias("vqa"),
        F.get("emb", F.lit(0)).cast("long").alias("token0"),
        F.size(F.filter("mask", lambda m: m)).cast("long").alias("n_mask"),
    )


@query(
    """select event_id, case when event_id % 3 = 0 or event_id % 7 = 0 then 0.0::double else value end as filled from events"""
)
def nonfinite_fill(spark, sf):
    e = table(spark, sf, "events")
    bad = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(
        F.col("event_id") % 7 == 0, F.lit(float("-inf"))
    )
    broken = e.select("event_id", F.coalesce(bad, F.col("value")).alias("filled"))
    return evaluate.nonfinite_fill(broken, ["filled"])


@query(
    """select 'value' as "column", count(*) filter (event_id % 3 = 0) as n_nan,
  count(*) filter (event_id % 3 <> 0 and event_id % 7 = 0) as n_inf from events"""
)
def nonfinite_report(spark, sf):
    e = table(spark, sf, "events")
    bad = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(
        F.col("event_id") % 7 == 0, F.lit(float("-inf"))
    )
    return evaluate.nonfinite_report(e.select(F.coalesce(bad, F.col("value")).alias("value")), ["value"])
