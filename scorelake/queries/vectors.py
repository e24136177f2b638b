"""Embedding and latent operators (H1-H12) over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import vectors as V
from scorelake.plans.requests import repeat_rows
from scorelake.queries.fixtures import table
from scorelake.queries.registry import query
from scorelake.schema import LATENT_CHANNEL_BIAS, LATENT_CHANNEL_SCALE


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


_E = "e as (select vec_id, embedding::double[] as v, label from embeddings)"
_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i]))"
_UNIT = f"{_E}, nrm as (select *, sqrt({_DOT.format(a='v', b='v')}) as n from e), " \
        "un as (select vec_id, label, list_transform(v, lambda x: x / case when n = 0 then 1 else n end) as v from nrm)"


@query(f"with {_UNIT} select vec_id, i - 1 as pos, round(v[i], 6) as x from un, range(1, 65) t(i)")
def l2_normalise(spark, sf):
    out = _emb(spark, sf).select("vec_id", F.posexplode(V.l2_normalise(F.col("v"))).alias("pos", "x"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(
    f"""with {_UNIT} select a.vec_id, round(100 * {_DOT.format(a='a.v', b='b.v')} / 100, 6) as similarity
from un a join un b on b.vec_id = a.vec_id + 1"""
)
def paired_similarity(spark, sf):
    """Image i against its own text only: an equi-join of two embedding tables on the key."""
    e = _emb(spark, sf)
    text = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("t"))
    joined = e.join(text, "vec_id")
    score = V.paired_similarity(F.col("v"), F.col("t"), 100.0) / 100
    return joined.select("vec_id", F.round(score, 6).alias("similarity"))


_WEIGHTS = [((i * 37) % 64 - 32) / 64 for i in range(64)]


@query(
    f"with {_E}, w as (select [{', '.join(f'{x!r}::double' for x in _WEIGHTS)}] as w) "
    f"select vec_id, round({_DOT.format(a='v', b='w')} + 0.25::double, 6) as score from e, w"
)
def affine_head(spark, sf):
    e = _emb(spark, sf)
    return e.select("vec_id", F.round(V.affine_head(F.col("v"), _WEIGHTS, 0.25), 6).alias("score"))


# ragged token lists: the word lengths of every whole text
_TOKENS = "tk as (select doc_id, list_transform(string_split(text, ' '), lambda x: length(x)::double) as t from documents)"


def _tokens(spark, sf):
    words = F.transform(F.split("text", " "), lambda x: F.length(x).cast("double"))
    return table(spark, sf, "documents").select("doc_id", words.alias("t"))


def _sum(tokens):
    return F.aggregate(tokens, F.lit(0.0), lambda a, x: a + x)


@query(
    f"""with {_TOKENS}, lengths as (select 256::bigint as width union select max(len(t)) from tk)
select doc_id, width, least(len(t), width)::bigint as n_true, list_sum(t[1:width]) as total from tk, lengths"""
)
def pad_mask(spark, sf):
    """Padded to the usual length, which cuts long lists, and to the longest list, which cuts none."""
    t = _tokens(spark, sf)
    out = None
    for width in {256, t.agg(F.max(F.size("t"))).first()[0]}:
        padded, mask = V.pad(F.col("t"), width, F.lit(0.0)), V.pad_mask(F.col("t"), width)
        true = (F.size(mask) - F.size(F.array_remove(mask, F.lit(True)))).cast("long")
        # zeros add nothing; most of a row padded to the longest list is zeros
        total = _sum(F.array_remove(padded, F.lit(0.0)))
        rows = t.select("doc_id", F.size(padded).cast("long").alias("width"), true.alias("n_true"), total.alias("total"))
        out = rows if out is None else out.union(rows)
    return out


@query(
    f"""with {_TOKENS}, lengths as (select 256::bigint as width union select max(len(t)) from tk)
select doc_id, width, least(len(t), width)::bigint as n, list_sum(t[1:width]) as total from tk, lengths"""
)
def trim_to_mask(spark, sf):
    """Lists padded to the usual length and to the longest list, trimmed to what the mask marks."""
    t = _tokens(spark, sf)
    out = None
    for width in {256, t.agg(F.max(F.size("t"))).first()[0]}:
        padded, mask = V.pad(F.col("t"), width, F.lit(0.0)), V.pad_mask(F.col("t"), width)
        trimmed = t.select("doc_id", F.lit(width).cast("long").alias("width"), V.trim_to_mask(padded, mask).alias("t"))
        rows = trimmed.select("doc_id", "width", F.size("t").cast("long").alias("n"), _sum(F.col("t")).alias("total"))
        out = rows if out is None else out.union(rows)
    return out


def _latent(spark, sf):
    """The vector as 4 channels of 16."""
    channels = F.array(*[F.slice("v", F.lit(16 * c + 1), F.lit(16)) for c in range(4)])
    return _emb(spark, sf).select("vec_id", channels.alias("latent"))


_SC = "[" + ", ".join(f"{0.5 / s!r}::double" for s in LATENT_CHANNEL_SCALE) + "]"
_SH = "[" + ", ".join(f"{-b * (0.5 / s)!r}::double" for b, s in zip(LATENT_CHANNEL_BIAS, LATENT_CHANNEL_SCALE)) + "]"


@query(
    f"""with {_E}, c as (select {_SC} as s, {_SH} as b)
select vec_id, (i - 1) // 16 as channel, (i - 1) % 16 as pos, round(v[i] * s[(i - 1) // 16 + 1] + b[(i - 1) // 16 + 1], 6) as x,
  round(v[i], 6) as back from e, c, range(1, 65) t(i)"""
)
def latent_normalise(spark, sf):
    z = _latent(spark, sf).withColumn("z", V.latent_normalise(F.col("latent")))
    z = z.withColumn("back", V.latent_denormalise(F.col("z")))
    channel = z.select("vec_id", F.posexplode(F.arrays_zip("z", "back")).alias("channel", "p"))
    cell = channel.select("vec_id", "channel", F.posexplode(F.arrays_zip(F.col("p.z").alias("x"), F.col("p.back").alias("back"))).alias("pos", "q"))
    return cell.select(
        "vec_id", F.col("channel").cast("long").alias("channel"), F.col("pos").cast("long").alias("pos"),
        F.round("q.x", 6).alias("x"), F.round("q.back", 6).alias("back"),
    )


@query(
    f"""with {_E}, c as (select vec_id, i - 1 as pos, v[i] as m, vec_id||'#'||(i - 1) as el from e, range(1, 65) t(i))
select vec_id, pos, round(m + abs(m) * sqrt(-2.0::double * ln(1.0::double - U(el,'latent/r'))) * cos(6.283185307179586::double * U(el,'latent/a')), 6) as x
from c"""
)
def latent_sample(spark, sf):
    """Seeded normal draws around the vector, with its absolute value as deviation."""
    e = _emb(spark, sf)
    std = F.transform("v", lambda x: F.abs(x))
    drawn = e.select("vec_id", V.latent_sample(F.col("v"), std, "vec_id", "latent").alias("z"))
    out = drawn.select("vec_id", F.posexplode("z").alias("pos", "x"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(
    f"with {_E} select vec_id, i - 1 as pos, floor(least(greatest(v[i] * 5 * 0.5::double + 0.5::double, 0), 1) * 255)::bigint as px from e, range(1, 65) t(i)"
)
def to_uint8(spark, sf):
    px = F.transform("v", lambda x: V.to_uint8(x * 5))
    out = _emb(spark, sf).select("vec_id", F.posexplode(px).alias("pos", "px"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("px").cast("long").alias("px"))


@query("select vec_id, label, n as sample from embeddings, range(3) t(n)")
def repeat_rows_n(spark, sf):
    out = repeat_rows(table(spark, sf, "embeddings").select("vec_id", "label"), 3)
    return out.select("vec_id", "label", F.col("sample").cast("long").alias("sample"))


@query(f"with {_E} select vec_id, i - 1 as pos, round(v[i], 6) as x from e, range(1, 65) t(i)")
def unpad_rows(spark, sf):
    """A batch column split to rows."""
    out = _emb(spark, sf).select("vec_id", F.posexplode("v").alias("pos", "x"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(
    """with l as (select event_id, 1.0::double - event_id % 100 / 99.0::double as v from events)
select event_id, round(greatest(v * 3.0::double / (v * 2.0::double + 1.0::double), 1e-9::double), 6) as gamma from l"""
)
def schedule_shifted(spark, sf):
    """The schedule bent upwards: odds three times those of the straight line."""
    t = F.col("event_id") % 100 / F.lit(99.0)
    return table(spark, sf, "events").select("event_id", F.round(V.linear_schedule(t, shift=3.0), 6).alias("gamma"))


@query(
    """select event_id, round(greatest((0.0::double - 1.0::double) * (event_id % 100 / 99.0::double) + 1.0::double, 1e-9::double), 6) as gamma,
  case when event_id % 5 = 0 then 0 else value end as value from events"""
)
def schedule_and_nan(spark, sf):
    """Linear schedule of a request time, and NaN read as zero."""
    e = table(spark, sf, "events")
    t = F.col("event_id") % 100 / F.lit(99.0)
    value = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return e.select("event_id", F.round(V.linear_schedule(t), 6).alias("gamma"), V.nan_to_zero(value).alias("value"))
