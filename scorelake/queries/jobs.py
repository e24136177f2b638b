"""Scorer jobs, sources on real files, and streams.

These queries write what they stream or flush below the session's shared folder.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from scorelake.functions.captions import clean_caption
from scorelake.functions.hashing import hash_u
from scorelake.functions.quality import passes_quality
from scorelake.operators import bins as B
from scorelake.operators import scoring_jobs as K
from scorelake.operators.scores import latest_scores
from scorelake.plans.epochs import shuffle
from scorelake.queries.fixtures import table, view
from scorelake.queries.registry import query

from scorelake.session import shared_folder
from scorelake.sources import archives, samples as samples_source
from scorelake.sources.tables import read_jsonl, read_scores_csv, write_jsonl, write_scores_csv
from scorelake.streaming import jobs, levels


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_VOWELS = " + ".join(f"(length(text) - length(replace(text, '{v}', '')))" for v in "aeiou")


@query(
    f"""select lpad(doc_id::varchar, 12, '0') as key, 'length_ratio' as score_name, round(least(length(text) / 1000.0::double, 1), 6) as value from documents
union all select lpad(doc_id::varchar, 12, '0'), 'vowel_share', round(({_VOWELS})::double / greatest(length(text), 1), 6) from documents"""
)
def apply_scorer(spark, sf):
    """Two scorers, one job each, flushed in between; the second call finds both finished."""
    docs = table(spark, sf, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("key"), "text")
    docs = docs.withColumnRenamed("source", "shard")
    store = _folder(spark, "scorers")
    K.apply_scorers(docs, "length_ratio", ["text"], store)
    out = K.apply_scorers(docs, "length_ratio,vowel_share", ["text"], store)
    return out.select("key", "score_name", F.round("value", 6).alias("value"))


def _word_encoder():
    def encode(texts: list[str]) -> list[np.ndarray]:
        words = [t.split(" ") for t in texts]
        return [np.column_stack([list(map(len, w)), np.arange(len(w))]) for w in words]

    return encode


@query(
    """with w as (select doc_id, string_split(text, ' ')[1:2048] as w from documents)
select doc_id, len(w)::bigint as n_tokens, list_sum(list_transform(w, lambda x: length(x)))::bigint as total from w"""
)
def encode_text(spark, sf):
    """A word-length encoder in place of a language model, cut to 2,048 tokens."""
    docs = table(spark, sf, "documents")
    emb = docs.select("doc_id", K.encode_text(F.col("text"), _word_encoder).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, t: a + F.get(t, F.lit(0)))
    return emb.select("doc_id", F.size("e").cast("long").alias("n_tokens"), total.cast("long").alias("total"))


@query(
    """with r as (select key, length(txt) as n, (row_number() over (order by U(key,'shuffle/1'), key) - 1) // 32 as batch from samples_v)
select batch, count(*) as n_rows, coalesce(max(n), 0)::bigint as longest from r group by batch"""
)
def collate_batches(spark, sf):
    """A user function sees one batch of 32 rows at a time."""
    rows = shuffle(view(spark, sf, "samples_v").select("key", F.length("txt").alias("n")), 1, 0)
    batched = rows.select("key", "n", F.floor(F.col("pos") / 32).alias("batch"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        longest = int(pdf["n"].max()) if pdf["n"].notna().any() else 0
        return pd.DataFrame({"batch": [pdf["batch"][0]], "n_rows": [len(pdf)], "longest": [longest]})

    return K.collate(batched, "batch", pack, "batch long, n_rows long, longest long")


@query(
    """select lang, count(*) as n, sum(length(replace(txt, '<PERSON>', '')))::bigint as chars from samples_v
where has_image and txt is not null group by lang"""
)
def transform_chain(spark, sf):
    """Named and plain steps applied in order."""
    K.NAMED_TRANSFORMS.setdefault("clean", lambda d: d.withColumn("txt", clean_caption(F.col("txt"))))
    steps = [
        lambda d: d.where(F.col("has_image") & F.col("txt").isNotNull()),
        "clean",
        lambda d: d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("txt")).alias("chars")),
    ]
    return K.transform_chain(view(spark, sf, "samples_v"), steps)


def _decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Samples from members; a tenth of the JSON members is cut short."""
    members = view(spark, sf, "members_v")
    cut = hash_u("key", "broken") < 0.1
    content = F.when((F.col("ext") == ".json") & cut, F.lit('{"width": ')).otherwise(F.col("content"))
    return samples_source.decode_json(samples_source.read_samples(members.withColumn("content", content)))


@query(
    """with r as (select key, case when U(key,'broken') < 0.1 then 'bad json' when txt is null then 'no caption'
  when not has_image then 'no image' end as reason from samples_v)
select reason, count(*) as n from r where reason is not null group by reason"""
)
def quarantine(spark, sf):
    # upper-case image extensions are not images, so these samples count as without one
    _, rejected = samples_source.quarantine(_decoded(spark, sf))
    return samples_source.rejected_counts(rejected)


@query(
    """select key, case when U(key,'broken') < 0.1 then null else width end as width, txt from samples_v"""
)
def decode_json(spark, sf):
    return _decoded(spark, sf).select("key", F.col("meta.width").alias("width"), "txt")


@query("select key, round(clip_score::double, 6) as clip_score, round(synthetic_vqa_score::double, 6) as synthetic_vqa_score from scores_v")
def scores_csv_round_trip(spark, sf):
    path = _folder(spark, "csv")
    scores = view(spark, sf, "scores_v").select("key", "clip_score", "synthetic_vqa_score")
    write_scores_csv(scores.select("key", *[F.col(c).cast("double").alias(c) for c in scores.columns[1:]]), path)
    back = read_scores_csv(spark, path)
    return back.select("key", *[F.round(c, 6).alias(c) for c in ("clip_score", "synthetic_vqa_score")])


@query("select filename, prompt, round(aesthetic, 6) as aesthetic from images_v")
def jsonl_round_trip(spark, sf):
    path = _folder(spark, "jsonl")
    write_jsonl(view(spark, sf, "images_v").select("filename", "prompt", "aesthetic"), path)
    back = read_jsonl(spark, path, "filename string, prompt string, aesthetic double")
    return back.select("filename", "prompt", F.round("aesthetic", 6).alias("aesthetic"))


# --- streams: the fixture tables are written in three slices and read as files arrive ------------


def _as_stream(df: DataFrame, key: str, batches: int = 3) -> DataFrame:
    """The rows in three writes, streamed in about `batches` micro-batches, however many files a write makes."""
    spark = df.sparkSession
    path = _folder(spark, "arriving")
    for i in range(3):
        part = df.where(F.floor(hash_u(key, "slice") * 3) == i)
        part.write.mode("append").parquet(path)
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(path)


def _finish(q) -> None:
    q.awaitTermination()


_ENRICH_KEEP = "(width is null or height is null or (width >= 256 and height >= 256 and coalesce(clip_score, 0) >= 0.2::float))"


@query(
    f"""with j as (select s.key, replace(s.txt, '<PERSON>', '') as txt, s.has_image, s.width, s.height, c.clip_score
   from samples_v s join scores_v c on s.key = c.key),
e as (select quantile_cont(v, [i / 8.0::double for i in range(9)]) as q from (select distinct clip_score::double as v from scores_v)),
f as (select list_sort(list_distinct([0.0::float, 1.0::float] || list_transform(q[2:8], lambda x: x::float))) as edges from e)
select key, txt, round((greatest(len(list_filter(edges, lambda z: z < clip_score)) - 1, 0) / 7.0::double)::float::double, 6) as clip_score_coherence
from j, f where has_image and txt is not null and {_ENRICH_KEEP}"""
)
def stream_enrich(spark, sf):
    scores = view(spark, sf, "scores_v").select("key", "clip_score")
    edges = B.load_edges(B.compute_bins(B.to_long(scores, ["clip_score"], ["key"]), B.BinSpec(8)))
    joined = view(spark, sf, "samples_v").join(scores, "key").select("key", "txt", "has_image", "width", "height", "clip_score")
    keep = passes_quality(F.col("width"), F.col("height"), F.col("clip_score"), F.lit(0.0), 256, 0.2, 0.0)
    out = _folder(spark, "enriched")
    _finish(jobs.stream_enrich(_as_stream(joined, "key"), edges, ["clip_score"], 8, keep, out, out + "-cp"))
    rows = spark.read.schema("key string, txt string, clip_score_coherence float").parquet(out)
    return rows.select("key", "txt", F.round(F.col("clip_score_coherence").cast("double"), 6).alias("clip_score_coherence"))


@query(
    """with c as (select key, replace(txt, '<PERSON>', '') as txt from samples_v where has_image and txt is not null),
s as (select key, least(length(txt) / 1000.0::double, 1) as v from c)
select key, round((greatest(len(list_filter([0.0, 0.25, 0.5, 0.75, 1.0], lambda z: z < v)) - 1, 0) / 3.0::double)::float::double, 6) as clip_score_coherence
from s where v >= 0.1::double"""
)
def stream_enrich_scored(spark, sf):
    """Samples arrive without scores; a scorer runs inside the stream, and the filter reads its result."""
    s = view(spark, sf, "samples_v").select("key", "txt", "has_image")
    add = lambda df: df.withColumn("clip_score", K.score_column("length_ratio", [F.col("txt")]))
    out, edges = _folder(spark, "scored"), {"clip_score": [0.0, 0.25, 0.5, 0.75, 1.0]}
    _finish(jobs.stream_enrich(_as_stream(s, "key"), edges, ["clip_score"], 4, F.col("clip_score") >= 0.1, out, out + "-cp", add))
    rows = spark.read.schema("key string, clip_score_coherence float").parquet(out)
    return rows.select("key", F.round(F.col("clip_score_coherence").cast("double"), 6).alias("clip_score_coherence"))


@query(
    """select key, round(clip_score::double, 6) as clip_score, round(synthetic_vqa_score::double, 6) as vqa_score from scores_v"""
)
def compact_scores(spark, sf):
    """The score log resolved once and stored."""
    s = view(spark, sf, "scores_v")
    schema = "shard string, key string, clip_score double, vqa_score double"
    empty = F.lit(None).cast("double")
    first = s.select("shard", "key", F.col("clip_score").cast("double").alias("clip_score"), empty.alias("vqa_score"))
    second = s.select("shard", "key", empty.alias("clip_score"), F.col("synthetic_vqa_score").cast("double").alias("vqa_score"))
    out = _folder(spark, "upserts")
    _finish(jobs.stream_upsert_scores(_as_stream(first.unionByName(second), "key"), out, out + "-cp"))
    table_ = jobs.compact_versions(spark, out, schema, ["clip_score", "vqa_score"], out + "-base")
    return table_.select("key", F.round("clip_score", 6).alias("clip_score"), F.round("vqa_score", 6).alias("vqa_score"))


@query(
    """select key, round(clip_score::double, 6) as clip_score, round(synthetic_vqa_score::double, 6) as vqa_score from scores_v"""
)
def stream_upsert_scores(spark, sf):
    """Stage one writes one column, a later stage the other; the log resolves to one row per key."""
    s = view(spark, sf, "scores_v")
    schema = "shard string, key string, clip_score double, vqa_score double"
    empty = F.lit(None).cast("double")
    first = s.select("shard", "key", F.col("clip_score").cast("double").alias("clip_score"), empty.alias("vqa_score"))
    second = s.select("shard", "key", empty.alias("clip_score"), F.col("synthetic_vqa_score").cast("double").alias("vqa_score"))
    out = _folder(spark, "upserts")
    # both stages arrive through one stream; replays of a batch replace its version
    _finish(jobs.stream_upsert_scores(_as_stream(first.unionByName(second), "key"), out, out + "-cp"))
    latest = latest_scores(jobs.read_versions(spark, out, schema), ["clip_score", "vqa_score"])
    return latest.select("key", F.round("clip_score", 6).alias("clip_score"), F.round("vqa_score", 6).alias("vqa_score"))


@query(
    """select key, round(clip_score::double, 6) as clip_score, round(synthetic_vqa_score::double, 6) as vqa_score from scores_v"""
)
def stream_upsert_levels(spark, sf):
    """Old scores, then new ones of either column, in micro-batches that fill and merge levels."""
    s = view(spark, sf, "scores_v")
    clip, vqa, empty = F.col("clip_score").cast("double"), F.col("synthetic_vqa_score").cast("double"), F.lit(None).cast("double")
    out, path = _folder(spark, "levels"), _folder(spark, "arriving")
    for a, b in [(clip - 1, vqa - 1), (empty, vqa), (clip, empty)]:
        rows = s.select("shard", "key", a.alias("clip_score"), b.alias("vqa_score"))
        for half in range(2):
            rows.where(F.floor(hash_u("key", "slice") * 2) == half).write.mode("append").parquet(path)
            _finish(levels.stream_upsert_levels(spark.readStream.schema(rows.schema).parquet(path), ["clip_score", "vqa_score"], out, out + "-cp", fanout=2, grace=1))
    latest = levels.read_levels(spark, rows.schema, ["clip_score", "vqa_score"], out)
    return latest.select("key", F.round("clip_score", 6).alias("clip_score"), F.round("vqa_score", 6).alias("vqa_score"))


@query(
    """with l as (select 'aesthetic' as scorer, aesthetic as v from images_v union all select 'pick_score', pick_score from images_v)
select scorer, round(avg(v), 6) as mean, round(coalesce(stddev_samp(v), 0), 6) as std, count(v) as n from l group by scorer"""
)
def stream_reward_summary(spark, sf):
    images = view(spark, sf, "images_v").select("filename", "aesthetic", "pick_score")
    out = _folder(spark, "summary")
    _finish(jobs.stream_reward_summary(_as_stream(images, "filename"), ["aesthetic", "pick_score"], out, out + "-cp"))
    got = jobs.read_summary(spark, out)
    return got.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    """with f as (select *, isnan(value) as bad, row_number() over (partition by series order by ts, event_id) as p from metrics_v),
g as (select *, p - row_number() over (partition by series order by ts, event_id) as run from f where bad),
h as (select *, row_number() over (partition by series, run order by p) as i from g)
select series, event_id from h where i = 5"""
)
def stream_nonfinite_alarm(spark, sf):
    """Metric rows arrive in time order, a third at a time."""
    m = view(spark, sf, "metrics_v")
    path = _folder(spark, "metrics")
    thirds = m.agg(F.max("ts").alias("hi"), F.min("ts").alias("lo")).first()
    step = (thirds["hi"] - thirds["lo"]) / 3
    cuts = [thirds["lo"] + step, thirds["lo"] + 2 * step]
    when = [F.col("ts") <= cuts[0], (F.col("ts") > cuts[0]) & (F.col("ts") <= cuts[1]), F.col("ts") > cuts[1]]
    out = _folder(spark, "alarms")
    for cond in when:
        m.where(cond).write.mode("append").parquet(path)
        _finish(jobs.stream_nonfinite_alarm(spark.readStream.schema(m.schema).parquet(path), out, out + "-cp"))
    return spark.read.schema("series string, event_id long").parquet(out + "/alarms").select("series", "event_id")


@query("select event_id, event_type, value from events")
def stream_dedupe_late(spark, sf):
    """Six micro-batches, old events last: each id comes out once, in time or in the table of late rows."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out, path = _folder(spark, "dedupe"), _folder(spark, "events")
    for part in (1, 3, 0, 5, 2, 4):
        e.where(F.pmod(F.xxhash64("event_id"), F.lit(6)) == part).write.mode("append").parquet(path)
        _finish(jobs.stream_dedupe(spark.readStream.schema(e.schema).parquet(path), ["event_id"], "ts", "1 hour", out, out + "-cp"))
    schema = "event_id long, event_type string, value double"
    return spark.read.schema(schema).parquet(out).select("event_id", "event_type", "value").union(
        spark.read.schema(schema).parquet(out + "_late").select("event_id", "event_type", "value")
    )


@query("select event_id, event_type, value from events")
def stream_dedupe_settled(spark, sf):
    """Six micro-batches that each repeat the one before, most rows late: after settling each id is there once."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out, path = _folder(spark, "dedupe"), _folder(spark, "events")
    slice_ = F.pmod(F.xxhash64("event_id"), F.lit(6))
    for step, parts in enumerate([(1, 3), (3, 0), (0, 5), (5, 2), (2, 4), (4, 1)]):
        e.where(slice_.isin(*parts)).write.mode("append").parquet(path)
        _finish(jobs.stream_dedupe(spark.readStream.schema(e.schema).parquet(path), ["event_id"], "ts", "1 hour", out, out + "-cp"))
        if step in (2, 5):
            jobs.settle_late(spark, e.schema, ["event_id"], "ts", out, None if step == 2 else "1 hour")
    return jobs.read_deduped(spark, e.schema, out).select("event_id", "event_type", "value")


@query("select event_id, event_type, value from events")
def stream_dedupe(spark, sf):
    """Every event arrives twice; one of each is kept."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = _folder(spark, "dedupe")
    path = _folder(spark, "events")
    e.unionByName(e).write.parquet(path)
    stream = spark.readStream.schema(e.schema).parquet(path)
    _finish(jobs.stream_dedupe(stream, ["event_id"], "ts", "1 hour", out, out + "-cp"))
    rows = spark.read.schema("event_id long, event_type string, value double").parquet(out)
    return rows.select("event_id", "event_type", "value")


@query("select key, shard, txt, width from samples_v")
def stream_archives(spark, sf):
    """Archives that arrive between two runs of the stream: each is read once, by the run that finds it."""
    folder, seen, out = (_folder(spark, n).removeprefix("file:") for n in ("arrivals", "seen", "streamed"))
    s = view(spark, sf, "samples_v").withColumns({"jpg": F.lit(b"x"), "json": F.to_json(F.struct("width"))})
    first = F.crc32(F.col("shard").cast("binary")) % 2 == 0
    for wave in (first, ~first):
        archives.write_archives(s.where(wave), folder, {".jpg": "jpg", ".txt": "txt", ".json": "json"})
        members = archives.stream_members(spark, folder, seen, [".jpg", ".txt", ".json"])
        _finish(jobs.stream_archives(members, out, out + "-cp"))
    shard = F.element_at(F.split("shard", "-"), 1)
    return spark.read.parquet(out).select("key", shard.alias("shard"), "txt", F.col("meta.width").alias("width"))
