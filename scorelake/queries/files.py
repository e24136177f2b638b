"""Sources and sinks on real files that Spark writes from the driver's tables."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from scorelake.functions.hashing import hash_u
from scorelake.functions.vectors import pad, pad_mask
from scorelake.operators import bins as B
from scorelake.operators import sampling, shards
from scorelake.operators import scoring_jobs as K
from scorelake.operators.ranks import ordered_index
from scorelake.plans import preparation
from scorelake.queries.fixtures import table, view
from scorelake.queries.registry import query
from scorelake.schema import AFFINE, SCORES, SYNTHETIC
from scorelake.session import shared_folder
from scorelake.sources import archives, samples as S, stores, tables


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/').removeprefix('file:')}/{name}-{uuid.uuid4().hex}"


def _archived(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """The sample corpus as archives: image bytes, caption and JSON members."""
    s = view(spark, sf, "samples_v").withColumns(
        {
            "jpg": F.when(F.col("has_image"), F.encode(F.concat(F.lit("image "), "key"), "utf-8")),
            "json": F.to_json(F.struct("width", "height")),
        }
    )
    folder = _folder(spark, "archives")
    return folder, archives.write_archives(s, folder, {".jpg": "jpg", ".txt": "txt", ".json": "json"})


@query("select key, shard, txt, has_image, width from samples_v")
def archive_round_trip(spark, sf):
    """Written as archives, read back by member in small splits, grouped and decoded."""
    folder, _ = _archived(spark, sf)
    members = archives.read_members(spark, folder, [".jpg", ".txt", ".json"], split_bytes=1 << 20)
    decoded = S.decode_json(S.read_samples(members))
    shard = F.element_at(F.split("shard", "-"), 1)
    return decoded.select("key", shard.alias("shard"), "txt", "has_image", F.col("meta.width").alias("width"))


@query("select case when U(doc_id,'root') < 0.5 then '0' else '1' end as root, shard, substr(key, 11) as key, txt from samples_v")
def archive_two_roots(spark, sf):
    """Two roots that use the same archive names and keys: every sample comes back, under its root."""
    root = F.when(hash_u("doc_id", "root") < 0.5, "a").otherwise("b")
    s = view(spark, sf, "samples_v").withColumns({"key": F.substring("key", 11, 2), "root": root, "jpg": F.lit("x")})
    base = _folder(spark, "roots")
    for name in ("a", "b"):
        archives.write_archives(s.where(F.col("root") == name), f"{base}/{name}", {".txt": "txt", ".jpg": "jpg"})
    back = S.read_samples(archives.read_members(spark, f"{base}/a {base}/b", [".txt", ".jpg"]))
    place = F.split("shard", "[/-]")
    return back.select(F.get(place, F.lit(0)).alias("root"), F.get(place, F.lit(1)).alias("shard"), "key", "txt")


@query("select shard, key || ext as member, count(*) over (partition by shard) as members from (select shard, key, unnest(['.json', '.txt']) as ext, txt from samples_v) where ext = '.json' or txt is not null")
def archive_offsets(spark, sf):
    """Slices of a stored offset table: every member once, numbered through its archive."""
    folder, offsets = _folder(spark, "saved"), _folder(spark, "offsets")
    s = view(spark, sf, "samples_v").withColumn("json", F.to_json(F.struct("width", "height")))
    archives.save_archives(s, folder, {".txt": "txt", ".json": "json"})
    archives.member_offsets(spark, folder, split_bytes=64 << 10).write.parquet(offsets)
    members = archives.read_members(spark, folder, offsets=spark.read.parquet(offsets)).where("error is null")
    last = members.groupBy("shard").agg((F.max("member_idx") + 1).alias("members"), F.count_distinct("member_idx").alias("n")).where("members = n")
    return members.join(last, "shard").select("shard", "member", "members")


@query("select shard, key, txt from samples_v where txt is not null")
def archive_committed(spark, sf):
    """One archive per shard, shown by the commit; the second job takes the place of the first."""
    folder = _folder(spark, "committed")
    s = view(spark, sf, "samples_v")
    archives.save_archives(s.withColumn("txt", F.lit("old")), folder, {".txt": "txt"})
    archives.save_archives(s, folder, {".txt": "txt"}, overwrite=True)
    members = archives.read_members(spark, folder)
    return members.select("shard", F.regexp_extract("member", r"^(.*)\.txt$", 1).alias("key"), F.decode("content", "utf-8").alias("txt"))


@query("select shard, count(*) as nsamples from samples_v group by shard")
def archive_index(spark, sf):
    """Shard index from member names only: no member's bytes are read."""
    folder, _ = _archived(spark, sf)
    names, store = archives.read_members(spark, folder, names_only=True), _folder(spark, "index")
    stores.load_or_build_index(names, store)
    # the second call finds the stored index
    counts = stores.load_or_build_index(names.limit(0), store).withColumn("shard", F.element_at(F.split("shard", "-"), 1))
    return counts.groupBy("shard").agg(F.sum("nsamples").alias("nsamples"))


@query("select key, true as has_json, has_image, txt is not null as has_txt from samples_v")
def select_fields(spark, sf):
    """Only the JSON bytes are kept; image and caption survive as flags."""
    folder, _ = _archived(spark, sf)
    grouped = shards.group_members(archives.read_members(spark, folder), [".json"], [".jpg", ".txt"])
    return grouped.select(
        "key", F.col("json").isNotNull().alias("has_json"), F.col("has_jpg").alias("has_image"),
        F.col("has_txt"),
    )


@query("select shard, true as ok from samples_v group by shard")
def archive_digests(spark, sf):
    """Archive checksums, streamed piece by piece, agree with those of the whole files read at once."""
    folder, index = _archived(spark, sf)
    name = F.regexp_extract("url", r"([^/]+)\.tar$", 1)
    counted = index.select(name.alias("shard"), "nsamples")
    actual = archives.shard_digests(spark, folder).join(shards.shard_table(archives.read_members(spark, folder, names_only=True)), "shard")
    files = spark.read.format("binaryFile").load(folder + "/*.tar").select(F.regexp_extract("path", r"([^/]+)\.tar$", 1).alias("shard"), F.md5("content").alias("md5"))
    checked = shards.verify_shards(actual, files.join(counted, "shard"))
    return checked.groupBy(F.element_at(F.split("shard", "-"), 1).alias("shard")).agg(F.bool_and("ok").alias("ok"))


@query(
    """with s as (select shard, crc32_of % 4 as r from (select distinct shard, ('0x' || substr(md5(shard), 1, 7))::bigint as crc32_of from samples_v))
select shard, case r when 0 then 'md5' when 1 then 'nsamples' when 2 then 'unexpected' else 'none' end as problem from s
union all select 'absent', 'missing'"""
)
def archive_tampered(spark, sf):
    """Expected digests of which some have another checksum or count, some are absent, and one names no archive."""
    folder, _ = _archived(spark, sf)
    counts = shards.shard_table(archives.read_members(spark, folder, names_only=True))
    actual = archives.shard_digests(spark, folder).join(counts, "shard")
    name = F.element_at(F.split("shard", "-"), 1)
    r = F.conv(F.substring(F.md5(name.cast("binary")), 1, 7), 16, 10).cast("long") % 4
    expected = actual.select("shard", F.when(r == 0, F.reverse("md5")).otherwise(F.col("md5")).alias("md5"), (F.col("nsamples") + (r == 1).cast("long")).alias("nsamples"), r.alias("r"))
    expected = expected.where("r <> 2").drop("r").unionByName(spark.createDataFrame([("absent", "0", 1)], "shard string, md5 string, nsamples long"))
    checked = shards.verify_shards(actual, expected)
    return checked.select(name.alias("shard"), F.coalesce("problem", F.lit("none")).alias("problem")).distinct()


@query("select substr(file_name, 1, 12) as stem, short_caption, long_caption from captions_v")
def captions_tsv(spark, sf):
    path = _folder(spark, "captions")
    caps = view(spark, sf, "captions_v").select("file_name", "short_caption", "long_caption")
    # a fourth column in between, and captions with line breaks; small splits, so that many begin inside a cell
    wide = caps.select("file_name", "short_caption", F.lit("a \"b\"\n\tc").alias("middle"), "long_caption")
    wide.write.option("sep", "\t").option("escape", '"').option("quoteAll", "true").csv(path)
    return tables.read_captions_tsv(spark, path, split_bytes=128 << 10).select("stem", "short_caption", "long_caption")


@query("select lpad(item_id::varchar, 12, '0') as key, text as caption, 1.0::double as clip_score_coherence, 1.0::double as vqa_score_coherence from benchmark")
def metadata_csv(spark, sf):
    path = _folder(spark, "metadata")
    rows = table(spark, sf, "benchmark").select(F.lpad(F.col("item_id").cast("string"), 12, "0").alias("key"), F.col("text").alias("caption"))
    rows.write.option("header", "true").option("escape", '"').csv(path)
    back = tables.read_metadata_csv(spark, path)
    return back.select("key", "caption", "clip_score_coherence", "vqa_score_coherence")


def _prompt_folders(spark: SparkSession, sf: str) -> str:
    """`NNNNN/samples/NNNN.png` per conversation turn, written by the tasks."""
    root = _folder(spark, "images")

    def write(batches):
        for pdf in batches:
            for conv, turns in pdf.groupby("conv_id")["turn"]:
                folder = Path(root) / f"{conv:05d}"
                (folder / "samples").mkdir(parents=True, exist_ok=True)
                (folder / "metadata.jsonl").write_text(f'{{"prompt": "prompt {conv}"}}\n')
                for turn in turns:
                    (folder / "samples" / f"{turn:04d}.png").write_bytes(b"x")
            yield pdf.iloc[:0]

    rows = table(spark, sf, "conversations").select("conv_id", "turn")
    rows.mapInPandas(write, rows.schema).count()
    return root


_TAIL = r"(\d+/samples/[^/]+)$"


@query("select lpad(conv_id::varchar, 5, '0')||'/samples/'||lpad(turn::varchar, 4, '0')||'.png' as filename, 'prompt '||conv_id as prompt from conversations")
def discover_images(spark, sf):
    found = tables.discover_images(spark, _prompt_folders(spark, sf))
    return found.select(F.regexp_extract("filename", _TAIL, 1).alias("filename"), "prompt")


@query(
    """select lpad(conv_id::varchar, 5, '0')||'/samples/'||lpad(turn::varchar, 4, '0')||'.png' as filename,
  '{"prompt": "prompt '||conv_id||'"}' as metadata from conversations"""
)
def discover_images_strict(spark, sf):
    found = tables.discover_images_strict(spark, _prompt_folders(spark, sf))
    return found.select(F.regexp_extract("filename", _TAIL, 1).alias("filename"), "metadata")


@query(
    """with j as (select s.key, s.shard, c.clip_score, U(s.doc_id,'nan') < 0.1 as bad, U(s.doc_id,'nojson') >= 0.1 as has, s.width, s.height, s.doc_id
  from samples_v s join scores_v c on s.key = c.key)
select key, shard, case when not bad then round(clip_score::double, 6) end as clip_score, case when has then width end as width,
  case when has then doc_id end as nested, 2::bigint as n_tokens
from j where not has or width is null or (width >= 256 and height >= 256)"""
)
def enriched_round_trip(spark, sf):
    """Scores merged into the metadata JSON, embeddings trimmed to their mask, one folder per shard."""
    tokens = F.array(F.lit(1.0), F.lit(2.0))
    s = S.decode_json(_enriched_input(spark, sf)).select(
        "key", "shard", "txt", "json", "other",
        pad(tokens, 8, F.lit(0.0)).alias("emb"), pad_mask(tokens, 8).alias("mask"),
    )
    bad = F.when(hash_u("doc_id", "nan") < 0.1, F.lit(float("nan"))).otherwise(F.col("clip_score").cast("double"))
    scores = view(spark, sf, "scores_v").select("shard", "key", bad.alias("clip_score"))
    path = _folder(spark, "enriched")
    stores.write_enriched(s, scores, ["clip_score"], path, [("emb", "mask")])
    back = spark.read.schema("key string, emb array<double>, json string, shard string").parquet(path)
    decoded = S.decode_json(back)
    kept = decoded.where(S.quality_of(decoded, 256, 0.0, 0.0))
    number = F.col("meta.clip_score")
    return kept.select(
        "key", "shard", F.when(~F.isnan(number), F.round(number, 6)).alias("clip_score"), F.col("meta.width").alias("width"),
        F.get_json_object("json", "$.tags[1].n").cast("long").alias("nested"), F.size("emb").cast("long").alias("n_tokens"),
    )


def _enriched_input(spark: SparkSession, sf: str) -> DataFrame:
    """Samples whose JSON holds sizes as floats, a nested field, or is missing."""
    tags = F.array(F.struct(F.lit(1).alias("n")), F.struct(F.col("doc_id").alias("n")))
    size = lambda c: F.col(c).cast("double").alias(c)
    json = F.when(hash_u("doc_id", "nojson") >= 0.1, F.to_json(F.struct(size("width"), size("height"), tags.alias("tags"))))
    return view(spark, sf, "samples_v").withColumn("json", json)


@query(" union all ".join(f"select '{s}' as score_name, true as same" for s in SCORES))
def bins_store(spark, sf):
    """Edges computed and stored, then read back under the same configuration."""
    names = SCORES
    long = B.to_long(view(spark, sf, "scores_v"), names, ["key"])
    config, root = B.BinsConfig(B.BinSpec(16), names), _folder(spark, "bins")
    first = B.load_or_compute_bins(long, config, root).select("score_name", F.col("edges").alias("e1"))
    again = B.load_or_compute_bins(long.limit(0), config, root).select("score_name", F.col("edges").alias("e2"))
    return first.join(again, "score_name").select("score_name", (F.col("e1") == F.col("e2")).alias("same"))


@query("select source, count(*) filter (width is null or (width >= 256 and height >= 256)) as n from samples_v group by source")
def size_store(spark, sf):
    """Filtered sizes per source, counted in one job, stored, and read from the store."""
    store, key = _folder(spark, "sizes"), stores.SizeKey(256, 0.0, 0.0)
    keep = F.col("width").isNull() | ((F.col("width") >= 256) & (F.col("height") >= 256))
    counted = view(spark, sf, "samples_v").groupBy("source").agg(F.count_if(keep).alias("n"))
    stores.store_sizes(counted.select(F.col("source").alias("root"), F.col("n").alias("total_size")), store, key)
    return stores.read_sizes(spark, store, key).select(F.col("root").alias("source"), F.col("total_size").alias("n"))


@query(
    "select '{0}' as score_name, round(min(clip_score)::double, 6) as lo, round(max(clip_score)::double, 6) as hi, count(distinct clip_score) as n_distinct from scores_v".format("clip_score")
    + "".join(
        f" union all select '{s}', round(min({s})::double, 6), round(max({s})::double, 6), count(distinct {s}) from scores_v" for s in SCORES[1:]
    )
)
def value_ranges(spark, sf):
    """Smallest and largest value and distinct count per score."""
    values = B.distinct_values(B.to_long(view(spark, sf, "scores_v"), SCORES, []))
    return values.groupBy("score_name").agg(
        F.round(F.min("value").cast("double"), 6).alias("lo"), F.round(F.max("value").cast("double"), 6).alias("hi"),
        F.count(F.lit(1)).alias("n_distinct"),
    )


@query(
    """with e as (select *, (row_number() over (order by vec_id) - 1) // 32 as batch, (row_number() over (order by vec_id) - 1) % 32 as slot from embeddings)
select batch, slot, vec_id, label::bigint as label from e"""
)
def rebatch(spark, sf):
    """Rows packed to batches of columns, then split to rows again."""
    rows = ordered_index(table(spark, sf, "embeddings").select("vec_id", "label"), ["vec_id"])
    packed = rows.groupBy(F.floor(F.col("idx") / 32).alias("batch")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "vec_id", "label"))).alias("b")
    )
    columns = packed.select("batch", F.col("b.vec_id").alias("vec_id"), F.col("b.label").alias("label"))
    split = columns.select("batch", F.posexplode(F.arrays_zip("vec_id", "label")).alias("slot", "z"))
    return split.select("batch", F.col("slot").cast("long").alias("slot"), "z.vec_id", F.col("z.label").cast("long").alias("label"))


@query(
    """select source, min(doc_id) as first_seen, row_number() over (order by min(doc_id)) - 1 as place from documents group by source"""
)
def ordered_sources(spark, sf):
    """Distinct sources in first-seen order."""
    firsts = table(spark, sf, "documents").groupBy("source").agg(F.min("doc_id").alias("first_seen"))
    return ordered_index(firsts, ["first_seen"], "place")


@query(
    "with c as (select key, least(length(replace(txt, '<PERSON>', '')) / 1000.0::double, 1) * (1 + right(key, 1)::int) / 10.0::double as v"
    " from samples_v where has_image and txt is not null) select key, "
    + ", ".join(f"round((v + {AFFINE[s][0]}::double) / {AFFINE[s][1]}::double, 6) as {p}{s}" for p in ("", "synthetic_") for s in SCORES)
    + " from c"
)
def preparation_job(spark, sf):
    """Archives to scores: read, decode, resolve captions, score images with all seven scorers, normalise."""
    folder, _ = _archived(spark, sf)
    members = archives.read_members(spark, folder, [".jpg", ".txt", ".json"])
    good, _ = S.quarantine(S.decode_json(S.read_samples(members, [".jpg"])))
    captioned = preparation.with_captions(good, None)
    scores = preparation.score_samples(captioned, {s: "image_and_length" for s in SCORES}, K.Switches(), "jpg")
    names = SCORES + SYNTHETIC
    return scores.select("key", *[F.round(n, 6).alias(n) for n in names])


@query(
    "select source, count(*) as n_raw,"
    " floor((select count(*) from samples_v where width is null or width >= 256)"
    " * count(*)::double / (select count(*) from samples_v))::bigint as estimate from samples_v group by source"
)
def estimate_per_root(spark, sf):
    """The whole estimate shared out by raw rows of each source."""
    s = view(spark, sf, "samples_v")
    keep = F.col("width").isNull() | (F.col("width") >= 256)
    whole = s.agg(F.count(F.lit(1)).alias("total"), F.count_if(keep).alias("estimate"))
    roots = s.groupBy(F.col("source").alias("root")).agg(F.count(F.lit(1)).alias("n_raw"))
    out = sampling.estimate_per_root(whole, roots)
    return out.select(F.col("root").alias("source"), "n_raw", "estimate")
